"""Answers of a remote service, each asked for once.

With a log, every answered batch is a file of its own, moved into place when it is whole, below the folder of its range.
Keys fall into ranges by hash, and one task has all rows of a range, sorted; so a task that is run again, and a run that
is resumed with more rows, reads the files of the ranges it touches and asks only for rows that none of them has. The
log is the result's store as well: :func:`logged` reads it as a table.
"""

from __future__ import annotations

import hashlib
import json
import random
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .remote import file_system

#: Ranges of keys in a log; a task holds the answers of one. They are part of the log: a run that resumes it uses the same.
RANGES = 256
ANSWER = "id string, variant string, label string"


def asked(ask: Callable[[list[dict]], list[dict]], rows: list[dict], attempts: int, sleep: Callable[[float], None]) -> list[dict]:
    """The answers to one batch. A failed call is made again after min(60, 2 ** attempt + a random part of a second)
    seconds, so tasks that failed together do not come back together."""
    for attempt in range(attempts):
        try:
            return ask(rows)
        except (OSError, ValueError):
            if attempt + 1 == attempts:
                raise
            sleep(min(60, 2**attempt + random.random()))
    return []


def _stored(folder: str) -> list[dict]:
    from pyarrow import fs

    system, inside = file_system(folder)
    found = []
    for info in system.get_file_info(fs.FileSelector(inside, allow_not_found=True)):
        if info.base_name.startswith("batch-"):
            with system.open_input_stream(info.path) as file:
                found += [json.loads(line) for line in file.read().decode().splitlines()]
    return found


def _store(folder: str, rows: list[dict], answers: list[dict]) -> None:
    """One file, seen whole or not at all. Rows of the batch that were left without an answer are stored as such."""
    known = {(a["id"], a["variant"]): a for a in answers}
    kept = [known.get((r["id"], r["variant"]), {"id": r["id"], "variant": r["variant"], "label": None}) for r in rows]
    kept += [a for key, a in known.items() if key not in {(r["id"], r["variant"]) for r in rows}]
    lines = "\n".join(json.dumps({k: a.get(k) for k in ("id", "variant", "label")}, ensure_ascii=False) for a in kept)
    name = hashlib.sha256(json.dumps([(r["id"], r["variant"]) for r in rows]).encode()).hexdigest()[:32]
    system, inside = file_system(folder)
    system.create_dir(inside, recursive=True)
    with system.open_output_stream(aside := f"{inside}/_writing-{uuid.uuid4().hex}") as file:
        file.write(lines.encode())
    system.move(aside, f"{inside}/batch-{name}.jsonl")


def answered_by(df: DataFrame, client: Callable[[], Callable[[list[dict]], list[dict]]], *, batch: int = 10, attempts: int = 8, pause: float = 1.0, wait=None,
                log: str | None = None, ranges: int = RANGES) -> DataFrame:
    """(id, variant, label) answers for (id, variant, text). ``client`` makes, once a task, the function that asks; ``pause``
    seconds pass between batches, and ``wait`` replaces sleeping. Answers are matched by id and variant; with a ``log``,
    a folder that all executors see, what it holds is not asked for again."""
    sleep = wait or time.sleep

    def plain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask, before = client(), False
        for pdf in batches:
            rows = pdf[["id", "variant", "text"]].to_dict("records")
            for a in range(0, len(rows), batch):
                if before:
                    sleep(pause)
                before = True
                yield pd.DataFrame(asked(ask, rows[a:a + batch], attempts, sleep), columns=["id", "variant", "label"])

    if log is None:
        return df.mapInPandas(plain, ANSWER)

    def durable(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask, before, now, todo, held = None, False, None, [], {}

        def commit(rows: list[dict]) -> pd.DataFrame:
            nonlocal ask, before
            ask = ask or client()
            if before:
                sleep(pause)
            before = True
            answers = asked(ask, rows, attempts, sleep)
            _store(f"{log}/range={now}", rows, answers)
            return pd.DataFrame(answers, columns=["id", "variant", "label"])

        for pdf in batches:
            stored = []
            for row in pdf[["id", "variant", "text", "range"]].to_dict("records"):
                if row["range"] != now:
                    if todo:
                        yield commit(todo)
                    now, todo = row["range"], []
                    held = {(a["id"], a["variant"]): a for a in _stored(f"{log}/range={now}")}
                if (row["id"], row["variant"]) in held:
                    stored.append(held[row["id"], row["variant"]])
                    continue
                todo.append({k: row[k] for k in ("id", "variant", "text")})
                if len(todo) == batch:
                    yield commit(todo)
                    todo = []
            if stored:
                yield pd.DataFrame([a for a in stored if a["label"] is not None], columns=["id", "variant", "label"])
        if todo:
            yield commit(todo)

    place = F.pmod(F.xxhash64("id", "variant"), F.lit(ranges)).cast("int").alias("range")
    dealt = df.select("id", "variant", "text", place).repartition("range").sortWithinPartitions("range", "id", "variant")
    return dealt.mapInPandas(durable, ANSWER)


def logged(spark: SparkSession, log: str) -> DataFrame:
    """The answers that a log holds; an answer that is there twice (of two attempts at once) counts once."""
    rows = spark.read.option("pathGlobFilter", "batch-*").schema(ANSWER).json(log)
    return rows.filter("label IS NOT NULL").groupBy("id", "variant").agg(F.max("label").alias("label"))
