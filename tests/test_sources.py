"""Durable answers, sinks by range, manifests of large files, headers, ordered files."""

import hashlib
import os
import re
import subprocess
import sys
import textwrap
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from glyphward.sources import answers, files, remote
from glyphward.streaming import incremental

ROOT = str(Path(__file__).resolve().parent.parent)


def counting(folder):
    """A client that notes each row it is asked for."""

    def client():
        def ask(rows):
            with open(f"{folder}/asked-{os.getpid()}", "a") as f:
                f.writelines(f"{r['id']}\n" for r in rows)
            return [{"id": r["id"], "variant": r["variant"], "label": f"L{len(r['text'])}"} for r in rows if r["id"] != "7"]

        return ask

    return client


def asked(folder):
    return Counter(x for p in folder.glob("asked-*") for x in p.read_text().split())


def questions(spark, n):
    return spark.createDataFrame([(str(k), "v", "x" * (k % 5)) for k in range(n)], "id string, variant string, text string").repartition(3)


def test_a_resumed_run_asks_only_for_what_is_new(spark, tmp_path):
    log, notes = str(tmp_path / "log"), tmp_path / "notes"
    notes.mkdir()
    ask = lambda n: {r.id: r.label for r in answers.answered_by(questions(spark, n), counting(notes), batch=4, wait=lambda s: None, log=log, ranges=3).collect()}
    want = lambda n: {str(k): f"L{k % 5}" for k in range(n) if k != 7}
    assert ask(20) == want(20) and ask(20) == want(20) and ask(31) == want(31)
    assert asked(notes) == Counter(map(str, range(31)))
    assert {r.id: r.label for r in answers.logged(spark, log).collect()} == want(31)
    (tmp_path / "log/range=0/_writing-abc").write_text('{"id": "cut')  # what a lost executor leaves
    assert ask(31) == want(31) and asked(notes) == Counter(map(str, range(31)))


def test_a_task_that_dies_asks_for_no_batch_twice(tmp_path):
    """A worker is killed behind its third batch; Spark runs the task again in the same job."""
    code = textwrap.dedent(f"""
        import os, sys
        from pyspark.sql import SparkSession
        from pyspark import TaskContext
        from glyphward.sources import answers
        conf = {{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "1", "spark.driver.memory": "1g"}}
        spark = SparkSession.builder.master("local[2,3]").config(map=conf).getOrCreate()
        def client():
            done = []
            def ask(rows):
                if TaskContext.get().attemptNumber() == 0 and len(done) == 3:
                    os.kill(os.getpid(), 9)
                done.append(1)
                with open("{tmp_path}/asked-" + str(os.getpid()), "a") as f:
                    f.writelines(r["id"] + "\\n" for r in rows)
                return [dict(r, label="yes") for r in rows]
            return ask
        df = spark.createDataFrame([(str(k), "v", "t") for k in range(40)], "id string, variant string, text string")
        found = answers.answered_by(df, client, batch=5, wait=lambda s: None, log="{tmp_path}/log", ranges=1).collect()
        print("ROWS", len(found), len({{r.id for r in found}}))
    """)
    run = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=300)
    assert "ROWS 40 40" in run.stdout, run.stderr[-2000:]
    assert asked(tmp_path) == Counter(map(str, range(40))) and len(list(tmp_path.glob("asked-*"))) == 2


def test_a_sink_reads_the_ranges_of_a_batch(spark, tmp_path):
    schema = "id long, x string"
    rows = lambda a, b: spark.range(a, b).select("id", F.lit("x").alias("x"))
    for n, (a, b) in enumerate([(0, 50), (40, 60), (40, 60)]):
        rows(a, b).write.mode("append").parquet(f"{tmp_path}/in")
        incremental.resume_into(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check", ["id"], ranges=8).awaitTermination()
        assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(50 if n == 0 else 60))
    found = incremental.present(spark, f"{tmp_path}/out", rows(0, 1).schema, [2, 5], ["id"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*key_range.*IN \(2,5\)", plan) and 0 < found.count() < 40


@pytest.mark.parametrize("piece", [7, 4 << 20])
def test_manifest(spark, tmp_path, piece):
    for k, data in enumerate([b"", b"abc" * 100, os.urandom(5000)]):
        (tmp_path / f"d {k}%").mkdir()
        (tmp_path / f"d {k}%/f.bin").write_bytes(data)
    found = {r.path.rsplit("/", 2)[1]: (r.length, r.sha256) for r in remote.manifest(spark, str(tmp_path), piece).collect()}
    assert found == {p.name: (len(d := (p / "f.bin").read_bytes()), hashlib.sha256(d).hexdigest()) for p in tmp_path.iterdir()}


def test_manifest_of_a_file_larger_than_a_value(tmp_path):
    """2.5 GB, with a heap of 512 MB."""
    path = tmp_path / "in" / "large.bin"
    path.parent.mkdir()
    size = 5 << 29
    with open(path, "wb") as f:
        f.truncate(size - 3)
        f.seek(0, 2)
        f.write(b"end")
    code = textwrap.dedent(f"""
        from pyspark.sql import SparkSession
        from glyphward.sources import remote
        spark = SparkSession.builder.master("local[2]").config(map={{"spark.ui.enabled": "false", "spark.driver.memory": "512m"}}).getOrCreate()
        print("FOUND", remote.manifest(spark, "{path.parent}").first().sha256)
    """)
    run = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=600)
    digest = hashlib.sha256()
    zeros = bytes(1 << 24)
    for _ in range((size - 3) // len(zeros)):
        digest.update(zeros)
    digest.update(bytes((size - 3) % len(zeros)) + b"end")
    assert f"FOUND {digest.hexdigest()}" in run.stdout, run.stderr[-2000:]


def test_headers_decide_what_is_read(spark, tmp_path):
    """Three headers, an empty file, a file without the columns, one that is named to be skipped."""
    texts = {"a.csv": "system,split,score\nx,test,0.5\n", "b.csv": "﻿score,extra,system\n0.25,e,\"y, z\"\n0.75,\"a\nb\",y\n", "c.csv": "other,system\n1,w\n", "d.csv": "", "e.csv": "system,split,score\nq,test,1\n",
             "f.csv": "score,system\n", "g.csv": "system,split,score\nlate,valid,\n"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    found = files.read_tables(spark, str(tmp_path / "*.csv"), {"system": "STRING", "score": "DOUBLE", "split": "STRING"}, required=("system", "score"), skip=("e.csv",))
    assert sorted(map(tuple, found.select("system", "score", "split", "source_file").collect())) == [
        ("late", None, "valid", "g.csv"), ("x", 0.5, "test", "a.csv"), ("y", 0.75, None, "b.csv"), ("y, z", 0.25, None, "b.csv")]
    assert files.read_tables(spark, str(tmp_path / "d.csv"), {"system": "STRING"}, required=("system",)).columns == ["system", "source_file", "source_path"]


def test_one_ordered_file(spark, tmp_path):
    """Header once, then train, valid, test, each in order, from many tasks."""
    path = tmp_path / "all.csv"
    path.write_text("old")
    part = lambda name, n: spark.range(n).repartition(5).select("id", F.concat(F.lit(f'{name} "q", '), F.col("id").cast("string")).alias("text"), F.lit(None).cast("int").alias("none"))
    files.write_ordered({"train": part("train", 300), "valid": part("valid", 0), "test": part("test", 40)}, str(path), "id", parts=7)
    rows = [f'{k},"{name} ""q"", {k}",' for name, n in (("train", 300), ("test", 40)) for k in range(n)]
    assert path.read_text() == "id,text,none\n" + "".join(r + "\n" for r in rows)
    files.write_ordered({"train": part("a", 0)}, str(path), "id")
    assert path.read_text() == "id,text,none\n"
