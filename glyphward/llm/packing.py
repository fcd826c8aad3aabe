"""Packing by concatenating and cutting.

Pass one tokenizes each document once and writes its ids with the document's start within its task's output: a
running sum that is fixed once it is written. One total for each task is left; their prefix sum gives every task's
global offset. Pass two adds the offset to each document's start, which places it in the endless row of tokens
without moving any document, and cuts it where fixed windows of ``length`` tokens end. Every window but the last is
full, so padding is less than one sequence for the whole corpus.

Only task totals (one row a task) come together: they are prefix-summed in one task and broadcast, 16 bytes for
each task that wrote.

Edge cases: a null or empty text is its end id alone; a text of any length is cut as often as needed; repeated rows
are packed each; a null id stays null; an empty table gives an empty result; further columns are ignored. Strings
of special tokens inside a text become those tokens, as the library has it.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import as_text, shared_dir, written

LENGTH = 2048
END_ID = 1
#: Fixed value: how byte-level BPE vocabularies of this family split text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write a byte as itself where it prints, else as the next free character from 256."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


#: The characters with the White_Space property, as a class; and runs of it that are merged elsewhere.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_SPACE = re.compile(rf"[{SPACES}]{{1000,}}")


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """The function from text to the ids that the tokenizers library gives with ``add_special_tokens=False``: strings of
    special tokens in a text are their ids. A byte-level BPE vocabulary whose ids are its merge ranks is merged by
    tiktoken, four times as fast; tiktoken's look-ahead cannot take a long run of white space, which is a piece of its
    own but for its last character before a word: such pieces are merged by tokenizers. So is any other file."""
    slow = _tokenizers_encoder(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    byte_level = model.get("type") == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel"
    added = spec.get("added_tokens", [])
    plain = not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added)
    if not (byte_level and plain and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not model.get("dropout")):
        return slow
    special = {t["content"]: t["id"] for t in added}
    to_byte = _byte_of_char()
    ranks = {bytes(to_byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    in_order = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if in_order != sorted(set(in_order)):
        return slow
    import tiktoken

    fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def between(text: str) -> list[int]:
        """Ids of a text without special tokens."""
        ids, at = [], 0
        for run in LONG_SPACE.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            ids += [*fast(text[at:run.start()]), *slow(text[run.start():end])]
            at = end
        return ids + fast(text[at:]) if ids else fast(text[at:])

    if not special:
        return between
    specials = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")

    def encode(text: str) -> list[int]:
        parts = specials.split(text)
        if len(parts) == 1:
            return between(text)
        return [i for k, part in enumerate(parts) for i in ([special[part]] if k % 2 else between(part))]

    return encode


def _tokenizers_encoder(path: str):
    held: list = []  # the file is parsed when first needed

    def encode(text: str) -> list[int]:
        if not held:
            from tokenizers import Tokenizer

            held.append(Tokenizer.from_file(path))
        return held[0].encode(text, add_special_tokens=False).ids

    return encode


#: Ids held by a task before it passes them on.
FLUSH_IDS = 2 << 20


def tokenized(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int = END_ID) -> DataFrame:
    """Written: (id, part, start, n, ids) with ids as little-endian unsigned 32-bit integers."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            start, starts, counts, held = 0, [], [], []
            for i, data in enumerate(batch.column(1)):
                ids = np.array([*encode(data.as_buffer().to_pybytes().decode()), end_id], "<u4")
                starts.append(at)
                counts.append(len(ids))
                held.append(ids.tobytes())
                at += len(ids)
                if i + 1 == batch.num_rows or at - starts[0] >= FLUSH_IDS:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(start, len(held)), pa.array([part] * len(held), pa.int32()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(held, pa.binary())],
                        names=["id", "part", "start", "n", "ids"])
                    start, starts, counts, held = i + 1, [], [], []

    rows = docs.select(F.col(f"`{id_col}`"), as_text(text_col).alias("_data"))
    return written(rows.mapInArrow(run, f"id {kind}, part int, start bigint, n bigint, ids binary"), "ids")


def pieces(batches: Iterator[pa.RecordBatch], length: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Cuts (id, n, ids, place): ``place`` is the document's start among all tokens."""
    for batch in batches:
        rows, out = [], [[] for _ in range(7)]
        for i, (n, data, place) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist())):
            ids, a = data.as_buffer(), 0
            while a < n:
                sequence, offset = divmod(place + a, length)
                b = min(n, a + length - offset)
                cut = ids.slice(4 * a, 4 * (b - a))
                for column, value in zip(out, (a, b - a, zlib.crc32(cut), n, sequence, offset, cut.to_pybytes() if with_ids else None)):
                    column.append(value)
                rows.append(i)
                a = b
        arrays = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in out[:6]), pa.array(out[6], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str | None = None, length: int = LENGTH,
         end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row for each piece: id, start and length within its document, ids_crc32, doc_tokens, the sequence and the
    offset there; with ``with_ids`` also the ids as 32-bit integers (little-endian bytes)."""
    shared_dir(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    table = tokenized(docs, id_col, text_col, tokenizer or default_tokenizer(), end_id)
    totals = table.groupBy("part").agg(F.max(F.col("start") + F.col("n")).alias("total"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    placed = table.join(F.broadcast(offsets), "part").select("id", "n", "ids", (F.col("before") + F.col("start")).alias("place"))
    columns = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
    found = placed.mapInArrow(lambda b: pieces(b, length, with_ids), f"id {kind}, {columns}")
    found = found.withColumnRenamed("id", id_col)
    return found if with_ids else found.drop("ids")
