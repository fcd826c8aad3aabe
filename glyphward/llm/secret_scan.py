"""Secret scans through a trigram inverted index.

From each rule's regular expression a Boolean trigram query is derived: literal strings that every match has to
contain become conjunctions of their trigrams, alternatives become disjunctions. A task takes its documents segment
by segment (an Arrow batch), folds ASCII case, and builds the segment's inverted index: for each trigram some query
asks for, the postings of the documents that hold it. Postings are intersected and united as the query says, and
only the candidates are verified by the regular expression. A rule without a mandatory trigram, such as a bare run
of hex digits, scans all texts. Segments are independent, so nothing is shuffled and memory is that of a segment.

Edge cases: a null text is empty and has no spans; offsets count code points; within a rule matches are leftmost
and do not overlap, and a match that fails the rule's length is dropped after it has used up its characters;
repeated rows are scanned each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``group`` is the part whose length has to reach ``least``; 0 is the whole match."""

    name: str
    pattern: str
    least: int = 1
    group: int = 0
    ignore_case: bool = False

    def flags(self) -> int:
        return re.ASCII | (re.IGNORECASE if self.ignore_case else 0)


#: The base rules.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
)
#: Public formats of keys and tokens that the base rules do not name.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:\s+[A-Za-z0-9+/]{32,76}={0,2})*(?:\s+[A-Za-z0-9+/]{1,76}={0,2})?(?:\s+-----END (?:[A-Z]+ )*PRIVATE KEY-----)"
         r"|-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:\s+[A-Za-z0-9+/]{32,76}={0,2})*"),
    Rule("github", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)

#: A query is True (no condition), ("all", parts), ("any", parts) or a trigram (bytes).
EXACT_MOST = 64


def _join(parts: list, kind: str):
    parts = list(dict.fromkeys(p for p in parts if p is not True)) if kind == "all" else list(dict.fromkeys(parts))
    if kind == "any" and any(p is True for p in parts) or not parts:
        return True
    return parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _of_string(s: str):
    data = s.encode().lower()  # bytes.lower folds A-Z only, as the index does
    return _join([data[i:i + 3] for i in range(len(data) - 2)], "all")


def _of_strings(strings: set[str]):
    return _join([_of_string(s) for s in sorted(strings)], "any")


def _walk(items) -> tuple[set[str] | None, object]:
    """(all strings the part can match, if few; the query that any match satisfies)."""
    exact: set[str] | None = {""}
    queries: list = []

    def flush() -> None:
        nonlocal exact
        if exact is not None:
            queries.append(_of_strings(exact))
        exact = None

    for op, arg in items:
        found: set[str] | None = None
        query: object = True
        if op is sre.LITERAL:
            found = {chr(arg)}
        elif op is sre.IN:
            chars = _chars(arg)
            found = chars if chars is not None and len(chars) <= 8 else None
        elif op is sre.SUBPATTERN:
            found, query = _walk(arg[3])
        elif op is sre.BRANCH:
            sides = [_walk(side) for side in arg[1]]
            if all(f is not None for f, _ in sides):
                found = set().union(*(f for f, _ in sides))
            query = _join([q for _, q in sides], "any")
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, sub = arg
            once, sub_query = _walk(sub)
            if once is not None and low == 0 and high == 1:
                found = once | {""}
            elif once is not None and low == high and low * max(map(len, once), default=0) <= 8:
                found = {""}
                for _ in range(low):
                    found = {a + b for a in found for b in once}
            elif low:
                query = sub_query
        elif op is sre.AT:
            found = {""}
        if found is not None and len(found) <= EXACT_MOST:
            if exact is not None and len(exact) * len(found) <= EXACT_MOST:
                exact = {a + b for a in exact for b in found}
            else:
                flush()
                exact = found
        else:
            flush()
            queries.append(query)
            exact = {""}
    if not queries:
        return exact, _of_strings(exact or {""})
    flush()
    return None, _join(queries, "all")


def _chars(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            out.add(chr(arg))
        elif op is sre.RANGE and arg[1] - arg[0] < 8:
            out |= {chr(c) for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out


def trigram_query(pattern: str):
    """The Boolean trigram query, over text in lower case, that every text with a match satisfies."""
    return _walk(sre_parser.parse(pattern))[1]


def trigrams(query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams, query[1]))


def _code(trigram: bytes) -> int:
    return trigram[0] << 16 | trigram[1] << 8 | trigram[2]


def segment_index(texts: list[bytes], wanted: list[int]) -> dict[int, np.ndarray]:
    """Postings of a segment: trigram code to ordinals of documents, ascending."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    data = np.frombuffer(b"\0".join(texts).lower() + b"\0", np.uint8)
    postings = {code: np.empty(0, np.int64) for code in wanted}
    if len(data) < 3 or not wanted:
        return postings
    # Only trigrams asked for are posted; their first two bytes rule out nearly all places.
    pairs = np.zeros(1 << 16, bool)
    pairs[[c >> 8 for c in wanted]] = True
    at = np.flatnonzero(pairs[data[:-2].astype(np.uint16) << 8 | data[1:-1]])
    codes = data[at].astype(np.int64) << 16 | data[at + 1].astype(np.int64) << 8 | data[at + 2]
    held = np.isin(codes, wanted)
    codes, owners = codes[held], np.searchsorted(ends, at[held], side="right")
    order = np.argsort(codes, kind="stable")
    codes, owners = codes[order], owners[order]
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else []
    for a, b in zip(starts, [*starts[1:], len(codes)]):
        postings[int(codes[a])] = np.unique(owners[a:b])
    return postings


def candidates(query, postings: dict[int, np.ndarray], documents: int) -> np.ndarray:
    if query is True:
        return np.arange(documents)
    if isinstance(query, bytes):
        return postings[_code(query)]
    parts = [candidates(q, postings, documents) for q in query[1]]
    if query[0] == "any":
        return np.unique(np.concatenate(parts))
    out = parts[0]
    for p in sorted(parts[1:], key=len):
        out = np.intersect1d(out, p, assume_unique=True)
    return out


def scan_segment(texts: list[bytes], rules) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, rule number, end)."""
    queries = [trigram_query(r.pattern) for r in rules]
    postings = segment_index(texts, sorted({_code(t) for q in queries for t in trigrams(q)}))
    spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    decoded: dict[int, str] = {}
    for k, (rule, query) in enumerate(zip(rules, queries)):
        regex = re.compile(rule.pattern, rule.flags())
        for i in candidates(query, postings, len(texts)).tolist():
            if (text := decoded.get(i)) is None:
                text = decoded[i] = texts[i].decode()
            for m in regex.finditer(text):
                a, b = m.span(rule.group)
                if b - a >= rule.least:
                    spans[i].append((m.start(), k, m.end()))
    return [sorted(s) for s in spans]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=BASE_RULES + MORE_RULES) -> DataFrame:
    """(id, spans array of (kind, start, end)) of each row, by start and then in the order of ``rules``."""
    rules = tuple(rules)
    kind = docs.schema[id_col].dataType.simpleString()
    names = [r.name for r in rules]
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _segments(whole):
                found = scan_segment([t or b"" for t in batch.column(1).to_pylist()], rules)
                rows = [[{"kind": names[k], "start": a, "end": b} for a, k, b in s] for s in found]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(span))], names=[id_col, "spans"])

    data = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("_data")
    return docs.select(F.col(f"`{id_col}`"), data).mapInArrow(run, f"`{id_col}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


#: Text of a segment at most, but for a single longer document.
SEGMENT_BYTES = 8 << 20


def _segments(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    start = held = 0
    for i, data in enumerate(batch.column(1)):
        size = data.as_buffer().size
        if held and held + size > SEGMENT_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base rules, a digest of the base spans, and all spans as text."""
    text = lambda s: F.concat_ws(",", F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
    base = [r.name for r in BASE_RULES]
    count = lambda name: F.size(F.filter("spans", lambda x: x["kind"] == name)).cast("long").alias(f"n_{name}")
    base_spans = F.filter("spans", lambda x: x["kind"].isin(base))
    return scan(docs, id_col, text_col).select(
        id_col, *[count(name) for name in base], F.sha2(text(base_spans).cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"))


