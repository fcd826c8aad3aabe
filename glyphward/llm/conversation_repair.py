"""Conversation structure repair by cost layers.

The roles of a conversation should read ``(s?(ua)+)?``: at most one system turn, then user and assistant in turn. Its
grammar has four states, so a set of states is a bitset of four bits. For each turn, from the last one back, there is a
bitset for each increasing cost: the states from which the rest of the conversation can be repaired for at most that
cost. A turn's layers follow from those of the next one by shifts of the cost (0 to keep, 2 to change the role, 3 to
delete, 2 to insert; 1 more for a truncated turn that stays) and by table lookups on bitsets. The first layer of the
first turn that holds the start state is the cost. Going forward again, the first edit in ASCII order (D, I, K, R) that
stays within its layer is taken, which gives the least audit among the cheapest.

States are few and any state reaches any accepted end by a few insertions, so layers above the least cost of a turn
number ten at most, and only few different stacks of layers exist. Stacks are numbered when first seen, and a turn
keeps a number of two bytes.

How it is dealt out: copies (equal conversation, turn, role and text) are counted and first appearances are found by
aggregations with partial sums, so copies do not travel. A conversation's rows then reach one task sorted, first without
texts and then again with the texts of first appearances: the first round fills the layers, the second hashes texts as
they stream by. A task holds one text and three bytes for each turn, whatever a conversation's size; one conversation
is one task because its SHA-256 is of one stream.

Edge cases: a null role, text, or part of a damage key is one space; rows with a null conversation are one
conversation; null turns come first; equal turns go by role, then by the SHA-256 of the text; turns are whole numbers;
repeated rows are duplicates; a conversation without rows has zeros, an empty audit and the hash of the empty string; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Grammar: states start, after system, after user, after assistant; the state after a role of class s, u, a, other.
NEXT = ((1, 2, None, None), (None, 2, None, None), (None, None, 3, None), (None, 2, None, None))
ACCEPTED, ALL = 0b1001, 0b1111
#: The only role that can come next by insertion or change, and the state after it.
MADE = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
#: Symbols of turns: class of the role, 4 more if truncated; this one for a turn that has to go.
FORCED = 8
LEGAL = {(0, 1), (1, 2), (2, 1)}


def _sources(role: int) -> tuple[int, ...]:
    """For each bitset of states: the states that ``role`` leads into it."""
    return tuple(sum(1 << q for q in range(4) if NEXT[q][role] is not None and bits >> NEXT[q][role] & 1) for bits in range(16))


BEFORE = tuple(_sources(role) for role in range(4))
BEFORE_MADE = tuple(BEFORE[1][bits] | BEFORE[2][bits] for bits in range(16))


class Layers:
    """Stacks of layers, numbered. ``stack[k]`` has the states from which the rest costs at most k above the stack's base."""

    def __init__(self):
        self.stacks: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.steps: dict[tuple[int, int], tuple[int, int]] = {}
        self.edits: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.end, _ = self._number(self._closed(lambda k: ACCEPTED))

    @staticmethod
    def _closed(without_insertion) -> list[int]:
        layers: list[int] = []
        while not layers or layers[-1] != ALL:
            k = len(layers)
            layers.append(without_insertion(k) | (BEFORE_MADE[layers[k - INSERT]] if k >= INSERT else 0))
        return layers

    def _number(self, layers: list[int]) -> tuple[int, int]:
        """The number of the stack, and how far its first layer that is not empty is up."""
        up = next(k for k, bits in enumerate(layers) if bits)
        stack = tuple(layers[up:])
        if stack not in self.numbers:
            self.numbers[stack] = len(self.stacks)
            self.stacks.append(stack)
        return self.numbers[stack], up

    def back(self, number: int, symbol: int) -> tuple[int, int]:
        """The stack before a turn, given the one after it, and how much its base is higher."""
        if (number, symbol) not in self.steps:
            after = self.stacks[number]
            at = lambda k: after[min(k, len(after) - 1)] if k >= 0 else 0
            role, extra = symbol % 4, TRUNCATED if symbol & 4 else 0

            def layer(k: int) -> int:
                bits = at(k - DELETE)
                if symbol != FORCED:
                    bits |= BEFORE[role][at(k - KEEP - extra)] | BEFORE_MADE[at(k - REROLE - extra)]
                return bits

            self.steps[number, symbol] = self._number(self._closed(layer))
        return self.steps[number, symbol]

    def cost(self, number: int, state: int) -> int:
        return next(k for k, bits in enumerate(self.stacks[number]) if bits >> state & 1)

    def edit(self, after: int, symbol: int | None, state: int) -> tuple[str, int]:
        """The least edits at one turn, insertions before it included, and the state behind it. ``after`` is the stack
        behind the turn; no symbol stands for the end."""
        if (after, symbol, state) not in self.edits:
            here, up = (after, 0) if symbol is None else self.back(after, symbol)
            q, done = state, []
            while True:
                left, (_, made) = self.cost(here, q) + up, MADE[q]
                if symbol is None and left == 0:
                    break
                if symbol is not None and self.cost(after, q) + DELETE == left:
                    done.append("D")
                    break
                if self.cost(here, made) + up + INSERT == left:
                    done.append("I")
                    q = made
                    continue
                extra, kept = TRUNCATED if symbol & 4 else 0, NEXT[q][symbol % 4]
                if kept is not None and self.cost(after, kept) + KEEP + extra == left:
                    done.append("K")
                    q = kept
                else:
                    done.append("R")
                    q = made
                break
            self.edits[after, symbol, state] = "".join(done), q
        return self.edits[after, symbol, state]


class Conversation:
    """One conversation as its rows stream by: turns without texts, then texts of first appearances."""

    def __init__(self, key, layers: Layers, sink):
        self.key, self.layers, self.sink = key, layers, sink
        self.symbols, self.mark = bytearray(), None
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.low = self.high = self.role = self.stacks = None
        self.distinct = 0
        self.audit: list[str] = []

    def turn(self, turn, role: str, digest: bytes, n: int, what: int) -> None:
        if what < 0:  # tells that the conversation exists
            return
        if n == 0:  # the next row is the first one with its role and text
            self.mark = (turn, role, digest)
            return
        first, self.mark = self.mark == (turn, role, digest), None
        if what >= FORCED:
            self.blank += n
        else:
            self.duplicate += n - first
            self.truncated += bool(first and what & 4)
        self.symbols += (bytes([what]) if first else b"") + bytes([FORCED]) * (n - first)
        kind = what % 4
        self.illegal += (self.role is not None and (self.role, kind) not in LEGAL) + (n - 1)
        self.role = kind
        if turn is not None:
            self.distinct += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn

    def repair(self) -> None:
        """Fills the layers from the last turn back."""
        number, base = self.layers.end, 0
        self.stacks = array("H", bytes(2 * (len(self.symbols) + 1)))
        self.stacks[-1] = number
        for i in range(len(self.symbols) - 1, -1, -1):
            number, up = self.layers.back(number, self.symbols[i])
            self.stacks[i] = number
            base += up
        self.cost = base + self.layers.cost(number, 0)
        self.at = self.state = 0

    def _apply(self, symbol: int | None, role: str | None, text: str | None) -> None:
        edits, after = self.layers.edit(self.stacks[self.at + (symbol is not None)], symbol, self.state)
        self.audit.append(edits)
        for edit in edits:
            made, behind = MADE[self.state]
            if edit == "I":
                self.sink.add(self.key, made, "", edit)
                self.state = behind
            elif edit != "D":
                self.sink.add(self.key, role if edit == "K" else made, text, edit)
        self.state = after
        self.at += 1

    def text(self, role: str, text: str) -> None:
        if self.stacks is None:
            self.repair()
        while self.symbols[self.at] == FORCED:
            self._apply(FORCED, None, None)
        self._apply(self.symbols[self.at], role, text)

    def close(self) -> None:
        if self.stacks is None:
            self.repair()
        while self.at < len(self.symbols):
            self._apply(FORCED, None, None)
        self._apply(None, None, None)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        self.sink.close(self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit))


class Verdicts:
    """A row for each conversation, with the hash of its repaired turns."""

    columns = ("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    kinds = (None, *[pa.int64()] * 6, pa.string(), pa.string())

    def __init__(self):
        self.rows, self.held, self.hash = [], 0, None

    def add(self, key, role: str, text: str, edit: str) -> None:
        if self.hash is None:
            self.hash = hashlib.sha256()
        else:
            self.hash.update(b"\n")
        self.hash.update(f"{role}:{text}".encode())

    def close(self, *facts) -> None:
        self.rows.append((*facts, (self.hash or hashlib.sha256()).hexdigest()))
        self.held, self.hash = self.held + 200 + len(facts[-1]), None


class Turns:
    """A row for each repaired turn."""

    columns = ("conv", "place", "role", "text", "edit")
    kinds = (None, pa.int64(), *[pa.string()] * 3)

    def __init__(self):
        self.rows, self.held, self.place = [], 0, 0

    def add(self, key, role: str, text: str, edit: str) -> None:
        self.rows.append((key, self.place, role, text, edit))
        self.held, self.place = self.held + 100 + len(text), self.place + 1

    def close(self, *facts) -> None:
        self.place = 0


#: Bytes of results that a task holds before it passes them on.
FLUSH_BYTES = 4 << 20


def walk(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv, kind, turn, role, text, digest, n, what) to the rows of a sink."""
    layers, sink, now, key_type = Layers(), make(), None, None

    def passed_on() -> pa.RecordBatch:
        columns = zip(*sink.rows)
        arrays = [pa.array(c, kind or key_type) for c, kind in zip(columns, sink.kinds)]
        sink.rows, sink.held = [], 0
        return pa.RecordBatch.from_arrays(arrays, names=list(sink.columns))

    for batch in batches:
        key_type = batch.schema.field(0).type
        keys, kinds, turns, roles, texts, digests, ns, whats = batch.columns
        ns, whats, kinds, turns = ns.to_pylist(), whats.to_pylist(), kinds.to_pylist(), turns.to_pylist()
        for i in range(batch.num_rows):
            key = keys[i].as_py()
            if now is None or key != now.key:
                if now is not None:
                    now.close()
                now = Conversation(key, layers, sink)
            if kinds[i]:
                now.text(roles[i].as_py(), texts[i].as_py())
            else:
                now.turn(turns[i], roles[i].as_py(), digests[i].as_py(), ns[i], whats[i])
            if sink.held >= FLUSH_BYTES:
                yield passed_on()
    if now is not None:
        now.close()
    if sink.rows:
        yield passed_on()


def text_or_blank(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(" "))


def digest_of(column: str) -> Column:
    return F.unhex(F.sha2(F.col(column).cast("binary"), 256))


def turns_of(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, n): the rows as they are, n times each."""
    return df.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), text_or_blank(role).alias("role"), text_or_blank(text).alias("text"), F.lit(1).cast("long").alias("n"))


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows damaged by the checksum of their key, of twenty kinds: 0 drops a row (n is 0), 1 empties its text, 2
    removes its full stops, exclamation and question marks, 3 repeats it (n is 2), 4 makes its role user."""
    kind = F.crc32(F.concat(text_or_blank("conv"), F.lit(":"), text_or_blank("turn")).cast("binary")) % 20
    rows = turns_of(df, conv, turn, role, text).withColumn("kind", kind)
    words = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    made = {"role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role")), "text": words, "n": F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long")}
    return rows.withColumns(made).drop("kind")


def _streamed(rows: DataFrame, sink, columns: str) -> DataFrame:
    """``rows`` (conv, turn, role, text, n) dealt out by conversation and walked through."""
    key = rows.schema["conv"].dataType.simpleString()
    first = F.substring("role", 1, 1)
    kind = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    cut = ~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")
    gone = F.col("n") == 0
    digest = F.when(~gone, digest_of("text")).alias("digest")
    what = F.when(gone, -1).when(blank, kind + FORCED).when(cut, kind + 4).otherwise(kind).alias("what")
    narrow = rows.select("conv", F.when(~gone, F.col("turn")).alias("turn"), F.when(gone, "").otherwise(F.col("role")).alias("role"), digest, what, "n")
    narrow = narrow.groupBy("conv", "turn", "role", "digest", "what").agg(F.sum("n").alias("n"))
    narrow = narrow.select("conv", F.lit(0).alias("kind"), "turn", "role", F.lit(None).cast("string").alias("text"), "digest", "n", "what")
    firsts = rows.filter(~gone & ~blank).groupBy("conv", "role", "text").agg(F.max(F.col("turn").isNull()).alias("none"), F.min("turn").alias("turn"))
    firsts = firsts.select("conv", F.when(~F.col("none"), F.col("turn")).alias("turn"), "role", "text", digest_of("text").alias("digest"))
    twice = F.array(F.struct(F.lit(0).alias("kind"), F.lit(None).cast("string").alias("words")), F.struct(F.lit(1).alias("kind"), F.col("text").alias("words")))
    marks = firsts.select("conv", "turn", "role", "digest", F.inline(twice)).select("conv", "kind", "turn", "role", F.col("words").alias("text"), "digest", F.lit(0).cast("long").alias("n"), F.lit(0).alias("what"))
    order = ["conv", "kind", F.col("turn").asc_nulls_first(), "role", F.col("digest").asc_nulls_first(), "n"]
    return narrow.unionByName(marks).repartition("conv").sortWithinPartitions(*order).mapInArrow(lambda batches: walk(batches, sink), f"conv {key}, {columns}")


def repair(rows: DataFrame) -> DataFrame:
    """A row for each conversation of ``rows`` (from :func:`turns_of` or :func:`damaged`): conv, gaps, numbers of blank,
    duplicate and truncated rows and of illegal neighbours, cost, audit and the hash of the repaired turns."""
    return _streamed(rows, Verdicts, ", ".join(f"{c} {'string' if k == pa.string() else 'bigint'}" for c, k in list(zip(Verdicts.columns, Verdicts.kinds))[1:]))


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired turns: conv, place, role, text and the edit that each comes from (I, K or R)."""
    return _streamed(rows, Turns, "place bigint, role string, text string, edit string")
