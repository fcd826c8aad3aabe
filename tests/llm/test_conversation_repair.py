"""Conversation repair against plain versions: all edit scripts of short conversations, a shortest path for longer ones."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from glyphward.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]")
GRAMMAR = re.compile(r"(s?(ua)+)?")


def scripts(turns):
    """All scripts of edits of (role, forced, truncated) with at most four insertions: cost, audit, roles."""
    best = None
    choices = [["D"] if forced else ["D", "K", "Ru", "Ra"] for _, forced, _ in turns]
    spots = [c for k in range(5) for c in itertools.product(*[("", "Iu", "Ia", "IuIa", "IaIu", "IuIaIuIa")] * (len(turns) + 1)) if sum(len(x) // 2 for x in c) == k] if len(turns) < 3 else \
        list(itertools.product(*[("", "Iu", "Ia", "IaIu", "IuIa")] * (len(turns) + 1)))
    for picked in itertools.product(*choices):
        for spot in spots:
            cost, audit, roles = 0, "", ""
            for i in range(len(turns) + 1):
                for made in re.findall("I(.)", spot[i]):
                    cost, audit, roles = cost + 2, audit + "I", roles + made
                if i < len(turns):
                    edit = picked[i]
                    audit += edit[0]
                    cost += {"K": 0, "R": 2, "D": 3}[edit[0]] + (turns[i][2] and edit != "D")
                    roles += {"K": turns[i][0][:1], "D": ""}.get(edit, edit[1:])
            if GRAMMAR.fullmatch(roles) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, roles
    return best


def shortest(turns):
    """The same by a search over (turns read, roles' state), by cost and then by the audit as text."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    queue, seen = [(0, "", 0, "")], set()
    while queue:
        cost, audit, i, state = heapq.heappop(queue)
        if (i, state) in seen:
            continue
        if i == len(turns) and state in ("", "a"):
            # Others of the same cost that end later in the queue have a greater audit.
            return cost, audit
        seen.add((i, state))
        go = [("I", 2, i, m) for m in "ua"]
        if i < len(turns):
            role, forced, cut = turns[i]
            go += [("D", 3, i + 1, None)]
            if not forced:
                go += [("K", int(cut), i + 1, role[:1])] + [("R", 2 + cut, i + 1, m) for m in "ua"]
        for edit, more, j, role in go:
            to = state if role is None else step.get((state, role))
            if to is not None:
                heapq.heappush(queue, (cost + more, audit + edit, j, to))


def solved(turns):
    """Through the layers: cost, audit, roles."""
    layers, kept = cr.Layers(), []

    class Sink:
        def add(self, key, role, text, edit):
            kept.append(role)

        def close(self, *facts):
            self.facts = facts

    sink = Sink()
    c = cr.Conversation(0, layers, sink)
    free = []
    for i, (role, forced, cut) in enumerate(turns):
        what = {"s": 0, "u": 1, "a": 2}.get(role[:1], 3) + 4 * (cut and not forced)
        digest = bytes([i])
        if forced:
            c.turn(i, role, digest, 1, what + cr.FORCED)
        else:
            c.turn(i, role, digest, 0, 0)
            c.turn(i, role, digest, 1, what)
            free.append(role)
    for role in free:
        c.text(role, "x")
    c.close()
    return sink.facts[6], sink.facts[7], "".join(r[:1] for r in kept)


@pytest.mark.parametrize("n", range(4))
def test_least_script_of_all(n):
    every = list(itertools.product(["system", "user", "assistant", "tool"], [False, True], [False, True]))
    rnd = random.Random(n)
    cases = [[]] if n == 0 else itertools.product(every, repeat=n) if n == 1 else [[rnd.choice(every) for _ in range(n)] for _ in range(60 if n == 2 else 25)]
    for turns in cases:
        assert solved(list(turns)) == scripts(list(turns)), turns


def test_longer_conversations_equal_a_shortest_path():
    rnd = random.Random(5)
    for _ in range(400):
        turns = [(rnd.choice(["system", "user", "user", "assistant", "assistant", "tool", "", "ünder"]), rnd.random() < 0.15, rnd.random() < 0.3) for _ in range(rnd.randrange(4, 60))]
        cost, audit, roles = solved(turns)
        assert (cost, audit) == shortest(turns) and GRAMMAR.fullmatch(roles)


def test_stacks_are_few():
    layers, seen = cr.Layers(), {0}
    todo = [layers.end]
    while todo:
        number = todo.pop()
        for symbol in range(9):
            after, _ = layers.back(number, symbol)
            if after not in seen:
                seen.add(after)
                todo.append(after)
    assert len(layers.stacks) < 400 and max(map(len, layers.stacks)) <= 10


def plain(rows, damage=True):
    """The contract in plain Python; rows of one turn go by role and text's hash."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        out = convs[conv]
        space = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20 if damage else 9
        role, text = space(role), space(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    found = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, faults, items = set(), [], []
        for _, role, text in turns:
            last = WORD.findall(text)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            items.append((role, fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit = shortest(items)
        kept, state, rest = [], "", iter(zip(turns, items))
        for edit in audit:
            made = {"": "user", "s": "user", "u": "assistant", "a": "user"}[state]
            if edit == "I":
                kept.append((made, ""))
            else:
                (_, role, text), _ = next(rest)
                if edit == "D":
                    continue
                kept.append((role if edit == "K" else made, text))
            state = kept[-1][0][:1]
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:])]
        found[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                       hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())
    return found


def conversations(seed=1, n=120):
    rnd = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rnd.randrange(1, 9) if conv else 700):
            role = "system" if turn == 0 and rnd.random() < 0.4 else ["user", "assistant"][turn % 2]
            text = rnd.choice(["Yes.", "No!", "Why?", "well", "", " \n", "é" * 9 + ".", None, f"turn {turn}. ", "x" * rnd.randrange(50) + "?"])
            rows.append((conv, turn * (2 if conv % 9 == 0 else 1), role if rnd.random() < 0.9 else rnd.choice(["tool", None, "user"]), text))
    return rows


def by_conv(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_repair(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert by_conv(cr.repair(cr.damaged(df))) == plain(rows)
    assert by_conv(cr.repair(cr.turns_of(df))) == plain(rows, damage=False)


def test_odd_rows(spark):
    """Nulls in any column, ties, repeated rows, a conversation that loses all rows, a very long text, clashing columns."""
    gone = next(k for k in range(1000, 9999) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows = [(None, None, None, None)] * 3 + [(None, 1, "user", "Hi."), (5, None, "user", "a."), (5, None, "assistant", "b."), (5, None, "user", "a."), (gone, 0, "user", "lost."),
            (6, 2, "user", "x."), (6, 2, "assistant", "y."), (6, 2, "user", "z"), (6, 9, "assistant", None), (7, 0, "user", "long " * 400_000 + "."), (7, 1, "assistant", "ok.")]
    rows += [(8, t, r, "same.") for t in range(40) for r in ("user", "assistant")] * 3
    clash = {c: F.lit(1) for c in ("conv", "kind", "n", "what", "digest", "words", "none", "audit", "cost", "place")}
    df = spark.createDataFrame(rows, SCHEMA).withColumns(clash).repartition(4)
    found = by_conv(cr.repair(cr.damaged(df)))
    assert found == plain(rows) | {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert spark.createDataFrame([], SCHEMA).transform(cr.damaged).transform(cr.repair).count() == 0


def test_repaired_turns(spark):
    df = spark.createDataFrame(conversations(2, 40), SCHEMA)
    turns = cr.repaired(cr.damaged(df))
    joined = turns.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("t"))
    hashed = {r[0]: r[1] for r in joined.select("conv", F.sha2(F.concat_ws("\n", F.transform("t", lambda x: F.concat_ws(":", x["role"], x["text"]))), 256)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert {k: hashed.get(k, empty) for k in range(40)} == {k: v[-1] for k, v in by_conv(cr.repair(cr.damaged(df))).items()}
    roles = joined.select(F.concat_ws("", F.transform("t", lambda x: F.substring(x["role"], 1, 1)))).collect()
    assert all(GRAMMAR.fullmatch(r[0]) for r in roles)
