import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glyphward.functions import deobfuscate as deob
from glyphward.functions import hangul, labels


def values(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in df.select("i", *columns).orderBy("i").collect()]


def test_romanize(spark):
    assert values(spark, ["부산의 자랑", "가", "힣", "A1!", ""], hangul.romanize(F.col("t"))) == ["busanui jarang", "ga", "hih", "A1!", ""]


def test_runes_there_and_back(spark):
    runes = hangul.to_runes(F.col("t"))
    assert values(spark, ["Az", "부a"], runes) == ["ᚨᛉ", "부ᚨ"]
    assert values(spark, ["hello", "ŋx"], hangul.from_runes(runes)) == ["hello", "ngx"]


GOLDEN = {
    "busanui jarang": "붓안의 자랑", "ᛒᚢsanui jᚨrang": "붓안의 자랑", "tv 100 0l": "tv 100 이", "strength school": "strength s초올", "Hello A": "헬l오 a",
    "①": "1", "ㄱㅏ": "가", "ㄱr": "ᄀr", "": "", "TV": "tv", "12345": "12345", "0L0l": "이이",
}


def test_deobfuscate(spark):
    assert [deob.reconstruct(t) for t in GOLDEN] == list(GOLDEN.values())
    assert values(spark, [*GOLDEN, None], deob.deobfuscate(F.col("t"))) == [*GOLDEN.values(), None]


def test_expression_equals_function(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abeghijnorstuyw 019AKŋᚨᛒ가.,") for _ in range(rnd.randrange(30))) for _ in range(200)]
    assert values(spark, texts, deob.deobfuscate_expression(F.col("t"))) == [deob.reconstruct(t) for t in texts]


def greedy(run: str) -> str:
    """The longest key first, one place after the other."""
    keys = {}
    for i, a in enumerate(hangul.INITIALS):
        for j, b in enumerate(hangul.VOWELS):
            for k, c in enumerate(hangul.FINALS):
                keys.setdefault(a + b + c, chr(0xAC00 + (i * 21 + j) * 28 + k))
    out, at, read = "", 0, 0
    while at < len(run):
        n = next((n for n in range(7, 0, -1) if run[at:at + n] in keys and at + n <= len(run)), 0)
        out += keys[run[at:at + n]] if n else run[at]
        read += n
        at += n or 1
    return run if len(run) < 2 or run.isdigit() or read / len(run) < 0.55 else out


@settings(max_examples=60, deadline=None)
@given(st.text("abeghijklmnoprstuwy0", max_size=14))
def test_pattern_is_the_greedy_reading(run):
    assert deob.read_run(run) == greedy(run)


def test_obfuscation_score(spark):
    score = F.round(hangul.obfuscation_score(F.col("t")), 9)
    assert values(spark, ["", " 　", "ᚨᛒ", "abcd", "1234", "ㅋㅋ", "!!"], score) == [0, 0, 1, 0.25, 0.2, 0.35, 0.1]


def test_parse_label(spark):
    cases = {
        "hate": 1, "Non_Hate": 0, "non - hate": 0, "nonhate": 0, "not hate": 1, "비혐오": 0, "혐오": 1, "정상": 0, "정상입니다": None,
        "hate입니다": None, "hateful": None, "1": None, "": None, "hate and non-hate": 0, "악성": 1, "비악성": 0, "일반": 0, "\tHATE\n": 1,
    }
    assert values(spark, [*cases, None], labels.parse_label(F.col("t"))) == [*cases.values(), None]


def test_binary_label(spark):
    assert values(spark, ["8", "2,3", " 8 ", "1, 8", "18", "", "8\t", "1,\r8\u00a0", "\u30008\n"], labels.binary_label(F.col("t"))) == [0, 1, 0, 0, 1, 1, 0, 0, 0]
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    assert values(spark, [f"{s}non{s}hate{s}{s}" for s in spaces], labels.parse_label(F.col("t"))) == [0] * len(spaces)
    assert values(spark, [f"x{s}{s}y" for s in spaces] + ["\u200bx"], labels.stripped(F.concat(F.lit("\u2003\t"), F.col("t"), F.lit("\x1f\n")))) == [f"x{s}{s}y" for s in spaces] + ["\u200bx"]


@pytest.mark.parametrize("budget,expected", [(4, "ab ... ij"), (5, "ab ... hij"), (10, "abcdefghij"), (0, " ... ")])
def test_clip(spark, budget, expected):
    assert values(spark, ["abcdefghij"], labels.clip_head_tail(F.col("t"), budget)) == [expected]


def test_messages(spark):
    assert [m["role"] for m in values(spark, ["x"], labels.messages(F.col("t"), F.col("t"), True, F.lit(1)))[0]] == ["system", "user", "assistant"]
    assert "Comment: x\nLabel:" in values(spark, ["x"], labels.messages(F.col("t")))[0][1]["content"]


def test_markdown_number(spark):
    df = spark.createDataFrame([(0.12345,), (None,), (float("nan"),)], "x double")
    assert [r[0] for r in df.select(labels.markdown_number(F.col("x"))).collect()] == ["0.123", "-", "-"]
