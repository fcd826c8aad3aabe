"""Hangul romanization and rune substitution: tables and native expressions, and an Arrow function that counts characters
by kind in one pass."""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column
from pyspark.sql import functions as F

# Romanization by initial, vowel and final, in Unicode order; a silent part is empty.
INITIALS = ["g", "kk", "n", "d", "tt", "r", "m", "b", "pp", "s", "ss", "", "j", "jj", "ch", "k", "t", "p", "h"]
VOWELS = ["a", "ae", "ya", "yae", "eo", "e", "yeo", "ye", "o", "wa", "wae", "oe", "yo", "u", "wo", "we", "wi", "yu", "eu", "ui", "i"]
FINALS = ["", "g", "kk", "gs", "n", "nj", "nh", "d", "l", "lg", "lm", "lb", "ls", "lt", "lp", "lh", "m", "b", "bs", "s", "ss", "ng", "j", "ch", "k", "t", "p", "h"]
# The rune for each letter from a to z.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
RUNES = "ᚨᛒᚲᛞᛖᚠᚷᚺᛁᛃᚴᛚᛗᚾᛟᛈᛩᚱᛋᛏᚢᚡᚹᛪᚣᛉ"
# Syllables and look-alikes of the glyph mix.
CONFUSABLE = {
    "가": "ㄱr", "나": "ㄴr", "다": "ㄷr", "라": "ㄹr", "마": "ㅁr", "바": "ㅂr", "사": "ㅅr", "아": "ㅇr",
    "자": "zㅏ", "차": "ㅊr", "카": "ㅋr", "타": "ㅌr", "파": "ㅍr", "하": "hㅏ", "이": "0l", "오": "0",
}
CONFUSED_SHARE = 0.15

FIRST, LAST = 0xAC00, 0xD7A3
#: White space as Python's str.isspace sees it.
BLANK = r"[\p{Z}\s\x1C-\x1F\x85]"


def is_syllable(char: Column) -> Column:
    return F.ascii(char).between(FIRST, LAST)


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def syllable_roman(char: Column) -> Column:
    """Romanization of one syllable: its code point is a number in base (initials, vowels, finals)."""
    place = F.ascii(char) - FIRST
    per_initial = len(VOWELS) * len(FINALS)
    pick = lambda values, i: F.get(_strings(values), F.floor(i).cast("int"))
    return F.concat(
        pick(INITIALS, place / per_initial), pick(VOWELS, (place % per_initial) / len(FINALS)), pick(FINALS, place % len(FINALS)))


def chars(text: Column) -> Column:
    return F.split(text, "")


def romanize(text: Column) -> Column:
    """All syllables romanized, other characters kept."""
    return F.array_join(F.transform(chars(text), lambda c: F.when(is_syllable(c), syllable_roman(c)).otherwise(c)), "")


def to_runes(text: Column) -> Column:
    """All letters, in either case, as runes."""
    return F.translate(text, LETTERS + LETTERS.upper(), RUNES + RUNES)


def from_runes(text: Column) -> Column:
    """Runes as letters, and ŋ as ng."""
    return F.replace(F.translate(text, RUNES, LETTERS), F.lit("ŋ"), F.lit("ng"))


def count_of(text: Column, characters: str) -> Column:
    """How many characters of a regex class the text holds: what it loses without them."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{characters}+", ""))


#: Kinds of characters; one may be of several. White space is as in BLANK, a word is of letters and numbers in any script.
KINDS = ("blank", "rune", "runic", "latin", "digit", "jamo", "word")


@functools.lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The kinds of each code point, as bits."""
    every = [chr(i) for i in range(sys.maxunicode + 1)]
    categories = [unicodedata.category(c) for c in every]
    among = lambda characters: np.isin(np.arange(len(every)), [ord(c) for c in characters])
    between = lambda first, last: (np.arange(len(every)) >= ord(first)) & (np.arange(len(every)) <= ord(last))
    held = {
        "blank": np.array([c.isspace() for c in every]), "rune": among(RUNES), "runic": between("ᚠ", "᛿"), "latin": among(LETTERS + LETTERS.upper()),
        "digit": np.array([k == "Nd" for k in categories]) | among("²³¹") | between("⁴", "⁹") | between("₀", "₉") | between("①", "⑨"),
        "jamo": between("㄰", "㆏"), "word": np.array([k[0] in "LN" for k in categories]),
    }
    return sum(held[name].astype(np.uint8) << k for k, name in enumerate(KINDS)).astype(np.uint8)


def _counted(texts: pa.Array) -> pa.Array:
    kinds, of_bits = _kinds(), np.arange(1 << len(KINDS))
    within = np.array([np.ones_like(of_bits), *[of_bits >> k & 1 for k in range(len(KINDS))]])
    out = np.zeros((len(texts), len(within)), np.int64)
    for i, text in enumerate(texts):
        if text.is_valid:
            codes = np.frombuffer(text.as_py().encode("utf-32-le"), np.uint32)
            out[i] = within @ np.bincount(kinds[codes], minlength=len(of_bits))
    missing = pa.compute.is_null(texts)
    return pa.StructArray.from_arrays([pa.array(column) for column in out.T], names=["length", *KINDS], mask=missing)


def counts(text: Column) -> Column:
    """How many characters a text has, and of each kind; null for a null."""
    return F.arrow_udf(_counted, ", ".join(f"{name} bigint" for name in ["length", *KINDS]))(text)


def _visible(found: Column) -> Column:
    """The number of visible characters, null for none."""
    return F.nullif(found["length"] - found["blank"], F.lit(0))


def rune_ratio(text: Column) -> Column:
    found = counts(text)
    return F.coalesce(found["rune"] / _visible(found), F.lit(0.0))


def latin_ratio(text: Column) -> Column:
    found = counts(text)
    return F.coalesce(found["latin"] / _visible(found), F.lit(0.0))


def obfuscation_score(text: Column) -> Column:
    """Weighted shares of runes, letters, digits, jamo and punctuation among visible characters, at most 1."""
    found = counts(text)
    visible = _visible(found)
    weighted = (
        1.4 * found["runic"] / visible + 0.25 * found["latin"] / visible + 0.2 * found["digit"] / visible
        + 0.35 * found["jamo"] / visible + 0.1 * (visible - found["word"]) / visible)
    return F.coalesce(F.when(weighted >= 1.0, F.lit(1.0)).otherwise(weighted), F.lit(0.0))
