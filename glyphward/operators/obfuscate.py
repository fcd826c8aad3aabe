"""Obfuscation: native with hashed draws, and compatible with a seeded Mersenne Twister."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
from collections.abc import Iterator
from hashlib import md5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.hangul import CONFUSABLE, CONFUSED_SHARE, FINALS, FIRST, INITIALS, LAST, LETTERS, RUNES, VOWELS, latin_ratio, rune_ratio
from .spread import pieces

#: Variant, share of syllables, share of letters; and the label shown.
READABLE = (
    ("romanized_35", 0.35, 0.0, "Romanized 35"),
    ("romanized_70", 0.70, 0.0, "Romanized 70"),
    ("roman_glyph_35", 0.35, 0.35, "Roman+Glyph 35"),
    ("roman_glyph_70", 0.70, 0.45, "Roman+Glyph 70"),
)
GLYPH_MIX = (("glyph_mix_35", 0.35, 0.35, "Glyph mix 35"), ("glyph_mix_90", 1.0, 0.98, "Glyph mix 90"))
READABLE_SEED, GLYPH_MIX_SEED = 20260604, 42
VARIANTS = (("clean", 0.0, 0.0, "Clean"), *READABLE)


#: The rune of each letter in either case.
RUNE = dict(zip(LETTERS + LETTERS.upper(), RUNES + RUNES))


#: The romanization of each syllable; and of these and the letters in ASCII what is drawn in the glyph mix.
ROMAN = {chr(FIRST + i): a + v + z for i, (a, v, z) in enumerate(itertools.product(INITIALS, VOWELS, FINALS))}
MIXED = ROMAN | {c: c for c in RUNE}


def variants(spark) -> DataFrame:
    """The dimension of variants in their order."""
    return spark.createDataFrame([(name, i, label, s, g) for i, (name, s, g, label) in enumerate(VARIANTS)],
                                 "variant string, variant_rank int, variant_label string, syllable_ratio double, glyph_ratio double")


def _limit(share: float) -> bytes:
    """A digest that is less than this is that of a draw below ``share``."""
    return min(max(0, math.ceil(share * 2**32)), 2**32 - 1).to_bytes(4, "big")


#: What a letter's place adds to its syllable's key.
_LETTER = [b"|g|%d" % j for j in range(16)]


class Hashed:
    """Draws of the native form: the first 32 bits of the MD5 of a key, the character's place and what is drawn."""

    def __init__(self, syllables: float, letters: float):
        self.syllables, self.letters = syllables, letters
        self.syllable_limit, self.letter_limit, self.look_limit = _limit(syllables), _limit(letters), _limit(CONFUSED_SHARE)

    def drawn(self, at: bytes) -> bool:
        return self.syllables >= 1 or (self.syllables > 0 and md5(at).digest() < self.syllable_limit)

    def runed(self, roman: str, at: bytes) -> str:
        """Each letter becomes its rune with a probability."""
        if self.letters <= 0:
            return roman
        limit = self.letter_limit
        return "".join([RUNE[c] if self.letters >= 1 or md5(at + g).digest() < limit else c for c, g in zip(roman, _LETTER)])

    def readable(self, text: str, key: bytes) -> str:
        out = list(text)
        for i, c in enumerate(text):
            if (roman := ROMAN.get(c)) is not None and self.drawn(at := b"%b%d" % (key, i)):
                out[i] = self.runed(roman, at)
        return "".join(out)

    def mixed(self, text: str, key: bytes) -> str:
        out = list(text)
        for i, c in enumerate(text):
            if (roman := MIXED.get(c)) is not None:
                at = b"%b%d" % (key, i)
                if c in CONFUSABLE and md5(at + b"|c").digest() < self.look_limit:
                    out[i] = CONFUSABLE[c]
                elif self.drawn(at):
                    out[i] = self.runed(roman, at)
        return "".join(out)


def _hashed(text: Column, key: Column, change) -> Column:
    def run(texts: pa.Array, keys: pa.Array) -> pa.Array:
        starts = (b"" if k is None else f"{k}|".encode() for k in keys.to_pylist())
        return pa.array([None if t is None else change(t, k) for t, k in zip(texts.to_pylist(), starts)], pa.string())

    # Marked so that no later step is merged with it and runs it again.
    return F.arrow_udf(run, StringType()).asNondeterministic()(text, key.cast("string"))


def obfuscate(text: Column, key: Column, syllable_share: float, letter_share: float) -> Column:
    """Syllables are romanized with a probability, their letters become runes with another; draws are hashes of
    ``key`` and the character's place, so a result depends on nothing else. An Arrow function: higher-order functions are
    interpreted for each character and draw, which takes more than twice as long."""
    return _hashed(text, key, Hashed(syllable_share, letter_share).readable)


def glyph_mix(text: Column, key: Column, syllable_share: float, letter_share: float) -> Column:
    """As :func:`obfuscate`, with look-alikes for some syllables and with letters drawn too."""
    return _hashed(text, key, Hashed(syllable_share, letter_share).mixed)


class Draws:
    """The compatible generator: one Mersenne Twister a row, seeded by text; a draw for each thing that may change."""

    def __init__(self, seed: str):
        self.next = random.Random(seed).random

    def runes(self, letters: str, share: float) -> str:
        draw = self.next
        return "".join([RUNE[c] if draw() < share else c for c in letters])

    def readable(self, text: str, syllables: float, letters: float) -> tuple[str, int, int]:
        out, draw, seen, changed = list(text), self.next, 0, 0
        for i, roman in enumerate(map(ROMAN.get, text)):
            if roman is not None:
                seen += 1
                if draw() < syllables:
                    changed += 1
                    if letters > 0:
                        out[i] = self.runes(roman, letters)
                    else:
                        out[i] = roman
                        for _ in roman:
                            draw()
        return "".join(out), seen, changed

    def mixed(self, text: str, syllables: float, letters: float) -> str:
        out, draw = list(text), self.next
        for i, c in enumerate(text):
            if (roman := MIXED.get(c)) is not None:
                if c in CONFUSABLE and draw() < CONFUSED_SHARE:
                    out[i] = CONFUSABLE[c]
                elif draw() < syllables:
                    out[i] = self.runes(roman, letters)
        return "".join(out)


def obfuscate_compatible(df: DataFrame, *, text: str = "text", split: str = "split", index: str = "idx", mix: bool = False, wanted: str | None = None) -> DataFrame:
    """``df`` times the variants, byte for byte as a per-row Mersenne Twister seeded by seed, variant, split, index and
    the text's SHA-256 gives them: variant, obfuscated, and (readable variants) seen and changed syllables. ``wanted``: a
    column with the variants that a row is asked for in, where that is not all of them (null)."""
    table = GLYPH_MIX if mix else READABLE
    names = df.columns
    made = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for batch in batches for p in pieces(batch, text)):
            texts = [t or "" for t in piece.column(text).to_pylist()]
            keys = [f"{s}:{i}:{hashlib.sha256(t.encode()).hexdigest()}" for t, s, i in zip(texts, piece.column(split).to_pylist(), piece.column(index).to_pylist())]
            asked = piece.column(wanted).to_pylist() if wanted else [None] * len(texts)
            for name, syllables, letters, _ in table:
                rows = [i for i, a in enumerate(asked) if a is None or name in a]
                if not rows:
                    continue
                if mix:
                    found = [(Draws(f"{GLYPH_MIX_SEED}:{keys[i]}").mixed(texts[i], syllables, letters), None, None) for i in rows]
                else:
                    found = [Draws(f"{READABLE_SEED}:{name}:{keys[i]}").readable(texts[i], syllables, letters) for i in rows]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*found), (pa.string(), pa.int32(), pa.int32()))]
                kept = piece if len(rows) == len(texts) else piece.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([name] * len(rows)), *columns], names=[*names, "variant", "obfuscated", "seen", "changed"])

    return df.mapInArrow(run, f"{made}, variant string, obfuscated string, seen int, changed int")


def split_summary(rows: DataFrame) -> DataFrame:
    """Counts and ratios by variant and split from rows (variant, split, label, obfuscated, seen, changed). The
    syllable ratio is one of sums, the others are means of ratios."""
    hate = F.sum(F.when(F.col("label") == 1, 1).otherwise(0))
    return rows.groupBy("variant", "split").agg(
        F.count(F.lit(1)).alias("rows"), hate.alias("hate_rows"), (F.count(F.lit(1)) - hate).alias("non_hate_rows"),
        F.round(F.coalesce(F.sum("changed") / F.nullif(F.sum("seen"), F.lit(0)), F.lit(0.0)), 6).alias("syllable_ratio"),
        F.round(F.avg(latin_ratio(F.col("obfuscated"))), 6).alias("latin_ratio"),
        F.round(F.avg(rune_ratio(F.col("obfuscated"))), 6).alias("rune_ratio"))
