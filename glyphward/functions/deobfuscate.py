"""Rule-based reconstruction of obfuscated text.

NFKC, runes to letters, look-alike repair, then each run of letters and digits is read as romanized syllables. The
native expression and the Arrow function give the same results; the Arrow function is the faster one in bulk, as
higher-order functions are interpreted row by row, and the expression is there where Python is not wanted.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .hangul import FINALS, FIRST, INITIALS, LETTERS, RUNES, VOWELS, from_runes

#: A run is left alone when less than this share of it reads as syllables.
LEAST_READ = 0.55


def _longest_first(values) -> str:
    return "|".join(sorted((v for v in values if v), key=lambda v: (-len(v), v)))


SYLLABLE = f"(?:({_longest_first(INITIALS)})?({_longest_first(VOWELS)})({_longest_first(FINALS)})?)"
_PLAIN = f"(?:{_longest_first(INITIALS)})?(?:{_longest_first(VOWELS)})(?:{_longest_first(FINALS)})?"
RUN = "[A-Za-z0-9ŋ]+"


def visual_fixes(text: Column) -> Column:
    return F.regexp_replace(text, "0[lL]", "이")


def _syllable_char(roman: Column) -> Column:
    """The syllable that a piece spells: its parts' places, as a UTF-16 code unit."""
    place = lambda values, group: F.array_position(F.array(*[F.lit(v) for v in values]), F.regexp_extract(roman, f"^{SYLLABLE}$", group)) - 1
    code = F.lit(FIRST) + (place(INITIALS, 1) * len(VOWELS) + place(VOWELS, 2)) * len(FINALS) + place(FINALS, 3)
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def run_to_hangul(run: Column) -> Column:
    """One run of letters and digits."""
    low = F.lower(run)
    pieces = F.regexp_extract_all(low, F.lit(f"({_PLAIN}|.)"), F.lit(1))
    spells = lambda p: p.rlike(f"^{_PLAIN}$")
    read = F.aggregate(pieces, F.lit(0), lambda n, p: n + F.when(spells(p), F.length(p)).otherwise(0))
    written = F.array_join(F.transform(pieces, lambda p: F.when(spells(p), _syllable_char(p)).otherwise(p)), "")
    keep = (F.length(low) < 2) | low.rlike("^[0-9]+$") | (read / F.greatest(F.length(low), F.lit(1)) < LEAST_READ)
    return F.when(keep, low).otherwise(written)


def deobfuscate_expression(text: Column) -> Column:
    """The stages after NFKC as an expression, for text that is in that form."""
    fixed = visual_fixes(from_runes(text))
    parts = F.regexp_extract_all(fixed, F.lit(f"({RUN}|[^A-Za-z0-9ŋ]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(f"^{RUN}$"), run_to_hangul(p)).otherwise(p)), "")


_PIECE = re.compile(SYLLABLE)
_PLAIN_PIECE = re.compile(f"({_PLAIN})")
_RUN = re.compile(RUN)
#: In this order; a search for each costs less than a look at every character.
_FIXES = (*zip(RUNES, LETTERS), ("ŋ", "ng"), ("0l", "이"), ("0L", "이"))


@functools.lru_cache(maxsize=1 << 14)  # there are fewer pieces
def _spelled(piece: str) -> str:
    initial, vowel, final = (g or "" for g in _PIECE.fullmatch(piece).groups())
    return chr(FIRST + (INITIALS.index(initial) * len(VOWELS) + VOWELS.index(vowel)) * len(FINALS) + FINALS.index(final))


def read_run(run: str) -> str:
    low = run.lower()
    if len(low) < 2 or low.isdigit():
        return low
    parts = _PLAIN_PIECE.split(low)  # every other one is a piece
    read = sum(map(len, parts[1::2]))
    if read / len(low) < LEAST_READ:
        return low
    parts[1::2] = map(_spelled, parts[1::2])
    return "".join(parts)


def _repaired(text: str, form: str) -> str:
    """The stages before the runs."""
    text = text if text.isascii() else unicodedata.normalize(form, text)
    for old, new in _FIXES:
        text = text.replace(old, new)
    return text


def reconstruct(text: str) -> str:
    return _RUN.sub(lambda m: read_run(m.group()), _repaired(text, "NFKC"))


def _in_bulk(form: str):
    @F.pandas_udf(StringType())
    def deobfuscate(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        """All stages, as an Arrow function; a null stays null. Runs recur, so their readings are remembered."""
        known: dict[str, str] = {}

        def run(match: re.Match) -> str:
            key = match.group()
            if (found := known.get(key)) is None:
                if len(known) > 200_000:
                    known.clear()
                found = known[key] = read_run(key)
            return found

        for series in texts:
            yield series.map(lambda text: None if text is None else _RUN.sub(run, _repaired(text, form)))

    return deobfuscate


deobfuscate = _in_bulk("NFKC")
#: The same without compatibility forms, as in SQL that has none.
deobfuscate_nfc = _in_bulk("NFC")


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def with_nfkc(text: Column) -> Column:
    """NFKC, skipping Python for texts in ASCII, which it does not change."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), nfkc(text)).otherwise(text)
