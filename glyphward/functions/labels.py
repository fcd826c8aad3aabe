"""Labels, prompts and formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A code point that is part of a word; \b differs between engines beyond ASCII.
_WORD = r"[\p{L}\p{N}_]"


#: The white space of Unicode as a regex class; trimming and folding go by it.
BLANKS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, rf"^[{BLANKS}]+|[{BLANKS}]+\z", "")


def _word(pattern: str) -> str:
    return rf"(?<!{_WORD})(?:{pattern})(?!{_WORD})"


def binary_label(labels: Column) -> Column:
    """1 where a comma-separated list of labels does not hold 8, else 0."""
    return (~F.array_contains(F.transform(F.split(labels, ","), stripped), "8")).cast("int")


def parse_label(answer: Column) -> Column:
    """A free-form answer as 1 (hate), 0 (non-hate) or null. Negated forms come before plain ones."""
    text = F.regexp_replace(F.replace(F.lower(stripped(answer)), F.lit("_"), F.lit("-")), rf"[{BLANKS}]+", " ")
    return (
        F.when(text.rlike(_word(r"non\s*-\s*hate|nonhate|non hate")), 0)
        .when(text.rlike(_word("hate")), 1)
        .when(text.contains("비혐오") | text.contains("비악성") | text.isin("정상", "일반"), 0)
        .when(text.contains("혐오") | text.contains("악성"), 1)
    )


def label_name(label: Column) -> Column:
    return F.when(label == 1, "hate").when(label == 0, "non-hate")


def parsed_name(label: Column) -> Column:
    return F.coalesce(label_name(label), F.lit("parse_failed"))


def display_name(system: Column, names: dict[str, str]) -> Column:
    """The name of a system, else itself with blanks for underscores."""
    known = reduce(lambda when, kv: when.when(system == kv[0], kv[1]), names.items(), F.when(F.lit(False), ""))
    return F.coalesce(known, F.replace(system, F.lit("_"), F.lit(" ")))


def clip_head_tail(text: Column, budget: int) -> Column:
    """Head and tail of a text longer than ``budget`` characters."""
    head = budget // 2
    return F.when(F.length(text) <= budget, text).otherwise(
        F.concat(F.substring(text, 1, head), F.lit(" ... "), F.expr("''") if budget == head else F.right(text, F.lit(budget - head))))


# Prompt texts.
SYSTEM_PROMPT = (
    "You are a Korean hate-speech classifier. Classify each comment according to whether it attacks, insults, dehumanizes, or expresses"
    " hostility toward a person or social group. Negative opinions without such attacks are non-hate. Return only hate or non-hate."
)
DIGIT_SYSTEM_PROMPT = "You are a Korean hate-speech classifier. Return only 1 for hate or 0 for non-hate."
ASK = "Classify this Korean comment as hate or non-hate.\nReturn exactly one label and no explanation.\n\nComment: "
ASK_BOTH = (
    "Classify this Korean comment as hate or non-hate. The original may contain romanized Korean or rune-like glyphs. A rule-based"
    " normalizer produced a possible reconstruction; it may be imperfect. Use both versions and return exactly one label with no"
    " explanation.\n\nOriginal: "
)
ASK_DIGIT = "Classify the Korean comment. Return only 0 or 1.\n0 = non-hate, 1 = hate.\n\nComment: "
ASK_DIGIT_BOTH = (
    "Classify the comment. It may contain romanized Korean or rune-like glyphs. The normalized candidate was produced by rules and may"
    " be imperfect. Use both versions. Return only 0 or 1.\n0 = non-hate, 1 = hate.\n\nOriginal: "
)


def user_prompt(text: Column, candidate: Column | None = None, digits: bool = False) -> Column:
    if candidate is None:
        return F.concat(F.lit(ASK_DIGIT if digits else ASK), text, F.lit("\nLabel:"))
    return F.concat(F.lit(ASK_DIGIT_BOTH if digits else ASK_BOTH), text, F.lit("\nNormalized candidate: "), candidate, F.lit("\nLabel:"))


def messages(text: Column, candidate: Column | None = None, digits: bool = False, answer: Column | None = None) -> Column:
    """Chat messages as array<struct<role, content>>."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    turns = [turn("system", F.lit(DIGIT_SYSTEM_PROMPT if digits else SYSTEM_PROMPT)), turn("user", user_prompt(text, candidate, digits))]
    return F.array(*turns, *([turn("assistant", answer.cast("string"))] if answer is not None else []))


def digits_of(name: Column) -> Column:
    """The digits of a name as a number."""
    return F.regexp_replace(name, "[^0-9]", "").cast("int")


def fixed(value: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", value)


def markdown_number(value: Column, places: int = 3) -> Column:
    return F.coalesce(F.when(value.isNotNull() & ~F.isnan(value), fixed(value, places)), F.lit("-"))


def uniform(key: Column) -> Column:
    """A number in [0, 1) from a string: the first 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
