"""Quality rules by weak supervision, in DataFrame operations only.

Each rule reads a document's statistics and votes for (1) or against (-1) it or abstains (0). The votes of all
documents are counted by pattern; expectation-maximisation over the patterns estimates, for good and bad documents,
how often each rule votes which way, and how many documents are good. A document is kept where its posterior
probability of being good is at least 0.5. Abstaining is no evidence. Documents that fail the base rule are out
already and are not learned from. There are at most 3 ** (number of rules) patterns whatever the input, so the counts
fit the driver, and the posterior is a sum of logs that Spark computes row by row.

Statistics: words are runs without white space (\\x20, \\x09-\\x0D); ``n_repeat_words`` counts the words inside
5-word windows found twice or more in the text. Windows are hashed, sorted with their positions and compared word
by word where hashes agree; texts in which all window hashes differ skip that.

Edge cases: null and empty texts have no words and fail the base rule; fewer than 5 words have no window; repeated
rows are judged each; an empty table gives an empty result; further columns are ignored, clashing ones replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, shared_dir, word_count, written

WINDOW = 5
SYMBOLS = "[#*$%&|<>]"
#: A word of letters and digits, with the usual marks around it.
PLAIN = r"^[(\[«\"“„'‘¿¡]*[\p{L}\p{M}\p{N}'’-]+[.,;:!?…)\]»\"”'’]*$"
#: Marks: neither letter, digit nor white space.
MARK = r"[^\p{L}\p{M}\p{N}\s]"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Lines that end like a sentence; read in code points.
SENTENCE_END = r"[.!?…。؟\"”»)][ \t\r]*(\n|$)"


def with_statistics(docs: DataFrame, text_col: str = "text", keep=("doc_id",)) -> DataFrame:
    """``keep`` and the statistics, with n_lines (lines that hold a word), n_ends (lines that end a sentence), n_marks
    and n_plain (words of letters, digits and usual punctuation)."""
    base = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    base = base.select("*", F.array_remove(F.split("_text", f"[{SPACE}]+", -1), "").alias("_words"), lines.alias("_lines"))
    n = F.size("_words")
    at = lambda i, k: F.get(F.col("_words"), i + k)
    hashes = F.when(n > WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)])))
    counted = base.select(
        *[F.col(f"`{c}`") for c in keep], "_words",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("_text", F.lit(SENTENCE_END)).cast("long").alias("n_ends"),
        F.regexp_count("_text", F.lit(MARK)).cast("long").alias("n_marks"),
        F.size(F.filter("_words", lambda w: w.rlike(PLAIN))).cast("long").alias("n_plain"),
        hashes.alias("_h"),
    )
    m = F.size("_h")
    some = F.col("_h").isNotNull() & (F.size(F.array_distinct("_h")) < m)
    ordered = F.when(some, F.sort_array(F.arrays_zip(F.col("_h").alias("h"), F.sequence(F.lit(0), m - 1).alias("i"))))
    counted = counted.select("*", ordered.alias("_s"))
    position = lambda k: F.get(F.col("_s"), k)["i"]
    equal = lambda k: F.reduce(  # noqa: E731  the windows' words
        F.sequence(F.lit(0), F.lit(WINDOW - 1)), F.lit(True),
        lambda same, j: same & (F.get(F.col("_words"), position(k) + j) == F.get(F.col("_words"), position(k - 1) + j)))
    pairs = F.filter(F.sequence(F.lit(1), F.size("_s") - 1), lambda k: (F.get(F.col("_s"), k)["h"] == F.get(F.col("_s"), k - 1)["h"]) & equal(k))
    counted = counted.select("*", F.when(F.col("_s").isNotNull(), pairs).alias("_k"))
    found = F.sort_array(F.array_distinct(F.concat(F.transform("_k", position), F.transform("_k", lambda k: position(k - 1)))))
    counted = counted.select("*", F.when(F.size("_k") > 0, found).alias("_p"))
    covered = F.reduce(
        F.sequence(F.lit(1), F.size("_p") - 1), F.lit(WINDOW).cast("long"),
        lambda total, j: total + F.least(F.lit(WINDOW), F.get(F.col("_p"), j) - F.get(F.col("_p"), j - 1)))
    return counted.select(
        *[F.col(f"`{c}`") for c in keep], "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.when(F.col("_p").isNull(), F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"), "n_lines", "n_ends", "n_marks", "n_plain",
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _vote(against: Column, for_it: Column) -> Column:
    return F.when(against, F.lit(-1)).when(for_it, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """Name and vote of each rule, over the columns of :func:`with_statistics`."""
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    mean_length, symbols = F.col("word_chars") / words, F.col("n_symbols") / words
    marks, plain = F.col("n_marks") / F.greatest(F.col("word_chars"), F.lit(1)), F.col("n_plain") / words
    repeated, same_lines, ends = F.col("n_repeat_words") / words, F.col("n_dup_lines") / lines, F.col("n_ends") / lines
    return {
        "length": _vote(F.col("n_words") < 10, F.col("n_words") >= 50),
        "word_length": _vote((mean_length < 2) | (mean_length > 12), (mean_length >= 3) & (mean_length <= 9)),
        "symbols": _vote(symbols > 0.1, symbols < 0.02),
        "marks": _vote(marks > 0.15, marks < 0.07),
        "plain_words": _vote(plain < 0.8, plain > 0.95),
        "same_lines": _vote(same_lines > 0.3, same_lines <= 0.1),
        "repeats": _vote(repeated > 0.2, repeated <= 0.05),
        "sentences": _vote(ends < 0.1, ends >= 0.5),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 30) -> dict:
    """Prior and rates of votes against, by EM from (votes, documents). The start takes a document without a vote
    against it to be good; add-one counts keep every rate between zero and one."""
    good = [{0: 0.95, 1: 0.3}.get(sum(v < 0 for v in votes), 0.02) for votes, _ in patterns]
    model: dict = {"prior": 0.5, "rates": []}
    for _ in range(rounds if patterns else 0):
        held = sum(n * g for (_, n), g in zip(patterns, good))
        rates = []
        for j in range(len(patterns[0][0])):
            seen = {True: [1.0, 1.0], False: [1.0, 1.0]}  # good: votes for, votes against; and bad
            for (votes, n), g in zip(patterns, good):
                if votes[j]:
                    seen[True][votes[j] < 0] += n * g
                    seen[False][votes[j] < 0] += n * (1 - g)
            rates.append(tuple(against / (for_it + against) for for_it, against in seen.values()))
        model = {"prior": (held + 1) / (sum(n for _, n in patterns) + 2), "rates": rates}
        good = [posterior(model, votes) for votes, _ in patterns]
    return model


def evidence(rate: tuple[float, float]) -> dict[int, float]:
    """What a vote adds to the log odds of being good."""
    good, bad = rate
    return {-1: math.log(good / bad), 0: 0.0, 1: math.log((1 - good) / (1 - bad))}


def posterior(model: dict, votes: tuple[int, ...]) -> float:
    log_odds = math.log(model["prior"] / (1 - model["prior"])) + sum(evidence(r)[v] for r, v in zip(model["rates"], votes))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, log_odds))))


def judge(docs: DataFrame, text_col: str = "text", keep=("doc_id",), threshold: float = 0.5) -> DataFrame:
    """``keep``, the statistics, base_failed, posterior and kept."""
    shared_dir(docs.sparkSession)
    votes = rules()
    names = [f"vote_{name}" for name in votes]
    voted = written(with_statistics(docs, text_col, keep).select("*", *[v.alias(n) for v, n in zip(votes.values(), names)]), "votes")
    counts = voted.filter(~base_failed()).groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()  # 3 ** len(rules) rows at most
    model = fit(sorted((tuple(r[n] for n in names), r["n"]) for r in counts))
    log_odds: Column = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for name, rate in zip(names, model["rates"]):
        adds = evidence(rate)
        log_odds = log_odds + F.when(F.col(name) < 0, adds[-1]).when(F.col(name) > 0, adds[1]).otherwise(0.0)
    score = 1 / (1 + F.exp(-log_odds))
    judged = voted.select("*", base_failed().alias("base_failed"), score.alias("posterior"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
