"""URL filters by Bloom filter cascades, in DataFrame operations only.

A rule (host, path, action) fits its host and all subdomains where the url's path starts with the rule's path; of
the rules that fit a url the longest wins. A rule can only fit through a key of its own shape (labels of the host,
characters of the path), so a url has one candidate key for each shape among the rules: the host's last labels and
the path's first characters, joined. Whether a key is listed is answered by a cascade: level 0 is a Bloom filter of
the listed keys, level 1 one of the other keys of the corpus that pass level 0, level 2 one of the listed keys that
pass level 1, and so on until no key is taken wrongly. As every key of the corpus was tried while building, the
answer is exact for each of them, and a url is judged by hash tests on literals, without a join.

The cascade's words are literals of the plan, which tasks get as Spark broadcasts their code: ten to twenty bits for
each listed key that the corpus has, whatever its size; levels go on until no key is taken wrongly. The rules are a
table. The driver gets words of filters and the rules' shapes, never keys of the corpus.

Edge cases: a null url, or one without ``://``, has empty host and path, no rule and the method's verdict; a url
that no rule fits is not listed and is allowed; equal lengths go to the rule with the longer host; repeated rows are
judged each; an empty table gives an empty result; further columns are ignored and clashing ones replaced.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop_written, shared_dir, written

#: The production rules (host, path, action).
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
BITS_PER_KEY = 10
HASHES = 4
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z in lower case, and path; empty where there is no ``://``."""
    url = F.coalesce(url, F.lit(""))
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, parts, 1), UPPER, UPPER.lower())
    return host, F.regexp_extract(url, parts, 2)


def _table(spark: SparkSession, rules) -> DataFrame:
    """Tuples as a table, from one literal."""
    named = json.dumps([{"host": h, "path": p, "action": a} for h, p, a in rules])
    return spark.range(1).select(F.inline(F.from_json(F.lit(named), "array<struct<host string, path string, action string>>")))


def listed_keys(spark: SparkSession, rules) -> DataFrame:
    """(key, action, labels, length) of ``rules``: a table with host, path and action, or such tuples. Hosts in lower
    case; a rule without host or path has the empty one."""
    table = rules if isinstance(rules, DataFrame) else _table(spark, rules)
    host, path = F.translate(F.coalesce("host", F.lit("")), UPPER, UPPER.lower()), F.coalesce("path", F.lit(""))
    return table.select(F.concat(host, path).alias("key"), "action", F.size(F.split(host, r"\.")).alias("labels"), F.length(path).alias("length"))


def shapes(rules: DataFrame) -> list[tuple[int, int]]:
    """(labels, path characters) of the rules, those of longer keys first."""
    return sorted(((r.labels, r.length) for r in rules.select("labels", "length").distinct().collect()), reverse=True)


def key_of(shape: tuple[int, int], host: Column, path: Column) -> Column:
    """The url's candidate key of this shape, null where host or path are too short."""
    labels, length = shape
    fits = (F.length(path) >= length) & (F.size(F.split(host, r"\.")) >= labels)
    return F.when(fits, F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, length)))


def _position(key: Column, level: int, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits).cast("bigint"))


def _filter_words(keys: DataFrame, level: int, bits: int) -> list[int]:
    words = (
        keys.select(F.explode(F.array(*[_position(F.col("key"), level, i, bits) for i in range(HASHES)])).alias("p"))
        .groupBy(F.shiftright("p", 6).alias("w"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 AS INT)))").alias("v"))
        .collect()  # bits / 64 rows at most
    )
    out = [0] * (bits // 64)
    for w, v in words:
        out[w] = v
    return out


class Cascade:
    """Exact membership for the keys of the universe it was built over."""

    def __init__(self, levels: list[list[int]]):
        self.levels = levels

    @classmethod
    def build(cls, universe: DataFrame, listed: DataFrame) -> Cascade:
        """``universe`` and ``listed`` have distinct keys (``key``)."""
        inside = universe.join(listed, "key", "left_semi")
        outside = universe.join(listed, "key", "left_anti")
        levels: list[list[int]] = []
        sides = [inside, outside]
        count = inside.count()
        while count:
            level = len(levels)
            bits = 64
            while bits < BITS_PER_KEY * count:
                bits <<= 1
            levels.append(_filter_words(sides[0], level, bits))
            # The keys of the other side that this level takes wrongly are what the next one encodes.
            wrong = sides[1].filter(cls._passes(F.col("key"), level, levels[level]))
            sides = [wrong, sides[0]]
            count = wrong.count()
        return cls(levels)

    @staticmethod
    def _passes(key: Column, level: int, words: list[int]) -> Column:
        table = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")
        passes = F.lit(True)
        for i in range(HASHES):
            p = _position(key, level, i, 64 * len(words))
            word = F.get(table, F.shiftright(p, 6).cast("int"))
            passes = passes & (F.getbit(word, (p % 64).cast("int")) == 1)
        return passes

    def contains(self, key: Column) -> Column:
        found: Column = F.lit(len(self.levels) % 2 == 1)  # past the last level: what that level encodes
        for level in reversed(range(len(self.levels))):
            found = F.when(self._passes(key, level, self.levels[level]), found).otherwise(F.lit(level % 2 == 1))
        return F.coalesce(found & key.isNotNull(), F.lit(False))


def judge_urls(pages: DataFrame, url_col: str = "url", rules=RULES, keep=("page_id",)) -> DataFrame:
    """``keep``, host, path, rule (null: none fits) and verdict (allow or block). Of equal rules that block and allow,
    the one that blocks wins."""
    spark = pages.sparkSession
    shared_dir(spark)
    host, path = host_and_path(F.col(f"`{url_col}`"))
    made = {"host", "path", "rule", "verdict"}
    urls = pages.select(*[F.col(f"`{c}`") for c in keep if c not in made], host.alias("host"), path.alias("path"))
    rules = listed_keys(spark, rules)
    forms = shapes(rules)
    if not forms:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})
    keys = {form: key_of(form, F.col("host"), F.col("path")) for form in forms}
    universe = written(
        urls.select(F.explode(F.array(*keys.values())).alias("key")).filter(F.col("key").isNotNull()).distinct(), "keys")
    cascades = {action: Cascade.build(universe, rules.filter(F.col("action") == action).select("key").distinct()) for action in ("block", "allow")}
    drop_written(universe)
    fits = []
    for form in forms:
        for action in ("block", "allow"):
            fits.append(F.when(cascades[action].contains(keys[form]), F.struct(
                F.length(keys[form]).alias("length"), F.lit(form[0]).alias("labels"), keys[form].alias("rule"), F.lit(action).alias("verdict"))))
    best = F.greatest(*fits) if len(fits) > 1 else fits[0]
    judged = urls.withColumn("_best", best)
    return judged.select("*", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit("allow")).alias("verdict")).drop("_best")
