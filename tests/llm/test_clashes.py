"""Stages and operators that return their input's columns leave them as they are, whatever they are called."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import glyphward.llm as llm
from glyphward.llm import exact_dedup, mixing, ngram_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Every name that the subpackage's code makes for a column, and a few of other styles.
NAMES = sorted({m for p in Path(llm.__file__).parent.glob("*.py") for m in re.findall(r'(?:alias|withColumn|withColumnRenamed)\(\s*"(\w+)"', p.read_text())} | {
    "_source", "_h", "_class", "_bucket", "_s", "_b", "_c", "_before", "_copy", "_row", "_digest", "_id", "_data", "e", "rid", "at", "rows", "words", "col", "n"} | set(mixing.MADE))
STAGES = {"exact": exact_dedup.survivors, "near": ngram_join.one_of_each, "mixed": mixing.mix}


@pytest.mark.parametrize("stage", sorted(STAGES))
def test_columns_stay(spark, stage):
    texts = [f"text number {k} of some words that differ a bit {k * k} and so on {k}" for k in range(30)] + ["the same text"] * 3 + ["", None]
    rows = [(k, t, "en", ["a", "b", None][k % 3], 1) for k, t in enumerate(texts)]
    plain = spark.createDataFrame(rows, SCHEMA)
    taken = {n.lower() for n in plain.columns}
    names = [n for n in NAMES if n.lower() not in taken and not taken.add(n.lower())]
    df = plain.withColumns({n: F.col("doc_id") * 1000 + i for i, n in enumerate(names)}).repartition(3)
    found = STAGES[stage](df)
    assert found.columns == df.columns and len(names) > 60
    out = found.collect()
    assert out and all(r[n] == r.doc_id * 1000 + i for r in out for i, n in enumerate(names))
    assert STAGES[stage](df.filter("false")).count() == 0
    nulls = STAGES[stage](spark.createDataFrame([(None,) * 5] * 4, SCHEMA))
    assert nulls.columns == plain.columns and nulls.count() <= (0 if stage == "mixed" else 4)


def test_a_mix_of_rows_that_differ_in_a_double_or_a_list(spark):
    rows = [(7, "one two three", "en", "a", 1, k / 3, [k, k + 1]) for k in range(40)] + [(8, "one two three four five six", "en", "b", 1, 0.5, None)]
    df = spark.createDataFrame(rows, SCHEMA + ", x double, l array<int>")
    twice = [sorted((r.x, r.l) for r in mixing.mix(df.repartition(n)).filter("doc_id = 7").collect()) for n in (1, 7)]
    assert twice[0] == twice[1] and 20 < len(twice[0]) < 90


def test_a_very_long_text_in_each_stage(spark):
    df = spark.createDataFrame([(1, "wörd " * 4_000_000, "en", "a", 1), (2, "short text", "en", "a", 1)], SCHEMA)
    for name, stage in STAGES.items():
        assert {r[0] for r in stage(df).select("doc_id").collect()} >= ({1, 2} if name != "mixed" else {1})
