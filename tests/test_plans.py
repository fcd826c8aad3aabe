"""Plans: what is read, and how it meets."""

import os
import re

import pytest
from pyspark.sql import functions as F

from glyphward.operators import align, calibrate, metrics
from glyphward.plans import queries, synthetic

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(text: str) -> list[set[str]]:
    return [set(re.findall(r"(\w+):", x)) for x in re.findall(r"ReadSchema: struct<([^>]*)>", text)]


def test_a_sweep_reads_two_columns(spark):
    assert all(c <= {"l_discount", "l_returnflag"} for c in read_columns(plan(queries.q_lineitem_sweep(spark, SF))))


def test_filters_reach_the_scan(spark):
    text = plan(synthetic.table(spark, SF, "documents").filter("doc_id > 5").select("doc_id"))
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThan(doc_id,5)]" in text and read_columns(text) == [{"doc_id"}]


def test_metrics_take_one_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).cast("string").alias("system"), (F.col("id") % 2).cast("int").alias("label"), F.lit(1).alias("pred_label"))
    text = plan(metrics.metrics(df, "system"))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_count" in text


def test_no_join_of_thresholds_with_rows(spark):
    scored = synthetic.scored(spark, SF)
    text = plan(calibrate.sweep(scored, thresholds=spark.createDataFrame([(0.1,), (0.2,)], "threshold double")))
    assert "CartesianProduct" not in text


def test_resume_is_an_anti_join(spark):
    rows = spark.range(10)
    assert re.search(r"Join.*LeftAnti", plan(align.pending(rows, rows.filter("id > 5"), "id")))
