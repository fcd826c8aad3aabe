"""Reports from files, and what they say where something is missing."""

import json

import pytest
from pyspark.sql import functions as F

from glyphward.operators import align, obfuscate, report
from glyphward.sources import files

HEAD = "system,split,variant,balanced_accuracy,macro_f1,max_failure_rate,fnr,fpr,predicted_hate_rate,parse_failures\n"


def line(system, split, variant, accuracy):
    return f"{system},{split},{variant},{accuracy},0.5,0.4,0.3,0.2,0.5,0\n"


def test_metrics_of_several_files(spark, tmp_path):
    """Splits do not overwrite each other; a later file does, and in a file a later row."""
    (tmp_path / "a_metrics.csv").write_text(HEAD + line("s", "test", "clean", 0.1) + line("s", "valid", "clean", 0.2) + line("t", "test", "clean", 0.9))
    (tmp_path / "b_metrics.csv").write_text("variant,extra,balanced_accuracy,system,split\nclean,1,0.3,s,test\nclean,1,0.35,s,test\nclean,1,0.7,chatgpt_x,test\n")
    (tmp_path / "c_metrics.csv").write_text("system,variant\ns,clean\n")
    (tmp_path / "all_metrics.csv").write_text(HEAD + line("s", "test", "clean", 1.0))
    loaded = report.load_metrics(spark, str(tmp_path / "*_metrics.csv"), skip=("all_metrics.csv",))
    assert sorted((r.system, r.split, r.balanced_accuracy) for r in loaded.collect()) == [("chatgpt_x", "test", 0.7), ("s", "test", 0.35), ("s", "valid", 0.2), ("t", "test", 0.9)]
    found = {r.system: (r.part, r.rank, r.worst_case_balanced_accuracy) for r in report.summary(loaded, plotted=["s", "t", "u"], ranked=["s", "u"]).collect()}
    assert found == {"s": ("main", 1, 0.2), "chatgpt_x": ("supplementary", 1, 0.7)}


def test_findings_without_rows(spark):
    rows = spark.createDataFrame([("raw", "v", 0.5, 0.1, 0.2, 0.3)], "system string, variant string, balanced_accuracy double, fnr double, fpr double, predicted_hate_rate double")
    found = dict(map(tuple, report.findings(rows, {"Raw": "raw", "Final": "final", "Other": "other"}, "raw", "final", "v").collect()))
    assert found == {"missing": "Final, Other", "before": "BA 0.500, FNR 0.100, FPR 0.200, predicted hate rate 0.300", "change": "not evaluated yet"}
    assert dict(map(tuple, report.findings(rows.filter("false"), {"Raw": "raw"}, "raw", "final", "v").collect()))["before"] == "not evaluated yet"


def test_external_comparison_needs_every_answer(spark):
    manifest = spark.createDataFrame([(k, v, k % 2) for k in range(6) for v in ("clean", "x")], "id int, variant string, label int")
    good = manifest.withColumn("label", F.when(F.col("label") == 1, "hate").otherwise("non-hate"))
    found = report.external_variants(manifest, {"a": good, "b": good.withColumn("label", F.lit("hate"))}, {"a": "A"}).collect()
    assert sorted((r.display_name, r.variant, r.rows, r.balanced_accuracy, r.place) for r in found) == [("A", "clean", 6, 1.0, 1), ("A", "x", 6, 1.0, 1), ("b", "clean", 6, 0.5, 2), ("b", "x", 6, 0.5, 2)]
    with pytest.raises(ValueError, match="without a partner"):
        report.external_variants(manifest, {"a": good.filter("id <> 3")}, {})


def test_run_info(tmp_path):
    info = report.run_info("models/x", input_mode="both", batch_size=8, max_length=512, threshold=0.25, elapsed_seconds=1.5)
    files.write_document(info, f"{tmp_path}/run_info.json")
    assert json.loads((tmp_path / "run_info.json").read_text()) == info and list(info)[:3] == ["model", "adapter_path", "input_mode"]


def test_variant_order(spark):
    order = [v[0] for v in obfuscate.VARIANTS]
    rows = [(f"{k:02}", v) for k in range(30) for v in order]
    df = spark.createDataFrame(rows, "id string, variant string").repartition(5)
    found = [(r.id, r.variant) for r in align.in_variant_order(df, obfuscate.variants(spark)).orderBy("place").collect()]
    assert found == sorted(rows, key=lambda r: (order.index(r[1]), r[0]))
