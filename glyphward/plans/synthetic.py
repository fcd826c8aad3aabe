"""Benchmark data made from the test tables: five systems score labelled documents in five variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import uniform
from ..operators.obfuscate import VARIANTS, variants
from ..operators.spread import spread, tasks  # noqa: F401

SYSTEMS = ("alpha_clean", "beta_mix", "gamma_mix", "delta_chat", "epsilon_raw")
THRESHOLD = 0.4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label): documents with a toxicity label."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("label"))
    return docs.join(labels, "id")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(system, variant, id, label, score): the better the rank, the more the label weighs."""
    systems = spark.createDataFrame([(s, i) for i, s in enumerate(SYSTEMS)], "system string, system_rank int")
    dims = systems.crossJoin(F.broadcast(variants(spark).select("variant", "variant_rank")))
    rows = truth(spark, sf_dir).crossJoin(F.broadcast(dims))
    key = F.concat_ws("|", "system", "variant", F.col("id").cast("string"))
    weight = 0.5 - 0.05 * F.col("system_rank") - 0.05 * F.col("variant_rank")
    # epsilon_raw was never run on the last variant.
    rows = rows.filter((F.col("system") != SYSTEMS[-1]) | (F.col("variant_rank") < len(VARIANTS) - 1))
    return rows.select("system", "variant", "id", "label", (weight * F.col("label") + (1 - weight) * uniform(key)).alias("score"), uniform(F.concat(key, F.lit("|pf"))).alias("luck"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with pred_label; about two in a hundred answers could not be read."""
    hit = F.when(F.col("luck") >= 0.02, (F.col("score") >= THRESHOLD).cast("int"))
    return scored(spark, sf_dir).select("system", "variant", "id", "label", "score", hit.alias("pred_label"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else repr(x) for x in r) + ")" for r in rows)


U = "(('0x' || substr(md5({}), 1, 8))::UBIGINT / 4294967296.0)"
#: The same data as common table expressions.
SQL = f"""
variants(variant, variant_rank, variant_label) AS (VALUES {_values([(v[0], i, v[3]) for i, v in enumerate(VARIANTS)])}),
systems(system, system_rank) AS (VALUES {_values([(s, i) for i, s in enumerate(SYSTEMS)])}),
truth AS (SELECT d.doc_id AS id, l.toxic::INT AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
scored AS (
    SELECT system, variant, id, label,
           (0.5::DOUBLE - 0.05::DOUBLE * system_rank - 0.05::DOUBLE * variant_rank) AS w,
           (0.5::DOUBLE - 0.05::DOUBLE * system_rank - 0.05::DOUBLE * variant_rank) * label
             + (1 - (0.5::DOUBLE - 0.05::DOUBLE * system_rank - 0.05::DOUBLE * variant_rank)) * {U.format("system || '|' || variant || '|' || id")}::DOUBLE AS score,
           {U.format("system || '|' || variant || '|' || id || '|pf'")} AS luck
    FROM truth, systems, variants WHERE system <> '{SYSTEMS[-1]}' OR variant_rank < {len(VARIANTS) - 1}),
predictions AS (SELECT system, variant, id, label, score, CASE WHEN luck >= 0.02 THEN (score >= {THRESHOLD}::DOUBLE)::INT END AS pred_label FROM scored)
"""
COUNTS = """count(*) AS rows, count(pred_label) AS valid_predictions, count(*) - count(pred_label) AS parse_failures,
    count(*) FILTER (label = 0 AND pred_label = 0) AS tn, count(*) FILTER (label = 0 AND pred_label = 1) AS fp,
    count(*) FILTER (label = 1 AND pred_label = 0) AS fn, count(*) FILTER (label = 1 AND pred_label = 1) AS tp"""
#: Metrics from a relation with those counts.
DERIVED = """rows, valid_predictions, parse_failures,
    CASE WHEN valid_predictions > 0 THEN parse_failures / greatest(1, rows) ELSE 1.0::DOUBLE END AS parse_failure_rate,
    CASE WHEN valid_predictions > 0 THEN (tp + tn) / valid_predictions END AS accuracy,
    CASE WHEN valid_predictions > 0 THEN (coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / ((tp + fn > 0)::INT + (tn + fp > 0)::INT) END AS balanced_accuracy,
    CASE WHEN valid_predictions > 0 THEN (coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0))
      / ((tp + fn + fp > 0)::INT + (tn + fp + fn > 0)::INT) END AS macro_f1,
    CASE WHEN valid_predictions > 0 THEN coalesce(tp / nullif(tp + fp, 0), 0) END AS hate_precision,
    CASE WHEN valid_predictions > 0 THEN coalesce(tp / nullif(tp + fn, 0), 0) END AS hate_recall,
    CASE WHEN valid_predictions > 0 THEN fn / greatest(1, fn + tp) END AS fnr, CASE WHEN valid_predictions > 0 THEN fp / greatest(1, fp + tn) END AS fpr,
    CASE WHEN valid_predictions > 0 THEN (tp + fp) / valid_predictions END AS predicted_hate_rate,
    CASE WHEN valid_predictions > 0 THEN (fn / greatest(1, fn + tp) + fp / greatest(1, fp + tn)) / 2 END AS balanced_error,
    CASE WHEN valid_predictions > 0 THEN greatest(fn / greatest(1, fn + tp), fp / greatest(1, fp + tn)) END AS max_failure_rate,
    tn, fp, fn, tp"""
DENSE = f"""dense AS (
    SELECT s.system, v.variant, v.variant_rank, v.variant_label, coalesce(rows, 0) AS rows, coalesce(valid_predictions, 0) AS valid_predictions,
           coalesce(parse_failures, 0) AS parse_failures, coalesce(tn, 0) AS tn, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, coalesce(tp, 0) AS tp
    FROM (SELECT DISTINCT system FROM predictions) s CROSS JOIN variants v LEFT JOIN (SELECT system, variant, {COUNTS} FROM predictions GROUP BY ALL) c
      ON c.system = s.system AND c.variant = v.variant),
metrics AS (SELECT system, variant, variant_label, variant_rank, {DERIVED} FROM dense)"""
