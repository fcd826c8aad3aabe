"""Tables of a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import display_name, markdown_number, parse_label, parsed_name
from ..sources.files import read_tables
from .align import checked_left_join, keep_last, require, union
from .metrics import metrics, system_ranking

#: Prefixes of systems whose answers came from a chat page.
CHAT_PREFIXES = ("chatgpt", "claude", "gemini_free", "grok_free")


def is_chat(system: Column) -> Column:
    found = F.lit(False)
    for prefix in CHAT_PREFIXES:
        found = found | system.startswith(prefix)
    return found


def hardest_variant(metrics: DataFrame, variant: str = "roman_glyph_70") -> DataFrame:
    """Systems on one variant, best first."""
    order = Window.orderBy(F.col("balanced_accuracy").desc_nulls_last(), "system")
    rows = metrics.filter(F.col("variant") == variant)
    return rows.select("system", "variant", "balanced_accuracy", "macro_f1", "fnr", "fpr").withColumn("place", F.row_number().over(order))


def stages(metrics: DataFrame, systems: list[str]) -> DataFrame:
    """The listed systems, in the order listed, and their variants in theirs."""
    listed = metrics.sparkSession.createDataFrame([(s, i) for i, s in enumerate(systems)], "system string, stage int")
    return metrics.join(F.broadcast(listed), "system").select("stage", "system", "variant", "balanced_accuracy", "balanced_accuracy_drop_from_clean")


def error_examples(predictions: DataFrame, requests: list[tuple[str, str, int, int, str]], most: int = 20, key: str = "id") -> DataFrame:
    """For each request (system, variant, label, pred_label, error_type) the first rows by key."""
    wanted = predictions.sparkSession.createDataFrame(requests, "system string, variant string, label int, pred_label int, error_type string")
    rows = predictions.join(F.broadcast(wanted), ["system", "variant", "label", "pred_label"])
    place = F.row_number().over(Window.partitionBy("error_type").orderBy(key))
    return rows.withColumn("place", place).filter(F.col("place") <= most)


def missing_systems(metrics: DataFrame, wanted: list[str]) -> DataFrame:
    listed = metrics.sparkSession.createDataFrame([(s,) for s in wanted], "system string")
    return listed.join(metrics.select("system").distinct(), "system", "left_anti")


def winner(ranking: DataFrame) -> DataFrame:
    return ranking.filter("rank = 1").select("system", "worst_case_balanced_accuracy", F.format_string(
        "%s has the best worst-case balanced accuracy, %.3f.", "system", "worst_case_balanced_accuracy").alias("conclusion"))


#: Columns of a file of metrics, and those without which a file is none.
METRIC_FILE = {c: "STRING" for c in ("system", "split", "variant")} | {
    c: "DOUBLE" for c in ("balanced_accuracy", "macro_f1", "max_failure_rate", "fnr", "fpr", "predicted_hate_rate")} | {"parse_failures": "BIGINT"}
NEEDED = ("system", "variant", "balanced_accuracy")


def load_metrics(spark, path: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """Metrics by variant from all files of a pattern that have them; of each (system, split, variant) the last row in
    the order of the files' names counts."""
    rows = read_tables(spark, path, METRIC_FILE, required=NEEDED, skip=skip)
    return keep_last(rows, ["system", "split", "variant"], F.col("source_path"), F.col("source_row")).drop("source_path", "source_row")


def listed_only(metrics: DataFrame, systems: list[str] | None) -> DataFrame:
    """Rows of the listed systems; all rows without a list."""
    return metrics if systems is None else metrics.filter(F.col("system").isin(systems))


def summary(metrics: DataFrame, plotted: list[str] | None = None, ranked: list[str] | None = None) -> DataFrame:
    """The summary of metrics by variant: systems from chat pages are ranked apart as a supplement, and the first of each
    part is its winner. Of the other systems those that are ``plotted`` belong to the main part, and of these the
    ``ranked`` ones have a rank."""
    main = listed_only(listed_only(metrics.filter(~is_chat(F.col("system"))), plotted), ranked)
    parts = []
    for part, rows in (("main", main), ("supplementary", metrics.filter(is_chat(F.col("system"))))):
        places = system_ranking(rows)
        parts.append(places.join(winner(places).select("system", "conclusion"), "system", "left").withColumn("part", F.lit(part)))
    return parts[0].unionByName(parts[1])


def findings(metrics: DataFrame, expected: dict[str, str], before: str, after: str, variant: str = "roman_glyph_70") -> DataFrame:
    """(topic, line): which expected systems (shown name to system) are missing, how a system stands on the hardest
    variant before a measure, and what changed with it."""
    at = F.col("variant") == variant
    value = lambda system, c: F.max(F.when(at & (F.col("system") == system), F.col(c)))
    names = {f"{when}_{c}": value(system, c) for when, system in (("b", before), ("a", after)) for c in ("balanced_accuracy", "fnr", "fpr", "predicted_hate_rate")}
    there = [F.max((F.col("system") == system).cast("int")).alias(f"has_{i}") for i, system in enumerate(expected.values())]
    found = metrics.agg(*there, *[v.alias(n) for n, v in names.items()])  # one row
    lacking = F.concat_ws(", ", *[F.when(F.coalesce(F.col(f"has_{i}"), F.lit(0)) == 0, label) for i, label in enumerate(expected)])
    first = F.format_string("BA %.3f, FNR %.3f, FPR %.3f, predicted hate rate %.3f", "b_balanced_accuracy", "b_fnr", "b_fpr", "b_predicted_hate_rate")
    change = F.format_string("BA %.3f to %.3f, FPR %.3f to %.3f", "b_balanced_accuracy", "a_balanced_accuracy", "b_fpr", "a_fpr")
    lines = {
        "missing": F.when(lacking == "", "none").otherwise(lacking), "before": F.when(F.col("b_balanced_accuracy").isNull(), "not evaluated yet").otherwise(first),
        "change": F.when(F.col("a_balanced_accuracy").isNull() | F.col("b_balanced_accuracy").isNull(), "not evaluated yet").otherwise(change)}
    return found.select(F.inline(F.array(*[F.struct(F.lit(topic).alias("topic"), line.alias("line")) for topic, line in lines.items()])))


def _answered(manifest: DataFrame, answers: dict[str, DataFrame]) -> DataFrame:
    """(system, id, variant, label, pred_label) of every system on every row of a manifest, or an error."""
    rows = []
    for system, given in answers.items():
        given = given.select("id", "variant", F.col("label").alias("answer"))
        joined = checked_left_join(require(manifest, "id", "variant", "label"), given, ["id", "variant"], complete="answer")
        rows.append(joined.select(F.lit(system).alias("system"), "id", "variant", "label", parse_label(F.col("answer")).alias("pred_label")))
    return union(rows)


def external_comparison(manifest: DataFrame, answers: dict[str, DataFrame], names: dict[str, str]) -> DataFrame:
    """Outside systems and models side by side on the rows of one manifest (id, variant, label): overall metrics, and the
    ranking by worst case, with display names. Every row must have been answered by every system."""
    every = _answered(manifest, answers)
    ranked = system_ranking(metrics(every, "system", "variant"))
    return named(metrics(every, "system").join(ranked.select("system", "worst_case_balanced_accuracy", "rank"), "system"), names)


def external_variants(manifest: DataFrame, answers: dict[str, DataFrame], names: dict[str, str]) -> DataFrame:
    """The same by variant, with the place on each variant by balanced accuracy."""
    place = F.row_number().over(Window.partitionBy("variant").orderBy(F.col("balanced_accuracy").desc_nulls_last(), "system"))
    return named(metrics(_answered(manifest, answers), "system", "variant").withColumn("place", place), names)


def run_info(model: str, *, input_mode: str, batch_size: int, max_length: int, threshold: float | None, elapsed_seconds: float, adapter_path: str | None = None,
             calibration_only: bool = False) -> dict:
    """What a run was made with, for ``write_document``."""
    return {
        "model": model, "adapter_path": adapter_path, "input_mode": input_mode, "batch_size": batch_size, "max_length": max_length, "calibrated_threshold": threshold,
        "calibration_only": calibration_only, "elapsed_seconds": elapsed_seconds}


def markdown_rows(df: DataFrame, order: str, places: int = 3) -> DataFrame:
    """(place, line): each row as a line of a table, numbers with fixed places, nulls as a dash."""
    cells = [
        markdown_number(F.col(f.name), places) if f.dataType.typeName() in ("double", "float") else F.coalesce(F.col(f.name).cast("string"), F.lit("-"))
        for f in df.schema.fields
    ]
    return df.select(F.col(order).alias("place"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def markdown(df: DataFrame, order: str, places: int = 3) -> str:
    """A small table as text; it is collected, so it is for reports."""
    head = [f"| {' | '.join(df.columns)} |", f"|{'---|' * len(df.columns)}"]
    return "\n".join(head + [r["line"] for r in markdown_rows(df, order, places).orderBy("place").collect()])


def named(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumn("display_name", display_name(F.col("system"), names))


def import_answers(manifest: DataFrame, answers: DataFrame, system: str) -> DataFrame:
    """Predictions of an outside system: each row of the manifest (id, variant, label) with its answer, read. Keys are
    unique on both sides; a row without an answer is one that could not be read, answers without a row are left out."""
    joined = checked_left_join(require(manifest, "id", "variant", "label"), require(answers, "id", "variant", "label").select("id", "variant", "label"), ["id", "variant"], suffix="_ui")
    read = parse_label(F.col("label_ui"))
    return joined.withColumns({"system": F.lit(system), "raw_output": F.col("label_ui"), "pred_label": read, "parsed_label": parsed_name(read)}).drop("label_ui")


def dataset_card(summary: DataFrame, title: str, order: str) -> str:
    """A short text with a table of the dataset's splits."""
    return f"# {title}\n\n{markdown(summary, order, 6)}\n"


def plot_data(metrics: DataFrame, value: str) -> DataFrame:
    """(series, x, x_order, y): what a line or bar chart of a metric over variants draws."""
    return metrics.select(F.col("system").alias("series"), F.col("variant_label").alias("x"), F.col("variant_rank").alias("x_order"), F.col(value).alias("y"))
