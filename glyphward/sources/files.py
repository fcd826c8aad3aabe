"""Readers and writers. Schemas are always given; a null text reads as the empty string only where asked for."""

from __future__ import annotations

import csv
import functools
import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import UnsupportedOperationException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .answers import answered_by  # noqa: F401
from .remote import file_system, first_lines
from .scratch import deleted, scratch

S = {
    "raw": "document STRING, label STRING",
    "clean": "split STRING, id STRING, document STRING, obfuscated_document STRING, label STRING, is_hate_speech INT, perturbation_type STRING,"
    " syllable_obfuscation_ratio_target DOUBLE, glyph_letter_ratio_target DOUBLE, observed_glyph_char_ratio DOUBLE, source STRING",
    "benchmark": "split STRING, id STRING, variant STRING, text STRING, original_document STRING, label INT, original_label STRING, sample_order INT, normalized_text STRING",
    "scores": "split STRING, id STRING, variant STRING, label INT, text STRING, normalized_text STRING, score DOUBLE",
    "predictions": "split STRING, id STRING, variant STRING, label INT, text STRING, normalized_text STRING, score DOUBLE, system STRING, threshold DOUBLE,"
    " pred_label INT, parsed_label STRING, raw_output STRING",
    "answers": "id STRING, variant STRING, label STRING",
}


def _schema(name: str | T.StructType) -> str | T.StructType:
    return S.get(name, name) if isinstance(name, str) else name


def read_csv(spark: SparkSession, path: str | list[str], schema, *, sep: str = ",") -> DataFrame:
    """Quoted, multi-line CSV or TSV with a header."""
    options = {"sep": sep, "header": True, "quote": '"', "escape": '"', "multiLine": True, "enforceSchema": False}
    return spark.read.options(**options).schema(_schema(schema)).csv(path)


def read_jsonl(spark: SparkSession, path: str | list[str], schema) -> DataFrame:
    """One object a line; blank lines are dropped, and a line that is no object is an error."""
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    wrong = F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("value", 1, 80)))
    whole = F.when(F.json_object_keys("value").isNotNull(), F.col("value")).otherwise(wrong.cast("string"))
    return lines.select(F.from_json(whole, _schema(schema)).alias("row")).select("row.*")


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """Answers of an outside system: CSV by its ending, else JSON lines."""
    return read_csv(spark, path, "answers") if path.endswith(".csv") else read_jsonl(spark, path, "answers")


def read_glob(spark: SparkSession, path: str, schema, *, skip: tuple[str, ...] = (), paths: bool = False) -> DataFrame:
    """All files of a pattern with ``source_file``, their names, without the files named in ``skip``; with ``paths``
    also ``source_path``, which tells files of the same name in several folders apart."""
    df = read_csv(spark, path, schema).withColumn("source_file", F.col("_metadata.file_name"))
    df = df.withColumn("source_path", F.col("_metadata.file_path")) if paths else df
    return df.filter(~F.col("source_file").isin(*skip)) if skip else df


def read_tables(spark: SparkSession, path: str | list[str], columns: dict[str, str], *, required: tuple[str, ...] = (), skip: tuple[str, ...] = (), sep: str = ",") -> DataFrame:
    """The ``columns`` (name to type) of all CSV files of a pattern or folder that have the ``required`` ones, in any order
    and among others, with ``source_file``, ``source_path`` and ``source_row``, which grows within a file. Headers are read first, a line a file, and files of the same
    header are one scan; a column that a file lacks is null, an empty file is passed over."""
    heads = first_lines(spark, path).filter("line IS NOT NULL").groupBy("line").agg(F.array_sort(F.collect_list("path")).alias("paths"))  # the driver plans by file anyway
    parts = []
    for head in heads.orderBy("line").collect():
        names = next(csv.reader([head["line"]], delimiter=sep), [])
        if set(required) <= set(names) and (paths := [p for p in head["paths"] if p.rsplit("/", 1)[-1] not in skip]):
            kinds = ", ".join(f"`{n}` {columns.get(n, 'STRING')}" for n in names)
            rows = read_csv(spark, paths, T.StructType.fromDDL(kinds), sep=sep)
            found = [F.col(f"`{n}`") if n in names else F.lit(None).cast(kind).alias(n) for n, kind in columns.items()]
            parts.append(rows.select(*found, F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_path").alias("source_path"), F.monotonically_increasing_id().alias("source_row")))
    if not parts:
        return spark.createDataFrame([], ", ".join([*(f"`{n}` {kind}" for n, kind in columns.items()), "source_file string", "source_path string", "source_row bigint"]))
    return functools.reduce(DataFrame.unionByName, parts)


def one_row_files(df: DataFrame) -> DataFrame:
    """Fails when a file has not exactly one row; adds ``step``, the digits of ``run_name``."""
    n = df.groupBy("source_path" if "source_path" in df.columns else "source_file").agg(F.count(F.lit(1)).alias("n")).filter("n <> 1").count()
    if n:
        raise ValueError(f"files without exactly one row: {n}")
    return df.withColumn("step", F.regexp_replace("run_name", "[^0-9]", "").cast("int"))


def with_row_ids(df: DataFrame, split: str) -> DataFrame:
    """``idx``, the row's place in the order the rows are read, and ``id``, split and place. The place within a
    partition is in Spark's own numbering; sizes of partitions (a row each) are summed up and broadcast. ``df`` has
    to give the same partitions twice, as a scan does."""
    placed = df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_before"))
    numbered = placed.join(F.broadcast(starts), "_part").withColumn("idx", F.col("_before") + F.col("_at") - F.shiftleft("_part", 33))
    return numbered.select(*df.columns, "idx", F.format_string(f"{split}_%06d", "idx").alias("id"))


def standardized(raw: DataFrame, split: str, source: str) -> DataFrame:
    """Raw (document, label) as the clean schema; ``source`` names the corpus."""
    from ..functions.labels import binary_label

    rows = with_row_ids(raw, split)
    return rows.select(
        F.lit(split).alias("split"), "id", "document", F.col("document").alias("obfuscated_document"), "label", binary_label(F.col("label")).alias("is_hate_speech"),
        F.lit("clean").alias("perturbation_type"), F.lit(0.0).alias("syllable_obfuscation_ratio_target"), F.lit(0.0).alias("glyph_letter_ratio_target"),
        F.lit(0.0).alias("observed_glyph_char_ratio"), F.lit(source).alias("source"))


def benchmark_rows(df: DataFrame, variant: str) -> DataFrame:
    """Standardized rows as benchmark rows: the text is the obfuscated one but for the clean variant."""
    text = F.col("document" if variant == "clean" else "obfuscated_document")
    return df.select(
        "split", F.col("id").cast("string").alias("id"), F.lit(variant).alias("variant"), F.coalesce(text, F.lit("")).alias("text"),
        F.coalesce("document", F.lit("")).alias("original_document"), F.col("is_hate_speech").cast("int").alias("label"), F.col("label").cast("string").alias("original_label"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, quote='"', escape='"', emptyValue="").csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line; characters beyond ASCII stay as they are."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    """Parquet in folders by column, so that readers of one variant or split read no other."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def append_done(df: DataFrame, path: str) -> None:
    """Adds finished rows of a run that can be resumed."""
    df.write.mode("append").parquet(path)


def append_note(folder: str, lines: list[str]) -> None:
    """Lines as one new file in a folder, written inside a task and seen whole or not at all."""
    system, inside = file_system(folder)
    system.create_dir(inside, recursive=True)
    name = uuid.uuid4().hex
    with system.open_output_stream(f"{inside}/_{name}") as file:
        file.write("".join(f"{line}\n" for line in lines).encode())
    system.move(f"{inside}/_{name}", f"{inside}/{name}.txt")


def write_document(row: dict, path: str) -> None:
    """A small JSON document, written by the driver."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(row, ensure_ascii=False, indent=2) + "\n")


def write_archive(paths: list[str], target: str, root: str) -> None:
    """A zip file of files that the driver can read, sorted, named relative to ``root``; an older one is replaced."""
    import os
    import zipfile

    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(paths):
            archive.write(path, os.path.relpath(path, root))


def concatenated(splits: dict[str, DataFrame]) -> DataFrame:
    """Splits one after the other, with their place."""
    out = None
    for rank, (name, df) in enumerate(splits.items()):
        part = df.withColumn("split", F.lit(name)).withColumn("split_rank", F.lit(rank))
        out = part if out is None else out.unionByName(part)
    return out


def write_ordered(splits: dict[str, DataFrame], path: str, order: str, *, parts: int | None = None) -> None:
    """One CSV file: a header, then the splits one after the other, each in the order of a column. Rows are dealt by range
    and written as parts whose names follow the order; the parts are joined by the file system where it can (HDFS),
    else by one task that copies their bytes in order. An older file is replaced when the new one is whole."""
    spark = next(iter(splits.values())).sparkSession
    rows = concatenated(splits)
    columns = [c for c in rows.columns if c not in ("split", "split_rank")]
    folder = scratch(spark, "ordered")
    dealt = rows.repartitionByRange(*([parts] if parts else []), "split_rank", order).sortWithinPartitions("split_rank", order)
    dealt.select(*[F.col(c).cast("string") for c in columns]).write.options(header=False, quote='"', escape='"', emptyValue="").csv(f"{folder}/parts")
    head = spark.createDataFrame([columns], ", ".join(f"`{c}` string" for c in columns))
    head.coalesce(1).write.options(header=False, quote='"', escape='"', emptyValue="").csv(f"{folder}/head")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(conf)
    names = [str(s.getPath().toString()) for part in ("head", "parts") for s in sorted(
        jvm.org.apache.hadoop.fs.Path(f"{folder}/{part}").getFileSystem(conf).listStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/{part}")), key=lambda s: s.getPath().getName())
        if s.getPath().getName().startswith("part-") and s.getLen()]
    whole = jvm.org.apache.hadoop.fs.Path(names[0])
    try:
        array = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(names) - 1)
        for i, name in enumerate(names[1:]):
            array[i] = jvm.org.apache.hadoop.fs.Path(name)
        if len(names) > 1:
            system.concat(whole, array)
    except UnsupportedOperationException:
        whole = jvm.org.apache.hadoop.fs.Path(_copied(spark, names, f"{folder}/whole"))
    system.delete(target, False)
    if not system.rename(whole, target):
        raise OSError(f"cannot rename to {path}")
    deleted(spark, folder)


def _copied(spark: SparkSession, names: list[str], target: str) -> str:
    """The files one after the other, copied by one task a piece at a time."""

    def run(batches):
        for batch in batches:
            system, inside = file_system(target)
            with system.open_output_stream(inside) as out:
                for name in names:
                    source, at = file_system(name)
                    with source.open_input_stream(at) as file:
                        while data := file.read(4 << 20):
                            out.write(data)
            yield batch

    spark.range(1).coalesce(1).mapInArrow(run, "id bigint").collect()
    return target


def scored_by(df: DataFrame, scorer: Callable[[], Callable[[list], list[float]]], *, text: str = "text", batch: int = 8,
              encode: Callable[[], Callable[[str], list[int]]] | None = None, most: int = 512, pad: int = 0) -> DataFrame:
    """``df`` with ``score`` from an outside model. ``scorer`` makes the model, once a task; it gets texts in batches
    and gives a number for each (a difference of logits, a probability). With ``encode``, which makes a tokenizer, it
    gets pairs of token ids and their number instead: the last ``most`` ids of a text, filled up on the right with
    ``pad`` to the longest of the batch, so the answer's place is always within them."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def filled(texts: list[str], ids_of) -> list[tuple[list[int], int]]:
        ids = [list(ids_of(t))[-most:] for t in texts]
        width = max(map(len, ids))
        return [(i + [pad] * (width - len(i)), len(i)) for i in ids]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score, ids_of = scorer(), encode() if encode else None
        for pdf in batches:
            texts = pdf[text].fillna("").tolist()
            parts = [texts[a:a + batch] for a in range(0, len(texts), batch)]
            yield pdf.assign(score=[float(x) for part in parts for x in score(filled(part, ids_of) if ids_of else part)])

    return df.mapInPandas(run, f"{columns}, score double")
