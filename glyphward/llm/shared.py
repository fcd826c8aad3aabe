"""What the operators of this subpackage share: the folder all executors see, written tables, tokens."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, as a Java regex class: \x20 and \x09-\x0D.
SPACE = r"\x20\x09-\x0D"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context_dir = spark.sparkContext.getCheckpointDir()
    if found:
        if not context_dir:
            spark.sparkContext.setCheckpointDir(found)
        return found
    if context_dir:
        return context_dir
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="glyphward-"))
    return spark.sparkContext.getCheckpointDir()


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended; the folder's owner clears it
        pass


#: Spark's own setting: shuffle files go as soon as the query that made them has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def cleaned_up(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside leave no shuffle files behind."""
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: lineage is cut, lost executors cost
    nothing, and what is not deterministic (partition ids, running offsets) is fixed. Its shuffle files go when it is
    written; the table itself goes by :func:`drop_written`, or when Python exits."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/glyphward-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    with cleaned_up(spark):
        df.write.options(compression="zstd", **options).parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(schema).parquet(path)


def drop_written(*tables: DataFrame | None) -> None:
    """Deletes tables from :func:`written` that no later step reads."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()} if df is not None else ():
            _delete(df.sparkSession, folder)


def word_count(text: str = "text"):
    """Number of words (runs without white space); null: 0. Native."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def as_text(column: str):
    """The column as bytes for Arrow: white-space splitting of bytes is exactly the contracts' class."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, data, d1, d2, r): the text's bytes, 128 bits of hashes of it, and a hash of id and text."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), as_text(text_col).alias("data"))
    rows = rows.withColumns({"d1": F.xxhash64(F.lit(1), "data"), "d2": F.xxhash64(F.lit(2), F.length("data"), "data")})
    return rows.withColumn("r", F.xxhash64("id", "d1", "d2"))

