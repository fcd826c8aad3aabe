"""Structured Streaming forms: running metrics, and a sink that a restarted run resumes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.metrics import METRICS, counts, from_counts


def running_metrics(predictions: DataFrame, *keys: str) -> DataFrame:
    """Metrics of a stream of predictions so far; state is one row of counts for each group. Complete output mode."""
    return from_counts(predictions.groupBy(*keys).agg(*counts())).select(*keys, *METRICS)


def windowed_metrics(predictions: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Metrics by tumbling window; rows later than ``late`` are dropped and closed windows leave the state."""
    grouped = predictions.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), *keys).agg(*counts())
    return from_counts(grouped).select("window", *keys, *METRICS)


#: Ranges of keys in a sink.
RANGES = 256


def resume_into(stream: DataFrame, path: str, checkpoint: str, keys: list[str], once: bool = True, ranges: int = RANGES) -> StreamingQuery:
    """Appends rows whose keys are not yet below ``path``, so a batch that is run again adds nothing. The sink has a folder
    for each range of the keys' hash (column ``key_range``), and a batch reads those that its own keys fall into."""
    place = F.pmod(F.xxhash64(*keys), F.lit(ranges)).cast("int")

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys).withColumn("key_range", place).persist()
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
                touched = [r[0] for r in fresh.select("key_range").distinct().collect()]  # as many as there are ranges
                new = fresh.join(present(spark, path, batch.schema, touched, keys), keys, "left_anti")
            else:
                new = fresh
            new.repartition("key_range").write.mode("append").partitionBy("key_range").parquet(path)
        finally:
            fresh.unpersist()

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def present(spark: SparkSession, path: str, schema, touched: list[int], keys: list[str]) -> DataFrame:
    """The keys that a sink has in some ranges; other ranges are not listed or read."""
    whole = StructType([*schema.fields, StructField("key_range", IntegerType())])
    return spark.read.schema(whole).parquet(path).filter(F.col("key_range").isin(touched)).select(*keys)
