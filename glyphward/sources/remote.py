"""Files read and written inside tasks, on any file system that the path's scheme names."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def file_system(path: str):
    """(file system, path in it) of a Hadoop-style path."""
    from pyarrow import fs

    path = quote(path, safe="/:@")
    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


def listed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, length) of the files below a path. Scans pass over empty files, so these are added from the list of files
    that the driver plans by."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    names = [(re.sub("^file:/+", "file:/", unquote(name)),) for name in files.inputFiles()]
    every = spark.createDataFrame(names, "path string")
    return every.join(files.select("path", "length"), "path", "left").na.fill(0, ["length"])


def manifest(spark: SparkSession, path: str, piece: int = 4 << 20) -> DataFrame:
    """(path, length, sha256) of the files below a folder. A file is read by one task, a piece at a time, so its size does
    not matter; files are dealt out to all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name in batch.column(0).to_pylist():
                system, inside = file_system(name)
                digest = hashlib.sha256()
                with system.open_input_stream(inside) as file:
                    while data := file.read(piece):
                        digest.update(data)
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=["path", "length", "sha256"])

    files = listed(spark, path)
    return files.repartition("path").mapInArrow(run, "path string, length bigint, sha256 string")


def first_lines(spark: SparkSession, path: str | list[str], most: int = 1 << 20) -> DataFrame:
    """(path, line): the first line of each file, without a byte-order mark or line end; null for an empty file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = []
            for name, length in zip(*(c.to_pylist() for c in batch.columns)):
                if not length:
                    lines.append(None)
                    continue
                system, inside = file_system(name)
                with system.open_input_stream(inside) as file:
                    lines.append(file.read(most).split(b"\n")[0].rstrip(b"\r").decode("utf-8-sig"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.string())], names=["path", "line"])

    return listed(spark, path).repartition("path").mapInArrow(run, "path string, line string")
