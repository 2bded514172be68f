"""Files opened inside tasks as streams, for what must be read byte by byte (archives, digests)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def opened(path: str):
    """A binary stream of a file on any store that Arrow reaches (local, HDFS, S3, GCS)."""
    store, at = _store(path)
    # What ends in .gz is handed on as it is.
    return store.open_input_stream(at, compression=None)


def digests(files: DataFrame) -> DataFrame:
    """path, sha256, length of files (path), a megabyte of each in memory at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                found, size = hashlib.sha256(), 0
                with opened(path) as stream:
                    while block := stream.read(1 << 20):
                        found.update(block)
                        size += len(block)
                rows.append((path, found.hexdigest(), size))
            yield pd.DataFrame(rows, columns=["path", "sha256", "length"])

    return files.select("path").mapInPandas(run, "path string, sha256 string, length long")


def _store(path: str):
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def seekable(path: str):
    """A binary file to be read from any place, on any store that Arrow reaches."""
    store, at = _store(path)
    return store.open_input_file(at)


def sink(path: str):
    """A binary stream to a new file."""
    store, at = _store(path)
    return store.open_output_stream(at, compression=None)


def moved(path: str, to: str) -> None:
    store, at = _store(path)
    store.move(at, _store(to)[1])


def folder(spark: SparkSession, path: str) -> None:
    """A new folder, made by the store that Spark uses; one that is there is an error."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(target):
        raise ValueError(f"{path} is there already")
    files.mkdirs(target)
