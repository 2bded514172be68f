"""Finding inputs by name through Spark's file index, so that any store Spark reads will do."""

from __future__ import annotations

import re
import tarfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelix.sources.streams import opened


def files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, name, depth, modified, length of all files under root whose names match the glob."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", F.col("modificationTime").alias("modified"), "length")
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.size(F.split("path", "/")).alias("depth"), "modified", "length")


def find(spark: SparkSession, root: str, names: Sequence[str]) -> str | None:
    """A file directly under root with one of the names, the first name that there is one for; else the shallowest of
    all files with any of the names in any case, ties by path in any case."""
    top = spark.read.format("binaryFile").load(root).select("path").where(F.element_at(F.split("path", "/"), -1).isin(list(names)))
    direct = {r["path"].rpartition("/")[2]: r["path"] for r in top.collect()}  # no more than there are names
    for name in names:
        if name in direct:
            return direct[name]
    hit = files(spark, root).where(F.lower("name").isin([n.lower() for n in names])).orderBy("depth", F.lower("path"), "path").first()
    return hit["path"] if hit else None


def with_suffix(spark: SparkSession, root: str, suffixes: Sequence[str]) -> DataFrame:
    """All files whose names end in one of the suffixes, in any case, in the order of their paths in any case."""
    ends = F.lit(False)
    for s in suffixes:
        ends |= F.lower("name").endswith(s.lower())
    return files(spark, root).where(ends).orderBy(F.lower("path"), "path")


def newest(spark: SparkSession, root: str, glob: str) -> str | None:
    hit = files(spark, root, glob).orderBy(F.desc("modified"), "path").first()
    return hit["path"] if hit else None


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """Members of tar archives, read as streams: archive, member (its name without folders), size, sidecar (a name that
    starts with ._), clean_name (without that), pair of genomes (N_M, what stands before the clean name's first dot)
    and category (by words in the clean name)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for archive in batch["path"]:
                with opened(archive) as stream, tarfile.open(fileobj=stream, mode="r|*") as tar:
                    for m in tar:
                        if m.isdir():
                            continue
                        name = m.name.rstrip("/").rpartition("/")[2]
                        clean = name.removeprefix("._")
                        pair = re.match(r"^(\d+)_(\d+)$", clean.partition(".")[0])
                        kind = "tandem_duplicates" if "tandems" in clean else "syntenic_alignment" if "aligncoords" in clean else "other"
                        rows.append((archive, name, m.size, name.startswith("._"), clean, pair[1] if pair else "", pair[2] if pair else "", kind))
            yield pd.DataFrame(rows, columns=["archive", "member", "size", "sidecar", "clean_name", "genome_a", "genome_b", "category"])

    found = spark.read.format("binaryFile").load(path).select("path")
    return found.mapInPandas(run, "archive string, member string, size long, sidecar boolean, clean_name string, genome_a string, genome_b string, category string")
