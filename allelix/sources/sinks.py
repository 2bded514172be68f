"""Sinks: bundles of named tables with a manifest, FASTA text and JSON status documents."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelix.sources.streams import digests


MANIFEST = "manifest.json"


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of the path, and its Path class."""
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _replace(spark: SparkSession, source: str, target: str) -> None:
    """Rename over what is there, in one step where the file system can."""
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs
    how = sc._gateway.new_array(hadoop.Options.Rename, 1)
    how[0] = hadoop.Options.Rename.OVERWRITE
    files = hadoop.FileContext.getFileContext(_files(spark, target)[0].getUri(), sc._jsc.hadoopConfiguration())
    files.rename(hadoop.Path(source), hadoop.Path(target), how)


def _committed(spark: SparkSession, path: str) -> dict | None:
    """The manifest of the bundle at path, or None."""
    fs, at = _files(spark, path)
    if not fs.exists(at(f"{path}/{MANIFEST}")):
        return None
    return json.loads(spark.read.text(f"{path}/{MANIFEST}", wholetext=True).first()["value"])


def _read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.option("header", True).csv(path) if kind == "csv" else spark.read.parquet(path)


def write_tables(tables: Mapping[str, DataFrame], path: str, kind: str = "parquet", descriptions: Mapping[str, str] | None = None) -> DataFrame:
    """Each table as a folder under path; returns the manifest (table, description, columns, rows, bytes, sha256 of its
    files' digests), computed by Spark from what was written; files are hashed as streams.

    A bundle is whole or not there: tables go to a version's folder, where the manifest is worked out, and count once
    ``manifest.json``, which names the version, is renamed into place. A run that fails leaves the bundle before it as
    it was, and tables may be read from the bundle that they replace; the version before is deleted after the commit,
    as are versions that failed."""
    spark = next(iter(tables.values())).sparkSession
    fs, at = _files(spark, path)
    version = f"_version-{uuid.uuid4().hex}"
    for name, df in tables.items():
        writer = df.write.mode("error")
        writer.option("header", True).csv(f"{path}/{version}/{name}") if kind == "csv" else writer.parquet(f"{path}/{version}/{name}")
    parts = []
    for name, df in tables.items():
        files = digests(spark.read.format("binaryFile").load(f"{path}/{version}/{name}").where(F.col("length") > 0))
        digest = files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ""), 256).alias("sha256"), F.sum("length").alias("bytes"))
        n = _read(spark, f"{path}/{version}/{name}", kind).agg(F.count("*").alias("rows"))
        parts.append(digest.crossJoin(n).select(F.lit(name).alias("table"), F.lit((descriptions or {}).get(name, "")).alias("description"), F.lit(len(df.columns)).alias("columns"), "rows", "bytes", "sha256"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rows = [r.asDict() for r in out.collect()]  # one for each table
    text = json.dumps({"version": version, "kind": kind, "tables": rows}, indent=2)
    stream = fs.create(at(f"{path}/{version}/{MANIFEST}"), True)
    stream.write(bytearray(text.encode()))
    stream.close()
    _replace(spark, f"{path}/{version}/{MANIFEST}", f"{path}/{MANIFEST}")
    for found in fs.listStatus(at(path)):
        name = found.getPath().getName()
        if name.startswith("_version-") and name != version:
            fs.delete(found.getPath(), True)
    return spark.createDataFrame([tuple(r.values()) for r in rows], out.schema)


def read_tables(spark: SparkSession, path: str, required: Mapping[str, list[str]]) -> dict[str, DataFrame]:
    """The bundle's required tables, each checked for its columns. Folders of Parquet tables without a manifest, which
    others wrote, are read as they are."""
    found, manifest = {}, _committed(spark, path)
    names = {t["table"] for t in manifest["tables"]} if manifest else set(required)
    for name, columns in required.items():
        if name not in names:
            raise ValueError(f"table {name} is missing from {path}")
        df = _read(spark, f"{path}/{manifest['version']}/{name}", manifest["kind"]) if manifest else _read(spark, f"{path}/{name}", "parquet")
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise ValueError(f"table {name}: missing columns {missing}")
        found[name] = df
    return found


def write_fasta(records: DataFrame, path: str, width: int = 80) -> None:
    """record_id, description, sequence as wrapped text."""
    head = F.concat(F.lit(">"), "record_id", F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(" "), "description")).otherwise(""))
    body = F.rtrim(F.regexp_replace("sequence", f"(.{{{width}}})", "$1\n"), F.lit("\n"))
    records.select(F.concat_ws("\n", head, body)).write.mode("overwrite").text(path)


def status_document(row: DataFrame) -> str:
    """A one-row table as indented JSON."""
    return json.dumps(row.limit(1).toPandas().to_dict("records")[0], indent=2, default=str, ensure_ascii=False)
