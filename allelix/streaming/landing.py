"""Incremental scans of a landing folder of variant text, as Structured Streaming aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelix.functions.scalars import window_start
from allelix.sources.readers import vcf_records


def window_counts(spark: SparkSession, folder: str, width: int = 1_000_000) -> DataFrame:
    """Variants by tumbling window over all files that land, kept up by state as large as there are windows."""
    text = spark.readStream.text(folder)
    return vcf_records(text).groupBy("contig", window_start("pos", width).alias("window_start")).agg(F.count("*").alias("n_variants"))
