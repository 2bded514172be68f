"""Cutting lineage where a plan's parts must see the same partitions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fixed(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder that ``spark.checkpoint.dir`` names. Where a session names none, a local
    master gets a folder of its own, as in tests; on a cluster that is an error."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all machines share")
        context.setCheckpointDir(named or f"/tmp/spark-checkpoints-{context.applicationId}")
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for text that is written and read again; it goes when the application ends."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: name a folder that all machines share")
    path = f"{(named or f'/tmp/spark-checkpoints-{spark.sparkContext.applicationId}').rstrip('/')}/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of scratch(): for rows that several passes read, each of them some columns."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(value: Column) -> Column:
    """``value`` as a generated column (one for a select): filters that come later aren't moved before it, where they
    would compute it again for each of their terms."""
    return F.explode(F.array(value))
