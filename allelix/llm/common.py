"""Helpers the operators share: cutting lineage in the shared folder, and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, a local master gets a folder of the session's
    own; on a cluster a machine's own folder would be lost with it, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all machines share")
        found = f"/tmp/spark-checkpoints-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _folder(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


#: With it, Spark deletes an execution's shuffle files as it ends, not when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str, instead_of: DataFrame | Iterable[DataFrame] | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: lineage ends there, and a lost executor costs
    a read. The shuffle files of its making go at once, as nothing reads them again. The table's go when the application
    ends, or when a later table is written ``instead_of`` this one (or of several); nothing but that table may then
    depend on them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _shuffles_go(spark):
        df.write.parquet(path)
    target, files = _folder(spark, path)
    files.deleteOnExit(target)
    found = spark.read.schema(df.schema).parquet(path)
    _places[found] = path
    for table in [instead_of] if isinstance(instead_of, DataFrame) else instead_of or []:
        if table in _places:
            old, files = _folder(spark, _places.pop(table))
            files.delete(old, True)
    return found


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns (an input's further columns never meet an operator's own names)."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}; found {df.columns}")
    return df.select(*[F.col(f"`{c}`") for c in columns])


def with_columns(docs: DataFrame, measure: Callable[[pa.Array], object], name: str, column: str = "text") -> DataFrame:
    """All columns of docs, and what ``measure`` makes of the column's batches, as doubles named ``name``."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    at = docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(measure(batch.column(at)), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


#: Rows of a key from which it may count as heavy.
HEAVY = 1_000


def met(rows: DataFrame, facts: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """rows joined with facts (keys…, n: the rows of a key, and more; one row a key), without n. Keys that hold more
    than a share of all ``total`` rows, of which there are no more than four for each shuffle partition, are broadcast,
    so that a hot key's rows aren't gathered in a task."""
    share = max(HEAVY, total // (4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    if total <= share:
        return rows.join(facts.drop(n), keys)
    more = [c for c in facts.columns if c not in (*keys, n)]
    heavy = facts.where(F.col(n) > share).select(*keys, F.struct(*more).alias("_facts"))
    tagged = rows.join(F.broadcast(heavy), keys, "left")
    light = tagged.where("_facts is null").drop("_facts").join(facts.where(F.col(n) <= share).drop(n), keys)
    return tagged.where("_facts is not null").select(*rows.columns, "_facts.*").unionByName(light.select(*rows.columns, *more))


def _with_least(edges: DataFrame, at: list[str], total: int) -> DataFrame:
    """edges (at…, v) with m, the least v of their node."""
    return met(edges, edges.groupBy(*at).agg(F.min("v").alias("m"), F.count("*").alias("_n")), at, "_n", total)


def _stars(key: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of graphs, one for each key, as stars: (key, node, the least node that these edges join it to)."""
    keys, of = np.unique(key, return_inverse=True)
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    both, at = np.unique(np.concatenate([of, of]) * len(nodes) + ends, return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(both))
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        for x in (a, b):
            np.minimum.at(after, x, low)
            np.minimum.at(after, root[x], low)
        while (after[after] != after).any():
            after = after[after]
        if (after == root).all():
            break
        root = after
    far = np.flatnonzero(root != np.arange(len(both)))
    return keys[both[far] // len(nodes)], nodes[both[far] % len(nodes)], nodes[both[root[far]] % len(nodes)]


#: Edges that a task holds at a time when it turns its own into stars.
CHUNK = 1 << 20


def _contracted(edges: DataFrame, key: list[str]) -> DataFrame:
    """edges (key, u, v) as stars of each task's edges: what a task joins by itself needs no rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            found = _stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["_key", "u", "v"])

        for batch in batches:
            if len(batch):
                held.append([np.asarray(c, np.int64) for c in batch.columns])
                size += len(batch)
            if size >= CHUNK:
                yield flush()
                size = 0
        if held:
            yield flush()

    found = edges.select(F.col(key[0]).cast("long") if key else F.lit(0).cast("long"), "u", "v").mapInArrow(run, "_key long, u long, v long")
    return found.select(*[F.col("_key").alias(k) for k in key], "u", "v")


def connected_components(edges: DataFrame, within: str | None = None) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node reachable. within: a
    column of whole numbers whose values are graphs of their own; it is returned too.

    Edges that repeat count once. Each task turns its own into stars first, a chunk at a time. Then large and small stars alternate: each round moves every edge
    towards its neighbourhood's minimum, and the number of rounds grows with the logarithm of the longest chain.
    Neighbourhoods meet as aggregates (combined
    before the shuffle) and joins that hubs take no part in, so a hub is never gathered in one task. Rounds
    end when all that is left are stars.
    """
    key = [within] if within else []
    at = [*key, "u"]

    def unfinished(e: DataFrame) -> tuple[int, int]:
        """(edges, nodes that have several, or have one and end others): without any of these, all are stars."""
        ends = e.select(*at, F.lit(1).alias("_from"), F.lit(0).alias("_to")).unionByName(e.select(*key, F.col("v").alias("u"), F.lit(0).alias("_from"), F.lit(1).alias("_to")))
        nodes = ends.groupBy(*at).agg(F.sum("_from").alias("_from"), F.max("_to").alias("_to"))
        total, bad = nodes.agg(F.sum("_from"), F.count_if((F.col("_from") > 1) | ((F.col("_from") > 0) & (F.col("_to") > 0)))).first()
        return total or 0, bad

    first = written(edges.select(*key, F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u > v").distinct(), "cc")
    chunks = -(-first.count() // CHUNK)
    e = written(_contracted(first.coalesce(max(1, chunks)), key), "cc", instead_of=first)
    # A single chunk's stars are the whole graph's.
    total, bad = unfinished(e) if chunks > 1 else (0, 0)
    while bad:
        both = e.unionByName(e.select(*key, F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, at, 2 * total).withColumn("m", F.least("u", "m"))
        large = large.where("v > u").select(*key, F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = _with_least(large, at, total)
        small = least.select(*key, F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(least.select(*at, F.col("m").alias("v")))
        e = written(small.distinct(), "cc", instead_of=e)
        total, bad = unfinished(e)
    roots = e.select(*key, F.col("v").alias("node")).distinct()
    return e.select(*key, F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select(*key, "node", F.col("node").alias("component")))
