"""Approximate nearest neighbours over balanced posting lists.

Largest inner product becomes least distance: every vector gets one more component that brings it to the largest norm,
queries get zero there. Centroids are fitted on a bounded sample, with a penalty on full clusters that balances the
lists. A vector goes to its nearest centroid's list, and near a boundary also to others that are nearly as close and
lie in other directions. Centroids are joined into an in-memory neighbour graph; a query walks it best-first and stops
where centroids are further than a given ratio of the nearest one's distance: that ratio alone selects lists, so
clustered queries read few and scattered ones many. Lists are stored in blocks of bounded size, met by blocks of
queries in an equi-join on the list, and each meeting keeps a query's best by exact inner products.

Lists grow in number with the vectors, not in length. Where that takes more centroids than CELLS, those found first are
cells: each cell fits centroids of its own on a bounded sample of its vectors, in a task, and vectors and queries that
reach the cell are dealt to its lists by the same rules, so no centroid graph is ever larger than CELLS.

Vectors that are null, zero, or hold null or non-finite components take no part, nor does a null vec_id. Vectors are
compared with others of their own number of components: the most frequent one, and each that more than SMALL rows have,
has an index; the rest are compared with all of their kind. Every row is one of its own, rows that repeat a vec_id, or both id and
vector, among them: only the query's own row isn't its neighbour. Ties go to the smaller vec_id. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelix.llm.common import met, require, written

#: Vectors, at most, that one graph's centroids are fitted on (least hashed ids), and bytes that these take at most.
SAMPLE, SAMPLE_BYTES = 65_536, 128 << 20
#: Vectors a list is meant to hold, and centroids of one graph at most.
LIST_SIZE, CELLS = 256, 4_096
#: A vector goes to further lists within this ratio of its nearest distance; at most so many.
COPY_RATIO, COPIES = 1.1, 4
#: A query reads the lists within this ratio of its nearest centroid's distance.
READ_RATIO = 1.2
BLOCK, QUERY_BLOCK, DEGREE = 1_024, 1_024, 24
#: Rows of one number of components up to which these are compared with all of their kind.
SMALL = 10_000


def lists_for(n: int) -> int:
    return max(1, round(n / LIST_SIZE))


def sample_size(components: int) -> int:
    return max(1, min(SAMPLE, SAMPLE_BYTES // (8 * components)))


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 12, weight: float = 0.3, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """k-means whose distances grow with the size that a cluster had a round before: centroids, members of each, and
    their mean squared distance."""
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), size=k, replace=False)].copy()
    penalty = np.zeros(k)
    for _ in range(rounds):
        nearest = np.concatenate([(((c * c).sum(1)[:, None] - 2 * c @ centers.T + (centers * centers).sum(1)) + penalty).argmin(1) for c in np.array_split(x, max(1, len(x) // 8192))])
        size = np.bincount(nearest, minlength=k)
        total = np.zeros_like(centers)
        np.add.at(total, nearest, x)
        full = size > 0
        centers[full] = total[full] / size[full, None]
        if (~full).any():  # an empty cluster starts anew at a member of the largest
            centers[~full] = x[rng.choice(np.flatnonzero(nearest == size.argmax()), size=int((~full).sum()))] + rng.normal(0, 1e-3, (int((~full).sum()), x.shape[1]))
        spread = np.median(((x[:2000] - centers[nearest[:2000]]) ** 2).sum(1))
        penalty = weight * spread * (size / (len(x) / k) - 1).clip(0, 10)
    away = np.zeros(k)
    np.add.at(away, nearest, ((x - centers[nearest]) ** 2).sum(1))
    return centers, size, away / np.maximum(size, 1)


@dataclass
class Index:
    """Centroids, each one's neighbours in the graph, the largest norm, and for each centroid the least squared
    distance that a query's ratio is taken of: its members' mean, or its nearest centroid's if it has few."""

    centers: np.ndarray
    near: np.ndarray
    top: float
    floor: np.ndarray

    @staticmethod
    def over(centers: np.ndarray, top: float, size: np.ndarray, away: np.ndarray) -> Index:
        few = np.full(len(centers), np.inf)
        k = len(centers)
        square = (centers * centers).sum(1)
        degree = min(DEGREE, k - 1)
        near = np.zeros((k, degree + 2), np.int64)
        for a in range(0, k, 1024):
            d = square - 2 * centers[a : a + 1024] @ centers.T
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
            few[a : a + 1024] = np.maximum((d + square[a : a + 1024, None]).min(1), 0)
            near[a : a + 1024, :degree] = np.argpartition(d, degree - 1, axis=1)[:, :degree] if degree else 0
        # A ring through all centroids keeps the graph in one piece.
        near[:, degree], near[:, degree + 1] = (np.arange(k) + 1) % k, (np.arange(k) - 1) % k
        return Index(centers, near, top, np.where(size >= 8, away, few))

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(self.top**2 - (x * x).sum(1), 0))[:, None]], 1)

    def lists(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of lifted vectors: the nearest centroid, and further ones across a boundary."""
        rows, lists = [], []
        for a in range(0, len(x), 2048):
            part = x[a : a + 2048]
            d = np.maximum((part * part).sum(1)[:, None] - 2 * part @ self.centers.T + (self.centers * self.centers).sum(1), 0)
            order = np.argpartition(d, min(COPIES, d.shape[1] - 1), axis=1)[:, :COPIES]
            dist = np.take_along_axis(d, order, 1)
            by = np.argsort(dist, axis=1, kind="stable")
            order, dist = np.take_along_axis(order, by, 1), np.take_along_axis(dist, by, 1)
            keep = dist <= COPY_RATIO**2 * dist[:, :1]
            for c in range(1, order.shape[1]):
                for b in range(c):  # a list that lies closer to one taken than the vector does says nothing new
                    keep[:, c] &= ~keep[:, b] | (((self.centers[order[:, c]] - self.centers[order[:, b]]) ** 2).sum(1) > dist[:, c])
            keep[:, 0] = True
            r, c = np.nonzero(keep)
            rows.append(r + a)
            lists.append(order[r, c])
        return (np.concatenate(rows), np.concatenate(lists)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def walk(self, q: np.ndarray) -> list[int]:
        """Lists of a lifted query, by best-first search of the graph."""
        seen = np.zeros(len(self.centers), bool)
        seen[0] = True
        best = float(((self.centers[0] - q) ** 2).sum())
        least = float(self.floor[0])
        heap, found = [(best, 0)], []
        patience = 0
        while heap:
            d, c = heapq.heappop(heap)
            if d > READ_RATIO**2 * max(best, least):
                patience += 1  # centroids beyond the ratio are crossed a little way, towards nearer ones
                if patience > DEGREE:
                    break
            else:
                found.append((d, c))
            new = self.near[c][~seen[self.near[c]]]
            if len(new):
                new = np.unique(new)
                seen[new] = True
                dist = ((self.centers[new] - q) ** 2).sum(1)
                if dist.min() < best:
                    best, patience = float(dist.min()), 0
                    least = float(self.floor[new[dist.argmin()]])
                for x, k in zip(dist.tolist(), new.tolist(), strict=True):
                    heapq.heappush(heap, (x, k))
        return [c for d, c in found if d <= READ_RATIO**2 * max(best, least)]


def usable(vectors: DataFrame) -> DataFrame:
    """row (a number of its own for each), vec_id, v of the vectors that take part; v: doubles. The numbers are fixed
    once this is written."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = require(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~bad & F.exists("v", lambda x: x != 0)).select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return np.array(flat, float).reshape(len(column), -1)


def fitted(sample: np.ndarray, top: float, lists: int) -> Index:
    """An index over so many lists, fitted on a sample of vectors whose norms are at most ``top``."""
    lifted = Index(np.zeros((1, 1)), np.zeros((1, 0), np.int64), top, np.zeros(1)).lift(sample)
    centers, size, away = balanced_centroids(lifted, min(lists, len(lifted)))
    return Index.over(centers, top, size, away)


def built(rows: DataFrame) -> tuple[Index, int]:
    """The index of rows (row, vec_id, v), of which there are some, and how many they are."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    n, top, components = rows.agg(F.count("*"), F.max(norm), F.max(F.size("v"))).first()
    # A bounded sample, which Arrow brings as packed doubles.
    sample = _matrix(rows.orderBy(F.xxhash64("vec_id"), "row").select("v").limit(sample_size(components)).toArrow().column(0))
    return fitted(sample, top, min(lists_for(n), CELLS)), n


def _dealt(index: Index, v: np.ndarray, asked: bool, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of vectors: where they are stored, or what queries read."""
    if not asked:
        return index.lists(index.lift(v))
    found = [list(range(len(index.centers))) if every else index.walk(np.append(q, 0.0)) for q in v]
    return np.repeat(np.arange(len(v)), [len(f) for f in found]), np.array([c for f in found for c in f], np.int64)


POSTED = "list long, row long, vec_id long, v array<double>"


def routed(rows: DataFrame, index: Index, asked: bool, every: bool = False) -> DataFrame:
    """list, row, vec_id, v: rows in the lists that hold them, or that they read as queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, lists = _dealt(index, _matrix(batch.column(2)), asked, every)
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int64()), *(batch.column(k).take(pa.array(row)) for k in range(3))], names=["list", "row", "vec_id", "v"])

    return written(rows.select("row", "vec_id", "v").mapInArrow(run, POSTED), "ann-lists")


def cells(posted: DataFrame, top: float) -> DataFrame:
    """Each cell's own centroids: list, components, centers, near, floor (packed)."""
    sizes = posted.groupBy("list").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("components"))
    sizes = sizes.withColumn("share", F.least(F.lit(1.0), F.least(F.lit(SAMPLE), F.floor(F.lit(SAMPLE_BYTES) / (8 * F.col("components")))) / F.col("n")))
    some = posted.join(sizes, "list").where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < F.col("share") * (1 << 30))

    def run(table: pa.Table) -> pa.Table:
        v = _matrix(table.column("v"))
        own = fitted(v, top, min(CELLS, lists_for(table.column("n")[0].as_py())))
        packed = {k: [np.ascontiguousarray(x).tobytes()] for k, x in (("centers", own.centers), ("near", own.near), ("floor", own.floor))}
        return pa.table({"list": table.column("list").slice(0, 1), "components": pa.array([v.shape[1]], pa.int32())} | packed)

    return written(some.select("list", "n", "v").groupBy("list").applyInArrow(run, "list long, components int, centers binary, near binary, floor binary"), "ann-cells")


def dealt_again(posted: DataFrame, own: DataFrame, top: float, asked: bool, every: bool = False) -> DataFrame:
    """Rows of cells in the cells' own lists; a cell's rows are dealt in blocks, each with the cell's centroids."""
    sizes = posted.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    left = posted.join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("row"), "blocks")).drop("blocks")
    right = own.join(sizes, "list").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")

    def run(rows: pa.Table, cell: pa.Table) -> pa.Table:
        if not rows.num_rows or not cell.num_rows:  # a query at a cell that no vector is in
            return rows.slice(0, 0).select(["list", "row", "vec_id", "v"])
        c = cell.slice(0, 1).to_pylist()[0]
        floor = np.frombuffer(c["floor"])
        index = Index(np.frombuffer(c["centers"]).reshape(len(floor), -1), np.frombuffer(c["near"], np.int64).reshape(len(floor), -1), top, floor)
        row, lists = _dealt(index, _matrix(rows.column("v")), asked, every)
        rows = rows.combine_chunks()
        return pa.table({"list": pa.array(c["list"] * (1 << 20) + lists, pa.int64())} | {k: rows.column(k).take(pa.array(row)) for k in ("row", "vec_id", "v")})

    return written(left.groupBy("list", "block").cogroup(right.groupBy("list", "block")).applyInArrow(run, POSTED), "ann-lists", instead_of=posted)


def _pack(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each group: its row numbers, ids and vectors, packed. Groups are dealt by all their keys at once, so
    that a list's parts don't meet in the task of their list."""

    def run(table: pa.Table) -> pa.Table:
        v = _matrix(table.column("v"))
        out = {k: table.column(k).slice(0, 1) for k in keys}
        ids = np.stack([np.asarray(table.column(k), np.int64) for k in ("row", "vec_id")], 1)
        return pa.table(out | {"ids": [ids.tobytes()], "data": [v.tobytes()]})

    slots = rows.withColumn("_slot", F.concat_ws(":", *keys))
    return slots.groupBy("_slot").applyInArrow(run, ", ".join(f"{k} long" for k in keys) + ", ids binary, data binary")


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def nearest(posted: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query in the lists it reads: query (its row), query_id, rank, vec_id, score."""

    def blocked(df: DataFrame, block: int, name: str) -> DataFrame:
        sizes = df.groupBy("list").agg(F.count("*").alias("_n"), F.ceil(F.count("*") / block).alias("blocks"))
        return _pack(met(df, sizes, ["list"], "_n", df.count()).withColumn(name, F.pmod(F.xxhash64("row"), "blocks")), ["list", name])

    lists = blocked(posted, BLOCK, "part")
    packs = blocked(asked, QUERY_BLOCK, "qpart").withColumnsRenamed({"ids": "qids", "data": "qdata"})
    kinds = {"query": pa.int64(), "query_id": pa.int64(), "rows": pa.list_(pa.int64()), "ids": pa.list_(pa.int64()), "scores": pa.list_(pa.float64())}

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in batch.to_pylist():
                held, qids = (np.frombuffer(pair[c], np.int64).reshape(-1, 2) for c in ("ids", "qids"))
                x, q = np.frombuffer(pair["data"]).reshape(len(held), -1), np.frombuffer(pair["qdata"]).reshape(len(qids), -1)
                rows, ids = held[:, 0], held[:, 1]
                found: list[tuple] = []
                for one, own, rough in zip(q, qids[:, 0], q @ x.T, strict=True):
                    rough = np.where(rows == own, -np.inf, rough)
                    cut = np.partition(rough, -min(k, len(rough)))[-min(k, len(rough))]
                    some = np.flatnonzero((rough >= cut - 1e-9 * max(1.0, abs(cut))) & (rows != own)) if np.isfinite(cut) else np.flatnonzero(rows != own)
                    exact = (x[some] * one).sum(1)
                    best = _best(ids[some], exact, k)
                    found.append((rows[some][best], ids[some][best], exact[best]))
                columns = [qids[:, 0], qids[:, 1], *([f[j] for f in found] for j in range(3))]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    best = lists.join(packs, "list").select("ids", "data", "qids", "qdata").mapInArrow(meet, "query long, query_id long, rows array<long>, ids array<long>, scores array<double>")

    def merge(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        flat = {c: np.asarray(table.column(c).combine_chunks().flatten()) for c in ("rows", "ids", "scores")}
        count = np.diff(np.asarray(table.column("ids").combine_chunks().offsets))
        f = pd.DataFrame({c: np.repeat(np.asarray(table.column(c)), count) for c in ("query", "query_id")} | {"row": flat["rows"], "vec_id": flat["ids"], "score": flat["scores"]})
        f = f.drop_duplicates(["query", "row"]).sort_values(["query", "score", "vec_id", "row"], ascending=[True, False, True, True])
        f["rank"] = f.groupby("query").cumcount() + 1
        return pa.Table.from_pandas(f.loc[f["rank"] <= k, ["query", "query_id", "rank", "vec_id", "score"]], preserve_index=False).cast(pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    # Queries meet in groups of some hundred.
    groups = max(1, asked.select("row").distinct().count() // 256)
    return best.groupBy(F.pmod(F.xxhash64("query"), F.lit(groups)).alias("g")).applyInArrow(merge, "query long, query_id long, rank int, vec_id long, score double")


def _indexed(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query among rows of one number of components."""
    index, n = built(rows)
    split = lists_for(n) > CELLS
    posted = routed(rows, index, False)
    own = cells(posted, index.top) if split else None
    if split:
        posted = dealt_again(posted, own, index.top, False)

    def ask(some: DataFrame, every: bool) -> DataFrame:
        asked = routed(some, index, True, every)
        return nearest(posted, dealt_again(asked, own, index.top, True, every) if split else asked, k)

    found = written(ask(queries, False), "ann-found")
    # Queries whose lists held fewer than k others read all lists.
    full = found.groupBy("query").count().where(F.col("count") >= min(k, n - 1)).select(F.col("query").alias("row"))
    short = written(queries.join(full, "row", "left_anti"), "ann-short")
    if n < 2 or short.isEmpty():
        return found
    return found.join(full.withColumnRenamed("row", "query"), "query", "left_semi").unionByName(ask(short, True))


def neighbours(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """vectors (vec_id, embedding); is_query: a condition on vec_id."""
    rows = written(usable(vectors).withColumn("components", F.size("v")), "ann-vectors")
    counts = rows.groupBy("components").count()
    # Numbers of components that more than SMALL rows have: few, whatever the rows.
    kinds = [r["components"] for r in counts.orderBy(F.desc("count"), "components").where(F.col("count") > SMALL).collect()]
    if not kinds:
        most = counts.orderBy(F.desc("count"), "components").first()
        kinds = [most["components"]] if most else []
    parts = [_indexed(rows.where(F.col("components") == c), rows.where(F.col("components") == c).where(is_query), k) for c in kinds]
    rest = rows.where(~F.col("components").isin(kinds)).select(F.col("components").cast("long").alias("list"), "row", "vec_id", "v")
    if kinds and not rest.isEmpty():
        parts.append(nearest(rest, rest.where(is_query), k))
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, parts).drop("query")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector."""
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.expr("vec_id % 20 = 0"))
