"""Ranked lexical search: best-first document intervals bounded by range-maximum sparse tables.

Documents are read once into postings of the queries' terms, and counted (how many documents and terms there are, and
documents of each term). Tasks then hold a block of documents at a time. Each term's posting list has its documents'
weighted impacts and a sparse table of the places of range maxima. A query begins with the interval of all documents;
the sum of its terms' range maxima bounds what any document of an interval can score. The intervals with the highest
bounds are taken, each is split at the document where its largest term has its maximum, that document is scored
exactly, and both remainders get bounds of their own. Intervals that can't reach the k-th best score are dropped;
the search ends when none is left. So that blocks without good documents end at once, a first run takes a few intervals
in each block, and the k-th best of what these found is the score to beat everywhere.

Queries come in sets of at most QUERIES rows or QUERY_TERMS terms, which are searched one after the other against all
documents: what tasks and driver hold of queries is bounded. Null or empty texts have no terms; documents without any
aren't counted; queries without any find nothing. Documents of one score ascend by doc_id, null ids last; repeated rows
are found each. Queries that share an item_id are searched each on its own. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from allelix.llm.common import require, written

#: Queries and their terms that one run over the documents answers.
QUERIES, QUERY_TERMS = 4_096, 1 << 20
#: Documents and postings that a task indexes at a time.
DOCUMENTS, POSTINGS = 1 << 14, 1 << 20
#: Intervals of each query and block that the first run takes, and intervals taken at a time at most.
FIRST, AT_ONCE = 48, 512
LAST = np.iinfo(np.int64).max

#: What ends a term: ASCII other than digits and letters; capitals become small.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


@dataclass(frozen=True)
class Counts:
    """Documents with a term, terms of all of them, and documents of each of the queries' terms."""

    documents: int
    terms: int
    held: np.ndarray

    def weights(self) -> np.ndarray:
        return np.array([math.floor(1000 * math.log((2 * self.documents + 2) / (2 * d + 1))) for d in self.held.tolist()], np.int64)

    def impacts(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 100 - 90 + (90 * n * self.documents) // self.terms
        return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Index:
    """Posting lists of a block of documents, and their sparse tables. Documents are numbered by ascending ids."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, term: np.ndarray, value: np.ndarray, vocabulary: int):
        """ids: ascending; the postings of document d stand from starts[d] to starts[d + 1]."""
        self.ids, self.size = ids, len(ids)
        keys = term.astype(np.int64) * self.size + np.repeat(np.arange(self.size), np.diff(starts))
        order = np.argsort(keys, kind="stable")
        self.keys, self.value = keys[order], value[order]
        self.doc = (self.keys % self.size).astype(np.int32)
        self.starts = np.searchsorted(self.keys, np.arange(vocabulary + 1) * self.size)
        longest = int(np.diff(self.starts).max(initial=1))
        # at[j][p]: the place of the first maximum among 2 ** j postings from p on.
        self.at = np.empty((longest.bit_length(), len(self.keys)), np.int32)
        self.at[0] = np.arange(len(self.keys))
        for j in range(1, len(self.at)):
            half = 1 << (j - 1)
            self.at[j] = self.at[j - 1]
            if len(self.keys) > half:
                a, b = self.at[j - 1, :-half], self.at[j - 1, half:]
                self.at[j, :-half] = np.where(self.value[a] >= self.value[b], a, b)
        self.log = np.array([0, *(k.bit_length() - 1 for k in range(1, longest + 1))], np.int64)

    def maxima(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, place) of the maxima of postings a to b; value 0 where there are none."""
        size = b - a
        some = size > 0
        level = self.log[size]
        left, right = self.at[level, np.where(some, a, 0)], self.at[level, np.where(some, b - (1 << level), 0)]
        place = np.where(self.value[left] >= self.value[right], left, right)
        return np.where(some, self.value[place], 0), place

    def search(self, query: np.ndarray, k: int, floor: tuple[int, int], most: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of the k best of the query's terms that are no worse than floor (score, id); most: ends
        after about so many intervals, with what was found by then."""
        query = query[self.starts[query] < self.starts[query + 1]]
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(query):
            return docs, scores
        base = query.astype(np.int64) * self.size
        low, high = np.array([0]), np.array([self.size])
        a, b = self.starts[query][None, :], self.starts[query + 1][None, :]
        value, place = self.maxima(a, b)
        bound = value.sum(1)
        taken, at_once = 0, 4
        while True:
            worst, last = floor
            if len(docs) == k and (scores[-1], -self.ids[docs[-1]]) > (worst, -last):
                worst, last = int(scores[-1]), int(self.ids[docs[-1]])
            keep = (low < high) & (bound > 0) & ((bound > worst) | ((bound == worst) & (self.ids[np.minimum(low, self.size - 1)] <= last)))
            if not keep.any() or (most is not None and taken >= most):
                return docs, scores
            low, high, a, b, value, place, bound = (x[keep] for x in (low, high, a, b, value, place, bound))
            best = np.argpartition(-bound, at_once - 1)[:at_once] if len(bound) > at_once else np.arange(len(bound))
            rows = np.arange(len(best))
            middle = self.doc[place[best, value[best].argmax(1)]].astype(np.int64)
            # Where each term's postings part at the document, and whether it holds the term.
            wanted = base + middle[:, None]
            part = np.searchsorted(self.keys, wanted)
            hit = self.keys[np.minimum(part, len(self.keys) - 1)] == wanted
            docs = np.concatenate([docs, middle])
            scores = np.concatenate([scores, np.where(hit, self.value[np.minimum(part, len(self.keys) - 1)], 0).sum(1)])
            order = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[order], scores[order]
            new_low, new_high = np.concatenate([low[best], middle + 1]), np.concatenate([middle, high[best]])
            new_a, new_b = np.concatenate([a[best], part + hit]), np.concatenate([part, b[best]])
            new_value, new_place = self.maxima(new_a, new_b)
            rest = np.ones(len(bound), bool)
            rest[best] = False
            low, high = np.concatenate([low[rest], new_low]), np.concatenate([high[rest], new_high])
            a, b = np.concatenate([a[rest], new_a]), np.concatenate([b[rest], new_b])
            value, place = np.concatenate([value[rest], new_value]), np.concatenate([place[rest], new_place])
            bound = np.concatenate([bound[rest], new_value.sum(1)])
            taken += len(rows)
            at_once = min(2 * at_once, AT_ONCE)


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), terms and tf (those of the vocabulary) of each document that has a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.get
        for batch in batches:
            n, ids, tf = np.zeros(len(batch), np.int64), [], []
            for k, text in enumerate(batch.column(1).cast(pa.binary())):
                found = terms(text.as_py())
                n[k] = len(found)
                some, count = np.unique(np.array([i for i in map(known, found) if i is not None], np.int32), return_counts=True)
                ids.append(some)
                tf.append(count)
            ends = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *x]).astype(np.int32))) for x in (ids, tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *lists], names=["doc_id", "n", "terms", "tf"]).filter(pa.array(n > 0))

    rows = require(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>"), "search-postings")


def counted(posted: DataFrame, vocabulary: int) -> Counts:
    documents, total = posted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = np.zeros(vocabulary, np.int64)
    for row in posted.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        held[row["term"]] = row["count"]
    return Counts(documents, total, held)


def found(posted: DataFrame, queries: list[np.ndarray], counts: Counts, k: int, floors: list[tuple[int, int]] | None) -> DataFrame:
    """query, doc_id, score: of each task's documents the k best of each query, no worse than its floor. Without floors,
    of those that each block's first intervals show."""
    weights = counts.weights()
    most_documents, most_postings, most = DOCUMENTS, POSTINGS, None if floors else FIRST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in queries]  # (-score, id)
        held: list[pa.RecordBatch] = []

        def flush() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            ids = np.asarray(table.column("doc_id").fill_null(LAST))
            table, ids = table.take(pa.array(order := np.argsort(ids, kind="stable"))).combine_chunks(), ids[order]
            lists = table.column("terms").combine_chunks()
            n = np.repeat(np.asarray(table.column("n")), size := np.asarray(lists.value_lengths()))
            term = np.asarray(lists.flatten())
            value = weights[term] * counts.impacts(np.asarray(table.column("tf").combine_chunks().flatten()).astype(np.int64), n)
            index = Index(ids, np.r_[0, np.cumsum(size)], term, value, len(weights))
            for q, query in enumerate(queries):
                floor = floors[q] if floors else (0, LAST)
                if len(best[q]) == k:
                    floor = max(floor, (-best[q][-1][0], best[q][-1][1]), key=lambda f: (f[0], -f[1]))
                docs, scores = index.search(query, k, floor, most)
                good = [(-s, i) for s, i in zip(scores.tolist(), ids[docs].tolist(), strict=True) if (s, -i) >= (floor[0], -floor[1]) and s > 0]
                if good:
                    best[q] = sorted(best[q] + good)[:k]

        postings_held = 0
        for batch in batches:
            # Pieces, so that a block ends where it is full.
            sizes = np.cumsum(np.asarray(batch.column(2).value_lengths().fill_null(0)))
            start = 0
            while start < len(batch):
                room = most_postings - postings_held + (sizes[start - 1] if start else 0)
                end = max(start + 1, min(int(np.searchsorted(sizes, room, "right")), start + most_documents - sum(map(len, held))))
                held.append(batch.slice(start, end - start))
                postings_held += int(sizes[end - 1] - (sizes[start - 1] if start else 0))
                start = end
                if postings_held >= most_postings or sum(map(len, held)) >= most_documents or start < len(batch):
                    flush()
                    postings_held = 0
        if held:
            flush()
        rows = [(q, None if i == LAST else i, -s) for q, some in enumerate(best) for s, i in some]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["query", "doc_id", "score"])

    return posted.mapInArrow(run, "query int, doc_id long, score long")


def top(rows: DataFrame, k: int) -> DataFrame:
    """rows (query, doc_id, score) with rank, to the k-th: parts of a query's rows first, then what these leave."""
    by = [F.desc("score"), F.asc_nulls_last("doc_id")]
    parts = rows.withColumn("part", F.spark_partition_id() % 64)
    some = parts.withColumn("rank", F.row_number().over(Window.partitionBy("query", "part").orderBy(*by))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*by))).where(F.col("rank") <= k).drop("part")


def _sets(items: DataFrame) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Queries (item_id, distinct terms) in sets of bounded size."""
    held: list[tuple[int | None, list[bytes]]] = []
    size = 0
    for row in items.toLocalIterator():
        words = list(dict.fromkeys(terms((row["text"] or "").encode())))
        if not words:
            continue
        if held and (len(held) == QUERIES or size + len(words) > QUERY_TERMS):
            yield held
            held, size = [], 0
        held.append((row["item_id"], words))
        size += len(words)
    if held:
        yield held


def searched(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """items (item_id, text) -> item_id, rank, doc_id, score of each one's k best documents of docs (doc_id, text)."""
    spark = docs.sparkSession
    results = []
    for queries in _sets(require(items, "item_id", "text")):
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, words in queries for w in words))}
        asked = [np.array([vocabulary[w] for w in words], np.int64) for _, words in queries]
        posted = postings(docs, vocabulary)
        counts = counted(posted, len(vocabulary))
        # A row for each query: bounded, like the queries.
        worst = top(found(posted, asked, counts, k, None), k).where(F.col("rank") == k).collect()
        floors = [(0, LAST)] * len(asked)
        for row in worst:
            floors[row["query"]] = (row["score"], LAST if row["doc_id"] is None else row["doc_id"])
        names = spark.createDataFrame([Row(query=q, item_id=item) for q, (item, _) in enumerate(queries)], "query int, item_id long")
        best = top(found(posted, asked, counts, k, floors), k)
        results.append(best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, results) if results else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents for each benchmark item."""
    return searched(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))


OP11_SQL = r"""WITH d AS (SELECT row_number() OVER () AS k, doc_id,
  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ts FROM documents),
b AS (SELECT row_number() OVER () AS q, item_id,
  unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
g AS (SELECT count(*)::bigint AS docs, sum(len(ts))::bigint AS total FROM d WHERE len(ts) > 0),
p AS (SELECT k, doc_id, len(ts)::bigint AS n, unnest(ts) AS term FROM d),
f AS (SELECT k, doc_id, n, term, count(*)::bigint AS tf FROM p WHERE term IN (SELECT term FROM b) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint AS w FROM f, g GROUP BY term, docs),
s AS (
  SELECT q, item_id, k, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::bigint AS score
  FROM b JOIN f USING (term) JOIN w USING (term), g GROUP BY q, item_id, k, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
