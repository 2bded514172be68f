"""Quality classifier: positive-unlabelled learning.

Every text is measured once, in numpy: by what its bytes, words and lines look like, and by its words and neighbouring
pairs of words, hashed with signs into a fixed number of sums. A small network then minimises the non-negative unbiased
risk of trusted positives (rows labelled good) against unlabelled web text; labels of bad rows are never used.

The class prior is the least ratio, over score cutoffs, of unlabelled to positive rows above the cutoff, with a bound
for chance. It is taken from networks fitted on one half of the samples: shares of positives come from the other half,
shares of unlabelled text from a histogram, made by Spark, of the scores of all documents of the other half (documents
are halved by a bit of their hashed ids), so a corpus of any size counts in full. The middle of three is used.

Null or empty texts are measured as all zeros and scored like any other. Without positives or without texts every
score is 1, which keeps all documents. Repeated rows give repeated rows; a null doc_id is carried, never held out;
documents whose labels contradict each other are no positives. Texts of any length are measured whole. Extra columns
are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelix.llm.common import require, with_columns, written
from allelix.llm.ngram_join import mix, text_bytes, words
from allelix.llm.toxicity import bounded, held_out, training_rows

#: Positives and unlabelled rows, about, that the network is fitted on at most each (chosen by hashed ids).
SAMPLE_ROWS = 20_000
#: Sums that words and pairs of words are hashed into.
HASHED = 128
#: Bins of the histogram of scores; networks (and halvings) that the prior is estimated with.
BINS, HALVINGS = 2_000, 3

# Byte classes that are counted, as fixed values.
CLASSES = {
    "upper": [*range(65, 91)],
    "lower": [*range(97, 123)],
    "digit": [*range(48, 58)],
    "mark": [*b"#$%&*"],
    "bang": [*b"!?"],
    "bar": [*b"|<>{}[]=_\\/@^~+"],
    "stop": [*b".,;:"],
    "space": [0x20, *range(0x09, 0x0E)],
    "line": [0x0A],
    "high": [*range(128, 192)],
    "lead": [*range(192, 256)],
}
_tables = np.zeros((len(CLASSES), 256), np.int64)
for _k, _bytes in enumerate(CLASSES.values()):
    _tables[_k, _bytes] = 1
SHAPES = [*CLASSES, "log_words", "word_bytes", "same_as_last", "same_as_second_last", "distinct", "log_line_words"]
NAMES = [*SHAPES, *(f"hash_{k}" for k in range(HASHED))]


def _counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x byte classes."""
    out = np.zeros((len(offsets) - 1, len(CLASSES)), np.int64)
    for row, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        if b > a:
            out[row] = _tables @ np.bincount(data[a:b], minlength=256)
    return out


def measured(column: pa.Array) -> np.ndarray:
    """A row of measures for each text, all between -1 and about 1."""
    data, offsets = text_bytes(column)
    counts = _counts(data, offsets).astype(float)
    size = np.maximum(np.diff(offsets), 1).astype(float)
    out = np.zeros((len(column), len(NAMES)))
    out[:, : len(CLASSES)] = np.sqrt(counts / size[:, None])
    k = len(CLASSES)
    for i, j, w, n in words(data, offsets):
        row = np.repeat(np.arange(i, j), n)
        many = np.maximum(n, 1)
        same = [np.bincount(row[s:][(w[s:] == w[:-s]) & (row[s:] == row[:-s])], minlength=j)[i:j] if len(w) > s else np.zeros(j - i) for s in (1, 2)]
        order = np.lexsort((w, row))
        first = np.ones(len(w), bool)
        first[1:] = (w[order][1:] != w[order][:-1]) | (row[order][1:] != row[order][:-1])
        distinct = np.bincount(row[order][first], minlength=j)[i:j] if len(w) else np.zeros(j - i)
        lines = counts[i:j, list(CLASSES).index("line")] + 1
        out[i:j, k] = np.log1p(n) / 10
        out[i:j, k + 1] = np.log1p(size[i:j] / many) / 5
        out[i:j, k + 2] = same[0] / many
        out[i:j, k + 3] = same[1] / many
        out[i:j, k + 4] = np.log(np.maximum(distinct, 1) / many) / 5
        out[i:j, k + 5] = np.log1p(n / lines) / 10
        out[i:j, len(SHAPES) :] = _hashed(w, row - i, j - i, n)
    return out


def _hashed(w: np.ndarray, row: np.ndarray, rows: int, n: np.ndarray) -> np.ndarray:
    """rows x HASHED: signed sums of words and of pairs, over the root of how many there are."""
    pair = mix(w[:-1] + w[1:] * np.uint64(0x9FB21C651E98DF25))[row[:-1] == row[1:]] if len(w) > 1 else w[:0]
    terms = np.concatenate([w, pair])
    of = np.concatenate([row, row[:-1][row[:-1] == row[1:]]]) if len(w) > 1 else row
    terms = mix(terms)
    sign = 1.0 - 2.0 * (terms >> np.uint64(63)).astype(float)
    sums = np.bincount(of * HASHED + (terms % np.uint64(HASHED)).astype(np.int64), weights=sign, minlength=rows * HASHED).reshape(rows, HASHED)
    return sums / np.sqrt(np.maximum(2 * n - 1, 1))[:, None]


@dataclass
class Network:
    """One hidden layer; positive outputs say good."""

    center: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    prior: float

    def output(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.tanh((x - self.center) / self.scale @ a + b) @ c + d[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.output(x), -30, 30)))


def risk(layers: list[np.ndarray], p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, list[np.ndarray]]:
    """(prior * R+(p), R-(u) - prior * R-(p), the direction to go against) of scaled rows, with logistic loss. Where
    the second is negative, it alone is followed, uphill, so that the network doesn't fit the unlabelled sample by
    heart; elsewhere the direction is the slope of the sum."""
    x = np.concatenate([p, u])
    a, b, c, d = layers
    h = np.tanh(x @ a + b)
    g = np.clip(h @ c + d[0], -30, 30)
    up = 1 / (1 + np.exp(-g))
    k = len(p)
    positive = prior * np.log1p(np.exp(-g[:k])).mean()
    negative = np.log1p(np.exp(g[k:])).mean() - prior * np.log1p(np.exp(g[:k])).mean()
    # Slopes of each row's share of the risk.
    slope = np.concatenate([-prior * up[:k] / k, up[k:] / len(u)])
    if negative < 0:
        slope = -slope
    else:
        slope[:k] += prior * (up[:k] - 1) / k
    back = slope[:, None] * c * (1 - h * h)
    return positive, negative, [x.T @ back, back.sum(0), h.T @ slope, np.array([slope.sum()])]


def _train(pos: np.ndarray, rest: np.ndarray, prior: float, hidden: int = 16, steps: int = 1000, batch: int = 512, seed: int = 7, shrink: float = 2e-3) -> Network:
    """Minimises prior * R+(pos) + max(0, R-(rest) - prior * R-(pos)), and a little of the weights' squares, by Adam."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([pos, rest])
    net = Network(both.mean(0), both.std(0) + 1e-3, [rng.normal(0, 0.3, (both.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), np.zeros(1)], prior)
    # A hashed sum tells less than a shape: together they weigh as much at the start as a few shapes.
    net.scale[len(SHAPES) :] *= np.sqrt(HASHED / 4)
    pos, rest = (pos - net.center) / net.scale, (rest - net.center) / net.scale
    m, v = [np.zeros_like(p) for p in net.layers], [np.zeros_like(p) for p in net.layers]
    for t in range(1, steps + 1):
        p, u = pos[rng.integers(len(pos), size=batch)], rest[rng.integers(len(rest), size=batch)]
        grads = risk(net.layers, p, u, prior)[2]
        for k, grad in enumerate(grads):
            grad = grad + shrink * net.layers[k] if k in (0, 2) else grad
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad * grad
            net.layers[k] = net.layers[k] - 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return net


def bins(output: np.ndarray) -> np.ndarray:
    """The histogram's bin of each network output."""
    return np.clip((np.clip(output, -30, 30) + 30) / 60 * BINS, 0, BINS - 1).astype(np.int64)


def estimated_prior(pos: np.ndarray, rest: np.ndarray, delta: float = 0.1) -> float:
    """The share of positives among unlabelled rows, from two histograms of scores of rows that the network wasn't
    trained on: the least ratio of tail shares, with a bound for chance, over all cutoffs."""
    if not pos.sum() or not rest.sum():
        return 0.5
    p, u = (np.cumsum(x[::-1])[::-1] / x.sum() for x in (pos, rest))
    slack = 0.5 * np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(pos.sum()) + 1 / np.sqrt(rest.sum()))
    some = p > 0.05
    best = np.argmin(((u + slack) / np.maximum(p, 1e-9))[some])
    return float(np.clip(u[some][best] / p[some][best], 0.05, 0.98))


def _half(k: int):
    """Which half of the documents one is in, for the k-th network."""
    return F.shiftright(F.xxhash64("doc_id"), 20 + k).bitwiseAND(F.lit(1)).cast("int")


def histograms(docs: DataFrame, networks: list[Network]) -> np.ndarray:
    """networks x BINS: scores of all documents (doc_id, text), each under the networks it wasn't trained for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(networks), BINS), np.int64)
        for batch in batches:
            x = measured(batch.column(0))
            for k, net in enumerate(networks):
                counts[k] += np.bincount(bins(net.output(x))[np.asarray(batch.column(1 + k)) == 1], minlength=BINS)
        k, b = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(b, pa.int32()), pa.array(counts[k, b], pa.int64())], names=["network", "bin", "n"])

    found = docs.select("text", *[_half(k).alias(f"half_{k}") for k in range(len(networks))]).mapInArrow(run, "network int, bin int, n long")
    out = np.zeros((len(networks), BINS), np.int64)
    for r in found.groupBy("network", "bin").agg(F.sum("n").alias("n")).collect():  # BINS rows for each network at most
        out[r["network"], r["bin"]] = r["n"]
    return out


def _fitted(sample: DataFrame, networks: int, prior: float | None) -> list[tuple[Network, np.ndarray]]:
    """Networks, each trained in a task of its own on the bounded sample (good, x), and the histogram of the positives
    that it wasn't trained on. prior: of a network over all rows; None: one for each halving, with an even prior."""

    def run(table: pa.Table) -> pa.Table:
        k = table.column("network")[0].as_py()
        x = np.frombuffer(b"".join(sorted(table.column("x").to_pylist()))).reshape(table.num_rows, len(NAMES) + HALVINGS + 1)
        good, halves, x = x[:, -1] == 1, x[:, len(NAMES) : -1], x[:, : len(NAMES)]
        here = np.ones(len(x), bool) if prior is not None else halves[:, k] == 0
        if not (here & good).any() or not (here & ~good).any():  # a handful of rows, all in one half
            here[:] = True
        net = _train(x[here & good], x[here & ~good], 0.5 if prior is None else prior)
        held = np.bincount(bins(net.output(x[~here & good])), minlength=BINS)
        return pa.table({"network": pa.array([k], pa.int32()), "net": [pickle.dumps(net)], "held": [held.astype(np.int64).tobytes()]})

    each = sample.withColumn("network", F.explode(F.array(*[F.lit(k) for k in range(networks)])))
    found = sorted(each.groupBy("network").applyInArrow(run, "network int, net binary, held binary").collect())
    return [(pickle.loads(r["net"]), np.frombuffer(r["held"], np.int64)) for r in found]


def fit(positives: DataFrame, unlabelled: DataFrame, corpus: DataFrame) -> Network | None:
    """positives, unlabelled: bounded samples of doc_id, text; corpus: all documents that may be learnt from. The first
    networks only serve to estimate the prior."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = np.stack([np.asarray(batch.column(1 + k)) for k in range(HALVINGS + 1)], 1)
            x = np.concatenate([measured(batch.column(0)), more], 1)
            yield pa.RecordBatch.from_arrays([batch.column(1 + HALVINGS), pa.array([r.tobytes() for r in x], pa.binary())], names=["good", "x"])

    kinds = [rows.select("text", *[_half(k).alias(f"half_{k}") for k in range(HALVINGS)], F.lit(good).alias("good")) for rows, good in ((positives, 1), (unlabelled, 0))]
    sample = written(kinds[0].unionByName(kinds[1]).mapInArrow(run, "good int, x binary"), "quality-sample")
    sizes = dict(sample.groupBy("good").count().collect())
    if min(sizes.get(0, 0), sizes.get(1, 0)) < 2:
        return None
    first = _fitted(sample, HALVINGS, None)
    tails = histograms(corpus, [net for net, _ in first])
    prior = float(np.median([estimated_prior(held, u) for (_, held), u in zip(first, tails, strict=True)]))
    return _fitted(sample, 1, prior)[0][0]


def scored(docs: DataFrame, network: Network | None) -> DataFrame:
    """docs (doc_id, text) with score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = network.score(measured(batch.column(1))) if network else np.ones(len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return require(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, score double")


def judged(docs: DataFrame, network: Network | None, name: str) -> DataFrame:
    """All columns of docs, and the score as column ``name``."""
    return with_columns(docs, lambda texts: network.score(measured(texts)) if network else np.ones(len(texts)), name)


def trained(docs: DataFrame, labels: DataFrame) -> Network | None:
    """Positives: labelled good, outside the held-out third. Unlabelled: any text outside it."""
    corpus = require(docs, "doc_id", "text").where(~held_out())
    return fit(training_rows(docs, labels, "quality", (1,), SAMPLE_ROWS), bounded(corpus, SAMPLE_ROWS), corpus)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt outside the held-out third."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return scored(docs, trained(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
