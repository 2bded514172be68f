"""Toxicity: a weighted lexicon, matched by an Aho-Corasick automaton over folded text.

Folding undoes disguises: compatibility forms, look-alike letters of other scripts, invisible characters, and digits
or signs that stand for letters inside words. Lexicon entries are words, weighed by the lower confidence bound of their
log-odds between toxic and other training documents, and beginnings of words. A beginning stands for a family of words:
it is learnt only from three or more different words, weighed by what its words leave without the most frequent of
them, and the longest beginning that covers a family is taken, so that an insult doesn't make its first letters one.
Neighbouring words in which an entry only ever occurred in harmless documents are exception phrases, and so are those
the caller gives, of any number of words; the automaton matches them too, and what lies within one isn't counted. A
document's weights are summed over different words, normalised by its length, and turned into a probability by a
logistic fit in which a missed toxic document costs as much as MISS_COST false alarms.

Null or empty texts hold no entry and get the score of no match. Without labelled rows of both classes every score is
the share of toxic labels (0 without labels). Documents whose labels contradict each other teach nothing; of one text's
labels the majority counts, and a tie teaches nothing. Repeated rows give repeated rows; a null doc_id is carried, never
held out. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from allelix.llm.common import require, with_columns, written

#: Labelled rows, about, that the lexicon is learnt from at most (chosen by hashed ids). What is collected from them is
#: bounded by them: an entry occurs in three of their documents or more.
SAMPLE_ROWS = 40_000
#: Letters of a beginning, and different words that one stands for at least.
PREFIXES, FAMILY = range(4, 9), 3
#: Standard errors below the log-odds at which words and beginnings are weighed (there are more of the latter to try).
WORD_Z, PREFIX_Z, LEAST_WEIGHT = 2.58, 3.0, 0.3
MISS_COST = 3.0

# Letters of other scripts that look like Latin ones, and what digits and signs stand for in words.
LOOK_ALIKES = dict(zip("аеорсухіјѕԁһӏѵԛԝвкмнтαειοκνρτυχɡıɑ", "aeopcyxijsdhlvqwbkmhtaeiokvptuxgia", strict=True))
STANDS_FOR = dict(zip("0134579@$!", "oieastgasi", strict=True))

# Insults that the lexicon knows before it has seen a label, and their weight.
INSULTS = "asshole bastard bitch clown cretin degenerate disgusting dumbass filth freak garbage idiot idiotic imbecile jerk loathsome loser lowlife moron moronic pathetic pig repulsive retard scum scumbag shit stupid trash twat vermin vile whore worthless".split()
INSULT_WEIGHT = 2.0

_letters = str.maketrans(LOOK_ALIKES | dict.fromkeys("­​‌‍⁠﻿", ""))
_digits = str.maketrans(STANDS_FOR)
_far = re.compile("[­ıɐ-￿]")
_token = re.compile(r"[\w@$!]*\w")


def fold(text: str) -> list[str]:
    """The folded words of a text."""
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if not text.isascii() and _far.search(text):
        text = text.translate(_letters)
    return [w if w.isalpha() or not any(map(str.isalpha, w)) else w.translate(_digits) for w in _token.findall(text)]


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    coefficients: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.0, 0.0, 0.0]))

    def automaton(self):
        """Entries with (size, weight), exception phrases with (size, None)."""
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(found):
            found.make_automaton()
        return found

    def hits(self, words: list[str], automaton) -> dict[str, float]:
        """Matched words that stand somewhere outside exception phrases, each with its entries' largest weight."""
        out: dict[str, float] = {}
        if not self.weights or not words:
            return out
        line = f" {' '.join(words)} "
        met: list[tuple[int, float]] = []
        spared: set[int] = set()
        for end, (size, weight) in automaton.iter(line):
            start = end - size + 2
            if weight is not None:
                met.append((start, weight))
                continue
            while start < end:  # where the phrase's words begin
                spared.add(start)
                start = line.index(" ", start) + 1
        for start, weight in met:
            if start not in spared:
                word = line[start : line.index(" ", start)]
                out[word] = max(out.get(word, 0.0), weight)
        return out

    @staticmethod
    def features(hits: dict[str, float], words: int) -> list[float]:
        """Summed weight, the same by length, and the number of different words matched."""
        total = sum(hits.values())
        return [1.0, math.log1p(total), math.log1p(100 * total / (words + 20)), math.log1p(len(hits))]

    def measure(self, texts: pa.Array) -> np.ndarray:
        """Features of each text; one text's words are held at a time."""
        automaton, out = automaton_of(self), np.zeros((len(texts), 4))
        for k, text in enumerate(texts):
            words = fold(text.as_py() or "")
            out[k] = self.features(self.hits(words, automaton), len(words))
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.coefficients, -30, 30)))


def _counted(rows: DataFrame, terms_of) -> DataFrame:
    """Distinct terms of each text, counted by label inside tasks and then added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = Counter(), Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            terms = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *[pa.array([counts[k][t] for t in terms], pa.int64()) for k in (1, 0)]], names=["term", "pos", "neg"])
            counts[0].clear()
            counts[1].clear()

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                counts[label].update(terms_of(text.as_py() or ""))
                if len(counts[0]) + len(counts[1]) > 100_000:
                    yield from flush()
        yield from flush()

    return rows.select("text", "label").mapInArrow(run, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, cost: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the first column is the constant and isn't shrunk. cost: what a
    row of y = 1 weighs."""
    w, weigh = np.zeros(x.shape[1]), np.where(y == 1, cost, 1.0)
    shrink = np.full(x.shape[1], ridge)
    shrink[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weigh * p * (1 - p))[:, None]).T @ x + np.diag(shrink), x.T @ (weigh * (y - p)) - shrink * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _bound(pos: Column, neg: Column, n_pos: int, n_neg: int, z: float) -> Column:
    """Lower confidence bound of the log-odds of a term met in so many toxic and other documents."""
    odds = F.log(((pos + 0.5) / (n_pos + 1)) / ((neg + 0.5) / (n_neg + 1)))
    return odds - z * F.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))


def learnt_entries(counts: DataFrame, n_pos: int, n_neg: int) -> DataFrame:
    """term, weight from counts (term: a word, pos, neg: documents of each class that hold it)."""
    words = counts.where("pos >= 3").select(F.concat(F.lit(" "), "term", F.lit(" ")).alias("term"), _bound(F.col("pos"), F.col("neg"), n_pos, n_neg, WORD_Z).alias("weight"))
    sizes = F.filter(F.array(*[F.lit(n) for n in PREFIXES]), lambda n: n < F.char_length("term"))
    begun = counts.select(F.explode(F.transform(sizes, lambda n: F.substring(F.col("term"), F.lit(1), n))).alias("begin"), "pos", "neg")
    families = begun.groupBy("begin").agg(F.sum("pos").alias("all"), F.sum("neg").alias("neg"), F.max("pos").alias("first"), F.count_if(F.col("pos") > 0).alias("members"))
    left = families.where((F.col("members") >= FAMILY) & (F.col("all") - F.col("first") >= 3))
    left = left.withColumn("weight", _bound(F.col("all") - F.col("first"), F.col("neg"), n_pos, n_neg, PREFIX_Z)).where(F.col("weight") > LEAST_WEIGHT)
    longer = left.groupBy(F.expr("left(begin, char_length(begin) - 1)").alias("begin")).agg(F.max("all").alias("longer"))
    own = left.join(longer, "begin", "left").where(F.coalesce("longer", F.lit(0)) < 0.9 * F.col("all"))
    return words.where(F.col("weight") > LEAST_WEIGHT).unionByName(own.select(F.concat(F.lit(" "), "begin").alias("term"), "weight"))


def fit(labelled: DataFrame, exceptions: Iterable[str] = (), insults: Iterable[str] = INSULTS) -> Lexicon:
    """labelled: a bounded sample of text, label (0 or 1). Learns entries, exception phrases and the logistic
    coefficients; insults are known beforehand."""
    rows = labelled.where("label in (0, 1)").groupBy("text").agg(F.avg(F.col("label").cast("double")).alias("share"))
    rows = written(rows.where("share <> 0.5").select("text", (F.col("share") > 0.5).cast("int").alias("label")), "toxicity-sample")
    rows = rows.repartition(max(8, labelled.sparkSession.sparkContext.defaultParallelism))
    sizes = dict(rows.groupBy("label").count().collect())
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    given = frozenset(" ".join(fold(x)) for x in exceptions) - {""}
    if not pos or not neg:
        share = min(max(pos / max(pos + neg, 1), 1e-9), 1 - 1e-9)
        return Lexicon({}, given, np.array([math.log(share / (1 - share)), 0.0, 0.0, 0.0]))
    found = learnt_entries(_counted(rows, lambda text: set(fold(text))), pos, neg).collect()
    lexicon = Lexicon({f" {w} ": INSULT_WEIGHT for w in insults} | {r["term"]: float(r["weight"]) for r in found}, given)

    def contexts(text: str) -> set[str]:
        words = fold(text)
        hit = set(lexicon.hits(words, automaton_of(lexicon)))
        return {f"{a} {b}" for a, b in zip(words, words[1:]) if a in hit or b in hit} if hit else set()

    # A phrase that met 3 harmless documents, and no toxic one, is an exception.
    phrases = _counted(rows, contexts).where("pos = 0 and neg >= 3").select("term")
    lexicon = Lexicon(lexicon.weights, given | frozenset(r["term"] for r in phrases.collect()))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(lexicon.measure(batch.column(0))), pa.list_(pa.float64())), batch.column(1)], names=["x", "label"])

    # A bounded sample's rows of four numbers, in an order of their own so that sums come out alike every time.
    data = sorted((r["x"], r["label"]) for r in rows.select("text", "label").mapInArrow(measured, "x array<double>, label int").collect())
    lexicon.coefficients = logistic(np.array([x for x, _ in data]), np.array([y for _, y in data], float), cost=MISS_COST)
    return lexicon


_automata: dict[int, tuple] = {}


def automaton_of(lexicon: Lexicon):
    """The lexicon's automaton, built once in a worker."""
    if id(lexicon) not in _automata:
        _automata.clear()
        _automata[id(lexicon)] = (lexicon, lexicon.automaton())
    return _automata[id(lexicon)][1]


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """docs (doc_id, text) with score, and the matched words with their weights: the operator's own output."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            x, matched = [], []
            for text in batch.column(1):
                words = fold(text.as_py() or "")
                hits = lexicon.hits(words, automaton)
                x.append(lexicon.features(hits, len(words)))
                matched.append(sorted(hits.items()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lexicon.score(np.array(x).reshape(-1, 4)), pa.float64()), pa.array(matched, pa.map_(pa.string(), pa.float64()))], names=["doc_id", "score", "matched"])

    return require(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, score double, matched map<string,double>")


def judged(docs: DataFrame, lexicon: Lexicon, name: str) -> DataFrame:
    """All columns of docs, and the score as column ``name``."""

    return with_columns(docs, lambda texts: lexicon.score(lexicon.measure(texts)), name)


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves 1 when divided by 3; null ids aren't held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def bounded(rows: DataFrame, most: int) -> DataFrame:
    """All rows, or about ``most`` of them, chosen by their hashed doc_id."""
    n = rows.count()
    return rows if n <= most else rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * most / n))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, values: tuple = (0, 1), most: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text, label of a bounded sample of labelled documents outside the held-out third; documents whose labels
    contradict each other are left out. The sample's ids and labels are broadcast: about ``most`` rows whatever the
    input, so no text is shuffled."""
    known = require(labels, "doc_id", label).where(F.col(label).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("_most"))
    known = known.where((F.col("label") == F.col("_most")) & F.col("label").isin(*values)).select("doc_id", "label")
    return require(docs, "doc_id", "text").join(F.broadcast(bounded(known, most)), "doc_id").select("doc_id", "text", "label")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learnt outside the held-out third."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = scored(docs, fit(training_rows(docs, labels, "toxic")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("matched").cast("long").alias("n_matched"))
