"""The corpus pipeline: quality classifier, toxicity, n-gram Jaccard join, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the
columns of documents. Stages are written and read again in between.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelix.llm import ngram_join, packing, quality, toxicity
from allelix.llm.common import written


def _unused(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted outside the held-out third, scores 0.5 or more."""
    network = quality.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = _unused(docs, "quality_score")
    return quality.judged(docs, network, score).where(F.col(score) >= 0.5).drop(score)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon, learnt outside the held-out third, scores below 0.7."""
    lexicon = toxicity.fit(toxicity.training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic"))
    score = _unused(docs, "toxicity_score")
    return toxicity.judged(docs, lexicon, score).where(F.col(score) < 0.7).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose 5-word shingles link them at a similarity of 0.8, the one with the least doc_id (null counts
    as the largest; of one id, the row read first) stays. Rows are numbered and written, so that it doesn't matter what
    their columns are or repeat; rows without text link with nothing and stay."""
    row, id_ = _unused(docs, "row_number"), _unused(docs, "doc_id_of_row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows")
    classes = ngram_join.jaccard_components(rows.select(F.col(row).alias("doc_id"), "text"), width=5, threshold="0.8")
    alike = written(classes.select(F.col("doc_id").alias(row), "component_id"), "pipeline-classes")
    # Only classes of several rows lose any; the first of each is found without its texts.
    many = alike.groupBy("component_id").count().where("count > 1").select("component_id")
    members = alike.join(many, "component_id").join(rows.select(row, F.col("doc_id").alias(id_)), row)
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col(id_).isNull(), F.col(id_), F.col(row)))[row].alias(row))
    copies = members.select(row).join(first, row, "left_anti")
    return rows.join(copies.hint("merge"), row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of the documents left, in sequences of at most 2048 tokens."""
    import public_tokenizers

    return packing.packed_sequences(docs, public_tokenizers.path("byte_bpe_50k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_good),
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("best-fit packing", pack),
]
#: Classifiers, components and packing aren't SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        kept = stage(spark, docs, sf_dir)
        docs = written(kept, "pipeline", instead_of=docs) if k + 1 < len(STAGES) else kept
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
