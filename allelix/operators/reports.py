"""Report tables: collapsed pairs, consensus of contrasts, sectioned shortlists, readiness and key/value summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelix.functions.ranking import percentile_rank
from allelix.functions.scalars import sign_label


def collapsed_pairs(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """Means of both directions of a pair (group_a, group_b), under its sorted key."""
    return df.groupBy(F.least("group_a", "group_b").alias("pair_1"), F.greatest("group_a", "group_b").alias("pair_2")).agg(*[F.avg(v).alias(v) for v in values])


def relationship_deltas(ibs: DataFrame, centroids: DataFrame) -> DataFrame:
    """ibs (group_a, group_b, delta_ibs), centroids (group_a, group_b, delta_distance): both collapsed and joined
    fully, with absolute values and which side each favours."""
    out = collapsed_pairs(ibs, ["delta_ibs"]).join(collapsed_pairs(centroids, ["delta_distance"]), ["pair_1", "pair_2"], "full")
    return out.select("*", F.abs("delta_ibs").alias("abs_delta_ibs"), F.abs("delta_distance").alias("abs_delta_distance"), sign_label("delta_ibs").alias("more_similar_in"), sign_label("delta_distance").alias("more_separated_in"))


def contrast_consensus(overview: DataFrame, *counts: DataFrame) -> DataFrame:
    """overview (contrast, subgenome, n_markers, mean_effect) and counts by contrast (contrast, one column each):
    totals and mean effect over subgenomes, counts with 0 where missing, and the mean of their percentile ranks."""
    wide = overview.groupBy("contrast").agg(
        *[F.sum(F.when(F.col("subgenome") == s, F.col("n_markers"))).alias(f"n_markers_{s}") for s in ("sgC", "sgE")], F.sum("n_markers").alias("n_markers_total"), F.avg("mean_effect").alias("mean_effect")
    )
    for c in counts:
        name = next(x for x in c.columns if x != "contrast")
        wide = wide.join(c, "contrast", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    ranked = wide.select("*", percentile_rank("n_markers_total").alias("_a"), percentile_rank("mean_effect").alias("_b"))
    return ranked.withColumn("consensus", (F.coalesce("_a", F.lit(0.0)) + F.coalesce("_b", F.lit(0.0))) / 2).drop("_a", "_b")


def sectioned(sections: Mapping[str, DataFrame]) -> DataFrame:
    """UNION ALL with a ``section`` column; columns a section lacks are NULL."""
    out = None
    for name, df in sections.items():
        tagged = df.withColumn("section", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def candidate_shortlist(rows: DataFrame, keys: Sequence[str], member: str, label: str) -> DataFrame:
    """Rows by nullable keys (NULL is a group): counts, distinct members and their labels, NULL keys sorted last."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_distinct(member).alias("n_members"), F.array_join(F.array_sort(F.collect_set(label)), "; ").alias("labels"))
    return out.orderBy(F.desc("n_rows"), *[F.asc_nulls_last(k) for k in keys])


def readiness(rows: DataFrame, by: str, level: str, levels: Sequence[str]) -> DataFrame:
    """Rows of each section by confidence level: total, and one column for each level."""
    return rows.groupBy(by).agg(F.count("*").alias("total"), *[F.count_if(F.col(level) == v).alias(f"n_{v}") for v in levels])


def key_values(df: DataFrame, **metrics: Column) -> DataFrame:
    """One aggregate row as (metric, value) rows."""
    row = df.agg(*[m.cast("string").alias(k) for k, m in metrics.items()])
    return row.unpivot([], list(metrics), "metric", "value")


def preferred(df: DataFrame, order: Sequence[str], only: bool = False) -> DataFrame:
    """Columns in a preferred order as far as they are there; the others behind them, or left out."""
    first = [c for c in order if c in df.columns]
    return df.select(*first, *([] if only else [c for c in df.columns if c not in first]))


def numeric_where_possible(df: DataFrame) -> DataFrame:
    """Text columns whose values are all numbers (or NULL) as doubles; one pass tells which."""
    texts = [c for c, kind in df.dtypes if kind == "string"]
    if not texts:
        return df
    bad = df.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast("double").isNull()).alias(c) for c in texts]).first()
    return df.withColumns({c: F.col(f"`{c}`").try_cast("double") for c in texts if not bad[c]})


def composite(df: DataFrame, key: str, parts: Mapping[str, bool]) -> DataFrame:
    """Mean percentile rank of columns (True: higher is better) over those that aren't NULL, by key."""
    from allelix.functions.scalars import mean_of

    ranked = df.select(key, *[percentile_rank(c, higher_is_better=up).alias(c) for c, up in parts.items()])
    return ranked.select(key, mean_of(*parts).alias("score"))
