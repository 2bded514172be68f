"""Ranks that SQL lacks, and best rows.

The column functions are windows, for groups of bounded size (a panel, a report). The with_… functions rank tables of
any size: rows are counted by value, running counts are taken over sorted ranges of the distinct values, each of which
starts behind the ranges before it, and ranks are joined back by value; no task sees all rows or all of a group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allelix.functions.lineage import fixed


def average_rank(value: str, by: Sequence[str] = (), descending: bool = False, nulls: str = "keep") -> Column:
    """Mean of the places that equal values take. nulls: keep (NULL stays NULL) or bottom (they share the last)."""
    c = F.col(value)
    order = c.desc_nulls_last() if descending else c.asc_nulls_last()
    rank = F.rank().over(Window.partitionBy(*by).orderBy(order))
    peers = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    out = rank + (peers - 1) / F.lit(2).cast("double")
    return out if nulls == "bottom" else F.when(c.isNotNull(), out)


def percentile_rank(value: str, by: Sequence[str] = (), higher_is_better: bool = True) -> Column:
    """Average rank over the number of values that aren't NULL; 1 is best."""
    return average_rank(value, by, descending=not higher_is_better) / F.count(value).over(Window.partitionBy(*by))


def min_rank(value: str, by: Sequence[str] = (), descending: bool = True, within: Column | None = None) -> Column:
    """Rank where equal values take the least place; NULL for NULLs, and outside ``within``."""
    c = F.col(value) if within is None else F.when(within, F.col(value))
    order = c.desc_nulls_last() if descending else c.asc_nulls_last()
    return F.when(c.isNotNull(), F.rank().over(Window.partitionBy(*by).orderBy(order)))


def best_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 1, name: str | None = None) -> DataFrame:
    """The first n rows of each group. order should be total: ties would fall as they come."""
    place = name or "_place"
    out = df.withColumn(place, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(place) <= n)
    return out if name else out.drop(place)


def counted(df: DataFrame, value: str, by: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """by…, value, _n (rows), _before (rows of the group that sort before it; NULL values last) of distinct values."""
    order = [*[F.asc(b) for b in by], F.col(value).isNull(), F.desc(value) if descending else F.asc(value)]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = df.groupBy(*by, value).agg(F.count("*").alias("_n"))
    dealt = fixed(values.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy(*by, "_part").orderBy(*order[len(by) :]).rowsBetween(Window.unboundedPreceding, -1)
    # One row for each group and range.
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*by, "_part").agg(F.sum("_n").alias("_sum")).select(*[F.col(b).alias(f"_s_{b}") for b in by], F.col("_part").alias("_s"), F.sum("_sum").over(earlier).alias("_start"))
    same = F.col("_part") == F.col("_s")
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"_s_{b}"))
    zero = F.lit(0).cast("long")
    met = dealt.withColumn("_in", F.coalesce(F.sum("_n").over(inside), zero)).join(starts, same)
    return met.select(*by, value, "_n", (F.col("_in") + F.coalesce("_start", zero)).alias("_before"))


def with_facts(df: DataFrame, counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with their keys' facts (a row each); NULL keys meet."""
    right = counts.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in counts.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return df.join(right, same).drop(*[f"_r_{k}" for k in keys])


def with_average_rank(df: DataFrame, value: str, name: str, by: Sequence[str] = (), descending: bool = False, nulls: str = "keep") -> DataFrame:
    """average_rank() as a column ``name`` of a table of any size."""
    rank = F.col("_before") + 1 + (F.col("_n") - 1) / F.lit(2).cast("double")
    ranked = with_facts(df, counted(df, value, by, descending), [*by, value])
    return ranked.withColumn(name, rank if nulls == "bottom" else F.when(F.col(value).isNotNull(), rank)).drop("_n", "_before")


def with_average_ranks(df: DataFrame, names: Mapping[str, str], by: Sequence[str] = ()) -> DataFrame:
    """with_average_rank() for several values, value -> name: each is counted over the rows as they are, not over those
    that have other ranks already."""
    out = df
    for value, name in names.items():
        rank = F.when(F.col(value).isNotNull(), F.col("_before") + 1 + (F.col("_n") - 1) / F.lit(2).cast("double"))
        out = with_facts(out, counted(df, value, by), [*by, value]).withColumn(name, rank).drop("_n", "_before")
    return out


def with_percentile_rank(df: DataFrame, value: str, name: str, by: Sequence[str] = (), higher_is_better: bool = True) -> DataFrame:
    """percentile_rank() as a column ``name`` of a table of any size."""
    ranked = with_average_rank(df, value, name, by, descending=not higher_is_better)
    known = df.groupBy(*by).agg(F.count(value).alias("_known"))
    met = with_facts(ranked, known, by) if by else ranked.join(F.broadcast(known))  # one row
    return met.withColumn(name, F.col(name) / F.nullif(F.col("_known"), F.lit(0))).drop("_known")


def with_min_rank(df: DataFrame, value: str, name: str, by: Sequence[str] = (), descending: bool = True, within: Column | None = None) -> DataFrame:
    """min_rank() as a column ``name`` of a table of any size."""
    rows = df.withColumn("_value", F.col(value) if within is None else F.when(within, F.col(value)))
    ranked = with_facts(rows, counted(rows, "_value", by, descending), [*by, "_value"])
    return ranked.withColumn(name, F.when(F.col("_value").isNotNull(), F.col("_before") + 1)).drop("_value", "_n", "_before")


def medians(df: DataFrame, value: str, by: Sequence[str], name: str) -> DataFrame:
    """by…, name: exact medians of groups of any size, NULLs left out."""
    counts = counted(df.where(F.col(value).isNotNull()), value, by)
    total = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
    holds = lambda at: ((F.col("_before") <= at) & (at < F.col("_before") + F.col("_n"))).cast("int")
    times = holds(F.floor((F.col("_total") - 1) / 2)) + holds(F.floor(F.col("_total") / 2))
    met = with_facts(counts, total, by).withColumn("_times", times).where("_times > 0")
    return met.groupBy(*by).agg((F.sum(F.col(value) * F.col("_times")) / 2).alias(name))
