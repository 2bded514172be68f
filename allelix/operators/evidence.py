"""Marts over scored tables: reconciled names, panels, pivots, consensus, shortlists and status gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allelix.functions.scalars import gate, mean_of, name_candidates, tier, token


def reconciled(samples: DataFrame, accessions: DataFrame) -> DataFrame:
    """samples (idx, vcf_sample) with canonical_id and method: exact, normalized:<candidate> or unresolved.

    accessions (ord, seq_id, accession_name): both names lead to seq_id, and of rows with one token the last wins."""
    named = accessions.select("ord", "seq_id", F.explode(F.array("seq_id", "accession_name")).alias("name")).select("ord", "seq_id", token("name").alias("tok")).where("tok is not null")
    lookup = named.groupBy("tok").agg(F.max_by("seq_id", "ord").alias("canonical"))
    tries = F.posexplode(F.concat(F.array(F.struct(F.lit(True).alias("exact"), F.col("vcf_sample").alias("name"))), F.transform(name_candidates("vcf_sample"), lambda x: F.struct(F.lit(False).alias("exact"), x.alias("name")))))
    flat = samples.select("idx", "vcf_sample", tries.alias("place", "try")).select("idx", "vcf_sample", "place", "try.exact", "try.name", token("try.name").alias("tok"))
    hits = flat.join(lookup, "tok").groupBy("idx").agg(F.min_by(F.struct("canonical", "exact", "name"), "place").alias("hit"))
    method = F.when(F.col("hit.exact"), "exact").when(F.col("hit").isNotNull(), F.concat(F.lit("normalized:"), F.col("hit.name"))).otherwise("unresolved")
    return samples.join(hits, "idx", "left").select("idx", "vcf_sample", F.col("hit.canonical").alias("canonical_id"), method.alias("method"))


def common_panel(a: DataFrame, b: DataFrame, order: DataFrame) -> DataFrame:
    """Canonical ids of both sides with their first column in each, in the order (canonical_id, ord) gives."""
    first = lambda df, name: df.where("canonical_id is not null").groupBy("canonical_id").agg(F.min("idx").alias(name))
    return first(a, "idx_a").join(first(b, "idx_b"), "canonical_id").join(order, "canonical_id").select("ord", "canonical_id", "idx_a", "idx_b")


def matched_metadata(sides: Mapping[str, DataFrame], metadata: DataFrame, key: str = "seq_id", allowed: DataFrame | None = None) -> DataFrame:
    """Rows of each side (canonical_id, …) with subgenome_source, the metadata of their canonical id (one row for each
    that it has, NULLs for none) and matched_metadata. allowed (canonical_id): only rows whose id is listed stay; an id
    that is listed twice counts once. A NULL id matches nothing and is never listed."""
    rows = None
    for name, df in sides.items():
        one = df.withColumn("subgenome_source", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    if allowed is not None:
        rows = rows.join(allowed.select("canonical_id"), "canonical_id", "left_semi")
    return rows.join(metadata, rows.canonical_id == metadata[key], "left").withColumn("matched_metadata", F.col(key).isNotNull())


def null_safe_join(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join in which NULL keys match each other; b's keys are dropped."""
    other = b.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in b.columns])
    test = F.lit(True)
    for k in keys:
        test &= F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return a.join(other, test, how).drop(*[f"_r_{k}" for k in keys])


def membership(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The union of keys, and which side has each."""
    left, right = a.select(key).distinct().withColumn("in_a", F.lit(True)), b.select(key).distinct().withColumn("in_b", F.lit(True))
    return left.join(right, key, "full").select(key, F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"))


def only_in_one(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of either side whose keys the other lacks, with ``side``."""
    return a.join(b, list(keys), "left_anti").withColumn("side", F.lit("a")).unionByName(b.join(a, list(keys), "left_anti").withColumn("side", F.lit("b")), allowMissingColumns=True)


def panel_overview(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts overall and by each of the columns, as grouping sets: scope, value, n."""
    if not columns:
        return df.agg(F.count("*").alias("n")).select(F.lit("overall").alias("scope"), F.lit(None).cast("string").alias("value"), "n")
    names = {f"_g{k}": c for k, c in enumerate(columns)}
    renamed = df.select(*[F.col(f"`{c}`").alias(g) for g, c in names.items()])
    sets = renamed.groupingSets([[], *[[F.col(g)] for g in names]], *[F.col(g) for g in names])
    here = {g: F.grouping(g) == 0 for g in names}
    scope = F.coalesce(*[F.when(test, names[g]) for g, test in here.items()], F.lit("overall"))
    value = F.coalesce(*[F.when(test, F.col(g).cast("string")) for g, test in here.items()])
    return sets.agg(F.count("*").alias("n"), scope.alias("scope"), value.alias("value")).select("scope", "value", "n")


def wide_metrics(df: DataFrame, key: str, by: str, values: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row for each key, a column metric_value for each metric and value of ``by``."""
    return df.groupBy(key).agg(*[F.max(F.when(F.col(by) == v, F.col(m))).alias(f"{m}_{v}") for m in metrics for v in values])


def shortlist(lists: DataFrame, scores: DataFrame) -> DataFrame:
    """lists: accession, role, rank, one row for each role that lists it. scores: accession, combined, asymmetry,
    affinity. Roles together, the best rank, the tier and the weighted score."""
    roles = lists.groupBy("accession").agg(F.count_distinct("role").alias("n_roles"), F.array_join(F.array_sort(F.collect_set("role")), "; ").alias("roles"), F.min("rank").alias("best_rank"))
    part = lambda c, w: w * F.coalesce(F.col(c), F.lit(0.0))
    score = 10.0 * F.col("n_roles") + part("combined", 5.0) + part("asymmetry", 2.0) + part("affinity", 3.0)
    return roles.join(scores, "accession", "left").select("accession", "n_roles", "roles", "best_rank", tier("n_roles", "best_rank").alias("tier"), score.alias("score"))


def exploded_counts(df: DataFrame, key: str, joined: str) -> DataFrame:
    """Counts and sorted distinct keys of each item of a '; '-joined column."""
    items = df.where(F.coalesce(joined, F.lit("")) != "").select(key, F.explode(F.split(joined, "; ")).alias("item"))
    return items.groupBy("item").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.col(key).cast("string"))), "; ").alias("members"))


def rank_stability(rankings: DataFrame, baseline: str, best: int = 6) -> DataFrame:
    """Per accession and subgenome: the baseline's rank, mean, least and largest rank, conditions, always among the best."""
    r = F.col("rank")
    return rankings.where("rank is not null").groupBy("accession", "subgenome").agg(
        F.max(F.when(F.col("condition") == baseline, r)).alias("baseline_rank"), F.avg(r).alias("mean_rank"), F.min(r).alias("min_rank"), F.max(r).alias("max_rank"), F.count_distinct("condition").alias("n_conditions"), F.every(r <= best).alias("always_best")
    )


def status(metrics: DataFrame, checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """One row of metrics with each check and the overall status: PASS, WARN with one failed, FAIL."""
    return metrics.select("*", *[F.coalesce(t, F.lit(False)).alias(n) for n, t in checks], gate([t for _, t in checks]).alias("status"))


def consensus(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Mean of the columns' percentile ranks (missing columns skipped) and its dense rank."""
    from allelix.functions.ranking import percentile_rank

    p = df.select(key, *[percentile_rank(c).alias(c) for c in columns]).withColumn("consensus", F.round(mean_of(*columns), 9))
    return p.select(key, "consensus", F.dense_rank().over(Window.orderBy(F.desc_nulls_last("consensus"))).alias("place"))
