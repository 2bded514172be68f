"""Evidence by accession: affinities of both subgenomes, their asymmetry, and what ranks first by both."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelix.functions.lineage import fixed
from allelix.functions.ranking import with_min_rank, with_percentile_rank
from allelix.functions.scalars import mean_of

SIDES = ("sgC", "sgE")
# The groups whose accessions are ranked, the measures that get a percentile, and what these make up.
RANKED = ("arabica_cultivated", "arabica_introgressed", "arabica_wild")
PERCENTILES = {
    "introgression_shift": "mean_introgressed_shift",
    "canephora_affinity": "mean_canephora_affinity",
    "parental_distortion": "parental_distortion_score",
    "asymmetry_introgressed_shift": "abs_delta_introgressed_shift",
    "heterozygosity_delta": "abs_delta_heterozygosity",
    "non_reference_delta": "abs_delta_non_reference_rate",
}
COMPOSITES = {
    "introgression_affinity": ("introgression_shift", "canephora_affinity"),
    "subgenome_asymmetry": ("parental_distortion", "asymmetry_introgressed_shift", "heterozygosity_delta", "non_reference_delta"),
    "combined_evidence": ("introgression_affinity", "subgenome_asymmetry"),
}


def measures(wide: DataFrame) -> DataFrame:
    """wide (…, sgC_mean_ibs_to_<group> and sgE_…, delta_<rate>_sgC_minus_sgE) with shifts towards the introgressed and
    the wild group, affinities and parental scores. A mean over the subgenomes is that of the one that is known; a
    difference needs both."""
    to = lambda s, group: F.col(f"{s}_mean_ibs_to_{group}")
    out = wide
    for name, group in (("introgressed", "arabica_introgressed"), ("wild", "arabica_wild")):
        out = out.withColumns({f"{s}_{name}_shift": to(s, group) - to(s, "arabica_cultivated") for s in SIDES})
        out = out.withColumn(f"mean_{name}_shift", mean_of(*[f"{s}_{name}_shift" for s in SIDES]))
    for group in ("canephora", "eugenioides"):
        out = out.withColumn(f"mean_{group}_affinity", mean_of(*[to(s, group) for s in SIDES]))
    own, other = to("sgC", "canephora") - to("sgC", "eugenioides"), to("sgE", "eugenioides") - to("sgE", "canephora")
    rates = {f"abs_delta_{r}": F.abs(F.col(f"delta_{r}_sgC_minus_sgE")) for r in ("heterozygosity", "non_reference_rate", "call_rate")}
    shifts = F.abs(F.col("sgC_introgressed_shift") - F.col("sgE_introgressed_shift"))
    return out.withColumns({"parental_consistency_score": mean_of(own, other), "parental_distortion_score": F.abs(own - other), "abs_delta_introgressed_shift": shifts} | rates)


def _wide(long: DataFrame, by: Sequence[str], names: Sequence[str], values: dict[str, str]) -> DataFrame:
    """metric and values back as columns; values: column -> the pattern of its name."""
    return long.groupBy(*by).agg(*[F.max(F.when(F.col("metric") == n, F.col(c))).alias(pattern.format(n)) for c, pattern in values.items() for n in names])


def evidence(wide: DataFrame, key: str = "seq_id", group: str = "analysis_group", ranked: Sequence[str] = RANKED) -> DataFrame:
    """measures(), and for accessions of the ranked groups the percentiles of six measures among these, three composites,
    and the composites' ranks (the largest first, equal ones the least place) over all and within the group. Other
    accessions, and rows without a key, keep NULLs. key: no repeats.

    Measures are ranked together as one long table (metric, value) over sorted ranges, so a ranking costs the same few
    stages for any number of measures and isn't one task."""
    rows = measures(wide)
    by = [key, group]
    long = fixed(rows.where(F.col(group).isin(*ranked) & F.col(key).isNotNull()).select(*by, *[F.col(c).cast("double").alias(n) for n, c in PERCENTILES.items()]).unpivot(by, list(PERCENTILES), "metric", "value"))
    found = _wide(with_percentile_rank(long, "value", "pct", ["metric"]), by, list(PERCENTILES), {"pct": "{}_percentile"})
    for name, parts in COMPOSITES.items():
        found = found.withColumn(f"{name}_percentile", mean_of(*[f"{p}_percentile" for p in parts]))
    scored = fixed(found.select(*by, *[F.col(f"{n}_percentile").alias(n) for n in COMPOSITES]).unpivot(by, list(COMPOSITES), "metric", "value"))
    places = with_min_rank(with_min_rank(scored, "value", "overall", ["metric"]), "value", "within", ["metric", group])
    ranks = _wide(places, by, list(COMPOSITES), {"overall": "overall_{}_rank", "within": "within_group_{}_rank"})
    return rows.join(found.drop(group), key, "left").join(ranks.drop(group), key, "left")
