"""Registered queries of the report marts, over the driver's tables, with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelix.functions import ranking as R
from allelix.functions import scalars as S
from allelix.functions.lineage import fixed, stored
from allelix.operators import accessions as X
from allelix.operators import alignment as A
from allelix.operators import evidence as E
from allelix.operators import linalg as L
from allelix.operators import marts as K
from allelix.operators import popgen as G
from allelix.plans.registry import CELLS, NAMED, ORACLES, SITES, WINDOW, accessions, cells, good_sites, hits, named_samples, query, regions, rounded, table

SIDES = [("sgC", 0), ("sgE", 1)]


def quality(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Sample quality by side: even and odd sites; the second side lacks every seventh sample."""
    c = cells(spark, d)
    out = {name: G.sample_qc(c.where(F.col("site_id") % 2 == k)).select("sample_id", *K.RATES) for name, k in SIDES}
    return out | {"sgE": out["sgE"].where("sample_id % 7 <> 0")}


QUALITY = f"""{CELLS}, q AS (SELECT sample_id, site_id % 2 AS k, count(dosage) / count(*)::double AS call_rate, count(*) FILTER (dosage = 1) / nullif(count(dosage), 0)::double AS het_rate, count(*) FILTER (dosage > 0) / nullif(count(dosage), 0)::double AS nonref_rate FROM cells GROUP BY ALL),
c AS (SELECT * FROM q WHERE k = 0), e AS (SELECT * FROM q WHERE k = 1 AND sample_id % 7 <> 0),
m AS (SELECT s_suppkey AS seq_id, CASE WHEN s_suppkey % 10 <> 3 THEN r_name END AS analysis_group FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 9 <> 0)"""
_rates = ", ".join(f'round(c.{r}, 9) AS "sgC_{r}", round(e.{r}, 9) AS "sgE_{r}", round(c.{r} - e.{r}, 9) AS delta_{r}' for r in K.RATES)


def grouped(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    who = table(spark, d, "supplier").where(k % 9 != 0).join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return who.select(k.alias("seq_id"), F.when(k % 10 != 3, F.col("r_name")).alias("analysis_group"))


@query(f"WITH {QUALITY} SELECT coalesce(c.sample_id, e.sample_id) AS sample_id, analysis_group, {_rates} FROM c FULL JOIN e USING (sample_id) LEFT JOIN m ON coalesce(c.sample_id, e.sample_id) = seq_id")
def quality_asymmetry(spark: SparkSession, d: str) -> DataFrame:
    """Full join of both sides' sample quality with metadata (which some samples lack), and differences."""
    q = quality(spark, d)
    return rounded(K.quality_asymmetry(q["sgC"], q["sgE"], grouped(spark, d)).drop("seq_id"))


@query(f"WITH {QUALITY}, j AS (SELECT c.sample_id AS canonical_id, analysis_group, {_rates} FROM c JOIN e USING (sample_id) LEFT JOIN m ON c.sample_id = seq_id WHERE c.sample_id % 5 <> 0), n AS (SELECT analysis_group, count(*) AS size FROM j WHERE analysis_group IS NOT NULL GROUP BY 1) SELECT j.*, coalesce(size >= 3, false) AS retained_for_common_analysis FROM j LEFT JOIN n USING (analysis_group)")
def rescued_quality(spark: SparkSession, d: str) -> DataFrame:
    """The same for reconciled samples; every fifth is unresolved on both sides."""
    q = {n: df.withColumn("canonical_id", F.when(F.col("sample_id") % 5 != 0, F.col("sample_id"))).drop("sample_id") for n, df in quality(spark, d).items()}
    return rounded(K.rescued_quality(q["sgC"], q["sgE"], grouped(spark, d), 3).drop("seq_id"))


def sides(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Qualifying sites as markers of two sides, in two contrasts; written once, as several parts of a plan read them."""
    s = good_sites(spark, d).where("abs_delta_af is not null").withColumn("contrast", F.when(F.col("site_id") % 3 == 0, "x__vs__y").otherwise("x__vs__z")).withColumn("abs_delta_af", F.round("abs_delta_af", 9))
    s = fixed(s.select("site_id", "contrast", "contig", "pos", "abs_delta_af"))
    return {name: s.where(F.col("site_id") % 2 == k).select("contrast", "contig", "pos", "abs_delta_af") for name, k in SIDES}


MARKERS = f"""{CELLS}, {SITES}, mk AS (SELECT CASE WHEN site_id % 2 = 0 THEN 'sgC' ELSE 'sgE' END AS side, CASE WHEN site_id % 3 = 0 THEN 'x__vs__y' ELSE 'x__vs__z' END AS contrast, contig, pos, round(abs_delta_af, 9) AS abs_delta_af FROM good WHERE abs_delta_af IS NOT NULL),
h AS (SELECT side, contrast, contig, min(pos) AS lo, max(pos) AS hi, count(*) AS n, avg(abs_delta_af) AS effect FROM mk GROUP BY ALL)"""


def shared(of: dict[str, DataFrame]) -> DataFrame:
    """Hotspots by contrast and contig with both sides' spans; where a side has none, its span is NULL."""
    by = {n: df.groupBy("contrast", "contig").agg(F.min("pos").alias(f"{n}_min_pos"), F.max("pos").alias(f"{n}_max_pos"), F.count("*").alias(f"{n}_n"), F.avg("abs_delta_af").alias(f"{n}_effect")) for n, df in of.items()}
    return by["sgC"].join(by["sgE"], ["contrast", "contig"], "full")


@query(f"WITH {MARKERS}, x AS (SELECT mk.*, row_number() OVER (PARTITION BY mk.side, contrast, contig ORDER BY abs_delta_af DESC, pos) AS k FROM mk JOIN h USING (side, contrast, contig) WHERE pos BETWEEN lo AND hi) SELECT contrast, contig, pos, abs_delta_af, side AS support_category, contrast || '::' || contig AS hotspot_key FROM x WHERE k <= 3")
def marker_support(spark: SparkSession, d: str) -> DataFrame:
    """The three strongest markers of each hotspot and side."""
    of = sides(spark, d)
    return rounded(K.marker_support(shared(of), of, 3))


# Hotspot pairs of both sides by contrast: overlapping ones with a percentile, those apart, and one-sided ones.
PAIRED = f"""{MARKERS}, p AS (SELECT coalesce(a.contrast, b.contrast) AS contrast, coalesce(a.contig, b.contig) AS contig, a.n AS na, b.n AS nb, a.effect AS ea, b.effect AS eb, CASE WHEN a.n IS NOT NULL AND b.n IS NOT NULL THEN least(a.hi, b.hi) - greatest(a.lo, b.lo) END AS bp FROM (SELECT * FROM h WHERE side = 'sgC') a FULL JOIN (SELECT * FROM h WHERE side = 'sgE') b ON a.contrast = b.contrast AND a.contig = b.contig),
ov AS (SELECT contrast, contig, bp AS overlap_bp, na + nb AS n_markers, round((ea + eb) / 2, 9) AS effect, (rank() OVER (ORDER BY na + nb) + (count(*) OVER (PARTITION BY na + nb) - 1) / 2.0::double) / count(*) OVER () AS pct FROM p WHERE bp >= 0),
c AS (SELECT contrast, {", ".join(f"max({m}) FILTER (side = '{s}') AS \"{n}_{s}\"" for n, m in (("n_markers", "k"), ("mean_abs_delta_af", "e"), ("n_ge_0_90", "g")) for s in ("sgC", "sgE"))} FROM (SELECT contrast, side, count(*) AS k, round(avg(abs_delta_af), 9) AS e, count(*) FILTER (abs_delta_af >= 0.9) AS g FROM mk GROUP BY ALL) GROUP BY 1),
w AS (SELECT c.*, coalesce(o.k, 0) AS n_overlapping_hotspot_pairs, coalesce(o.contigs, 0) AS n_overlapping_contigs, coalesce(o.bp, 0)::bigint AS total_overlap_bp, o.pct AS mean_consensus_hotspot_percentile, coalesce(x.k, 0) AS n_same_contig_nonoverlap_pairs, coalesce(y.k, 0) AS n_subgenome_specific_hotspots,
  coalesce((\"mean_abs_delta_af_sgC\" + \"mean_abs_delta_af_sgE\") / 2, \"mean_abs_delta_af_sgC\", \"mean_abs_delta_af_sgE\") AS mean_abs_delta_af_average, coalesce(\"n_markers_sgC\", 0) + coalesce(\"n_markers_sgE\", 0) AS n_markers_total,
  CASE WHEN \"mean_abs_delta_af_sgC\" > \"mean_abs_delta_af_sgE\" THEN 'sgC' WHEN \"mean_abs_delta_af_sgC\" < \"mean_abs_delta_af_sgE\" THEN 'sgE' ELSE 'tie' END AS subgenome_with_higher_mean_abs_delta_af, CASE WHEN \"n_markers_sgC\" > \"n_markers_sgE\" THEN 'sgC' WHEN \"n_markers_sgC\" < \"n_markers_sgE\" THEN 'sgE' ELSE 'tie' END AS subgenome_with_more_top_markers
  FROM c LEFT JOIN (SELECT contrast, count(*) AS k, count(DISTINCT contig) AS contigs, sum(overlap_bp) AS bp, avg(pct) AS pct FROM ov GROUP BY 1) o USING (contrast) LEFT JOIN (SELECT contrast, count(*) AS k FROM p WHERE bp < 0 GROUP BY 1) x USING (contrast) LEFT JOIN (SELECT contrast, count(*) AS k FROM p WHERE bp IS NULL GROUP BY 1) y USING (contrast)),
t AS (SELECT *, (pa + pb) / 2 AS strength FROM (SELECT *, (rank() OVER (ORDER BY n_markers_total) + (count(*) OVER (PARTITION BY n_markers_total) - 1) / 2.0::double) / count(*) OVER () AS pa, (rank() OVER (ORDER BY mean_abs_delta_af_average) + (count(*) OVER (PARTITION BY mean_abs_delta_af_average) - 1) / 2.0::double) / count(*) OVER () AS pb FROM w))"""


def contrast_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The contrast table, the overlapping hotspot pairs and the hotspots of one side only."""
    d_af = F.col("abs_delta_af")
    overview, of = None, sides(spark, d)
    for name, rows in of.items():
        one = rows.groupBy("contrast").agg(F.count("*").alias("n_markers"), F.round(F.avg(d_af), 9).alias("mean_abs_delta_af"), F.count_if(d_af >= 0.9).alias("n_ge_0_90")).withColumn("subgenome", F.lit(name))
        overview = one if overview is None else overview.unionByName(one)
    both = shared(of).withColumn("_bp", F.least("sgC_max_pos", "sgE_max_pos") - F.greatest("sgC_min_pos", "sgE_min_pos")).withColumn("_both", F.col("sgC_n").isNotNull() & F.col("sgE_n").isNotNull())
    meet = both.where("_both and _bp >= 0").select("contrast", "contig", F.col("_bp").alias("overlap_bp"), (F.col("sgC_n") + F.col("sgE_n")).alias("n_markers"), F.round((F.col("sgC_effect") + F.col("sgE_effect")) / 2, 9).alias("mean_abs_delta_af"))
    pairs = R.with_percentile_rank(meet, "n_markers", "percentile")
    single = both.where("not _both").select("contrast", "contig", F.coalesce("sgC_n", "sgE_n").alias("n_markers"), F.round(F.coalesce("sgC_effect", "sgE_effect"), 9).alias("mean_abs_delta_af"))
    single = R.with_percentile_rank(single, "n_markers", "percentile")
    return K.contrast_table(overview, pairs, both.where("_both and _bp < 0").select("contrast", "contig"), both.where("not _both").select("contrast", "contig")), pairs, single


_table = ["contrast", *[f'"{m}_{s}"' for m in ("n_markers", "n_ge_0_90") for s in ("sgC", "sgE")], "n_overlapping_hotspot_pairs", "n_overlapping_contigs", "total_overlap_bp", "n_same_contig_nonoverlap_pairs", "n_subgenome_specific_hotspots", "n_markers_total", "subgenome_with_higher_mean_abs_delta_af", "subgenome_with_more_top_markers"]


@query(f"WITH {PAIRED} SELECT {', '.join(_table)}, " + ", ".join(f'round({c}, 9) AS {c}' for c in ('"mean_abs_delta_af_sgC"', '"mean_abs_delta_af_sgE"', "mean_consensus_hotspot_percentile", "mean_abs_delta_af_average")) + ", round(strength, 9) AS consensus_strength_percentile, rank() OVER (ORDER BY strength DESC) AS consensus_strength_rank FROM t")
def contrast_table(spark: SparkSession, d: str) -> DataFrame:
    """All metrics of both sides by contrast, with pair counts, leaders and consensus strength."""
    return rounded(contrast_parts(spark, d)[0])


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """Accessions with a group, two percentiles and two ranks: balances and keys of suppliers."""
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(k.alias("seq_id"), F.when(k % 6 != 0, F.col("s_name")).alias("accession_name"), F.col("n_regionkey").cast("long").alias("grp"), F.floor("s_acctbal").cast("long").alias("bal"), (k * 37 % 101).alias("key"))
    s = R.with_percentile_rank(R.with_percentile_rank(s, "bal", "combined"), "key", "asymmetry")
    return R.with_min_rank(R.with_min_rank(s, "bal", "rank"), "key", "asymmetry_rank")


EVIDENCE = """s0 AS (SELECT s_suppkey AS seq_id, CASE WHEN s_suppkey % 6 <> 0 THEN s_name END AS accession_name, n_regionkey::bigint AS grp, floor(s_acctbal)::bigint AS bal, s_suppkey * 37 % 101 AS key FROM supplier JOIN nation ON s_nationkey = n_nationkey),
ev AS (SELECT *, (rank() OVER (ORDER BY bal) + (count(*) OVER (PARTITION BY bal) - 1) / 2.0::double) / count(*) OVER () AS combined, (rank() OVER (ORDER BY key) + (count(*) OVER (PARTITION BY key) - 1) / 2.0::double) / count(*) OVER () AS asymmetry, rank() OVER (ORDER BY bal DESC) AS rank, rank() OVER (ORDER BY key DESC) AS asymmetry_rank FROM s0)"""
_lists = {"introgressed_reference": ("grp = 0", "combined DESC, rank, seq_id", 6, 1), "cultivated_comparator": ("grp = 1", "combined DESC, rank, seq_id", 8, 2), "asymmetry_support": ("true", "asymmetry DESC, combined DESC, asymmetry_rank, seq_id", 10, 3)}
ROLE_LISTS = ", ".join(f"l{k} AS (SELECT '{role}' AS role, {p} AS pri, * FROM ev WHERE {test} ORDER BY {order} LIMIT {n})" for k, (role, (test, order, n, p)) in enumerate(_lists.items()))


def role_lists(spark: SparkSession, d: str) -> list[tuple[str, int, DataFrame]]:
    ev = evidence(spark, d)
    orders = {"introgressed_reference": [F.desc("combined"), F.asc("rank"), F.asc("seq_id")], "cultivated_comparator": [F.desc("combined"), F.asc("rank"), F.asc("seq_id")], "asymmetry_support": [F.desc("asymmetry"), F.desc("combined"), F.asc("asymmetry_rank"), F.asc("seq_id")]}
    priority = K.shortlist_roles("arabica_cultivated__vs__arabica_introgressed")
    return [(role, priority[role], K.top_of(ev.where(test), n, orders[role])) for role, (test, _, n, _) in _lists.items()]


@query(f"WITH {EVIDENCE}, {ROLE_LISTS}, u AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2) SELECT seq_id, accession_name, string_agg(DISTINCT role, '; ' ORDER BY role) AS primary_role_labels, count(DISTINCT role) AS primary_role_count, min(pri)::bigint AS best_primary_role_priority, any_value(grp) AS grp, any_value(bal) AS bal, any_value(key) AS key, round(any_value(combined), 9) AS combined, round(any_value(asymmetry), 9) AS asymmetry, any_value(rank) AS rank, any_value(asymmetry_rank) AS asymmetry_rank FROM u GROUP BY 1, 2")
def accession_shortlist(spark: SparkSession, d: str) -> DataFrame:
    """Roles by primary contrast, their lists united, the best row of each accession (some names are NULL)."""
    return rounded(K.accession_shortlist(role_lists(spark, d)))


@query(f"WITH {EVIDENCE} SELECT grp, count(*) AS n_accessions, round(avg(combined), 9) AS mean_combined, round(avg(asymmetry), 9) AS mean_asymmetry, round(avg(bal), 9) AS mean_balance FROM ev GROUP BY 1")
def group_parental_means(spark: SparkSession, d: str) -> DataFrame:
    return rounded(K.group_means(evidence(spark, d), "grp", {"mean_combined": "combined", "mean_asymmetry": "asymmetry", "mean_balance": "bal"}))


# Accessions with identities to five groups by subgenome: multiples of 1/1024 from suppliers' keys, some of them missing.
_GROUPS = ("arabica_cultivated", "arabica_introgressed", "arabica_wild", "canephora", "eugenioides")
_RATES = ("heterozygosity", "non_reference_rate", "call_rate")


def _values(key: str, div: str) -> dict[str, str]:
    """Column -> SQL of its value."""
    out = {f"{s}_mean_ibs_to_{g}": f"nullif({key} * {31 + 7 * k} % {211 - 10 * i}, {3 + k}) / {div}" for i, s in enumerate(X.SIDES) for k, g in enumerate(_GROUPS)}
    return out | {f"delta_{r}_sgC_minus_sgE": f"({key} * {53 + 6 * k} % 97 - 48) / {div}" for k, r in enumerate(_RATES)}


_mean = lambda *xs: f"({' + '.join(f'coalesce({x}, 0)' for x in xs)}) / nullif({' + '.join(f'({x} IS NOT NULL)::int' for x in xs)}, 0)::double"
_to = lambda s, g: f'"{s}_mean_ibs_to_{g}"'
_part = lambda x: f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0::double) / count({x}) OVER () END"
ACCESSIONS = f"""w0 AS (SELECT s_suppkey AS seq_id, [{", ".join(f"'{g}'" for g in _GROUPS)}][n_regionkey + 1] AS analysis_group, {", ".join(f'{v} AS "{c}"' for c, v in _values("s_suppkey", "1024.0::double").items())} FROM supplier JOIN nation ON s_nationkey = n_nationkey),
w1 AS (SELECT *, {", ".join(f'{_to(s, "arabica_" + n)} - {_to(s, "arabica_cultivated")} AS "{s}_{n}_shift"' for s in X.SIDES for n in ("introgressed", "wild"))}, {_to("sgC", "canephora")} - {_to("sgC", "eugenioides")} AS own, {_to("sgE", "eugenioides")} - {_to("sgE", "canephora")} AS oth FROM w0),
w2 AS (SELECT *, {", ".join(f'{_mean(*[chr(34) + s + "_" + n + "_shift" + chr(34) for s in X.SIDES])} AS mean_{n}_shift' for n in ("introgressed", "wild"))}, {", ".join(f"{_mean(*[_to(s, g) for s in X.SIDES])} AS mean_{g}_affinity" for g in ("canephora", "eugenioides"))}, {_mean("own", "oth")} AS parental_consistency_score, abs(own - oth) AS parental_distortion_score, abs("sgC_introgressed_shift" - "sgE_introgressed_shift") AS abs_delta_introgressed_shift, {", ".join(f'abs("delta_{r}_sgC_minus_sgE") AS abs_delta_{r}' for r in _RATES)} FROM w1),
p0 AS (SELECT seq_id, analysis_group, {", ".join(f"{_part(c)} AS {n}_percentile" for n, c in X.PERCENTILES.items())} FROM w2 WHERE analysis_group LIKE 'arabica%'),
p1 AS (SELECT *, {", ".join(f"{_mean(*[p + '_percentile' for p in X.COMPOSITES[n]])} AS {n}_percentile" for n in ("introgression_affinity", "subgenome_asymmetry"))} FROM p0),
p2 AS (SELECT *, {_mean(*[p + "_percentile" for p in X.COMPOSITES["combined_evidence"]])} AS combined_evidence_percentile FROM p1),
p3 AS (SELECT * EXCLUDE (analysis_group), {", ".join(f"CASE WHEN {n}_percentile IS NOT NULL THEN rank() OVER ({by}ORDER BY {n}_percentile DESC NULLS LAST) END AS {place}_{n}_rank" for n in X.COMPOSITES for place, by in (("overall", ""), ("within_group", "PARTITION BY analysis_group ")))} FROM p2)"""
_doubles = ["mean_introgressed_shift", "mean_wild_shift", "mean_canephora_affinity", "mean_eugenioides_affinity", "parental_consistency_score", "parental_distortion_score", "abs_delta_introgressed_shift", *[f"abs_delta_{r}" for r in _RATES], *[f"{n}_percentile" for n in (*X.PERCENTILES, *X.COMPOSITES)]]
_ranks = [f"{place}_{n}_rank" for place in ("overall", "within_group") for n in X.COMPOSITES]


@query(f"WITH {ACCESSIONS} SELECT seq_id, analysis_group, {', '.join(f'round({c}, 9) AS {c}' for c in _doubles)}, {', '.join(_ranks)} FROM w2 LEFT JOIN p3 USING (seq_id)")
def accession_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Measures of every accession; percentiles, composites and ranks of those in the ranked groups."""
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    group = F.element_at(F.array(*[F.lit(g) for g in _GROUPS]), F.col("n_regionkey").cast("int") + 1)
    wide = s.select(F.col("s_suppkey").alias("seq_id"), group.alias("analysis_group"), *[F.expr(v).alias(c) for c, v in _values("s_suppkey", "1024.0D").items()])
    return rounded(X.evidence(wide).select("seq_id", "analysis_group", *_doubles, *_ranks))


def directions(spark: SparkSession, d: str, parts: tuple[DataFrame, DataFrame, DataFrame]) -> list[DataFrame]:
    wide, pairs, single = parts
    roles = {role: rows for role, _, rows in role_lists(spark, d)}
    found = [K.contrast_directions(wide), K.hotspot_directions(pairs)]
    found.append(K.list_direction(roles["introgressed_reference"], 6, [F.desc("combined"), F.asc("rank"), F.asc("seq_id")], "introgressed_reference", "Introgressed reference accessions", "breeding reference accessions", "top_introgressed", ["combined"], ["bal", "key"], mean_combined=F.avg("combined"), mean_balance=F.avg("bal"), mean_key=F.avg("key"), best_rank=F.min("rank")))
    found.append(K.list_direction(pairs, 15, [F.desc("percentile"), F.desc("mean_abs_delta_af"), F.asc("contrast"), F.asc("contig")], "same_contig", "Offset hotspots", "same-contig architecture", "top_offset", ["percentile"], ["mean_abs_delta_af", "n_markers"], mean_percentile=F.avg("percentile"), mean_effect=F.avg("mean_abs_delta_af"), sum_markers=F.sum("n_markers"), n_contrasts=F.count_distinct("contrast")))
    ev = evidence(spark, d)
    whole = ev.crossJoin(F.broadcast(ev.agg(F.greatest(F.count_distinct("grp"), F.lit(1)).alias("_groups"))))  # a row beside
    found.append(K.list_direction(whole, 10, [F.desc("asymmetry"), F.desc("combined"), F.asc("asymmetry_rank"), F.asc("seq_id")], "accession_asymmetry", "Subgenome asymmetry across accessions", "accession-level asymmetric structure", "top_asymmetry", ["asymmetry", "combined"], [], [F.count_distinct("grp") / F.max("_groups")], mean_asymmetry=F.avg("asymmetry"), mean_combined=F.avg("combined"), n_groups=F.count_distinct("grp"), best_rank=F.min("asymmetry_rank")))
    found.append(K.list_direction(ev.where("grp = 2"), 8, [F.desc("combined"), F.asc("rank"), F.asc("seq_id")], "wild_transition", "Wild transition accessions", "wild accession shortlist", "top_wild", ["combined"], ["bal", "asymmetry"], mean_combined=F.avg("combined"), mean_balance=F.avg("bal"), mean_asymmetry=F.avg("asymmetry"), best_rank=F.min("rank")))
    found.append(K.list_direction(single, 15, [F.desc("percentile"), F.desc("mean_abs_delta_af"), F.desc("n_markers"), F.asc("contrast"), F.asc("contig")], "subgenome_specific_hotspots", "Subgenome-specific hotspots", "subgenome-specific architecture", "top_specific", ["percentile"], ["mean_abs_delta_af", "n_markers"], mean_percentile=F.avg("percentile"), mean_effect=F.avg("mean_abs_delta_af"), sum_markers=F.sum("n_markers"), n_contrasts=F.count_distinct("contrast")))
    return found


_pct = lambda x: f"(rank() OVER (ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0::double) / count({x}) OVER ()"
_four = lambda *pairs: ", ".join(f"'{n}' AS support_metric_{k}_name, ({v})::double AS support_metric_{k}" for k, (n, v) in enumerate(pairs, 1))
DIRECTIONS = f"""{PAIRED}, {EVIDENCE}, {ROLE_LISTS},
d1 AS (SELECT 'contrast' AS direction_type, replace(contrast, '__vs__', ' vs ') AS direction_label, 'panel-wide contrast architecture' AS support_scope, contrast AS source_key, (coalesce(strength, 0) + {_pct("mean_abs_delta_af_average")} + {_pct("ex")} + {_pct("n_overlapping_hotspot_pairs")} + coalesce(mean_consensus_hotspot_percentile, 0)) / 5 AS score, {_four(("mean_abs_delta_af_average", "mean_abs_delta_af_average"), ("n_markers_delta_ge_0_90_total", "ex"), ("n_overlapping_hotspot_pairs", "n_overlapping_hotspot_pairs"), ("mean_consensus_hotspot_percentile", "mean_consensus_hotspot_percentile"))} FROM (SELECT *, coalesce("n_ge_0_90_sgC", 0) + coalesce("n_ge_0_90_sgE", 0) AS ex FROM t)),
b2 AS (SELECT contrast, count(*) AS n, max(pct) AS top, max(n_markers) AS markers, avg(effect) AS effect FROM ov GROUP BY 1),
d2 AS (SELECT 'shared_hotspot', 'Shared hotspot architecture: ' || replace(contrast, '__vs__', ' vs '), 'shared hotspot architecture', contrast, ({_pct("n")} + {_pct("top")} + {_pct("markers")} + {_pct("effect")}) / 4, {_four(("n_shared_hotspots", "n"), ("max_consensus_hotspot_percentile", "top"), ("max_combined_n_markers_hotspot", "markers"), ("mean_combined_mean_abs_delta_af", "effect"))} FROM b2),
b3 AS (SELECT *, {_pct("bal")} AS p1, {_pct("key")} AS p2 FROM l0),
d3 AS (SELECT 'introgressed_reference', 'Introgressed reference accessions', 'breeding reference accessions', 'top_introgressed', (avg(combined) + avg(p1) + avg(p2)) / 3, {_four(("mean_combined", "avg(combined)"), ("mean_balance", "avg(bal)"), ("mean_key", "avg(key)"), ("best_rank", "min(rank)"))} FROM b3 HAVING count(*) > 0),
b4 AS (SELECT *, {_pct("effect")} AS p1, {_pct("n_markers")} AS p2 FROM (SELECT * FROM ov ORDER BY pct DESC, effect DESC, contrast, contig LIMIT 15)),
d4 AS (SELECT 'same_contig', 'Offset hotspots', 'same-contig architecture', 'top_offset', (avg(pct) + avg(p1) + avg(p2)) / 3, {_four(("mean_percentile", "avg(pct)"), ("mean_effect", "avg(effect)"), ("sum_markers", "sum(n_markers)"), ("n_contrasts", "count(DISTINCT contrast)"))} FROM b4 HAVING count(*) > 0),
d5 AS (SELECT 'accession_asymmetry', 'Subgenome asymmetry across accessions', 'accession-level asymmetric structure', 'top_asymmetry', (avg(asymmetry) + avg(combined) + count(DISTINCT grp) / (SELECT greatest(count(DISTINCT grp), 1) FROM ev)::double) / 3, {_four(("mean_asymmetry", "avg(asymmetry)"), ("mean_combined", "avg(combined)"), ("n_groups", "count(DISTINCT grp)"), ("best_rank", "min(asymmetry_rank)"))} FROM (SELECT * FROM ev ORDER BY asymmetry DESC, combined DESC, asymmetry_rank, seq_id LIMIT 10) HAVING count(*) > 0),
b6 AS (SELECT *, {_pct("bal")} AS p1, {_pct("asymmetry")} AS p2 FROM (SELECT * FROM ev WHERE grp = 2 ORDER BY combined DESC, rank, seq_id LIMIT 8)),
d6 AS (SELECT 'wild_transition', 'Wild transition accessions', 'wild accession shortlist', 'top_wild', (avg(combined) + avg(p1) + avg(p2)) / 3, {_four(("mean_combined", "avg(combined)"), ("mean_balance", "avg(bal)"), ("mean_asymmetry", "avg(asymmetry)"), ("best_rank", "min(rank)"))} FROM b6 HAVING count(*) > 0),
sp AS (SELECT contrast, contig, n_markers, effect, {_pct("n_markers")} AS pct FROM (SELECT contrast, contig, coalesce(na, nb) AS n_markers, round(coalesce(ea, eb), 9) AS effect FROM p WHERE bp IS NULL)),
b7 AS (SELECT *, {_pct("effect")} AS p1, {_pct("n_markers")} AS p2 FROM (SELECT * FROM sp ORDER BY pct DESC, effect DESC, n_markers DESC, contrast, contig LIMIT 15)),
d7 AS (SELECT 'subgenome_specific_hotspots', 'Subgenome-specific hotspots', 'subgenome-specific architecture', 'top_specific', (avg(pct) + avg(p1) + avg(p2)) / 3, {_four(("mean_percentile", "avg(pct)"), ("mean_effect", "avg(effect)"), ("sum_markers", "sum(n_markers)"), ("n_contrasts", "count(DISTINCT contrast)"))} FROM b7 HAVING count(*) > 0),
dirs AS (SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3 UNION ALL SELECT * FROM d4 UNION ALL SELECT * FROM d5 UNION ALL SELECT * FROM d6 UNION ALL SELECT * FROM d7),
board AS (SELECT * REPLACE (round(score, 6) AS score) FROM dirs)"""
_metrics = ", ".join(f"support_metric_{k}_name, round(support_metric_{k}, 9) AS support_metric_{k}" for k in range(1, 5))


def board(spark: SparkSession, d: str, parts: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    # Scores are rounded so that both engines rank them alike.
    return K.scoreboard([x.withColumn("composite_support_score", F.round("composite_support_score", 6)) for x in directions(spark, d, parts)])


@query(f"WITH {DIRECTIONS} SELECT direction_type, direction_label, support_scope, source_key, score AS composite_support_score, {_metrics}, dense_rank() OVER (ORDER BY score DESC) AS recommended_rank, dense_rank() OVER (ORDER BY score DESC) = 1 AS is_primary_recommendation FROM board")
def direction_scoreboard(spark: SparkSession, d: str) -> DataFrame:
    """Scored directions of contrasts, shared hotspots and five lists, with their dense rank."""
    return rounded(board(spark, d, contrast_parts(spark, d)))


@query(f"WITH {DIRECTIONS}, f AS (SELECT * FROM board ORDER BY score DESC, direction_type, direction_label LIMIT 1) SELECT 'recommended_direction_type' AS field, direction_type AS value FROM f UNION ALL SELECT 'recommended_direction_label', direction_label FROM f UNION ALL SELECT 'support_scope', support_scope FROM f UNION ALL SELECT 'composite_support_score', printf('%.6f', score) FROM f UNION ALL SELECT 'primary_source_key', source_key FROM f WHERE direction_type IN ('contrast', 'shared_hotspot') UNION ALL SELECT 'top_shared_hotspot_count', count(*)::varchar FROM ov")
def direction_summary(spark: SparkSession, d: str) -> DataFrame:
    parts = contrast_parts(spark, d)
    found = board(spark, d, parts).join(parts[1].agg(F.count("*").alias("_pairs")))  # a row each
    return K.direction_summary(found, top_shared_hotspot_count=F.col("_pairs"))


REGIONS = f"""{CELLS}, {SITES}, x AS (SELECT CASE WHEN site_id % 2 = 0 THEN 'sgC' ELSE 'sgE' END AS subgenome, *, round(abs_delta_af, 9) AS delta FROM good WHERE abs_delta_af IS NOT NULL),
ctg AS (SELECT subgenome, contig, round(avg(delta), 9) AS m, count(*) FILTER (delta >= 0.75) AS n75, count(*) FILTER (delta >= 0.9) AS n90 FROM x GROUP BY ALL),
win AS (SELECT subgenome, contig, ((pos - 1) // {WINDOW}) * {WINDOW} + 1 AS s, round(avg(delta), 9) AS m FROM x GROUP BY ALL),
c1 AS (SELECT * FROM ctg QUALIFY row_number() OVER (PARTITION BY subgenome ORDER BY n90 DESC, n75 DESC, m DESC, contig) = 1),
w1 AS (SELECT * FROM win QUALIFY row_number() OVER (PARTITION BY subgenome ORDER BY m DESC, contig, s) = 1),
b1 AS (SELECT subgenome, min(pos) AS a, max(pos) AS b FROM x GROUP BY 1),
nulls AS (SELECT CASE subgenome WHEN 'sgC' THEN 'sgE' ELSE 'sgC' END AS subgenome, contig, max(m) AS v FROM win GROUP BY ALL),
t1 AS (SELECT w1.subgenome, w1.m AS observed, quantile_cont(v, 0.99) AS null_99, count(v) AS n_valid, CASE WHEN count(v) FILTER (v >= w1.m) > 0 THEN (1 + count(v) FILTER (v >= w1.m)) / (1 + count(v))::double END AS p_value FROM w1 JOIN nulls USING (subgenome) GROUP BY 1, 2)"""


def regional(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    x = good_sites(spark, d).where("abs_delta_af is not null").withColumn("subgenome", F.when(F.col("site_id") % 2 == 0, "sgC").otherwise("sgE")).withColumn("delta", F.round("abs_delta_af", 9))
    x = stored(x.select("subgenome", "contig", "pos", "delta"), "regional")
    mean = F.round(F.avg("delta"), 9).alias("mean_abs_delta_af")
    contigs = x.groupBy("subgenome", "contig").agg(mean, F.count_if(F.col("delta") >= 0.75).alias("n_ge_0_75"), F.count_if(F.col("delta") >= 0.9).alias("n_ge_0_90"))
    # Contigs and windows are written once too, as several parts of a report read them.
    contigs = fixed(R.best_rows(contigs, ["subgenome"], [F.desc("n_ge_0_90"), F.desc("n_ge_0_75"), F.desc("mean_abs_delta_af"), F.asc("contig")], 1 << 30, "rank"))
    start = S.window_start("pos", WINDOW)
    windows = fixed(x.groupBy("subgenome", "contig", start.alias("window_start")).agg(mean).withColumn("window_end", F.col("window_start") + WINDOW - 1))
    spans = x.groupBy("subgenome").agg(F.min("pos").alias("interval_start"), F.max("pos").alias("interval_end"), F.lit(True).alias("expected_match"), F.lit("base").alias("condition"))
    top = R.best_rows(windows, ["subgenome"], [F.desc("mean_abs_delta_af"), F.asc("contig"), F.asc("window_start")])
    # The other subgenome's largest means by contig stand for the null; a P value without a hit is left to its bound.
    other = F.when(F.col("subgenome") == "sgC", "sgE").otherwise("sgC")
    nulls = windows.groupBy(other.alias("subgenome"), "contig").agg(F.max("mean_abs_delta_af").alias("null"))
    met = top.select("subgenome", "window_start", "window_end", F.col("mean_abs_delta_af").alias("observed")).join(nulls, "subgenome")
    hits = F.count_if(F.col("null") >= F.col("observed"))
    tests = met.groupBy("subgenome", "window_start", "window_end", "observed").agg(F.percentile("null", F.lit(0.99)).alias("null_99"), F.count("null").alias("n_valid"), F.when(hits > 0, (1 + hits) / (1 + F.count("null"))).alias("p_value"))
    return {"sites": x, "contigs": contigs, "windows": windows, "permutations": tests, "intervals": spans}


@query(f"WITH {REGIONS} SELECT c1.subgenome, c1.contig AS top_contig, c1.m AS contig_mean_abs_delta_af, n90 AS n_ge_0_90, s AS window_start, s + {WINDOW - 1} AS window_end, w1.m AS window_mean_abs_delta_af, s AS permutation_window_start, s + {WINDOW - 1} AS permutation_window_end, observed, round(null_99, 9) AS null_99, n_valid, round(p_value, 9) AS p_value, a AS interval_start, b AS interval_end, b - a + 1 AS interval_span_bp, true AS expected_match FROM c1 JOIN w1 USING (subgenome) JOIN b1 USING (subgenome) JOIN t1 USING (subgenome)")
def top_regions(spark: SparkSession, d: str) -> DataFrame:
    r = regional(spark, d)
    return rounded(K.top_regions(r["contigs"], r["windows"], r["permutations"], r["intervals"], "base"))


def _correlation(x: str, y: str) -> str:
    return f"CASE WHEN count(*) >= 3 AND stddev_pop({x}) * stddev_pop({y}) > 0 THEN covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0) END"


def _mean_rank(x: str) -> str:
    return f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0::double"


@query(f"""WITH {REGIONS}, n AS (SELECT count(*) FILTER (subgenome = 'sgC') AS c, count(*) FILTER (subgenome = 'sgE') AS e FROM x), cs AS ({ORACLES["chromosome_support"]}),
wj AS (SELECT a.m AS x, b.m AS y FROM win a JOIN win b ON a.contig = b.contig AND a.s = b.s WHERE a.subgenome = 'sgC' AND b.subgenome = 'sgE'), wc AS (SELECT {_correlation("x", "y")} AS r FROM wj),
cj AS (SELECT {_mean_rank("a.m")} AS x, {_mean_rank("b.m")} AS y FROM ctg a JOIN ctg b USING (contig) WHERE a.subgenome = 'sgC' AND b.subgenome = 'sgE'), cc AS (SELECT {_correlation("x", "y")} AS r FROM cj),
six AS (SELECT contig FROM (SELECT subgenome, contig FROM ctg QUALIFY row_number() OVER (PARTITION BY subgenome ORDER BY n90 DESC, n75 DESC, m DESC, contig) <= 6) GROUP BY 1 HAVING count(*) = 2)
SELECT 'Strict subgenome filtering' AS component, 'Pass' AS result, format('sgC eligible variants: {{:,}}; sgE: {{:,}}', c, e) AS evidence FROM n
UNION ALL SELECT 'SNP-panel sensitivity', 'Pass', printf('Median PCA distance correlation = %.4f', r) FROM wc
UNION ALL SELECT 'Accession ranking', 'Pass', printf('Median Spearman correlation = %.4f; median top-six overlap = %.0f/6', r, (SELECT count(*) FROM six)::double) FROM cc
UNION ALL SELECT 'Direct alignment, ' || region, 'Chromosome ' || chromosome_status || '; boundary ' || boundary_status, printf('%.1f%% source coverage; %.3f%% identity; top-target fraction %.3f', 100 * fraction, weighted_identity, top_fraction) FROM cs
UNION ALL SELECT 'Baseline permutation, ' || subgenome, 'Significant', printf('Observed max = %.4f; null 99th = %.4f; empirical P = %.6f', observed, null_99, coalesce(p_value, 1 / (1 + n_valid)::double)) FROM t1""")
def validation_overview(spark: SparkSession, d: str) -> DataFrame:
    """Report rows whose evidence comes from the scan of two subgenomes and from alignment hits: how their windows' means
    correlate and their contigs rank, the support of each region, and the tests of the top windows."""
    r = regional(spark, d)
    x = r["sites"].groupBy("subgenome").agg(F.count("*").alias("eligible_variants"))
    two = lambda df, keys, c: df.where("subgenome = 'sgC'").select(*keys, F.col(c).alias("x")).join(df.where("subgenome = 'sgE'").select(*keys, F.col(c).alias("y")), keys)
    contigs = two(r["contigs"], ["contig"], "mean_abs_delta_af")
    ranked = R.with_average_rank(R.with_average_rank(contigs, "x", "a"), "y", "b")
    shared = two(r["contigs"], ["contig"], "rank").where("x <= 6 and y <= 6").agg(F.count("*").cast("double").alias("top_overlap"))
    metrics = two(r["windows"], ["contig", "window_start"], "mean_abs_delta_af").agg(L.pearson("x", "y").alias("distance_correlation"))
    metrics = metrics.join(ranked.agg(L.pearson("a", "b").alias("rank_spearman"))).join(shared)  # a row each
    support = A.chromosome_support(hits(spark, d), regions(spark, d).withColumn("expected", F.lit("T_0"))).withColumnRenamed("region", "subgenome")
    return K.validation_overview(x, metrics, support, r["permutations"])


LIBRARY = {"metal": ("bolt", "gear", "steel"), "ring": ("ring",), "colour": ("red", "blue", "green")}


@query("WITH p AS (SELECT p_partkey, p_brand, p_name, lower(p_name || ' ' || p_type) AS t, p_size FROM part), k AS (SELECT *, list_filter(['blue', 'bolt', 'gear', 'green', 'red', 'ring', 'steel'], lambda x: contains(t, x)) AS terms, list_filter([CASE WHEN contains(t, 'red') OR contains(t, 'blue') OR contains(t, 'green') THEN 'colour' END, CASE WHEN contains(t, 'bolt') OR contains(t, 'gear') OR contains(t, 'steel') THEN 'metal' END, CASE WHEN contains(t, 'ring') THEN 'ring' END], lambda x: x IS NOT NULL) AS cats FROM p), g AS (SELECT p_brand AS subgenome, p_partkey AS gene_id, p_name AS gene_name, array_to_string(cats, '; ') AS categories, array_to_string(terms, '; ') AS terms, len(terms)::bigint AS hits, len(terms) + p_size / 50.0::double AS priority, p_size::bigint AS overlap_bp FROM k) SELECT subgenome, gene_id, gene_name, categories, terms, hits, round(priority, 9) AS priority, overlap_bp, row_number() OVER (PARTITION BY subgenome ORDER BY priority DESC, gene_id) AS within_subgenome_rank, row_number() OVER (ORDER BY hits DESC, priority DESC, overlap_bp DESC, gene_name, gene_id) AS global_candidate_rank FROM g WHERE hits > 0")
def gene_shortlist(spark: SparkSession, d: str) -> DataFrame:
    """Parts as genes, by a keyword library, with places in their brand (input order breaks ties) and over all."""
    p = table(spark, d, "part").withColumn("_k", K.keyword_hits(F.concat_ws(" ", "p_name", "p_type"), LIBRARY))
    g = p.select(F.col("p_brand").alias("subgenome"), F.col("p_partkey").alias("gene_id"), F.col("p_name").alias("gene_name"), "_k.categories", "_k.terms", F.col("_k.hits").cast("long").alias("hits"), (F.col("_k.hits") + F.col("p_size") / F.lit(50.0)).alias("priority"), F.col("p_size").cast("long").alias("overlap_bp"), F.col("p_partkey").alias("ordinal"))
    return rounded(K.gene_shortlist(g).drop("ordinal"))


@query("WITH h AS (SELECT p_partkey AS hotspot, p_brand AS seqid, p_partkey * 10 AS a, p_partkey * 10 + p_size * 200 AS b FROM part), g AS (SELECT p_partkey AS gene_id, p_brand AS seqid, p_partkey * 10 AS s, p_partkey * 10 + 500 AS e, lower(p_name || ' ' || p_type) AS t, p_size % 2 = 0 AS coding FROM part), j AS (SELECT h.hotspot, g.gene_id, h.seqid, greatest(a, s) AS overlap_start, least(b, e) AS overlap_end, least(b, e) - greatest(a, s) + 1 AS overlap_bp, b - a + 1 AS span, t, coding FROM h JOIN g ON h.seqid = g.seqid AND s <= b AND e >= a), k AS (SELECT *, list_filter(['blue', 'bolt', 'gear', 'green', 'red', 'ring', 'steel'], lambda x: contains(t, x)) AS terms, list_filter([CASE WHEN contains(t, 'red') OR contains(t, 'blue') OR contains(t, 'green') THEN 'colour' END, CASE WHEN contains(t, 'bolt') OR contains(t, 'gear') OR contains(t, 'steel') THEN 'metal' END, CASE WHEN contains(t, 'ring') THEN 'ring' END], lambda x: x IS NOT NULL) AS cats FROM j) SELECT hotspot, gene_id, seqid, overlap_start, overlap_end, overlap_bp, round(overlap_bp / span::double, 9) AS overlap_fraction, array_to_string(cats, '; ') AS categories, array_to_string(terms, '; ') AS terms, len(terms)::bigint AS hits, coding, round(len(terms) + CASE WHEN coding THEN 0.25 ELSE 0 END + overlap_bp / max(overlap_bp) OVER ()::double, 9) AS priority FROM k")
def gene_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Parts as hotspots and genes, all that overlap, with shares, keywords and priorities."""
    p, at, size = table(spark, d, "part"), F.col("p_partkey") * 10, F.col("p_size").cast("long")
    h = p.select(F.col("p_partkey").alias("hotspot"), F.col("p_brand").alias("seqid"), at.alias("a_start"), (at + size * 200).alias("a_end"))
    g = p.select(F.col("p_partkey").alias("gene_id"), F.col("p_brand").alias("seqid"), at.alias("b_start"), (at + 500).alias("b_end"), F.col("p_name").alias("gene_name"), F.col("p_type").alias("description"), F.when(size % 2 == 0, "protein_coding").alias("gene_biotype"))
    return rounded(A.gene_overlaps(h, g, LIBRARY, 2_000))


@query("SELECT l_orderkey, l_linenumber::bigint AS l_linenumber, least(greatest(1, floor(a * scale)::bigint), least(t, ceil(b * scale)::bigint)) AS start, greatest(greatest(1, floor(a * scale)::bigint), least(t, ceil(b * scale)::bigint)) AS \"end\" FROM (SELECT l_orderkey, l_linenumber, l_partkey AS a, l_partkey + l_quantity::bigint AS b, l_suppkey + 900 AS t, (l_suppkey + 900)::double / (l_partkey + 1000)::double AS scale FROM lineitem)")
def stretched_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Intervals scaled outwards to another length."""
    li = table(spark, d, "lineitem")
    k = F.col("l_partkey")
    return rounded(li.select("l_orderkey", "l_linenumber", S.stretched(k, k + F.col("l_quantity").cast("long"), k + 1000, F.col("l_suppkey") + 900).alias("s")).select("l_orderkey", "l_linenumber", "s.start", "s.end"))


@query("WITH i AS (SELECT 'chr_' || chr((65 + n_nationkey % 12)::int) || '_sg_' || (CASE WHEN n_nationkey < 14 THEN 'C' ELSE 'E' END) || '_' || n_nationkey AS id, chr((65 + n_nationkey % 12)::int) AS letter, CASE WHEN n_nationkey < 14 THEN 'sgC' ELSE 'sgE' END AS sg FROM nation), o AS (SELECT letter, count(*) AS n, min(id) AS id FROM i WHERE sg = 'sgE' GROUP BY 1) SELECT i.id AS contig, CASE WHEN n = 1 THEN o.id END AS paired_contig FROM i LEFT JOIN o USING (letter) WHERE sg = 'sgC'")
def paired_contigs(spark: SparkSession, d: str) -> DataFrame:
    """Contigs with the other subgenome's contig of their letter, where there is just one."""
    from allelix.sources.readers import contig_inventory

    k = F.col("n_nationkey")
    name = F.concat(F.lit("chr_"), F.char(65 + k % 12), F.lit("_sg_"), F.when(k < 14, "C").otherwise("E"), F.lit("_"), k.cast("string"))
    made = table(spark, d, "nation").select(name.alias("contig_id"), F.lit(1).cast("long").alias("contig_length"))
    inventory = contig_inventory(made.where("contig_id like '%_sg_C_%'"), made)
    return K.paired_contigs(inventory.where("subgenome = 'sgC'").select(F.col("contig_id").alias("contig"), "letter"), inventory, "sgE")


@query("WITH m AS (SELECT label, i, avg(embedding[i]::double) AS x FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2) SELECT p.label::bigint AS a, q.label::bigint AS b, round(sqrt(sum((p.x - q.x) * (p.x - q.x))), 9) AS distance FROM m p JOIN m q ON p.label <= q.label AND p.i = q.i GROUP BY 1, 2")
def centroid_distances_own(spark: SparkSession, d: str) -> DataFrame:
    """Distances of group centroids, each with itself too."""
    long = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centre = long.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    return rounded(L.pairwise_distances(centre, "label", "v", own=True))


@query(f"WITH {NAMED}, r2 AS (SELECT canonical_id AS accession, idx % 4 AS condition, min(idx) AS rank FROM m WHERE canonical_id IS NOT NULL GROUP BY ALL), f AS (SELECT accession, bool_and(rank <= 60) AS ok FROM r2 GROUP BY 1) SELECT s_suppkey AS display_order, 'ACC' || s_suppkey AS accession, ok IS NOT NULL AS found, coalesce(ok, false) AS stable FROM supplier LEFT JOIN f ON accession = 'ACC' || s_suppkey")
def stable_choices(spark: SparkSession, d: str) -> DataFrame:
    """A priority list held against rankings: found at all, and within the limit in all conditions."""
    found = E.reconciled(named_samples(spark, d), accessions(spark, d)).where("canonical_id is not null")
    rankings = found.groupBy(F.col("canonical_id").alias("accession"), (F.col("idx") % 4).alias("condition")).agg(F.min("idx").alias("rank"))
    names = accessions(spark, d).select(F.col("ord").alias("display_order"), F.col("seq_id").alias("accession"))
    return K.stable_choices(names, rankings, 60)


@query("SELECT n_name, n_nationkey::varchar AS n_nationkey FROM nation WHERE n_nationkey > 90 UNION ALL SELECT 'No records', NULL WHERE (SELECT count(*) FROM nation WHERE n_nationkey > 90) = 0")
def empty_sheet_note(spark: SparkSession, d: str) -> DataFrame:
    """A table without rows as a note of one."""
    return K.or_note(table(spark, d, "nation").where("n_nationkey > 90").select("n_name", "n_nationkey"))


@query(f"WITH {CELLS}, {SITES} SELECT CASE WHEN site_id % 2 = 0 THEN 'even' ELSE 'odd' END AS contrast, count(*) AS n_markers, count(DISTINCT contig) AS n_contigs, round(avg(abs_delta_af), 9) AS mean_abs_delta_af, round(max(abs_delta_af), 9) AS max_abs_delta_af, count(*) FILTER (abs_delta_af >= 0.75) AS n_ge_0_75, count(*) FILTER (abs_delta_af >= 0.9) AS n_ge_0_90 FROM good WHERE abs_delta_af IS NOT NULL GROUP BY 1")
def contrast_overview(spark: SparkSession, d: str) -> DataFrame:
    marked = good_sites(spark, d).where("abs_delta_af is not null").withColumn("contrast", F.when(F.col("site_id") % 2 == 0, "even").otherwise("odd"))
    return rounded(G.contrast_overview(marked))


@query("WITH x AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END AS a, CASE WHEN s_suppkey % 4 <> 0 THEN s_nationkey::double END AS b, CASE WHEN s_suppkey % 12 <> 0 THEN 7.0::double END AS c FROM supplier) SELECT s_suppkey, round(list_avg(list_filter([a, b, c], lambda v: v IS NOT NULL)), 9) AS mean, round(list_median(list_filter([a, b, c], lambda v: v IS NOT NULL)), 9) AS median, len(list_filter([a, b, c], lambda v: v IS NOT NULL)) AS known FROM x")
def row_wise_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Mean, median and number of the values that a row has."""
    k = F.col("s_suppkey")
    x = table(spark, d, "supplier").select("s_suppkey", F.when(k % 3 != 0, F.col("s_acctbal")).alias("a"), F.when(k % 4 != 0, F.col("s_nationkey").cast("double")).alias("b"), F.when(k % 12 != 0, F.lit(7.0)).alias("c"))
    return rounded(x.select("s_suppkey", S.mean_of("a", "b", "c").alias("mean"), S.median_of("a", "b", "c").alias("median"), S.known_of("a", "b", "c").alias("known")))
