"""Registered queries of the reference's operator families over the driver's tables, with SQL for DuckDB.

lineitem stands in for genotype cells: parts are sites (contig: brand, pos: key * 1000 + 1), suppliers are samples,
regions their groups, and the least quantity modulo 4, less 1, is the dosage (-1: missing)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelix.functions import ranking as R
from allelix.functions import scalars as S
from allelix.functions.lineage import fixed
from allelix.operators import alignment as A
from allelix.operators import evidence as E
from allelix.operators import intervals as I
from allelix.operators import linalg as L
from allelix.operators import packed as K
from allelix.operators import permutation as P
from allelix.operators import popgen as G
from allelix.operators import reports as T
from allelix.operators import sampling as M

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WINDOW = 200_000
PAIRS = [("AMERICA", "EUROPE"), ("AMERICA", "AFRICA"), ("AMERICA", "ASIA"), ("AMERICA", "MIDDLE EAST"), ("EUROPE", "ASIA"), ("EUROPE", "MIDDLE EAST"), ("AFRICA", "ASIA"), ("AFRICA", "MIDDLE EAST")]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


def _calls(spark: SparkSession, d: str, panel: bool) -> DataFrame:
    """site, sample_id, grp and call of every line, dealt once, by site: what follows groups and joins by it."""
    who = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    who = who.select("s_suppkey", (F.col("n_nationkey") if panel else F.col("s_suppkey")).cast("long").alias("sample_id"), F.col("r_name").alias("grp"))
    lines = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_quantity").cast("int") % 4 - 1).alias("call"))
    return lines.join(who, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_partkey").alias("_site"), "sample_id", "grp", "call").repartition("_site")


def _at_sites(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    """Rows (_site, …) with their site's site_id, contig and pos."""
    site = table(spark, d, "part").select(F.col("p_partkey").alias("site_id"), F.col("p_brand").alias("contig"), (F.col("p_partkey") * 1000 + 1).alias("pos")).distinct()
    return site.join(rows, F.col("site_id") == F.col("_site")).drop("_site")


def cells(spark: SparkSession, d: str, panel: bool = False) -> DataFrame:
    """Genotype cells; panel: nations as samples, which bounds the samples by 25."""
    least = _calls(spark, d, panel).groupBy("_site", "sample_id", "grp").agg(F.nullif(F.min("call"), F.lit(-1)).alias("dosage"))
    return _at_sites(spark, d, least).select("site_id", "contig", "pos", "sample_id", "grp", "dosage")


CELLS = """cells AS (
  SELECT l_partkey AS site_id, p_brand AS contig, l_partkey * 1000 + 1 AS pos, l_suppkey AS sample_id, r_name AS grp, nullif(min(l_quantity::int % 4 - 1), -1) AS dosage
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL)"""
PANEL = """cells AS (
  SELECT l_partkey AS site_id, p_brand AS contig, l_partkey * 1000 + 1 AS pos, n_nationkey::bigint AS sample_id, r_name AS grp, nullif(min(l_quantity::int % 4 - 1), -1) AS dosage
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL)"""
SITES = """raw AS (
  SELECT site_id, contig, pos, count(dosage) AS called, count(dosage) / count(*) AS call_rate, sum(dosage) / (2.0::double * nullif(count(dosage), 0)) AS freq,
    avg(dosage / 2.0::double) FILTER (grp = 'AMERICA') AS af_a, avg(dosage / 2.0::double) FILTER (grp = 'EUROPE') AS af_b
  FROM cells GROUP BY ALL),
sites AS (SELECT *, least(freq, 1 - freq) AS maf, abs(af_a - af_b) AS abs_delta_af FROM raw),
good AS (SELECT * FROM sites WHERE called > 0 AND call_rate >= 0.5 AND maf >= 0.05)"""
MEASURES = "count(*) AS n_markers, avg(abs_delta_af) AS mean_abs_delta_af, max(abs_delta_af) AS max_abs_delta_af, count(*) FILTER (abs_delta_af >= 0.75) AS n_ge_0_75, count(*) FILTER (abs_delta_af >= 0.90) AS n_ge_0_90"


def good_sites(spark: SparkSession, d: str) -> DataFrame:
    return G.passing(G.site_frequencies(cells(spark, d), "AMERICA", "EUROPE"), 0.5, 0.05)


@query(f"WITH {CELLS}, {SITES}, w AS (SELECT contig, ((pos - 1) // {WINDOW}) * {WINDOW} + 1 AS window_start, {MEASURES} FROM good WHERE abs_delta_af IS NOT NULL GROUP BY ALL) SELECT contig, window_start, n_markers, round(mean_abs_delta_af, 9) AS mean_abs_delta_af, round(max_abs_delta_af, 9) AS max_abs_delta_af, n_ge_0_75, n_ge_0_90, window_start + {WINDOW - 1} AS window_end FROM w")
def window_scan_delta_af(spark: SparkSession, d: str) -> DataFrame:
    return rounded(G.window_scan(good_sites(spark, d), WINDOW))


@query(f"WITH {CELLS}, {SITES}, w AS (SELECT contig, {MEASURES} FROM good WHERE abs_delta_af IS NOT NULL GROUP BY ALL) SELECT contig, n_markers, round(mean_abs_delta_af, 9) AS mean_abs_delta_af, round(max_abs_delta_af, 9) AS max_abs_delta_af, n_ge_0_75, n_ge_0_90, row_number() OVER (ORDER BY n_ge_0_90 DESC, n_ge_0_75 DESC, round(mean_abs_delta_af, 9) DESC, contig) AS rank FROM w")
def contig_scan_delta_af(spark: SparkSession, d: str) -> DataFrame:
    scan = rounded(G.contig_scan(good_sites(spark, d)).drop("rank"))
    from pyspark.sql import Window

    return scan.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_ge_0_90"), F.desc("n_ge_0_75"), F.desc("mean_abs_delta_af"), "contig")).cast("long"))


@query(f"WITH {CELLS}, {SITES} SELECT site_id, contig, pos, called, round(call_rate, 9) AS call_rate, round(maf, 9) AS maf, round(af_a, 9) AS af_a, round(af_b, 9) AS af_b, round(abs_delta_af, 9) AS abs_delta_af FROM good")
def site_qc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(good_sites(spark, d))


@query(f"WITH {CELLS} SELECT sample_id, count(*) AS total, count(dosage) AS called, count(*) - count(dosage) AS missing, round(count(dosage) / count(*), 9) AS call_rate, round(count(*) FILTER (dosage = 1) / nullif(count(dosage), 0), 9) AS het_rate, round(count(*) FILTER (dosage > 0) / nullif(count(dosage), 0), 9) AS nonref_rate FROM cells GROUP BY sample_id")
def sample_qc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(G.sample_qc(cells(spark, d)))


@query(f"WITH {CELLS}, {SITES} SELECT count(*) AS n_records, count(*) FILTER (called > 0) AS n_called, count(*) FILTER (call_rate >= 0.5) AS n_call_rate, count(*) FILTER (maf >= 0.05) AS n_maf, count(*) FILTER (abs_delta_af IS NOT NULL) AS n_both_groups FROM sites")
def filter_audit(spark: SparkSession, d: str) -> DataFrame:
    sites = G.site_frequencies(cells(spark, d), "AMERICA", "EUROPE")
    return G.filter_audit(sites, n_called=F.col("called") > 0, n_call_rate=F.col("call_rate") >= 0.5, n_maf=F.col("maf") >= 0.05, n_both_groups=F.col("abs_delta_af").isNotNull())


def calls(spark: SparkSession, d: str) -> DataFrame:
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    allele = lambda x, m: F.when(x % m == m - 1, ".").otherwise((x % m).cast("string"))
    return table(spark, d, "lineitem").select(F.concat(allele(q, 4), F.when(n % 2 == 0, "/").otherwise("|"), allele(n, 3), F.lit(":"), q.cast("string")).alias("call"))


CALLS = "calls AS (SELECT (CASE WHEN l_quantity::int % 4 = 3 THEN '.' ELSE (l_quantity::int % 4)::varchar END) || (CASE WHEN l_linenumber % 2 = 0 THEN '/' ELSE '|' END) || (CASE WHEN l_linenumber % 3 = 2 THEN '.' ELSE (l_linenumber % 3)::varchar END) || ':' || l_quantity::int::varchar AS call FROM lineitem)"


@query(f"WITH {CALLS}, g AS (SELECT call, split_part(call, ':', 1) AS gt FROM calls) SELECT call, CASE WHEN regexp_full_match(gt, '0*[01][/|]0*[01]') THEN regexp_extract(gt, '^(\\d+)', 1)::bigint + regexp_extract(gt, '(\\d+)$', 1)::bigint END AS dosage, count(*) AS n FROM g GROUP BY ALL")
def gt_decode(spark: SparkSession, d: str) -> DataFrame:
    return rounded(calls(spark, d).select("call", S.gt_dosage("call").alias("dosage")).groupBy("call", "dosage").agg(F.count("*").alias("n")))


@query(f"WITH {CALLS}, g AS (SELECT call, split_part(call, ':', 1) AS gt FROM calls) SELECT call, CASE WHEN NOT contains(gt, '.') THEN (regexp_extract(gt, '^(\\d+)', 1)::bigint + regexp_extract(gt, '(\\d+)$', 1)::bigint)::double END AS dosage, count(*) AS n FROM g GROUP BY ALL")
def gt_decode_any_ploidy(spark: SparkSession, d: str) -> DataFrame:
    return calls(spark, d).select("call", S.gt_dosage_any("call").alias("dosage")).groupBy("call", "dosage").agg(F.count("*").alias("n"))


@query("WITH c AS (SELECT 'chr_' || chr((65 + p_partkey % 12)::int) || (CASE p_partkey % 3 WHEN 0 THEN '_sg_C_' WHEN 1 THEN '_sg_E_' ELSE '_scaffold_' END) || p_brand AS contig FROM part) SELECT contig, CASE WHEN contains(contig, '_sg_C_') THEN 'sgC' WHEN contains(contig, '_sg_E_') THEN 'sgE' ELSE 'unassigned' END AS subgenome, CASE WHEN regexp_matches(contig, '^chr_[A-L]_sg_[CE]_') THEN 'Chr' || (ascii(substr(contig, 5, 1)) - 64)::varchar ELSE contig END AS label, count(*) AS n FROM c GROUP BY ALL")
def contig_classify(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    contig = F.concat(F.lit("chr_"), F.char(65 + k % 12), F.when(k % 3 == 0, "_sg_C_").when(k % 3 == 1, "_sg_E_").otherwise("_scaffold_"), "p_brand")
    c = table(spark, d, "part").select(contig.alias("contig"))
    return c.select("contig", S.subgenome_of("contig").alias("subgenome"), S.chromosome_label("contig").alias("label")).groupBy("contig", "subgenome", "label").agg(F.count("*").alias("n"))


@query(f"WITH {CELLS}, {SITES} SELECT site_id, contig, pos, round(abs_delta_af, 9) AS abs_delta_af FROM good WHERE abs_delta_af IS NOT NULL ORDER BY round(abs_delta_af, 9) DESC, round(maf, 9) DESC, site_id LIMIT 250")
def top_markers(spark: SparkSession, d: str) -> DataFrame:
    sites = good_sites(spark, d).withColumn("abs_delta_af", F.round("abs_delta_af", 9)).withColumn("maf", F.round("maf", 9))
    return rounded(G.top_markers(sites).select("site_id", "contig", "pos", "abs_delta_af"))


@query(f"WITH {CELLS}, {SITES}, t AS (SELECT * FROM good WHERE abs_delta_af IS NOT NULL ORDER BY round(abs_delta_af, 9) DESC, round(maf, 9) DESC, site_id LIMIT 250), b AS (SELECT contig, count(*) AS n_top_markers, min(pos) AS interval_start, max(pos) AS interval_end, round(avg(round(abs_delta_af, 9)), 9) AS mean_abs_delta_af, round(max(round(abs_delta_af, 9)), 9) AS max_abs_delta_af FROM t GROUP BY contig) SELECT contig, interval_start, interval_end, mean_abs_delta_af, max_abs_delta_af, n_top_markers FROM b ORDER BY n_top_markers DESC, max_abs_delta_af DESC, mean_abs_delta_af DESC, contig LIMIT 1")
def top_interval(spark: SparkSession, d: str) -> DataFrame:
    sites = good_sites(spark, d).withColumn("abs_delta_af", F.round("abs_delta_af", 9)).withColumn("maf", F.round("maf", 9))
    return rounded(G.interval_summary(G.top_markers(sites)))


_contrast_sql = " UNION ALL ".join(f"SELECT '{a}__vs__{b}' AS contrast, site_id, contig, pos, abs(max(af) FILTER (grp = '{a}') - max(af) FILTER (grp = '{b}')) AS x FROM af GROUP BY site_id, contig, pos" for a, b in PAIRS)


@query(f"WITH {CELLS}, af AS (SELECT site_id, contig, pos, grp, avg(dosage / 2.0::double) AS af FROM cells WHERE dosage IS NOT NULL GROUP BY ALL), x AS ({_contrast_sql}), r AS (SELECT *, row_number() OVER (PARTITION BY contrast ORDER BY round(x, 9) DESC, site_id) AS place FROM x WHERE x IS NOT NULL) SELECT contrast, round(x, 9) AS abs_delta_af, site_id, contig, pos, place FROM r WHERE place <= 250")
def group_contrasts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(G.group_contrasts(cells(spark, d), PAIRS, 250, decimals=9))


@query(f"WITH {CELLS}, {SITES}, t AS (SELECT CASE WHEN site_id % 2 = 0 THEN 'even' ELSE 'odd' END AS contrast, * FROM good WHERE abs_delta_af IS NOT NULL) SELECT contrast, contig, count(*) AS n_markers, min(pos) AS min_pos, max(pos) AS max_pos, max(pos) - min(pos) AS span_bp, round(avg(abs_delta_af), 9) AS mean_abs_delta_af, round(median(abs_delta_af), 9) AS median_abs_delta_af, round(max(abs_delta_af), 9) AS max_abs_delta_af, count(*) FILTER (abs_delta_af >= 0.75) AS n_ge_0_75, count(*) FILTER (abs_delta_af >= 0.9) AS n_ge_0_90 FROM t GROUP BY ALL")
def hotspots(spark: SparkSession, d: str) -> DataFrame:
    marked = good_sites(spark, d).where("abs_delta_af is not null").withColumn("contrast", F.when(F.col("site_id") % 2 == 0, "even").otherwise("odd"))
    # Written once for its two passes.
    return rounded(G.hotspots(fixed(marked.select("contrast", "contig", "pos", "abs_delta_af"))))


def named_samples(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("idx"), F.concat(F.lit("Supplier-"), F.lpad((k % 129).cast("string"), 9, "0"), F.when(k % 4 == 0, "_sgC").when(k % 4 == 1, "_SGE").when(k % 4 == 2, "_Canephora").otherwise("")).alias("vcf_sample"))


def accessions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("ord"), F.concat(F.lit("ACC"), "s_suppkey").alias("seq_id"), F.col("s_name").alias("accession_name"))


NAMED = """s AS (SELECT c_custkey AS idx, 'Supplier-' || lpad((c_custkey % 129)::varchar, 9, '0') || (CASE c_custkey % 4 WHEN 0 THEN '_sgC' WHEN 1 THEN '_SGE' WHEN 2 THEN '_Canephora' ELSE '' END) AS vcf_sample FROM customer),
a AS (SELECT s_suppkey AS ord, 'ACC' || s_suppkey AS seq_id, regexp_replace(lower(s_name), '[^a-z0-9]+', '', 'g') AS tok FROM supplier),
r AS (SELECT s.idx, s.vcf_sample, regexp_replace(s.vcf_sample, '_(sgC|SGE|Canephora)$', '') AS base, regexp_replace(lower(regexp_replace(s.vcf_sample, '_(sgC|SGE|Canephora)$', '')), '[^a-z0-9]+', '', 'g') AS tok FROM s),
m AS (SELECT r.idx, r.vcf_sample, a.seq_id AS canonical_id, CASE WHEN a.seq_id IS NULL THEN 'unresolved' WHEN r.base = r.vcf_sample THEN 'exact' ELSE 'normalized:' || r.base END AS method FROM r LEFT JOIN a ON a.tok = r.tok)"""


@query(f"WITH {NAMED} SELECT * FROM m")
def id_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return E.reconciled(named_samples(spark, d), accessions(spark, d))


def _described(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Reconciled samples of two sides, and what is known of some accessions."""
    found = E.reconciled(named_samples(spark, d), accessions(spark, d)).select("idx", "canonical_id")
    k = F.col("s_suppkey")
    known = table(spark, d, "supplier").where(k % 7 != 0).select(F.concat(F.lit("ACC"), k.cast("string")).alias("seq_id"), "s_name", F.col("s_nationkey").cast("string").alias("nation"))
    return {"sgC": found.where("idx % 2 = 0"), "sgE": found.where("idx % 2 = 1")}, known


DESCRIBED = f"{NAMED}, known AS (SELECT 'ACC' || s_suppkey AS seq_id, s_name, s_nationkey::varchar AS nation FROM supplier WHERE s_suppkey % 7 <> 0), j AS (SELECT idx, canonical_id, CASE WHEN idx % 2 = 0 THEN 'sgC' ELSE 'sgE' END AS subgenome_source, seq_id, s_name, nation, seq_id IS NOT NULL AS matched_metadata FROM m LEFT JOIN known ON canonical_id = seq_id)"


@query(f"WITH {DESCRIBED} SELECT * FROM j")
def metadata_matches(spark: SparkSession, d: str) -> DataFrame:
    """Samples of both sides with their accession's metadata and whether there is any."""
    return E.matched_metadata(*_described(spark, d))


@query(f"WITH {DESCRIBED} SELECT * FROM j WHERE canonical_id IN (SELECT 'ACC' || s_suppkey FROM supplier WHERE s_acctbal > 0)")
def allowed_metadata_matches(spark: SparkSession, d: str) -> DataFrame:
    """The same for listed accessions only."""
    listed = table(spark, d, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("ACC"), F.col("s_suppkey").cast("string")).alias("canonical_id"))
    return E.matched_metadata(*_described(spark, d), allowed=listed)


@query(f"WITH {NAMED}, x AS (SELECT canonical_id, min(idx) FILTER (idx % 4 IN (0, 2)) AS idx_a, min(idx) FILTER (idx % 4 IN (1, 3)) AS idx_b FROM m WHERE canonical_id IS NOT NULL GROUP BY 1) SELECT s_suppkey AS ord, canonical_id, idx_a, idx_b FROM x JOIN supplier ON canonical_id = 'ACC' || s_suppkey WHERE idx_a IS NOT NULL AND idx_b IS NOT NULL")
def common_panel(spark: SparkSession, d: str) -> DataFrame:
    found = E.reconciled(named_samples(spark, d), accessions(spark, d))
    even = F.col("idx") % 4
    return E.common_panel(found.where(even.isin(0, 2)), found.where(even.isin(1, 3)), accessions(spark, d).select(F.col("seq_id").alias("canonical_id"), "ord"))


def balances(spark: SparkSession, d: str) -> DataFrame:
    b = (F.floor(F.col("s_acctbal") / 500)).cast("long")
    return table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("s_nationkey"), F.when(F.col("s_suppkey") % 7 != 0, b).alias("x"))


BALANCES = "b AS (SELECT s_suppkey, s_nationkey::bigint AS s_nationkey, CASE WHEN s_suppkey % 7 <> 0 THEN floor(s_acctbal / 500)::bigint END AS x FROM supplier)"


@query(f"WITH {BALANCES} SELECT s_suppkey, x, CASE WHEN x IS NOT NULL THEN round((rank() OVER (ORDER BY x NULLS LAST) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::double) / count(x) OVER (), 9) END AS pct FROM b")
def rank_percentile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.with_percentile_rank(balances(spark, d), "x", "pct").select("s_suppkey", "x", "pct"))


@query(f"WITH {BALANCES} SELECT s_suppkey, s_nationkey, x, CASE WHEN x IS NOT NULL THEN rank() OVER (PARTITION BY s_nationkey ORDER BY x DESC NULLS LAST) END AS rank, CASE WHEN x IS NOT NULL AND s_nationkey < 10 THEN rank() OVER (ORDER BY CASE WHEN s_nationkey < 10 THEN x END DESC NULLS LAST) END AS rank_within FROM b")
def rank_min_group(spark: SparkSession, d: str) -> DataFrame:
    b = R.with_min_rank(balances(spark, d), "x", "rank", ["s_nationkey"])
    return rounded(R.with_min_rank(b, "x", "rank_within", within=F.col("s_nationkey") < 10).select("s_suppkey", "s_nationkey", "x", "rank", "rank_within"))


@query(f"WITH {BALANCES} SELECT s_suppkey, x, rank() OVER (ORDER BY x DESC NULLS LAST) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::double AS rank FROM b")
def rank_average_bottom(spark: SparkSession, d: str) -> DataFrame:
    return R.with_average_rank(balances(spark, d), "x", "rank", descending=True, nulls="bottom").select("s_suppkey", "x", "rank")


@query("WITH h AS (SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_extendedprice, l_quantity, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_quantity DESC, l_suppkey, l_orderkey, l_linenumber) AS n FROM lineitem) SELECT l_partkey, l_suppkey, l_extendedprice, l_quantity FROM h WHERE n = 1")
def best_per_query(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    best = R.best_rows(li, ["l_partkey"], [F.desc("l_extendedprice"), F.desc("l_quantity"), F.asc("l_suppkey"), F.asc("l_orderkey"), F.asc("l_linenumber")])
    return best.select("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")


# Keys of the second side are shifted, so that each side has some that the other lacks.
NULLKEYS = "s AS (SELECT nullif(s_nationkey::bigint, 3) AS k, count(*) AS n_suppliers FROM supplier GROUP BY 1), c AS (SELECT nullif(c_nationkey::bigint + 5, 8) AS k, count(*) AS n_customers FROM customer GROUP BY 1)"


def null_keyed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, d, "supplier").groupBy(F.nullif(F.col("s_nationkey").cast("long"), F.lit(3)).alias("k")).agg(F.count("*").alias("n_suppliers"))
    c = table(spark, d, "customer").groupBy(F.nullif(F.col("c_nationkey").cast("long") + 5, F.lit(8)).alias("k")).agg(F.count("*").alias("n_customers"))
    return s, c


@query(f"WITH {NULLKEYS} SELECT s.k, n_suppliers, n_customers FROM s JOIN c ON s.k IS NOT DISTINCT FROM c.k")
def null_safe_join(spark: SparkSession, d: str) -> DataFrame:
    return E.null_safe_join(*null_keyed(spark, d), keys=["k"])


@query(f"WITH {NULLKEYS} SELECT coalesce(s.k, c.k) AS k, s.k IS NOT NULL AS in_a, c.k IS NOT NULL AS in_b FROM (SELECT k FROM s WHERE k IS NOT NULL) s FULL JOIN (SELECT k FROM c WHERE k IS NOT NULL) c ON s.k = c.k")
def membership_flags(spark: SparkSession, d: str) -> DataFrame:
    a, b = null_keyed(spark, d)
    return E.membership(a.where("k is not null"), b.where("k is not null"), "k")


@query("WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 45), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity < 4) SELECT k, 'a' AS side FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'b' AS side FROM b WHERE k NOT IN (SELECT k FROM a)")
def only_in_one(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    side = lambda test: li.where(test).select(F.col("l_partkey").alias("k")).distinct()
    return E.only_in_one(side("l_quantity > 45"), side("l_quantity < 4"), ["k"])


def spans(spark: SparkSession, d: str) -> DataFrame:
    start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    return table(spark, d, "events").select("event_id", "user_id", start.alias("start"), (start + F.floor(F.col("value") * 60).cast("long")).alias("end"))


SPANS = 'e AS (SELECT event_id, user_id, floor(epoch(ts))::bigint AS s, floor(epoch(ts))::bigint + floor(value * 60)::bigint AS t FROM events)'


def merge_sql(gap: int) -> str:
    return f"""{SPANS}, o AS (SELECT *, CASE WHEN s <= max(t) OVER (PARTITION BY user_id ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap + 1} THEN 0 ELSE 1 END AS fresh FROM e),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS island FROM o),
m AS (SELECT user_id, min(s) AS s, max(t) AS t, count(*) AS n FROM i GROUP BY user_id, island)"""


@query(f"WITH {merge_sql(3600)} SELECT user_id, s AS start, t AS \"end\", n FROM m")
def interval_merge(spark: SparkSession, d: str) -> DataFrame:
    return I.merged(spans(spark, d), ["user_id"], max_gap=3600)


@query(f"WITH {merge_sql(0)} SELECT user_id, sum(t - s + 1)::bigint AS covered FROM m GROUP BY 1")
def interval_coverage(spark: SparkSession, d: str) -> DataFrame:
    return I.union_length(spans(spark, d), ["user_id"])


@query(f"WITH {merge_sql(3600)} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY s) AS block_index, s AS start, t AS \"end\", t - s + 1 AS span FROM m")
def interval_blocks(spark: SparkSession, d: str) -> DataFrame:
    return rounded(I.blocks(spans(spark, d), ["user_id"], 3600))


T0, T1 = 1_704_067_200, 1_706_745_599


@query(f"""WITH {merge_sql(0)}, c AS (SELECT * FROM m WHERE t >= {T0} AND s <= {T1}), g AS (SELECT user_id, coalesce(lag(t) OVER (PARTITION BY user_id ORDER BY s) + 1, {T0}) AS a, s - 1 AS b FROM c UNION ALL SELECT user_id, max(t) + 1, {T1} FROM c GROUP BY 1) SELECT user_id, a AS start, b AS "end" FROM g WHERE a <= b""")
def interval_gaps(spark: SparkSession, d: str) -> DataFrame:
    return I.gaps(spans(spark, d), ["user_id"], T0, T1)


@query(f"WITH {SPANS}, p AS (SELECT event_id, s, t, lead(s) OVER (PARTITION BY user_id ORDER BY s, event_id) AS s2, lead(t) OVER (PARTITION BY user_id ORDER BY s, event_id) AS t2 FROM e) SELECT event_id, round(greatest(0, least(t, t2) - greatest(s, s2)) / nullif(greatest(t, t2) - least(s, s2), 0)::double, 9) AS jaccard FROM p WHERE s2 IS NOT NULL")
def interval_jaccard(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("start", "event_id")
    p = spans(spark, d).select("event_id", "start", "end", F.lead("start").over(w).alias("s2"), F.lead("end").over(w).alias("t2")).where("s2 is not null")
    return rounded(p.select("event_id", S.interval_jaccard("start", "end", "s2", "t2").alias("jaccard")))


@query(f"WITH {merge_sql(0)} SELECT e.event_id, m.s AS block_start, greatest(e.s, m.s) AS overlap_start, least(e.t, m.t) AS overlap_end, least(e.t, m.t) - greatest(e.s, m.s) + 1 AS overlap_bp FROM e JOIN m ON e.user_id = m.user_id + 1 AND e.s <= m.t AND e.t >= m.s")
def overlap_join(spark: SparkSession, d: str) -> DataFrame:
    e = spans(spark, d)
    a = e.select("event_id", "user_id", F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    b = I.merged_binned(e, ["user_id"], 86_400 * 7).select((F.col("user_id") + 1).alias("user_id"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    return I.overlapping(a, b, "user_id", 21_600).select("event_id", F.col("b_start").alias("block_start"), "overlap_start", "overlap_end", "overlap_bp")


@query(f"WITH {merge_sql(0)} SELECT e.event_id FROM e WHERE EXISTS (SELECT 1 FROM m WHERE e.user_id = m.user_id + 1 AND e.s <= m.t AND e.t >= m.s)")
def overlap_semi_join(spark: SparkSession, d: str) -> DataFrame:
    e = spans(spark, d)
    a = e.select("event_id", "user_id", F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    b = I.merged_binned(e, ["user_id"], 86_400 * 7).select((F.col("user_id") + 1).alias("user_id"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    return I.overlapping(a, b, "user_id", 21_600, "left_semi").select("event_id")


@query(f"WITH {SPANS} SELECT a.event_id AS span_id, count(b.event_id) AS n_points FROM e a LEFT JOIN e b ON a.user_id = b.user_id + 1 AND b.s BETWEEN a.s AND a.t GROUP BY 1")
def points_in_interval(spark: SparkSession, d: str) -> DataFrame:
    e = spans(spark, d)
    counted = I.points_within(e.select((F.col("user_id") + 1).alias("user_id"), F.col("start").alias("pos")), e.select(F.col("event_id").alias("span_id"), "user_id", "start", "end"), "user_id", 21_600)
    return counted.select("span_id", "n_points")


@query("WITH s AS (SELECT s_acctbal AS v, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1), c AS (SELECT c_custkey, c_acctbal AS x FROM customer), j AS (SELECT c_custkey, x, s_suppkey, v, row_number() OVER (PARTITION BY c_custkey ORDER BY round(abs(x - v), 9), v) AS n FROM c, s) SELECT c_custkey, s_suppkey, v AS nearest, round(abs(x - v), 9) AS distance FROM j WHERE n = 1")
def nearest_value(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("x"))
    right = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("v"))
    return rounded(I.nearest_value(left, right, "x", "v", "s_suppkey", 9).select("c_custkey", "s_suppkey", "nearest", "distance"))


@query("WITH p AS (SELECT p_partkey, p_size::bigint * 13000 + 500 AS n FROM part), k AS (SELECT p_partkey, n, unnest(range(0, greatest(0, ceil((n - 200000) / 180000.0)::bigint) + 1)) AS i FROM p) SELECT p_partkey, i + 1 AS chunk_index, i * 180000 + 1 AS chunk_start, least(i * 180000 + 200000, n) AS chunk_end FROM k WHERE least(i * 180000 + 200000, n) - i * 180000 >= 1000")
def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size").cast("long") * 13000 + 500).alias("n"))
    return I.chunks(p, "n", 200_000, 20_000, 1_000).select("p_partkey", "chunk_index", "chunk_start", "chunk_end")


@query("SELECT l_partkey, l_orderkey AS pos, greatest(1, least(round_even(l_orderkey::double * (l_partkey + 1000) / (l_suppkey + 500), 0)::bigint, l_partkey + 1000)) AS mapped FROM lineitem")
def coordinate_transfer(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select("l_partkey", F.col("l_orderkey").alias("pos"), S.transferred("l_orderkey", F.col("l_suppkey") + 500, F.col("l_partkey") + 1000).alias("mapped"))


@query("SELECT p_partkey, 'p' || p_partkey AS id, p_type AS kind, p_brand AS note FROM part")
def attribute_map(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("ID=p"), "p_partkey", F.lit("; type =old;flag;type="), "p_type", F.lit(";note="), "p_brand")
    m = table(spark, d, "part").select("p_partkey", S.attributes(text).alias("a"))
    return m.select("p_partkey", F.col("a")["ID"].alias("id"), F.col("a")["type"].alias("kind"), F.col("a")["note"].alias("note"))


@query("SELECT event_type, sum((props->>'$.k')::bigint)::bigint AS total, count(*) FILTER (json_extract(props, '$.k') IS NOT NULL) AS n_with_key FROM events GROUP BY 1")
def json_path(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(k.try_cast("long")).alias("total"), F.count(k).alias("n_with_key"))


RULES = [("ring-like", r"\bring\b"), ("widget", "widget"), ("metal", "bolt|gear"), ("red", "red")]


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_name, '(?i)\\bring\\b') THEN 'ring-like' WHEN regexp_matches(p_name, '(?i)widget') THEN 'widget' WHEN regexp_matches(p_name, '(?i)bolt|gear') THEN 'metal' WHEN regexp_matches(p_name, '(?i)red') THEN 'red' ELSE 'other' END AS category FROM part")
def keyword_first(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", S.first_category("p_name", RULES, "other").alias("category"))


@query("WITH k AS (SELECT p_brand, unnest(list_filter([CASE WHEN regexp_matches(p_name, '(?i)\\bring\\b') THEN 'ring-like' END, CASE WHEN regexp_matches(p_name, '(?i)widget') THEN 'widget' END, CASE WHEN regexp_matches(p_name, '(?i)bolt|gear') THEN 'metal' END, CASE WHEN regexp_matches(p_name, '(?i)red') THEN 'red' END], lambda x: x IS NOT NULL)) AS item FROM part) SELECT item, count(*) AS n, string_agg(DISTINCT p_brand, '; ' ORDER BY p_brand) AS members FROM k GROUP BY 1")
def keyword_counts(spark: SparkSession, d: str) -> DataFrame:
    return E.exploded_counts(table(spark, d, "part").select("p_brand", S.all_categories("p_name", RULES).alias("c")), "p_brand", "c")


IBS = f"{PANEL}, p AS (SELECT a.sample_id::varchar AS sample_a, b.sample_id::varchar AS sample_b, avg(1 - abs(a.dosage - b.dosage) / 2.0::double) AS ibs, count(*) AS n_sites FROM cells a JOIN cells b ON a.site_id = b.site_id AND a.sample_id::varchar < b.sample_id::varchar WHERE a.dosage IS NOT NULL AND b.dosage IS NOT NULL GROUP BY 1, 2), b AS (SELECT sample_a, sample_b, ibs FROM p UNION ALL SELECT sample_b, sample_a, ibs FROM p), g AS (SELECT n_nationkey::varchar AS sample_id, r_name AS grp FROM nation JOIN region ON n_regionkey = r_regionkey)"


def groups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("sample_id"), F.col("r_name").alias("grp"))


@query(f"WITH {IBS} SELECT sample_a, sample_b, round(ibs, 9) AS ibs, n_sites FROM p")
def ibs_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(G.ibs_pairs(cells(spark, d, panel=True), groups(spark, d), K.DIPLOID))


@query(f"WITH {IBS}, x AS (SELECT ga.grp AS group_a, gb.grp AS group_b, ibs FROM b JOIN g ga ON sample_a = ga.sample_id JOIN g gb ON sample_b = gb.sample_id WHERE ga.grp <> gb.grp OR sample_a < sample_b) SELECT group_a, group_b, count(*) AS n_pairs, round(avg(ibs), 9) AS mean_ibs, round(median(ibs), 9) AS median_ibs, round(min(ibs), 9) AS min_ibs, round(max(ibs), 9) AS max_ibs, round(1 - avg(ibs), 9) AS distance FROM x GROUP BY ALL")
def group_ibs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(G.group_ibs(G.ibs_pairs(cells(spark, d, panel=True), groups(spark, d), K.DIPLOID), groups(spark, d)))


@query(f"WITH {IBS} SELECT sample_a AS sample_id, round(avg(ibs) FILTER (grp = 'AMERICA'), 9) AS AMERICA, round(avg(ibs) FILTER (grp = 'EUROPE'), 9) AS EUROPE, round(avg(ibs) FILTER (grp = 'AFRICA'), 9) AS AFRICA FROM b JOIN g ON sample_b = g.sample_id GROUP BY 1")
def affinity_pivot(spark: SparkSession, d: str) -> DataFrame:
    return rounded(G.group_affinity(G.ibs_pairs(cells(spark, d, panel=True), groups(spark, d), K.DIPLOID), groups(spark, d), ["AMERICA", "EUROPE", "AFRICA"]))


@query("WITH c AS (SELECT label, list_transform(range(1, 65), lambda i: 0) AS z, 1 AS one FROM embeddings), m AS (SELECT label, i, avg(embedding[i]::double) AS x FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2) SELECT p.label::bigint AS a, q.label::bigint AS b, round(sqrt(sum((p.x - q.x) * (p.x - q.x))), 9) AS distance FROM m p JOIN m q ON p.label < q.label AND p.i = q.i GROUP BY 1, 2")
def centroid_distances(spark: SparkSession, d: str) -> DataFrame:
    long = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centre = long.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    return rounded(L.pairwise_distances(centre, "label", "v"))


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 9) AS pearson, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS weighted_mean FROM lineitem GROUP BY 1")
def pearson_weighted(spark: SparkSession, d: str) -> DataFrame:
    return rounded(table(spark, d, "lineitem").groupBy("l_returnflag").agg(L.pearson("l_quantity", "l_extendedprice").alias("pearson"), L.weighted_mean("l_discount", "l_quantity").alias("weighted_mean")))


@query("WITH r AS (SELECT s_nationkey::bigint AS s_nationkey, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) + (count(*) OVER (PARTITION BY s_nationkey, s_acctbal) - 1) / 2.0::double AS a, rank() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 11) + (count(*) OVER (PARTITION BY s_nationkey, s_suppkey % 11) - 1) / 2.0::double AS b FROM supplier) SELECT s_nationkey, CASE WHEN count(*) >= 3 AND stddev_pop(a) * stddev_pop(b) > 0 THEN round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 9) END AS spearman FROM r GROUP BY 1")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("s_nationkey"), F.col("s_acctbal").alias("x"), (F.col("s_suppkey") % 11).alias("y"))
    r = s.select("s_nationkey", R.average_rank("x", ["s_nationkey"]).alias("a"), R.average_rank("y", ["s_nationkey"]).alias("b"))
    return rounded(r.groupBy("s_nationkey").agg(L.pearson("a", "b").alias("spearman")))


@query("SELECT 'overall' AS scope, NULL::varchar AS value, count(*) AS n FROM customer UNION ALL SELECT 'c_mktsegment', c_mktsegment, count(*) FROM customer GROUP BY 2 UNION ALL SELECT 'c_nationkey', c_nationkey::varchar, count(*) FROM customer GROUP BY 2")
def grouping_panel(spark: SparkSession, d: str) -> DataFrame:
    return E.panel_overview(table(spark, d, "customer"), ["c_mktsegment", "c_nationkey"])


@query("SELECT o_orderpriority, max(o_totalprice) FILTER (o_orderstatus = 'F') AS price_F, max(o_totalprice) FILTER (o_orderstatus = 'O') AS price_O, max(o_custkey) FILTER (o_orderstatus = 'F') AS cust_F, max(o_custkey) FILTER (o_orderstatus = 'O') AS cust_O FROM orders GROUP BY 1")
def pivot_metrics(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumnsRenamed({"o_totalprice": "price", "o_custkey": "cust"})
    return E.wide_metrics(o, "o_orderpriority", "o_orderstatus", ["F", "O"], ["price", "cust"])



@query("WITH t AS (SELECT n_nationkey::bigint AS k, count(s_suppkey) AS x, nullif(max(s_suppkey) % 5, 0) AS y FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1), p AS (SELECT k, (rank() OVER (ORDER BY x NULLS LAST) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::double) / count(x) OVER () AS px, CASE WHEN y IS NOT NULL THEN (rank() OVER (ORDER BY y NULLS LAST) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::double) / count(y) OVER () END AS py FROM t), c AS (SELECT k, round(CASE WHEN py IS NULL THEN px ELSE (px + py) / 2 END, 9) AS consensus FROM p) SELECT k, round(consensus, 9) AS consensus, dense_rank() OVER (ORDER BY consensus DESC NULLS LAST) AS place FROM c")
def consensus_scores(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "nation").join(table(spark, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy(F.col("n_nationkey").cast("long").alias("k")).agg(F.count("s_suppkey").alias("x"), F.nullif(F.max("s_suppkey") % 5, F.lit(0)).alias("y"))
    return rounded(E.consensus(t, "k", ["x", "y"]))


ROLES = "lists AS (SELECT s_suppkey AS accession, 'balance' AS role, rank() OVER (ORDER BY s_acctbal DESC) AS rank FROM supplier UNION ALL SELECT s_suppkey, 'key', rank() OVER (ORDER BY s_suppkey) FROM supplier UNION ALL SELECT s_suppkey, 'nation', rank() OVER (ORDER BY s_nationkey DESC, s_suppkey) FROM supplier), top AS (SELECT * FROM lists WHERE rank <= 20)"


@query(f"WITH {ROLES}, r AS (SELECT accession, count(DISTINCT role) AS n_roles, string_agg(DISTINCT role, '; ' ORDER BY role) AS roles, min(rank) AS best_rank FROM top GROUP BY 1) SELECT accession, n_roles, roles, best_rank, CASE WHEN n_roles >= 3 THEN 'core' WHEN n_roles >= 2 OR best_rank <= 3 THEN 'high' ELSE 'supporting' END AS tier, round(10.0::double * n_roles + 5.0::double * coalesce(s_acctbal / 10000, 0) + 2.0::double * (s_nationkey / 25.0::double), 9) AS score FROM r JOIN supplier ON accession = s_suppkey")
def role_shortlist(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    nation = F.struct((-F.col("s_nationkey")).alias("a"), F.col("s_suppkey").alias("b"))
    orders = {"balance": -F.col("s_acctbal"), "key": F.col("s_suppkey"), "nation": nation}
    place = lambda role: R.with_min_rank(s.withColumn("_v", orders[role]), "_v", "rank", descending=False).where("rank <= 20")
    lists = [place(role).select(F.col("s_suppkey").alias("accession"), F.lit(role).alias("role"), "rank") for role in orders]
    scores = s.select(F.col("s_suppkey").alias("accession"), (F.col("s_acctbal") / 10000).alias("combined"), (F.col("s_nationkey") / F.lit(25.0)).alias("asymmetry"), F.lit(None).cast("double").alias("affinity"))
    return rounded(E.shortlist(lists[0].unionByName(lists[1]).unionByName(lists[2]), scores))


@query("WITH r AS (SELECT l_suppkey AS accession, l_returnflag AS subgenome, l_linestatus AS condition, rank() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY sum(l_quantity) DESC, l_suppkey) AS rank FROM lineitem GROUP BY 1, 2, 3) SELECT accession, subgenome, max(rank) FILTER (condition = 'F') AS baseline_rank, round(avg(rank), 9) AS mean_rank, min(rank) AS min_rank, max(rank) AS max_rank, count(DISTINCT condition) AS n_conditions, bool_and(rank <= 6) AS always_best FROM r GROUP BY 1, 2")
def rank_stability(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    q = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("accession"), F.col("l_returnflag").alias("subgenome"), F.col("l_linestatus").alias("condition")).agg(F.sum("l_quantity").alias("q"))
    r = q.withColumn("rank", F.rank().over(Window.partitionBy("subgenome", "condition").orderBy(F.desc("q"), "accession")).cast("long"))
    return rounded(E.rank_stability(r, "F"))


@query("WITH m AS (SELECT median(l_quantity) AS median_quantity, min(l_discount) AS min_discount, avg((l_returnflag = 'R')::int::double) AS share_r, count(DISTINCT l_linestatus) AS n_status FROM lineitem), c AS (SELECT *, median_quantity >= 20 AS a, min_discount >= 0.05 AS b, share_r <= 0.5 AS c FROM m) SELECT median_quantity, min_discount, round(share_r, 9) AS share_r, n_status, a AS median_ok, b AS discount_ok, c AS share_ok, CASE a::int + b::int + c::int WHEN 3 THEN 'PASS' WHEN 2 THEN 'WARN' ELSE 'FAIL' END AS status FROM c")
def status_gates(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").agg(F.median("l_quantity").alias("median_quantity"), F.min("l_discount").alias("min_discount"), F.avg((F.col("l_returnflag") == "R").cast("double")).alias("share_r"), F.count_distinct("l_linestatus").alias("n_status"))
    return rounded(E.status(m, [("median_ok", F.col("median_quantity") >= 20), ("discount_ok", F.col("min_discount") >= 0.05), ("share_ok", F.col("share_r") <= 0.5)]))


def variants(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("site_id"), F.col("p_brand").alias("contig"), (F.col("p_partkey") * 1000 + 1).alias("pos"), F.substring("p_name", 1, 1).alias("ref"), F.substring("p_type", 1, 1).alias("alt"))


@query()
def bottom_k_sample(spark: SparkSession, d: str) -> DataFrame:
    """Nested hash-priority samples; the tests hold them against unbounded integers."""
    return M.nested(M.bottom_k(variants(spark, d), 400, 91731), [100, 200, 400])


@query()
def reservoir_sample(spark: SparkSession, d: str) -> DataFrame:
    """A replayed reservoir over the sites in order; the tests hold it against a sequential one."""
    return M.reservoir(M.ordinals(variants(spark, d), [F.col("site_id")]), "ordinal", 120, 7)


def panel_rows(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """Sites with an array of dosages over the 25 nations, and the nations' groups."""
    named = groups(spark, d).orderBy("sample_id").collect()
    # The panel is short: one aggregate for each of its samples, and no cells.
    least = lambda k: F.nullif(F.min(F.when(F.col("sample_id") == k, F.col("call"))), F.lit(-1)).cast("double")
    wide = _calls(spark, d, True).groupBy("_site").agg(F.array(*[least(r["sample_id"]) for r in named]).alias("dosages"))
    return _at_sites(spark, d, wide).select("site_id", "contig", "pos", "dosages"), [r["grp"] for r in named]


@query()
def permutation_null(spark: SparkSession, d: str) -> DataFrame:
    """The label-permutation test; the tests hold it against numpy."""
    named = groups(spark, d).orderBy("sample_id").collect()
    rows = K.packed_sites(cells(spark, d, panel=True), [str(r["sample_id"]) for r in named], ["site_id", "contig", "pos"])
    sites = rows.select("contig", S.window_start("pos", WINDOW).alias("window_start"), "planes")
    grp = [r["grp"] for r in named]
    return P.empirical_p(P.window_nulls(sites, grp, "AMERICA", "EUROPE", least=5))


@query()
def pca_variance(spark: SparkSession, d: str) -> DataFrame:
    """Explained variance of the panel's principal components; the tests hold it against numpy."""
    rows, grp = panel_rows(spark, d)
    g, n = L.gram(rows, "dosages", len(grp))
    _, ratio = L.principal_components(g, 5)
    return spark.createDataFrame([(k + 1, float(r), n) for k, r in enumerate(ratio)], "component int, explained_variance_ratio double, n_sites int")


@query()
def pca_affinity(spark: SparkSession, d: str) -> DataFrame:
    """Each panel member's distance to one group's centroid less that to another's, over five components."""
    rows, grp = panel_rows(spark, d)
    scores, _ = L.principal_components(L.gram(rows, "dosages", len(grp))[0], 5)
    affinity = L.introgression_affinity(scores, grp, "AMERICA", "EUROPE")
    return spark.createDataFrame([(k, g, float(a)) for k, (g, a) in enumerate(zip(grp, np.asarray(affinity), strict=True))], "sample_id int, grp string, affinity double")


def hits(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    start = F.col("l_partkey") * 50 + F.col("l_suppkey") + 1
    ahead = F.col("l_linenumber") % 5 > 0
    at = F.col("l_orderkey") * 3 + 1
    long = F.col("l_quantity").cast("long") * 10
    return li.select(
        F.col("l_returnflag").alias("region"), F.concat(F.lit("chunk"), F.col("l_partkey").cast("string")).alias("query"), F.concat(F.lit("T_"), F.when(F.col("l_quantity") > 40, 2).when(F.col("l_quantity") > 30, 1).otherwise(0)).alias("target"),
        start.alias("source_start"), (start + long - 1).alias("source_end"), at.alias("target_start"), (at + long - 1).alias("target_end"), F.when(ahead, 1).otherwise(-1).alias("strand"), long.alias("length"), (F.lit(100.0) - F.col("l_discount") * 100).alias("pident"), F.col("l_extendedprice").alias("bitscore"),
    )


def regions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("region")).agg(F.lit(1).cast("long").alias("region_start"), (F.max("l_partkey") * 50 + 1000).alias("region_end"), F.lit("t.0").alias("expected"))


HITS = """h AS (SELECT l_returnflag AS region, 'chunk' || l_partkey AS query, 'T_' || (CASE WHEN l_quantity > 40 THEN 2 WHEN l_quantity > 30 THEN 1 ELSE 0 END) AS target, l_partkey * 50 + l_suppkey + 1 AS ss, l_partkey * 50 + l_suppkey + l_quantity::bigint * 10 AS se, l_orderkey * 3 + 1 AS ts, l_orderkey * 3 + l_quantity::bigint * 10 AS te, CASE WHEN l_linenumber % 5 > 0 THEN 1 ELSE -1 END AS strand, l_quantity::bigint * 10 AS length, 100.0::double - l_discount * 100 AS pident, l_extendedprice AS bitscore FROM lineitem),
r AS (SELECT l_returnflag AS region, 1::bigint AS a, max(l_partkey) * 50 + 1000 AS b FROM lineitem GROUP BY 1),
best AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY region, query, target ORDER BY bitscore DESC, length DESC, pident DESC, target, ss) = 1),
o AS (SELECT *, CASE WHEN ss <= max(se) OVER (PARTITION BY region, target ORDER BY ss, se ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM best),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY region, target ORDER BY ss, se ROWS UNBOUNDED PRECEDING) AS island FROM o),
u AS (SELECT region, target, sum(n)::bigint AS covered FROM (SELECT region, target, max(se) - min(ss) + 1 AS n FROM i GROUP BY region, target, island) GROUP BY 1, 2),
c AS (SELECT u.*, covered / (b - a + 1) AS fraction, m FROM u JOIN r USING (region) JOIN (SELECT region, target, median(pident) AS m FROM best GROUP BY 1, 2) USING (region, target)),
dom AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY region ORDER BY covered DESC, m DESC, target) = 1),
alt AS (SELECT c.region, max(c.fraction) AS other FROM c JOIN dom ON c.region = dom.region AND c.target <> dom.target GROUP BY 1),
s AS (SELECT best.region, sum(pident * length) / sum(length) AS w, min(ts) AS ms, max(te) AS me, string_agg(DISTINCT CASE WHEN strand >= 0 THEN '+' ELSE '-' END, ';' ORDER BY CASE WHEN strand >= 0 THEN '+' ELSE '-' END) AS strands, count(*) AS n_hits, count(DISTINCT query) AS n_chunks FROM best JOIN dom ON best.region = dom.region AND best.target = dom.target GROUP BY 1)"""


def union_sql(rows: str, by: str) -> str:
    """A subquery: by…, covered positions of rows (by…, ss, se)."""
    return f"""(SELECT {by}, sum(n)::bigint AS covered FROM (SELECT {by}, max(se) - min(ss) + 1 AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY {by} ORDER BY ss, se ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, CASE WHEN ss <= max(se) OVER (PARTITION BY {by} ORDER BY ss, se ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM {rows})) GROUP BY {by}, island) GROUP BY {by})"""


@query(f"WITH {HITS}, x AS (SELECT dom.region, dom.target AS dominant, dom.target = 'T_0' AS expected_match, dom.covered, fraction, least(coalesce(other, 0), 1) AS largest_other, w, ms, me, strands, n_hits, n_chunks, al.covered AS all_covered, nt.k AS n_target_contigs, b - a + 1 AS span FROM dom LEFT JOIN alt USING (region) JOIN s USING (region) JOIN r USING (region) JOIN {union_sql("best", "region")} al USING (region) JOIN (SELECT region, count(*) AS k FROM c GROUP BY 1) nt USING (region)) SELECT region, dominant, expected_match, covered, round(fraction, 9) AS fraction, round(largest_other, 9) AS largest_other, round(w, 9) AS weighted_identity, ms AS mapped_start, me AS mapped_end, strands, n_hits, n_chunks, round(all_covered / span::double, 9) AS all_target_fraction, me - ms + 1 AS mapped_span, n_target_contigs, CASE WHEN expected_match AND fraction >= 0.7 AND largest_other <= 0.1 AND w >= 90 THEN 'PASS' WHEN expected_match AND fraction >= 0.4 AND w >= 85 THEN 'WARN' ELSE 'FAIL' END AS status FROM x")
def interval_mapping(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.interval_mapping(hits(spark, d), regions(spark, d)))


_best = lambda rows, by: f"(SELECT * FROM {rows} QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY bitscore DESC, length DESC, pident DESC, target, ss) = 1)"
_mean_rank = lambda x: f"rank() OVER (PARTITION BY region ORDER BY {x}) + (count(*) OVER (PARTITION BY region, {x}) - 1) / 2.0::double"


@query(f"""WITH {HITS}, top AS (SELECT region, avg((target = 'T_0')::int::double) AS top_fraction, count(*) AS n_queries FROM {_best("h", "region, query")} GROUP BY 1),
own AS {_best("(SELECT * FROM h WHERE target = 'T_0')", "region, query")}, rest AS {_best("(SELECT * FROM h WHERE target <> 'T_0')", "region, target, query")},
ranked AS (SELECT *, {_mean_rank("(ss + se) / 2.0::double")} AS rs, {_mean_rank("(ts + te) / 2.0::double")} AS rt FROM own),
stats AS (SELECT region, sum(pident * length) / sum(length) AS weighted_identity, avg((strand >= 0)::int::double) AS forward_fraction, CASE WHEN count(*) >= 3 AND stddev_pop(rs) * stddev_pop(rt) > 0 THEN covar_pop(rs, rt) / nullif(stddev_pop(rs) * stddev_pop(rt), 0) END AS order_spearman FROM ranked GROUP BY 1),
m AS (SELECT r.region, top_fraction, n_queries, weighted_identity, forward_fraction, order_spearman, v.covered / (b - a + 1)::double AS fraction, coalesce(w.covered / (b - a + 1)::double, 0) AS other
  FROM r LEFT JOIN top USING (region) LEFT JOIN stats USING (region) LEFT JOIN {union_sql("own", "region")} v USING (region) LEFT JOIN (SELECT region, max(covered) AS covered FROM {union_sql("rest", "region, target")} GROUP BY 1) w USING (region)),
g AS (SELECT *, coalesce(top_fraction >= 0.95 AND fraction >= 0.60 AND weighted_identity >= 98 AND other <= 0.10 AND order_spearman >= 0.95, false) AS chrom, coalesce(fraction >= 0.90 AND forward_fraction >= 0.98, false) AS bound FROM m)
SELECT region, round(top_fraction, 9) AS top_fraction, n_queries, round(weighted_identity, 9) AS weighted_identity, round(forward_fraction, 9) AS forward_fraction, round(order_spearman, 9) AS order_spearman, round(fraction, 9) AS fraction, round(other, 9) AS other,
  CASE WHEN chrom THEN 'PASS' ELSE 'WARN' END AS chromosome_status, CASE WHEN bound THEN 'PASS' ELSE 'WARN' END AS boundary_status, CASE WHEN chrom AND bound THEN 'PASS' WHEN chrom THEN 'WARN' ELSE 'FAIL' END AS overall_status FROM g""")
def chromosome_support(spark: SparkSession, d: str) -> DataFrame:
    """Gates of chromosome-level support."""
    return rounded(A.chromosome_support(hits(spark, d), regions(spark, d).withColumn("expected", F.lit("T_0"))))


def lengths(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, d, "orders").where("o_totalprice >= 1").select(F.col("o_orderkey").cast("string").alias("contig"), F.round(F.col("o_totalprice") * 100).cast("long").alias("length"), "o_orderkey")
    t = table(spark, d, "part").select(F.col("p_partkey").alias("seqid"), ((F.col("p_partkey") + 1) * (F.col("p_partkey") % 97 + 3) * 110).alias("target_length"))
    return s, t


@query("WITH s AS (SELECT o_orderkey::varchar AS contig, round(o_totalprice * 100)::bigint AS length FROM orders WHERE o_totalprice >= 1), t AS (SELECT p_partkey AS seqid, (p_partkey + 1) * (p_partkey % 97 + 3) * 110 AS target_length FROM part), j AS (SELECT contig, length, min({'rel': abs(target_length - length) / target_length::double, 'n': target_length, 'k': seqid}, 2) AS m FROM s, t GROUP BY 1, 2), b AS (SELECT contig, length, m[1].k AS seqid, m[1].n AS target_length, m[1].rel AS rel, m[2].rel - m[1].rel AS gap FROM j) SELECT contig, length, seqid, target_length, round(rel, 9) AS rel_diff, round(gap, 9) AS gap, CASE WHEN rel = 0 THEN 'exact' WHEN rel <= 0.08 AND gap >= 0.01 THEN CASE WHEN rel <= 0.03 THEN 'high' ELSE 'medium' END WHEN rel <= 0.08 THEN CASE WHEN rel <= 0.03 THEN 'medium' ELSE 'low' END ELSE 'unresolved' END AS confidence FROM b")
def length_matches(spark: SparkSession, d: str) -> DataFrame:
    """Every order against every part, nothing crossed; the SQL crosses the tables and keeps two of each order's."""
    return rounded(A.length_matches(*lengths(spark, d)))


def two_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two sides that all qualifying sites are dealt to."""
    sites = good_sites(spark, d).where("abs_delta_af >= 0.3").withColumn("contrast", F.lit("a__vs__b"))
    side = lambda k: G.hotspots(sites.where(F.col("site_id") % 2 == k)).select("contrast", "contig", "min_pos", "max_pos", "n_markers")
    return side(0), side(1)


@query(f"WITH {CELLS}, {SITES}, h AS (SELECT contig, site_id % 2 AS k, min(pos) AS lo, max(pos) AS hi, count(*) AS n FROM good WHERE abs_delta_af >= 0.3 GROUP BY ALL) SELECT 'a__vs__b' AS contrast, a.contig, a.n AS n_markers, b.n AS n_markers_b, greatest(least(a.hi, b.hi) - greatest(a.lo, b.lo), 0) AS overlap_bp, round(greatest(0, least(a.hi, b.hi) - greatest(a.lo, b.lo)) / nullif(greatest(a.hi, b.hi) - least(a.lo, b.lo), 0)::double, 9) AS jaccard, CASE WHEN greatest(a.lo, b.lo) <= least(a.hi, b.hi) THEN 'overlap' ELSE 'same_contig' END AS kind FROM h a JOIN h b ON a.contig = b.contig AND a.k = 0 AND b.k = 1")
def hotspot_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.hotspot_pairs(*two_sides(spark, d)))


def supported(p: DataFrame, spots: DataFrame) -> DataFrame:
    at, size = F.col("p_partkey") * 10, F.col("p_size").cast("long")
    h = spots.select(F.col("p_partkey").alias("hotspot"), F.col("p_brand").alias("seqid"), at.alias("a_start"), (at + size * 200).alias("a_end"))
    named = F.when(size % 3 == 1, F.col("p_type")).when(size % 3 == 2, F.concat("p_type", F.lit("; any"))).otherwise("")
    g = p.select(F.col("p_partkey").alias("gene_id"), F.col("p_brand").alias("seqid"), at.alias("b_start"), (at + 500).alias("b_end"), (size % 2 == 0).alias("coding"), (size % 3).alias("hits"), named.alias("categories"))
    return A.gene_support(h, g, 2_000)


@query("WITH h AS (SELECT p_partkey AS hotspot, p_brand AS seqid, p_partkey * 10 AS a, p_partkey * 10 + p_size * 200 AS b FROM part), g AS (SELECT p_partkey AS gene_id, p_brand AS seqid, p_partkey * 10 AS s, p_partkey * 10 + 500 AS e, p_size % 2 = 0 AS coding, p_size % 3 AS hits, CASE p_size % 3 WHEN 1 THEN p_type WHEN 2 THEN p_type || '; any' ELSE '' END AS c FROM part), j AS (SELECT h.hotspot, g.*, least(b, e) - greatest(a, s) + 1 AS bp FROM h JOIN g ON h.seqid = g.seqid AND s <= b AND e >= a), x AS (SELECT hotspot, unnest(string_split(c, '; ')) AS item FROM j), n AS (SELECT hotspot, string_agg(DISTINCT item, '; ' ORDER BY item) AS categories FROM x WHERE item <> '' GROUP BY 1) SELECT h.hotspot, count(DISTINCT gene_id) AS n_genes, count(*) FILTER (coding) AS n_coding, count(*) FILTER (hits > 0) AS n_keyword, coalesce(sum(bp), 0)::bigint AS overlap_bp, coalesce(any_value(categories), '') AS categories FROM h LEFT JOIN j ON h.hotspot = j.hotspot LEFT JOIN n ON h.hotspot = n.hotspot GROUP BY 1")
def gene_support(spark: SparkSession, d: str) -> DataFrame:
    """Every part is a hotspot, and a gene."""
    return supported(table(spark, d, "part"), table(spark, d, "part"))


@query("WITH o AS (SELECT o_orderpriority AS contrast, CASE WHEN o_custkey % 2 = 0 THEN 'sgC' ELSE 'sgE' END AS sg, count(*) AS n, avg(o_totalprice) AS e FROM orders GROUP BY ALL), w AS (SELECT contrast, max(n) FILTER (sg = 'sgC') AS c, max(n) FILTER (sg = 'sgE') AS e, sum(n)::bigint AS t, round(avg(e), 9) AS m FROM o GROUP BY 1), x AS (SELECT o_orderpriority AS contrast, count(*) AS n_final FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' GROUP BY 1) SELECT w.contrast, c AS \"n_markers_sgC\", e AS \"n_markers_sgE\", t AS n_markers_total, m AS mean_effect, coalesce(n_final, 0) AS n_final, round(((rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2.0::double) / count(*) OVER () + (rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0::double) / count(*) OVER ()) / 2, 9) AS consensus FROM w LEFT JOIN x USING (contrast)")
def contrast_consensus(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    overview = o.groupBy(F.col("o_orderpriority").alias("contrast"), F.when(F.col("o_custkey") % 2 == 0, "sgC").otherwise("sgE").alias("subgenome")).agg(F.count("*").alias("n_markers"), F.avg("o_totalprice").alias("mean_effect"))
    final = o.where("o_orderstatus = 'F' and o_orderpriority <> '5-LOW'").groupBy(F.col("o_orderpriority").alias("contrast")).agg(F.count("*").alias("n_final"))
    return rounded(T.contrast_consensus(overview, final))


@query("WITH x AS (SELECT c_mktsegment AS a, nullif(c_nationkey::bigint, 7) AS b, c_custkey, c_name FROM customer) SELECT a, b, count(*) AS n_rows, count(DISTINCT c_custkey) AS n_members, string_agg(DISTINCT c_name, '; ' ORDER BY c_name) AS labels FROM x GROUP BY ALL")
def candidate_shortlist(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "customer").select(F.col("c_mktsegment").alias("a"), F.nullif(F.col("c_nationkey").cast("long"), F.lit(7)).alias("b"), "c_custkey", "c_name")
    return T.candidate_shortlist(x, ["a", "b"], "c_custkey", "c_name")


@query("SELECT 'open' AS section, count(*) AS total, count(*) FILTER (o_orderpriority = '1-URGENT') AS \"n_1-URGENT\", count(*) FILTER (o_orderpriority = '5-LOW') AS \"n_5-LOW\" FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'rest', count(*), count(*) FILTER (o_orderpriority = '1-URGENT'), count(*) FILTER (o_orderpriority = '5-LOW') FROM orders WHERE o_orderstatus <> 'O'")
def readiness(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    both = T.sectioned({"open": o.where("o_orderstatus = 'O'").select("o_orderpriority"), "rest": o.where("o_orderstatus <> 'O'").select("o_orderpriority", "o_custkey")})
    return T.readiness(both, "section", "o_orderpriority", ["1-URGENT", "5-LOW"])


@query("SELECT 'n_rows' AS metric, count(*)::varchar AS value FROM lineitem UNION ALL SELECT 'n_sites', count(DISTINCT l_partkey)::varchar FROM lineitem UNION ALL SELECT 'last_sample', max(l_suppkey)::varchar FROM lineitem")
def dataset_summary(spark: SparkSession, d: str) -> DataFrame:
    return T.key_values(table(spark, d, "lineitem"), n_rows=F.count("*"), n_sites=F.count_distinct("l_partkey"), last_sample=F.max("l_suppkey"))


@query("WITH p AS (SELECT n_regionkey::bigint AS a, (n_nationkey % 5)::bigint AS b, n_nationkey - 12.0::double AS x FROM nation), c AS (SELECT least(a, b)::varchar AS pair_1, greatest(a, b)::varchar AS pair_2, avg(x) AS delta_ibs FROM p GROUP BY 1, 2), q AS (SELECT least(a, b)::varchar AS pair_1, greatest(a, b)::varchar AS pair_2, avg(x * 2) AS delta_distance FROM p WHERE a <> 2 GROUP BY 1, 2) SELECT coalesce(c.pair_1, q.pair_1) AS pair_1, coalesce(c.pair_2, q.pair_2) AS pair_2, delta_ibs, delta_distance, abs(delta_ibs) AS abs_delta_ibs, abs(delta_distance) AS abs_delta_distance, CASE WHEN delta_ibs > 0 THEN 'sgC' WHEN delta_ibs < 0 THEN 'sgE' ELSE 'tie' END AS more_similar_in, CASE WHEN delta_distance > 0 THEN 'sgC' WHEN delta_distance < 0 THEN 'sgE' ELSE 'tie' END AS more_separated_in FROM c FULL JOIN q ON c.pair_1 = q.pair_1 AND c.pair_2 = q.pair_2")
def relationship_deltas(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("group_a"), (F.col("n_nationkey") % 5).cast("string").alias("group_b"), (F.col("n_nationkey") - F.lit(12.0)).alias("delta_ibs"))
    return T.relationship_deltas(n, n.where("group_a <> '2'").select("group_a", "group_b", (F.col("delta_ibs") * 2).alias("delta_distance")))


def named_records(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = table(spark, d, "supplier").select(F.col("s_name").alias("alias"), (F.col("s_suppkey") * 100).alias("length"), F.array(F.col("s_suppkey").cast("string")).alias("tokens"), "s_suppkey")
    k = F.col("p_partkey")
    r = table(spark, d, "part").select(k.cast("string").alias("record_id"), F.when(k % 10 == 1, F.concat(F.lit("supplier#"), F.lpad(F.floor(k / 4).cast("string"), 9, "0"))).otherwise(F.col("p_name")).alias("description"), (k * 25).alias("record_length"))
    return a, r


@query("WITH a AS (SELECT s_name AS alias, s_suppkey * 100 AS length, regexp_replace(lower(s_name), '[^a-z0-9]+', '', 'g') AS plain, s_suppkey::varchar AS tok FROM supplier), r AS (SELECT p_partkey::varchar AS record_id, p_partkey * 25 AS n, regexp_replace(lower(p_partkey::varchar || ' ' || CASE WHEN p_partkey % 10 = 1 THEN 'supplier#' || lpad((p_partkey // 4)::varchar, 9, '0') ELSE p_name END), '[^a-z0-9]+', '', 'g') AS d FROM part), s AS (SELECT alias, record_id, abs(n - length) AS off, CASE WHEN contains(d, plain) THEN 100 ELSE 0 END + CASE WHEN contains(d, tok) THEN 20 ELSE 0 END + CASE WHEN n = length THEN 80 WHEN length > 0 AND abs(n - length) / nullif(length, 0)::double < 0.001 THEN 30 ELSE 0 END AS score FROM a, r), k AS (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY score DESC, off, record_id) AS n, count(*) OVER (PARTITION BY alias, score, off) = 1 AS uniq FROM s WHERE score >= 50) SELECT alias, record_id, score::bigint AS score, off AS length_difference, uniq AS \"unique\", CASE WHEN record_id IS NULL THEN 'unmapped' WHEN score >= 100 THEN 'alias_and_length' WHEN off = 0 THEN 'exact_length' ELSE 'best_available' END AS method FROM a LEFT JOIN (SELECT * FROM k WHERE n = 1) USING (alias)")
def alias_matches(spark: SparkSession, d: str) -> DataFrame:
    """Every supplier is an alias."""
    return rounded(A.alias_matches(*named_records(spark, d)))


def sampled_panels(spark: SparkSession, d: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Nested hash-priority samples of the panel's sites as conditions, and the panel."""
    rows, grp = panel_rows(spark, d)
    who = [(str(k), g) for k, g in enumerate(grp)]
    named = rows.join(variants(spark, d).select("site_id", "ref", "alt"), "site_id")
    sample = M.nested(M.bottom_k(named, 1200, 91731), [150, 300, 600, 1200])
    return sample.select(F.concat(F.lit("sites_"), "panel_size").alias("condition"), "site_id", "contig", "pos", "dosages"), who


@query()
def sampling_stability(spark: SparkSession, d: str) -> DataFrame:
    """Components and ranks of nested samples against the largest; the tests hold it against numpy."""
    from allelix.operators import stability as B

    rows, who = sampled_panels(spark, d)
    scores = B.component_scores(rows, "condition", "dosages", who, ("AMERICA", "EUROPE"))
    ranks = B.affinity_ranks(scores, "EUROPE")
    return B.component_stability(scores, "sites_1200").join(B.rank_agreement(ranks, "sites_1200", 3), "condition")


@query(f"WITH {CELLS}, {SITES}, t AS (SELECT CASE WHEN site_id % 3 = 0 THEN 'third' WHEN site_id % 3 = 1 THEN 'second' ELSE 'base' END AS condition, * FROM good WHERE abs_delta_af >= 0.25), b AS (SELECT condition, contig, min(pos) AS s, max(pos) AS e, count(*) AS c FROM t GROUP BY 1, 2), o AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY condition ORDER BY c DESC, contig) = 1), z AS (SELECT contig AS bc, s AS bs, e AS be FROM o WHERE condition = 'base') SELECT condition, contig, s AS interval_start, e AS interval_end, round(CASE WHEN contig = bc THEN greatest(0, least(e, be) - greatest(s, bs)) / nullif(greatest(e, be) - least(s, bs), 0)::double ELSE 0 END, 9) AS jaccard FROM o, z")
def interval_stability(spark: SparkSession, d: str) -> DataFrame:
    from allelix.operators import stability as B

    k = F.col("site_id") % 3
    t = good_sites(spark, d).where("abs_delta_af >= 0.25").withColumn("condition", F.when(k == 0, "third").when(k == 1, "second").otherwise("base"))
    by = t.groupBy("condition", "contig").agg(F.count("*").alias("n"), F.min("pos").alias("interval_start"), F.max("pos").alias("interval_end"))
    best = R.best_rows(by, ["condition"], [F.desc("n"), F.asc("contig")])
    return rounded(B.interval_stability(best, "base"))


# The same queries under the names that whole tables had beside earlier, smaller ones.
for _name in ("length_matches", "hotspot_pairs", "gene_support", "alias_matches"):
    QUERIES[f"{_name}_all"], ORACLES[f"{_name}_all"] = QUERIES[_name], ORACLES[_name]
