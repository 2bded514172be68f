"""Registered queries of readers and sinks: text in each format is made from the driver's tables by Spark, written to the
shared folder, read back by the reader, and compared with SQL over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelix.functions import scalars as S
from allelix.functions.lineage import fixed, scratch, stored
from allelix.operators import alignment as AL
from allelix.operators import intervals as I
from allelix.operators import marts as K
from allelix.operators import popgen as G
from allelix.operators import sensitivity as A
from allelix.operators import variants as V
from allelix.plans.registry import PANEL, groups, panel_rows, query, rounded, table
from allelix.sources import ranges, readers, sinks

#: Of the VCF's sites: contig, and the two ways in which a site isn't a biallelic SNP.
CONTIG = "'chr_' || chr((65 + site_id % 12)::int) || (CASE site_id % 3 WHEN 0 THEN '_sg_C_1' WHEN 1 THEN '_sg_E_1' ELSE '_scaffold_1' END)"


def staged(df: DataFrame, name: str) -> str:
    path = scratch(df.sparkSession, name)
    df.write.text(path)
    return path


def vcf(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """Text of a VCF whose samples are the nations: its lines as read back, and the samples' groups."""
    rows, grp = panel_rows(spark, d)
    k = F.col("site_id")
    contig = F.concat(F.lit("chr_"), F.char(65 + k % 12), F.when(k % 3 == 0, "_sg_C_1").when(k % 3 == 1, "_sg_E_1").otherwise("_scaffold_1"))
    base = lambda n: F.element_at(F.array(*map(F.lit, "ACGT")), (n % 4 + 1).cast("int"))
    alt = F.when(k % 11 == 0, F.concat(base(k + 1), F.lit(","), base(k + 2))).when(k % 13 == 0, F.lit("*")).otherwise(base(k + 1))
    ref = F.when(k % 17 == 0, F.concat(base(k), base(k))).otherwise(base(k))
    call = F.transform("dosages", lambda x, i: F.concat(F.when(x == 0, "0/0").when(x == 1, "0|1").when(x == 2, "1/1").otherwise("./."), F.lit(":"), (i + 3).cast("string")))
    swapped = F.transform("dosages", lambda x, i: F.concat((i + 3).cast("string"), F.lit(":"), F.when(x == 0, "0/0").when(x == 1, "1|0").when(x == 2, "1/1").otherwise(".")))
    even = k % 2 == 0
    line = F.concat_ws("\t", contig, k * 1000 + 1, F.lit("."), ref, alt, F.lit("50"), F.when(k % 5 == 0, "LowQual").otherwise("PASS"), F.lit("."), F.when(even, "GT:DP").otherwise("DP:GT"), F.array_join(F.when(even, call).otherwise(swapped), "\t"))
    path = staged(rows.select(line.alias("value")), "vcf")
    # Contigs and their lengths come from the lines as written (a site's position is k * 1000 + 1), not from the cells again.
    begins = F.split(F.substring_index("value", "\t", 2), "\t")
    lengths = readers.lines(spark, path).groupBy(F.get(begins, F.lit(0)).alias("contig")).agg(F.max(F.get(begins, F.lit(1)).cast("long") + 499).alias("n")).select(F.format_string("##contig=<ID=%s,length=%d>", F.col("contig"), F.col("n")).alias("value"))
    fixed = ["##fileformat=VCFv4.2", "##GATKCommandLine.HaplotypeCaller=<ID=HaplotypeCaller,Version=4.1,CommandLine=\"x --sample_ploidy=2 reference_sequence=/r/sub.fa y\">", "##GATKCommandLine.GenotypeGVCFs=<ID=GenotypeGVCFs,CommandLine=\"sample_ploidy=4 reference_sequence=/r/all.fa z\",Version=4.2>"]
    names = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *(f"n{i}" for i in range(len(grp)))])
    head = spark.createDataFrame([(x,) for x in [*fixed, names, "short\tline"]], "value string")
    head.unionByName(lengths).write.mode("append").text(path)
    return readers.lines(spark, path), grp


SCAN = f"""{PANEL}, v AS (SELECT site_id, {CONTIG} AS contig, pos, count(dosage) AS called, sum(dosage) AS alts, avg(dosage / 2.0::double) FILTER (grp = 'AMERICA') AS af_a, avg(dosage / 2.0::double) FILTER (grp = 'EUROPE') AS af_b FROM cells GROUP BY ALL),
w AS (SELECT *, CASE site_id % 3 WHEN 0 THEN 'sgC' WHEN 1 THEN 'sgE' ELSE 'unassigned' END AS class, site_id % 11 <> 0 AND site_id % 13 <> 0 AND site_id % 17 <> 0 AS snp, called / 25.0::double AS call_rate, alts / (2.0::double * nullif(called, 0)) AS freq FROM v),
s AS (SELECT *, least(freq, 1 - freq) AS maf, snp AND called > 0 AND call_rate >= 0.2 AND least(freq, 1 - freq) >= 0.05 AS ok FROM w)"""


def scan(spark: SparkSession, d: str, subgenome: str, mode: str) -> tuple[DataFrame, DataFrame]:
    text, grp = vcf(spark, d)
    return text, V.scanned(text, subgenome, mode, range(len(grp)), grp, ("AMERICA", "EUROPE"), 0.2, 0.05)


def _audit_sql(subgenome: str, kept: str) -> str:
    return f"SELECT '{subgenome}' AS subgenome, count(*) + 1 AS variant_lines_total, count(*) FILTER (class = 'sgC') AS \"records_on_sgC_contigs\", count(*) FILTER (class = 'sgE') AS \"records_on_sgE_contigs\", count(*) FILTER (class = 'unassigned') AS records_on_unassigned_contigs, count(*) FILTER (NOT {kept} AND class <> 'unassigned') AS opposite_subgenome_records_excluded, count(*) FILTER (NOT {kept} AND class = 'unassigned') AS unassigned_records_excluded, count(*) FILTER ({kept}) AS retained_contig_records, count(*) FILTER ({kept} AND snp) AS biallelic_snp_lines, count(*) FILTER ({kept} AND ok) AS eligible_variants FROM s"


@query(f"WITH {SCAN} {_audit_sql('sgC', '(class = ' + repr('sgC') + ')')} UNION ALL {_audit_sql('sgE', '(class IN (' + repr('sgE') + ', ' + repr('unassigned') + '))')}")
def vcf_filter_audit(spark: SparkSession, d: str) -> DataFrame:
    """Counters of the contig filter in two modes, over one VCF."""
    text, grp = vcf(spark, d)
    modes = (("sgC", "matching_pseudomolecules_only"), ("sgE", "matching_plus_unassigned"))
    strict, loose = (V.audit(V.scanned(text, g, mode, range(len(grp)), grp, COMPARED, 0.2, 0.05, short=True), g) for g, mode in modes)
    return rounded(strict.unionByName(loose))


def scan_groups(spark: SparkSession, d: str) -> list[str]:
    return [r["grp"] for r in groups(spark, d).orderBy("sample_id").collect()]  # the panel


@query(f"WITH {SCAN} SELECT contig, pos, called, round(call_rate, 9) AS call_rate, round(maf, 9) AS maf, round(af_a, 9) AS af_a, round(af_b, 9) AS af_b, round(abs(af_a - af_b), 9) AS abs_delta_af FROM s WHERE ok AND class = 'sgC'")
def vcf_eligible_sites(spark: SparkSession, d: str) -> DataFrame:
    _, found = scan(spark, d, "sgC", "matching_pseudomolecules_only")
    return rounded(found.where("eligible").select("contig", "pos", "called", "call_rate", "maf", "af_a", "af_b", "abs_delta_af"))


@query(f"WITH {SCAN} SELECT contig, pos, called, round(call_rate, 9) AS call_rate, round(maf, 9) AS maf, round(af_a, 9) AS af_a, round(af_b, 9) AS af_b, round(abs(af_a - af_b), 9) AS abs_delta_af FROM s WHERE ok AND class = 'sgC'")
def vcf_blocks_eligible_sites(spark: SparkSession, d: str) -> DataFrame:
    """The same from block-compressed text, which tasks enter at any of its blocks."""
    text, grp = vcf(spark, d)
    path = scratch(spark, "vcf-gz")
    ranges.write_block_compressed(text.coalesce(2), path)
    lines = ranges.compressed_lines(spark, path, 1 << 16).select("value")
    found = V.scanned(lines, "sgC", "matching_pseudomolecules_only", range(len(grp)), grp, ("AMERICA", "EUROPE"), 0.2, 0.05)
    return rounded(found.where("eligible").select("contig", "pos", "called", "call_rate", "maf", "af_a", "af_b", "abs_delta_af"))


@query(f"WITH {SCAN} SELECT contig, ((pos - 1) // 1000000) * 1000000 + 1 AS window_start, count(*) AS n_markers, round(avg(abs(af_a - af_b)), 9) AS mean_abs_delta_af, round(max(abs(af_a - af_b)), 9) AS max_abs_delta_af, count(*) FILTER (abs(af_a - af_b) >= 0.75) AS n_ge_0_75, count(*) FILTER (abs(af_a - af_b) >= 0.9) AS n_ge_0_90, ((pos - 1) // 1000000) * 1000000 + 1000000 AS window_end FROM s WHERE ok AND class = 'sgC' AND af_a IS NOT NULL AND af_b IS NOT NULL GROUP BY ALL")
def vcf_window_scan(spark: SparkSession, d: str) -> DataFrame:
    _, found = scan(spark, d, "sgC", "matching_pseudomolecules_only")
    # Written once, so that the measures don't each decode the calls.
    return rounded(G.window_scan(fixed(found.where("eligible").select("contig", "pos", "abs_delta_af"))))


@query(f"WITH {PANEL}, v AS (SELECT DISTINCT site_id FROM cells) SELECT {CONTIG} AS contig, max(site_id * 1000 + 500) AS length FROM v GROUP BY 1")
def vcf_contig_lengths(spark: SparkSession, d: str) -> DataFrame:
    return readers.vcf_header(vcf(spark, d)[0])[1]


@query(f"WITH {PANEL}, c AS (SELECT count(DISTINCT {CONTIG})::varchar AS n FROM cells) SELECT * FROM (VALUES ('fileformat', 'VCFv4.2'), ('sample_count', '25'), ('GenotypeGVCFs_version', '4.2'), ('HaplotypeCaller_version', '4.1'), ('GenotypeGVCFs_sample_ploidy', '4'), ('HaplotypeCaller_sample_ploidy', '2'), ('combined_reference_path', '/r/all.fa'), ('subgenome_reference_path', '/r/sub.fa')) t(field, value) UNION ALL SELECT 'contig_count', n FROM c")
def vcf_gatk_fields(spark: SparkSession, d: str) -> DataFrame:
    text, _ = vcf(spark, d)
    return readers.gatk_fields(text, len(readers.vcf_header(text)[0]))


@query(f"WITH {PANEL}, v AS (SELECT DISTINCT site_id, site_id % 13 <> 0 OR site_id % 11 = 0 AS plain FROM cells), s AS (SELECT plain AND site_id % 17 <> 0 AS snp, plain AND site_id % 17 <> 0 AND site_id % 11 <> 0 AS bi FROM v) SELECT count(*) AS variant_lines, count(*) FILTER (snp) AS snp_variant_lines, count(*) FILTER (NOT snp) AS non_snp_variant_lines, count(*) FILTER (bi) AS biallelic_snp_variant_lines, count(*) FILTER (NOT bi) AS non_biallelic_or_non_snp_variant_lines FROM s")
def vcf_variant_classes(spark: SparkSession, d: str) -> DataFrame:
    return V.variant_classes(readers.vcf_records(vcf(spark, d)[0]))


@query(f"WITH {PANEL}, v AS (SELECT DISTINCT site_id FROM cells) SELECT CASE WHEN site_id % 5 = 0 THEN 'LowQual' ELSE 'PASS' END AS filter, count(*) AS n FROM v GROUP BY 1")
def vcf_filter_values(spark: SparkSession, d: str) -> DataFrame:
    return G.filter_counts(readers.vcf_records(vcf(spark, d)[0]), "filter")


@query(f"WITH {PANEL}, t AS (SELECT count(DISTINCT site_id) AS total FROM cells), m AS (SELECT sample_id::int AS place, count(dosage) AS called, count(*) FILTER (dosage = 1) AS het FROM cells GROUP BY 1), every AS (SELECT unnest(range(0, 25)) AS place) SELECT place, total, coalesce(called, 0) AS called, coalesce(het, 0) AS het, total * (place + 3) AS depth, (place + 3)::double AS mean_depth FROM every CROSS JOIN t LEFT JOIN m USING (place)")
def vcf_sample_depth(spark: SparkSession, d: str) -> DataFrame:
    """Calls of any ploidy and their depths (a missing call that is written with a depth keeps it), by sample."""
    records = readers.vcf_records(vcf(spark, d)[0])
    flat = records.select(F.col("format").startswith("GT").alias("first"), F.posexplode("samples").alias("place", "call"))
    g = flat.select("place", F.when(F.col("first"), S.genotype("call", 0, 1)).otherwise(S.genotype("call", 1, 0)).alias("g"))
    return rounded(g.groupBy("place").agg(F.count("*").alias("total"), F.count("g.dosage").alias("called"), F.count_if(F.col("g.dosage") == 1).alias("het"), F.sum("g.depth").alias("depth"), F.avg("g.depth").alias("mean_depth")))


@query()
def vcf_conditions(spark: SparkSession, d: str) -> DataFrame:
    """Sites by sampled condition, five seeds and a reservoir; the tests hold the samples against plain loops."""
    _, found = scan(spark, d, "sgC", "matching_plus_unassigned")
    return sampled(found).groupBy("condition").agg(F.count("*").alias("n_sites"), F.sum("pos").alias("sum_pos"))


def eligible(found: DataFrame) -> DataFrame:
    """The eligible sites, written once: samples and matrices come from one scan."""
    return stored(found.where("eligible").select("contig", "pos", "ref", "alt", "maf", "abs_delta_af", "dosages", F.col("pos").alias("site_id")), "sites")


def sampled(found: DataFrame) -> DataFrame:
    return fixed(V.conditions(eligible(found), SIZES, SEEDS, (100, 7)))


SIZES, SEEDS, BASE, COMPARED = [20, 40, 80, 160], [11, 23, 37, 51, 91731], "filtered_reservoir_100", ("AMERICA", "EUROPE")


def panels(spark: SparkSession, d: str) -> dict[str, list[tuple[int, str]]]:
    """Places and groups of the whole panel's samples, and of a part's."""
    grp = list(enumerate(scan_groups(spark, d)))
    return {"full_panel": grp, "arabica_only": [(k, g) for k, g in grp if g in ("AMERICA", "EUROPE", "AFRICA")]}


def in_conditions(spark: SparkSession, d: str) -> DataFrame:
    """Eligible sites and the conditions that hold them: nested samples of each seed, a reservoir, and all sites."""
    sites = eligible(scan(spark, d, "sgC", "matching_plus_unassigned")[1])
    return A.memberships(sites, V.conditions(sites.select("site_id", "contig", "pos", "ref", "alt"), SIZES, SEEDS, (100, 7)).select("condition", "site_id"))


def analysed(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, list[tuple[str, str]]]]:
    """Components of every condition and panel, a row each, and the panels' samples."""
    of = panels(spark, d)
    samples = {name: [(f"n{k}", g) for k, g in rows] for name, rows in of.items()}
    matrices = A.grams(in_conditions(spark, d), {name: [k for k, _ in rows] for name, rows in of.items()})
    return fixed(A.components(matrices, samples, COMPARED)), samples


@query()
def vcf_stability(spark: SparkSession, d: str) -> DataFrame:
    """Components, ranks and centroid distances of all conditions, all eligible sites among them, and both panels,
    against the reservoir's; the tests hold them against numpy."""
    found, samples = analysed(spark, d)
    by = ["condition", "panel_type"]
    agreed = A.rank_agreement(A.sample_scores(found, samples, "EUROPE"), BASE, 3)
    size = F.create_map(*[F.lit(x) for p, rows in samples.items() for x in (p, len(rows))])
    out = found.select(*by, "n_sites", "n_variable", F.col("separation").alias("centroid_distance"), F.element_at(size, F.col("panel_type")).alias("n_samples"))
    out = out.join(A.stability(found, samples, BASE), by).join(agreed, by)
    return out.withColumn("condition", F.concat_ws("/", "panel_type", "condition")).drop("panel_type")


@query()
def vcf_component_variance(spark: SparkSession, d: str) -> DataFrame:
    """Explained variance by component, condition and panel."""
    return A.variances(analysed(spark, d)[0])


@query()
def vcf_diploid_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """A part's samples within the whole panel's components against the part's own, by condition."""
    found, samples = analysed(spark, d)
    return A.restricted(found, samples, "full_panel", "arabica_only", COMPARED)


@query()
def vcf_interval_stability(spark: SparkSession, d: str) -> DataFrame:
    """The top markers' interval of every condition, against the reservoir's."""
    return A.intervals(in_conditions(spark, d), 50, BASE)


@query(f"""WITH {SCAN}, e AS (SELECT contig, pos, maf, abs(af_a - af_b) AS x FROM s WHERE ok AND class IN ('sgC', 'unassigned')),
c AS (SELECT 'all_eligible' AS condition, * FROM e UNION ALL SELECT 'part_' || ((pos - 1) // 1000) % 3, * FROM e),
z AS (SELECT condition, count(*) AS n_sites FROM c GROUP BY 1), m AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY x DESC, maf DESC, pos) AS r FROM c WHERE x IS NOT NULL),
b AS (SELECT condition, contig, count(*) AS n_top, min(pos) AS i, max(pos) AS j, avg(x) AS mean_x, max(x) AS max_x FROM m WHERE r <= 50 GROUP BY 1, 2),
f AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY n_top DESC, max_x DESC, mean_x DESC, contig) AS r FROM b), g AS (SELECT * FROM f WHERE r = 1), o AS (SELECT contig AS oc, i AS oi, j AS oj FROM g WHERE condition = 'all_eligible')
SELECT z.condition, n_sites, contig AS top_contig, n_top, i AS interval_start, j AS interval_end, j - i AS span_bp, round(mean_x, 9) AS mean_abs_delta_af, round(max_x, 9) AS max_abs_delta_af, contig = oc AS same_top_contig,
  round(CASE WHEN contig = oc THEN greatest(0, least(j, oj) - greatest(i, oi)) / nullif(greatest(j, oj) - least(i, oi), 0)::double ELSE 0 END, 9) AS jaccard, i - oi AS start_shift_bp, j - oj AS end_shift_bp FROM z JOIN g USING (condition) CROSS JOIN o""")
def vcf_interval_conditions(spark: SparkSession, d: str) -> DataFrame:
    """The same for thirds of the sites, against all of them."""
    sites = eligible(scan(spark, d, "sgC", "matching_plus_unassigned")[1])
    thirds = sites.select(F.concat(F.lit("part_"), F.expr("((pos - 1) div 1000) % 3").cast("string")).alias("condition"), "site_id")
    return rounded(A.intervals(A.memberships(sites, thirds, few=False), 50, A.ALL))


# ---- annotations


def gff(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    k, seq = F.col("p_partkey"), F.concat(F.lit("ref|NC_"), F.regexp_extract("p_brand", r"(\d+)", 1), F.lit(".1|"))
    gene = F.concat_ws("\t", seq, F.lit("x"), F.lit("gene"), k * 10, k * 10 + F.col("p_size") * 3, F.lit("."), F.when(k % 2 == 0, "+").otherwise("-"), F.lit("."), F.concat(F.lit("ID=gene-"), k.cast("string"), F.when(k % 3 == 0, F.concat(F.lit(";gene=g"), k.cast("string"))).otherwise(F.concat(F.lit(";Name=n"), k.cast("string"))), F.lit(";description="), F.col("p_type")))
    other = F.concat_ws("\t", seq, F.lit("x"), F.lit("exon"), k * 10, k * 10 + 1, F.lit("."), F.lit("+"), F.lit("."), F.lit("ID=e"))
    region = p.groupBy(seq.alias("s")).agg(F.max(k * 10 + 500).alias("n")).select(F.concat_ws("\t", "s", F.lit("x"), F.lit("region"), F.lit("1"), "n", F.lit("."), F.lit("+"), F.lit("."), F.concat(F.lit("ID=r;Name=c;chromosome="), F.regexp_extract("s", r"(\d+)", 1))).alias("value"))
    text = spark.createDataFrame([("##gff-version 3",)], "value string").unionByName(region).unionByName(p.select(gene.alias("value"))).unionByName(p.select(other.alias("value")))
    return readers.lines(spark, staged(text, "gff3"))


NC = "'NC_' || regexp_extract(p_brand, '(\\d+)', 1) || '.1'"


@query(f"SELECT {NC} AS seqid, 1::bigint AS start, max(p_partkey * 10 + 500) AS \"end\", max(p_partkey * 10 + 500) AS length, regexp_extract(any_value(p_brand), '(\\d+)', 1) AS chromosome_label FROM part GROUP BY 1")
def gff3_regions(spark: SparkSession, d: str) -> DataFrame:
    return readers.regions_and_genes(gff(spark, d), "sgC")[0].select("seqid", "start", "end", "length", "chromosome_label")


@query(f"WITH g AS (SELECT {NC} AS seqid, p_partkey, p_partkey * 10 AS s, p_partkey * 10 + p_size * 3 AS e, p_type FROM part), b AS (SELECT {NC} AS seqid, p_partkey * 40 + 7 AS s, p_partkey * 40 + 60 AS e FROM part) SELECT seqid, s AS start, e AS \"end\", 'gene-' || p_partkey AS gene_id, CASE WHEN p_partkey % 3 = 0 THEN 'g' ELSE 'n' END || p_partkey AS gene_name, p_type AS description, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM g WHERE EXISTS (SELECT 1 FROM b WHERE b.seqid = g.seqid AND g.s <= b.e AND g.e >= b.s)")
def gff3_supported_genes(spark: SparkSession, d: str) -> DataFrame:
    """Genes that touch a supported block."""
    found = readers.regions_and_genes(gff(spark, d), "sgC")[1]
    k = F.col("p_partkey")
    blocks = table(spark, d, "part").select(F.concat(F.lit("NC_"), F.regexp_extract("p_brand", r"(\d+)", 1), F.lit(".1")).alias("seqid"), (k * 40 + 7).alias("start"), (k * 40 + 60).alias("end"))
    return readers.on_blocks(found, blocks, 10_000).select("seqid", "start", "end", "gene_id", "gene_name", "description", "strand")


PRODUCTS = ("disease resistance protein RPP13", "sugar transporter ERD6", "WRKY transcription factor 40", "ATP synthase subunit", "wall-associated receptor kinase", "ribosomal protein L2", "peroxidase 12", "")
_product = f"[{', '.join(repr(x) for x in PRODUCTS)}][p_partkey % {len(PRODUCTS)} + 1]"
_terms = sorted({t for terms in S.GENE_LIBRARY.values() for t in terms})


def loose_gff(spark: SparkSession, d: str) -> DataFrame:
    """Gene lines of nine fields or more, of any case, whose names and products stand under each of their keys; lines of
    eight fields, comments and other features beside them."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    product = F.element_at(F.array(*[F.lit(x) for x in PRODUCTS]), (k % len(PRODUCTS)).cast("int") + 1)
    key = lambda *names: F.element_at(F.array(*[F.lit(n) for n in names]), (k % len(names)).cast("int") + 1)
    named = F.when(k % 5 != 0, F.concat(F.lit(";"), key("Name", "gene", "gene_name"), F.lit("=n"), k.cast("string")))
    text = F.concat(key("ID", "gene_id"), F.lit("=g"), k.cast("string"), F.coalesce(named, F.lit("")), F.lit(";"), key("product", "description", "Note"), F.lit("="), product)
    fields = [F.concat(F.lit("ref|NC_"), (k % 7).cast("string"), F.lit(".1|")), F.lit("x"), key("gene", "Gene", "exon", "GENE"), k * 10, k * 10 + 99, F.lit("."), key("+", "-"), F.lit(".")]
    more = F.when(k % 6 == 0, F.lit("\tkinase"))
    lines = F.when(k % 11 == 0, F.concat_ws("\t", *fields)).otherwise(F.concat(F.concat_ws("\t", *fields, text), F.coalesce(more, F.lit(""))))
    return readers.lines(spark, staged(p.select(lines.alias("value")).unionByName(p.select(F.concat(F.lit("#"), lines).alias("value"))), "loose_gff3"))


@query(f"WITH g AS (SELECT 'NC_' || p_partkey % 7 || '.1' AS seqid, p_partkey * 10 AS s, p_partkey * 10 + 99 AS e, ['+', '-'][p_partkey % 2 + 1] AS strand, 'g' || p_partkey AS gene_id, CASE WHEN p_partkey % 5 <> 0 THEN 'n' || p_partkey ELSE '' END AS gene_name, {_product} AS product FROM part WHERE p_partkey % 4 <> 2 AND p_partkey % 11 <> 0), t AS (SELECT *, lower(gene_name || ' ' || product) AS low, [{', '.join(repr(t) for t in _terms)}] AS every FROM g WHERE regexp_matches(gene_name || ' ' || product, '{S.CANDIDATES}', 'i')) SELECT seqid, s AS start, e AS \"end\", strand, gene_id, gene_name, product, array_to_string(list_filter([{', '.join('CASE WHEN ' + ' OR '.join(f'contains(low, {t!r})' for t in terms) + f' THEN {n!r} END' for n, terms in sorted(S.GENE_LIBRARY.items()))}], lambda x: x IS NOT NULL), '; ') AS categories, array_to_string(list_filter(every, lambda x: contains(low, x)), '; ') AS terms, len(list_filter(every, lambda x: contains(low, x)))::bigint AS hits FROM t")
def gff3_candidate_genes(spark: SparkSession, d: str) -> DataFrame:
    """Genes under all their fallbacks that the candidate pattern finds, with the library's terms."""
    return rounded(AL.candidate_genes(readers.genes(readers.gff3(loose_gff(spark, d)))).drop("raw_attributes"))


# ---- sequences and hits


def records(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.concat(F.lit("rec"), "p_partkey").alias("record_id"), F.col("p_name").alias("description"), F.expr("repeat('ACGTN', p_size * 7)").alias("sequence"))


@query("SELECT 'rec' || p_partkey AS record_id, p_name AS description, p_size::bigint * 35 AS length FROM part")
def fasta_lengths(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "fasta")
    sinks.write_fasta(records(spark, d), path)
    return ranges.record_lengths(ranges.fasta_pieces(spark, path))


@query("SELECT 'rec' || p_partkey AS record_id, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'G->A >> ' || p_name END AS description, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE p_size::bigint * 35 END AS length FROM part")
def fasta_marked_headers(spark: SparkSession, d: str) -> DataFrame:
    """Records with ">" inside their headers, without descriptions, or without a sequence, and text before the first;
    pieces are shorter than lines' sums, so records reach over several."""
    k, path = F.col("p_partkey"), scratch(spark, "fasta")
    text = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("G->A >> "), "p_name"))
    marked = table(spark, d, "part").select(F.concat(F.lit("rec"), k.cast("string")).alias("record_id"), text.alias("description"), F.when(k % 7 == 0, "").otherwise(F.expr("repeat('ACGTN', p_size * 7)")).alias("sequence"))
    sinks.write_fasta(marked, path)
    spark.range(1).select(F.lit("no header\nACGT")).write.mode("append").text(path)
    return ranges.record_lengths(ranges.fasta_pieces(spark, path, 200))


@query("WITH c AS (SELECT p_partkey, p_size::bigint * 35 AS n FROM part), k AS (SELECT p_partkey, n, unnest(range(0, greatest(0, ceil((n - 300) / 200.0)::bigint) + 1)) AS i FROM c) SELECT 'rec' || p_partkey AS record_id, i + 1 AS chunk_index, i * 200 + 1 AS chunk_start, least(i * 200 + 300, n) AS chunk_end, substr(repeat('ACGTN', 500), i * 200 + 1, least(i * 200 + 300, n) - i * 200) AS sequence FROM k WHERE least(i * 200 + 300, n) - i * 200 >= 100")
def fasta_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping chunks cut from pieces of records."""
    path = scratch(spark, "fasta")
    sinks.write_fasta(records(spark, d), path)
    return ranges.record_chunks(ranges.fasta_pieces(spark, path, 170), 300, 100, 100)


@query("SELECT 'rec7' AS record_id, p_size::bigint * 35 AS length FROM part WHERE p_partkey = 7")
def fasta_one_record(spark: SparkSession, d: str) -> DataFrame:
    """One record copied out to a file of its own, and read from there."""
    paths = [scratch(spark, "fasta") for _ in range(2)]
    sinks.write_fasta(records(spark, d), paths[0])
    sinks.write_fasta(readers.fasta_record(readers.fasta(spark, paths[0]), "rec7"), paths[1])
    return readers.fasta(spark, paths[1]).select("record_id", "length")


@query("WITH h AS (SELECT 'NC_' || l_suppkey || '.1' AS target_seqid, l_partkey * 100 + 1 + 9 AS source_start, l_partkey * 100 + l_quantity::bigint * 300 AS source_end, least(l_orderkey, l_orderkey + CASE WHEN l_linenumber % 2 = 0 THEN 500 ELSE -500 END) AS ts, 100 - l_discount * 100 AS pident, l_quantity::bigint * 300 AS length, CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END AS strand FROM lineitem) SELECT target_seqid, strand::bigint AS strand, count(*) AS n_hits, min(source_start) AS first_start, max(source_end) AS last_end, min(ts) AS first_target FROM h WHERE round(pident, 6) >= 98 AND length >= 10000 GROUP BY 1, 2")
def blast_supported(spark: SparkSession, d: str) -> DataFrame:
    """Supported hits of a tabular file, by target and strand."""
    li = table(spark, d, "lineitem")
    n, start = F.col("l_quantity").cast("long") * 300, F.col("l_partkey") * 100 + 1
    far = F.col("l_orderkey") + F.when(F.col("l_linenumber") % 2 == 0, 500).otherwise(-500)
    cells = [F.concat(F.lit("chunk"), F.lpad(F.col("l_linenumber").cast("string"), 4, "0"), F.lit("|src="), start.cast("string"), F.lit("-"), (start + n).cast("string")), n, F.lit(10), n, F.concat(F.lit("ref|NC_"), F.col("l_suppkey").cast("string"), F.lit(".1|")), F.lit(9), F.col("l_orderkey"), far, F.round(100 - F.col("l_discount") * 100, 6), n, F.lit(200), F.lit(0)]
    found = readers.blast(spark, staged(li.select(F.concat_ws("\t", *[c.cast("string") for c in cells]).alias("value")), "blast"))
    return rounded(readers.supported(found).groupBy("target_seqid", "strand").agg(F.count("*").alias("n_hits"), F.min("source_start").alias("first_start"), F.max("source_end").alias("last_end"), F.min("target_start").alias("first_target")))


@query("WITH c AS (SELECT p_partkey, p_size::bigint * 35 AS n FROM part), k AS (SELECT p_partkey, least(n, 1500) - 11 + 1 AS m, unnest(range(0, greatest(0, ceil((least(n, 1500) - 10 - 300) / 200.0)::bigint) + 1)) AS i FROM c WHERE n > 10) SELECT p_partkey, 'chunk' || lpad((i + 1)::varchar, 4, '0') || '|src=' || (11 + i * 200) || '-' || (10 + least(i * 200 + 300, m)) AS query, i + 1 AS chunk_index, 11 + i * 200 AS source_start, 10 + least(i * 200 + 300, m) AS source_end, least(i * 200 + 300, m) - i * 200 AS chunk_length, substr('ACGTN', (i * 200 + 10) % 5 + 1, 1) AS first_base FROM k WHERE least(i * 200 + 300, m) - i * 200 >= 100")
def named_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping chunks of a stretch of each record, with their names and sequences."""
    p = table(spark, d, "part").select("p_partkey", F.expr("repeat('ACGTN', p_size * 7)").alias("sequence"), F.lit(11).alias("a"), F.lit(1500).alias("b"))
    return I.named_chunks(p, "sequence", "a", "b", 300, 100, 100).withColumn("first_base", F.substring("chunk_sequence", 1, 1)).drop("chunk_sequence")


@query("WITH h AS (SELECT 'q' || l_partkey AS query, 10 + l_linenumber * 5 AS q1, CASE WHEN l_linenumber % 3 = 0 THEN 2 ELSE 90 END AS q2, l_orderkey AS s1, l_orderkey + CASE WHEN l_linenumber % 2 = 0 THEN 50 ELSE -50 END AS s2 FROM lineitem), c AS (SELECT 'q' || p_partkey AS query, p_partkey * 1000 AS origin FROM part WHERE p_partkey % 10 <> 3) SELECT h.query, origin + least(q1, q2) - 1 AS source_hsp_start, origin + greatest(q1, q2) - 1 AS source_hsp_end, least(s1, s2) AS target_hsp_start, greatest(s1, s2) AS target_hsp_end, CASE WHEN (q2 - q1) * (s2 - s1) >= 0 THEN '+' ELSE '-' END AS orientation FROM h LEFT JOIN c USING (query)")
def hits_on_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Hits placed by a table of chunks, some of which it lacks."""
    n = F.col("l_linenumber")
    hits = table(spark, d, "lineitem").select(F.concat(F.lit("q"), "l_partkey").alias("query"), (n * 5 + 10).alias("qstart"), F.when(n % 3 == 0, 2).otherwise(90).alias("qend"), F.col("l_orderkey").alias("sstart"), (F.col("l_orderkey") + F.when(n % 2 == 0, 50).otherwise(-50)).alias("send"), F.lit(99.0).alias("pident"), F.lit(100).alias("length"))
    chunks = table(spark, d, "part").where("p_partkey % 10 <> 3").select(F.concat(F.lit("q"), "p_partkey").alias("query"), (F.col("p_partkey") * 1000).alias("source_start"))
    return rounded(readers.on_chunks(hits, chunks).select("query", "source_hsp_start", "source_hsp_end", "target_hsp_start", "target_hsp_end", "orientation"))


@query("SELECT count(*) AS n_records, min_by(n_name, n_nationkey) AS \"organismName\", min_by(n_nationkey::varchar, n_nationkey) AS accession, true AS has_alias FROM nation")
def jsonl_report(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").orderBy("n_nationkey")
    text = n.select(F.to_json(F.struct(F.struct(F.col("n_name").alias("organismName")).alias("organism"), F.col("n_nationkey").cast("string").alias("accession"), F.struct(F.struct(F.lit("x").alias("sequenceAlias")).alias("deep")).alias("chr"))).alias("value")).coalesce(1)
    return readers.jsonl_inventory(readers.lines(spark, staged(text, "jsonl")), ["$.organism.organismName", "$.accession"])


# ---- metadata and tables


@query("WITH s AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Coffea canephora' WHEN 1 THEN 'Coffea eugenioides' ELSE 'Coffea arabica' END AS sp, CASE s_suppkey % 5 WHEN 0 THEN 'Wild' WHEN 1 THEN 'cultivated' WHEN 2 THEN 'Introgressed' ELSE NULL END AS v, s_suppkey % 7 = 0 AS no_lat, s_suppkey % 3 = 0 AS text_order FROM supplier) SELECT CASE WHEN sp LIKE '%canephora' THEN 'canephora' WHEN sp LIKE '%eugenioides' THEN 'eugenioides' WHEN v = 'Introgressed' THEN 'arabica_introgressed' WHEN v = 'cultivated' THEN 'arabica_cultivated' WHEN v = 'Wild' THEN 'arabica_wild' ELSE 'arabica_other' END AS analysis_group, count(*) AS n, count(*) FILTER (NOT no_lat) AS n_with_latitude, count(*) FILTER (NOT text_order) AS n_with_order FROM s GROUP BY 1")
def metadata_groups(spark: SparkSession, d: str) -> DataFrame:
    """Delimited metadata, renamed, checked and flagged, by analysis group."""
    k = F.col("s_suppkey")
    raw = table(spark, d, "supplier").select(
        F.concat(F.lit(" ACC"), k.cast("string"), F.lit(" ")).alias("Seq.ID"), F.when(k % 4 == 0, "Coffea canephora").when(k % 4 == 1, "Coffea eugenioides").otherwise(" Coffea arabica ").alias("species"), F.when(k % 5 == 0, "Wild").when(k % 5 == 1, "cultivated").when(k % 5 == 2, "Introgressed").alias("variety(s)"),
        F.when(k % 7 != 0, k * 1.5).alias("Latitude"), F.lit(1.0).alias("Longitude"), F.lit(None).cast("double").alias("altitude"), F.when(k % 3 == 0, "none").otherwise(k.cast("string")).alias("order"),
    )
    path = scratch(spark, "metadata")
    raw.write.option("header", True).csv(path)
    meta = readers.with_coordinates(readers.metadata(spark, path, {"Seq.ID": "seq_id", "species": "species_name", "variety(s)": "variety"}, ["seq_id", "species_name"]))
    return meta.groupBy("analysis_group").agg(F.count("*").alias("n"), F.count_if("has_latitude").alias("n_with_latitude"), F.count("order").alias("n_with_order"))


@query("SELECT 'nations' AS \"table\", 'nations of the panel' AS description, 3::bigint AS columns, count(*) AS rows FROM nation UNION ALL SELECT 'regions', '', 2, count(*) FROM region UNION ALL SELECT 'suppliers', '', 4, count(*) FROM supplier")
def table_bundle(spark: SparkSession, d: str) -> DataFrame:
    """Named tables written with a manifest, read back with their required columns."""
    path = scratch(spark, "bundle")
    tables = {n: table(spark, d, t) for n, t in (("nations", "nation"), ("regions", "region"), ("suppliers", "supplier"))}
    manifest = sinks.write_tables(tables, path, descriptions={"nations": "nations of the panel"})
    back = sinks.read_tables(spark, path, {n: df.columns for n, df in tables.items()})
    counted = K.guide(back, {}).select(F.col("sheet").alias("table"), F.col("rows").alias("_rows"))
    return rounded(manifest.join(counted, "table").where("rows = _rows").select("table", "description", "columns", "rows"))


@query("SELECT 'first' AS sheet, 'nations' AS description, count(*) AS rows, 3::bigint AS columns FROM nation UNION ALL SELECT 'an empty table with a very long', '', 0, 2")
def report_guide(spark: SparkSession, d: str) -> DataFrame:
    return rounded(K.guide({"first": table(spark, d, "nation"), "an empty table with a very long name": table(spark, d, "region").where("false")}, {"first": "nations"}))


MATRIX = "long AS (SELECT 'S' || a.n_nationkey AS r, 'S' || b.n_nationkey AS c, CASE WHEN (a.n_nationkey + b.n_nationkey) % 9 <> 0 THEN a.n_nationkey + b.n_nationkey * 2.0::double END AS v FROM nation a, nation b)"


def matrix(spark: SparkSession, d: str) -> DataFrame:
    """A wide CSV of nations against nations, read into long form."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    keys = [r["k"] for r in n.orderBy("k").collect()]  # the panel
    cell = lambda b: F.when((F.col("k") + b) % 9 == 0, "n/a").otherwise((F.col("k") + b * 2.0).cast("string")).alias(f"S{b}")
    path = scratch(spark, "matrix")
    n.select(F.concat(F.lit("S"), "k").alias("any name"), *[cell(b) for b in keys]).write.option("header", True).csv(path)
    return readers.wide_matrix(spark, path)


@query(f"WITH {MATRIX} SELECT r AS \"row\", c AS col, v AS value FROM long")
def wide_matrix(spark: SparkSession, d: str) -> DataFrame:
    return matrix(spark, d)


@query(f"WITH {MATRIX}, m AS (SELECT 'S' || n_nationkey AS name, CASE WHEN n_nationkey % 6 <> 5 THEN 'C' || (n_nationkey % 8) END AS canon FROM nation), x AS (SELECT p.canon AS a, long.c, q.canon AS b, avg(v) AS v FROM long JOIN m p ON r = p.name JOIN m q ON c = q.name WHERE p.canon IS NOT NULL AND q.canon IS NOT NULL GROUP BY ALL) SELECT a AS sample_a, b AS sample_b, round(avg(v), 9) AS value FROM x WHERE a <> 'C3' AND b <> 'C3' GROUP BY 1, 2")
def relabelled_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The matrix under canonical names, repeated ones averaged, cut to the names allowed."""
    k = F.col("n_nationkey")
    lookup = table(spark, d, "nation").select(F.concat(F.lit("S"), k.cast("string")).alias("name"), F.when(k % 6 != 5, F.concat(F.lit("C"), (k % 8).cast("string"))).alias("canonical"))
    return rounded(K.relabelled(matrix(spark, d), lookup, lookup.select("canonical").where("canonical <> 'C3'")))
