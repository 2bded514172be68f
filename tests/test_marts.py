"""The assembled variant analysis against plain loops, the report marts on small cases, and readers' odd input."""

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from allelix.functions import scalars as S
from allelix.operators import linalg, marts, popgen, reports, sampling, variants
from allelix.plans import formats, registry
from allelix.sources import readers

HEAD = ["##fileformat=VCFv4.2", "##contig=<ID=chr_D_sg_C_1,length=900>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\tc\td"]
BODY = [
    ("chr_D_sg_C_1", 1, "A", "G", "GT", "0/1 1/1 0/0 ./."),
    ("chr_D_sg_C_1", 2, "A", "G,T", "GT", "0/1 1/1 0/0 0/0"),
    ("chr_D_sg_C_1", 3, "A", "*", "GT", "0/1 1/1 0/0 0/0"),
    ("chr_D_sg_C_1", 4, "AT", "G", "GT", "0/1 1/1 0/0 0/0"),
    ("chr_D_sg_C_1", 5, "A", "C", "DP:GT", "3:0/1 4:. 5 6:0/0"),
    ("chr_D_sg_C_1", 6, "A", "C", "GT", ". ./. .|. ."),
    ("chr_D_sg_E_1", 7, "A", "C", "GT", "0/1 0/1 0/1 0/1"),
    ("scaffold_9", 8, "A", "C", "GT", "0/1 0|1 1/0 0/1"),
    ("chr_A_sg_CC_1", 9, "A", "C", "GT", "1/1 1/1 0/0 0/0"),
]


def lines(spark, rows=BODY):
    text = [*HEAD, *["\t".join([c, str(p), ".", r, a, "1", "PASS", ".", f, *calls.split(" ")]) for c, p, r, a, f, calls in rows], "too\tshort"]
    return spark.createDataFrame([(x,) for x in text], "value string")


def test_scan_and_audit(spark):
    text = lines(spark)
    scan = variants.scanned(text, "sgC", "matching_pseudomolecules_only", [0, 1, 2, 3], ["x", "x", "y", "y"], ("x", "y"), 0.5, 0.05)
    rows = {r["pos"]: r for r in scan.collect()}
    assert rows[1]["dosages"] == [1, 2, 0, None] and rows[1]["call_rate"] == 0.75 and rows[1]["maf"] == 0.5
    assert (rows[1]["af_a"], rows[1]["af_b"], rows[1]["abs_delta_af"]) == (0.75, 0.0, 0.75)
    assert rows[5]["dosages"] == [1, None, None, 0] and rows[6]["called"] == 0 and rows[6]["abs_delta_af"] is None
    assert rows[7]["dosages"] is None and not rows[2]["snp"] and not rows[4]["snp"]
    assert [p for p, r in sorted(rows.items()) if r["eligible"]] == [1, 5]
    counted = variants.scanned(text, "sgC", "matching_pseudomolecules_only", [0, 1, 2, 3], ["x", "x", "y", "y"], ("x", "y"), 0.5, 0.05, short=True)
    got = variants.audit(counted, "sgC").first().asDict()
    assert got == {"subgenome": "sgC", "variant_lines_total": 10, "records_on_sgC_contigs": 6, "records_on_sgE_contigs": 1, "records_on_unassigned_contigs": 2, "opposite_subgenome_records_excluded": 1, "unassigned_records_excluded": 2, "retained_contig_records": 6, "biallelic_snp_lines": 3, "eligible_variants": 2}
    loose = variants.scanned(text, "sgC", "matching_plus_unassigned", [0, 1, 2, 3], ["x", "x", "y", "y"], ("x", "y"), 0.5, 0.05)
    assert {r["pos"] for r in loose.where("retained").collect()} == {1, 2, 3, 4, 5, 6, 8, 9}
    every = variants.scanned(text, "sgC", "none", [2], ["y"], ("x", "y"))
    assert every.where("retained").count() == 9 and every.where("af_a is not null").count() == 0
    with pytest.raises(ValueError, match="mode"):
        variants.scanned(text, "sgC", "some", [0], ["x"], ("x", "y"))
    with pytest.raises(Exception, match="without GT"):
        variants.scanned(lines(spark, [("chr_D_sg_C_1", 1, "A", "G", "DP", "1 2 3 4")]), "sgC", "none", [0], ["x"], ("x", "y")).collect()


def test_variant_classes(spark):
    got = variants.variant_classes(readers.vcf_records(lines(spark))).first().asDict()
    assert got == {"variant_lines": 9, "snp_variant_lines": 7, "non_snp_variant_lines": 2, "biallelic_snp_variant_lines": 6, "non_biallelic_or_non_snp_variant_lines": 3}


def test_genotype_depth(spark):
    calls = ["0/1:7", "./.:7", ".", "./.", "", "1/2/3:x", ".:9", "0|.:4", "a/b:1", "2:5"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(calls)], "i int, c string").select("i", S.genotype("c", 0, 1).alias("g")).orderBy("i")
    assert [tuple(r["g"]) for r in df.collect()] == [(1.0, 7, False), (None, 7, True), (None, None, True), (None, None, True), (None, None, True), (6.0, None, False), (None, 9, True), (None, 4, True), (None, 1, True), (2.0, 5, False)]


def test_conditions_are_prefixes(spark, small):
    """Samples of every seed are the first of one order, and of the size asked for; the reservoir is the replayed one."""
    _, found = formats.scan(spark, small, "sgC", "matching_plus_unassigned")
    sites = [r for r in found.where("eligible").orderBy("pos").collect()]
    rows = formats.sampled(found).collect()
    by = {}
    for r in rows:
        by.setdefault(r["condition"], set()).add(r["pos"])
    mask = (1 << 64) - 1
    for seed in (11, 23, 37, 51, 91731):
        def key(r):
            return int(sampling.splitmix64(np.array([sampling.fnv1a64(r["contig"]) ^ (r["pos"] * 0xD6E8FEB86659FD93 & mask) ^ sampling.fnv1a64(f"{r['ref']}>{r['alt']}") ^ seed], np.uint64))[0])
        order = [r["pos"] for r in sorted(sites, key=key)]
        for size in (20, 40, 80, 160):
            assert by[f"priority_seed_{seed}_{size}"] == set(order[:size])
    rng, held = random.Random(7), []
    for i, r in enumerate(sites):
        if i < 100:
            held.append(r["pos"])
        elif (j := rng.randint(0, i)) < 100:
            held[j] = r["pos"]
    assert by["filtered_reservoir_100"] == set(held)


def test_stability_of_conditions(spark, small):
    """Scores, correlations, Procrustes and centroid distances of one condition and both panels, against numpy."""
    _, found = formats.scan(spark, small, "sgC", "matching_plus_unassigned")
    grp = formats.scan_groups(spark, small)
    data = {}
    every = formats.eligible(found).select(F.lit("all_eligible").alias("condition"), "dosages")
    for r in formats.sampled(found).select("condition", "dosages").unionByName(every).collect():
        data.setdefault(r["condition"], []).append([np.nan if v is None else v for v in r["dosages"]])
    assert len(data) == 22
    got = {r["condition"]: r for r in formats.vcf_stability(spark, small).collect()}
    assert len(got) == 2 * len(data)
    some = [k for k, g in enumerate(grp) if g in ("AMERICA", "EUROPE", "AFRICA")]
    variance = {}
    for r in formats.vcf_component_variance(spark, small).collect():
        variance.setdefault((r["panel_type"], r["condition"]), {})[r["component"]] = r["explained_variance_ratio"]
    restricted = {r["condition"]: r for r in formats.vcf_diploid_sensitivity(spark, small).collect()}
    wide = {}
    for panel, places in (("full_panel", list(range(25))), ("arabica_only", some)):
        own = np.array(grp)[places]
        scores = {c: linalg.principal_components((z := linalg.standardised(np.array(x, float)[:, places])).T @ z, 5)[0] for c, x in data.items()}
        base = scores["filtered_reservoir_100"]
        i, j = np.triu_indices(len(places), 1)
        away = lambda s: np.linalg.norm(s[i] - s[j], axis=1)
        for c, s in scores.items():
            r = got[f"{panel}/{c}"]
            assert r["distance_correlation"] == pytest.approx(np.corrcoef(away(s), away(base))[0, 1], abs=1e-6)
            assert r["similarity"] == pytest.approx(linalg.procrustes(base, s)[0], abs=1e-6)
            gap = lambda m: np.linalg.norm(m[own == "AMERICA"].mean(0) - m[own == "EUROPE"].mean(0))
            assert r["centroid_distance"] == pytest.approx(gap(s), abs=1e-6)
            assert r["n_sites"] == len(data[c]) and r["n_samples"] == len(places)
            near = lambda m: np.linalg.norm(m - m[own == "AMERICA"].mean(0), axis=1) - np.linalg.norm(m - m[own == "EUROPE"].mean(0), axis=1)
            assert r["spearman"] == pytest.approx(np.corrcoef(pd.Series(near(s).round(9)).rank(), pd.Series(near(base).round(9)).rank())[0, 1], abs=1e-6)
            best = lambda m: set(np.flatnonzero(pd.Series(-near(m)).where(own == "EUROPE").round(9).rank(method="min") <= 3).tolist())
            assert r["shared_best"] == len(best(s) & best(base))
            z = linalg.standardised(np.array(data[c], float)[:, places])
            values = np.sort(np.linalg.eigvalsh(z.T @ z))[::-1]
            assert [variance[panel, c][f"PC{k + 1}"] for k in range(5)] == pytest.approx((values[:5] / values.sum()).tolist(), abs=1e-9)
            if panel == "full_panel":
                wide[c] = s
            else:
                d, part = restricted[c], wide[c][places]
                assert d["distance_correlation"] == pytest.approx(np.corrcoef(away(part), away(s))[0, 1], abs=1e-6)
                assert d["similarity"] == pytest.approx(linalg.procrustes(part, s)[0], abs=1e-6)
                assert (d["separation_whole"], d["separation_part"], d["separation_ratio"]) == pytest.approx((gap(part), gap(s), gap(s) / gap(part)), abs=1e-6)


def test_matched_metadata(spark):
    """NULL and unknown ids, ids that are listed or described twice."""
    from allelix.operators import evidence

    side = spark.createDataFrame([("s1", "A"), ("s2", None), ("s3", "C"), ("s4", "B")], "sample string, canonical_id string")
    known = spark.createDataFrame([("A", 1), ("B", 2), ("B", 3), (None, 4)], "seq_id string, x int")
    got = {(r["sample"], r["subgenome_source"], r["x"], r["matched_metadata"]) for r in evidence.matched_metadata({"sgC": side, "sgE": side.where("sample = 's1'")}, known).collect()}
    assert got == {("s1", "sgC", 1, True), ("s2", "sgC", None, False), ("s3", "sgC", None, False), ("s4", "sgC", 2, True), ("s4", "sgC", 3, True), ("s1", "sgE", 1, True)}
    listed = spark.createDataFrame([("A",), ("A",), ("C",), (None,)], "canonical_id string")
    assert sorted(r["sample"] for r in evidence.matched_metadata({"sgC": side}, known, allowed=listed).collect()) == ["s1", "s3"]


def test_identity_of_any_dosage(spark):
    """Against plain loops, with missing calls, repeated ones and dosages above two."""
    rng = np.random.default_rng(5)
    rows = [(s, f"n{k}", None if rng.random() < 0.3 else int(rng.integers(0, 4))) for s in range(40) for k in range(6)]
    rows += [(0, "n1", 2), (1, "only", 1)]
    got = {(r["sample_a"], r["sample_b"]): (r["ibs"], r["n_sites"]) for r in popgen.ibs_pairs(spark.createDataFrame(rows, "site_id long, sample_id string, dosage int").repartition(3)).collect()}
    least = {}
    for s, n, v in rows:
        if v is not None:
            least[s, n] = min(v, least.get((s, n), 99))
    want = {}
    for (s, a), x in least.items():
        for (t, b), y in least.items():
            if s == t and a < b:
                want.setdefault((a, b), []).append(1 - abs(x - y) / 2)
    assert got == {k: (pytest.approx(np.mean(v)), len(v)) for k, v in want.items()}
    panel = spark.createDataFrame([("n1",), ("n3",), ("none",), ("n5",)], "sample_id string")
    some = popgen.ibs_pairs(spark.createDataFrame(rows, "site_id long, sample_id string, dosage int"), panel).collect()
    assert {(r["sample_a"], r["sample_b"]): r["n_sites"] for r in some} == {k: len(v) for k, v in want.items() if set(k) <= {"n1", "n3", "n5"}}


def test_svd_variant():
    x = np.random.default_rng(3).integers(0, 3, (30, 7)).astype(float)
    x[2] = np.nan
    x[3] = 1
    x[4, :3] = np.nan
    filled = np.where(np.isnan(x), np.nan_to_num(np.array([np.nanmean(r) if np.isfinite(r).any() else 0 for r in x]))[:, None], x)
    z = filled - filled.mean(1, keepdims=True)
    sd = z.std(1, ddof=1)
    z = z / np.where(sd > 0, sd, 1)[:, None]
    s = np.linalg.svd(z, compute_uv=False)
    scores, ratio = linalg.svd_components(x, 3)
    assert ratio == pytest.approx((s**2 / (s**2).sum())[:3]) and np.linalg.norm(scores, axis=0) == pytest.approx(s[:3])


def test_shortlist_roles():
    assert marts.shortlist_roles("arabica_cultivated__vs__arabica_wild") == {"wild_reference": 1, "cultivated_comparator": 2, "asymmetry_support": 3}
    assert set(marts.shortlist_roles("any")) == {"introgressed_reference", "wild_reference", "cultivated_comparator", "asymmetry_support"}


def test_marker_support_without_a_side(spark):
    spots = spark.createDataFrame([("c", "k", 1, 5, None, None)], "contrast string, contig string, sgC_min_pos long, sgC_max_pos long, sgE_min_pos long, sgE_max_pos long")
    markers = spark.createDataFrame([("c", "k", p, d) for p, d in ((1, 0.5), (2, 0.9), (5, 0.9), (6, 1.0))], "contrast string, contig string, pos long, abs_delta_af double")
    got = [(r["pos"], r["support_category"]) for r in marts.marker_support(spots, {"sgC": markers, "sgE": markers}, 2).orderBy("pos").collect()]
    assert got == [(2, "sgC"), (5, "sgC")]


def test_report_texts(spark):
    rows = spark.createDataFrame([("a", "1")], "label string, value string")
    assert marts.narrative("T", {"H": rows}) == "# T\n\n## H\n\n- a: **1**\n"
    assert [tuple(r) for r in marts.or_note(rows.where("false")).collect()] == [("No records", None)]
    assert marts.or_note(rows).count() == 1


def test_matrix_means_of_means(spark):
    """Rows are averaged before columns, so entries weigh by their row."""
    m = spark.createDataFrame([("r1", "c1", 1.0), ("r2", "c1", 3.0), ("r1", "c2", 10.0), ("r9", "c1", 99.0)], "row string, col string, value double")
    look = spark.createDataFrame([("r1", "X"), ("r2", "X"), ("c1", "X"), ("c2", "X"), ("r9", None)], "name string, canonical string")
    assert [tuple(r) for r in marts.relabelled(m, look).collect()] == [("X", "X", 6.0)]


def test_readers_odd(spark, tmp_path):
    assert readers.priorities(spark, None, ["A", "B"]).count() == 2
    (tmp_path / "p.csv").write_text("display_order,accession\n2, Bee \n1,Ay\n3,\n")
    assert [r["accession"] for r in readers.priorities(spark, str(tmp_path / "p.csv"), []).orderBy("display_order").collect()] == ["Ay", "Bee"]
    (tmp_path / "q.csv").write_text("name\nx\n")
    with pytest.raises(ValueError, match="accession"):
        readers.priorities(spark, str(tmp_path / "q.csv"), [])
    assert readers.contexts(spark, None, ["Accession", "Note"]).columns == ["Accession", "Note"]
    with pytest.raises(ValueError, match="Note"):
        readers.contexts(spark, str(tmp_path / "q.csv"), ["name", "Note"])
    gff = spark.createDataFrame([("s\tx\tgene\t1\t9\t.\t+\t.\tID=g;Name=n",)], "value string")
    with pytest.raises(ValueError, match="region"):
        readers.regions_and_genes(gff, "sgC")
    chr4 = spark.createDataFrame([("chr_D_sg_C_1",), ("chr_D_sg_E_1",), ("chr_A_sg_C_1",), (None,)], "c string").select(S.expected_chr4("c", "sgC").alias("x"))
    assert [r["x"] for r in chr4.collect()] == [True, False, False, False]


def test_alias_keys_at_any_depth(spark):
    """Keys, not text that looks like one; a key must speak of a sequence."""
    for text, want in (('{"a":[{"b":{"sequenceName":1}}]}', True), ('{"aliasName":1}', False), ('{"a":"the \\"sequence_name\\": x"}', False), ('{"SEQUENCE synonyms" : 2}', True), ('{"a":"sequence name"}', False)):
        assert readers.jsonl_inventory(spark.createDataFrame([(text,)], "value string"), []).first()["has_alias"] is want, text


def test_small_functions(spark, tmp_path):
    df = spark.createDataFrame([("1", "x", "H.Timor"), (None, "2", "B")], "a string, b string, n string")
    assert reports.numeric_where_possible(df).dtypes == [("a", "double"), ("b", "string"), ("n", "string")]
    assert reports.preferred(df, ["n", "z", "a"]).columns == ["n", "a", "b"] and reports.preferred(df, ["n", "z"], only=True).columns == ["n"]
    assert [r[0] for r in df.select(S.renamed("n", {"H.Timor": "Híbrido de Timor"})).collect()] == ["Híbrido de Timor", "B"]
    now = df.select(S.utc_now().alias("t")).first()["t"]
    assert abs((datetime.datetime.fromisoformat(now) - datetime.datetime.now(datetime.UTC)).total_seconds()) < 120
    rows = [("sgC", "c", 1, 2, "t", "l")]
    assert readers.intervals(spark, None, rows).first()["source_end"] == 2
    (tmp_path / "i.csv").write_text("subgenome,source_contig,source_start,source_end,expected_target_seqid,expected_target_label\nsgE,d,5,9,u,m\n")
    assert tuple(readers.intervals(spark, str(tmp_path / "i.csv"), rows).first()) == ("sgE", "d", 5, 9, "u", "m")


@pytest.mark.parametrize("name", ["vcf_filter_audit", "gff3_supported_genes", "quality_asymmetry", "contrast_table", "direction_scoreboard", "accession_shortlist", "length_matches", "chromosome_support", "validation_overview", "top_regions", "vcf_interval_conditions", "metadata_matches", "allowed_metadata_matches", "fasta_marked_headers", "vcf_blocks_eligible_sites"])
def test_new_queries_against_sql(spark, small, name):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    got, want = entry.queries()[name](spark, small).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    plain = lambda x: None if pd.isna(x) else x if isinstance(x, (str, bool, np.bool_)) else round(float(x), 7)
    rows = lambda d: sorted(repr([plain(x) for x in r]) for r in d[cols].astype(object).itertuples(index=False))
    assert rows(got) == rows(want) and len(got) > 0


def test_calls_are_decoded_once(spark, small):
    """Filters on what comes from the calls don't decode them again."""
    _, found = formats.scan(spark, small, "sgC", "matching_plus_unassigned")
    plan = found.where("eligible")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[/|]0*[01]$") == 1


def test_cells_are_dealt_once_by_site(spark, small):
    """One shuffle by supplier, one by site, and those of smaller tables."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.good_sites(spark, small)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Two for each of the joins with suppliers, nations and regions, one of cells by site, and two of sites; none for what
    # is grouped by cell or site.
    assert plan.count("Exchange hashpartitioning") <= 9, plan
