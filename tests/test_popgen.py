"""Samplers, permutation and linear algebra against sequential or numpy versions; readers on small files."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from allelix.operators import linalg as L
from allelix.operators import permutation as P
from allelix.operators import popgen as G
from allelix.operators import sampling as M
from allelix.sources import readers, sinks
from allelix.streaming.landing import window_counts

MASK = (1 << 64) - 1


def mixed(v):
    z = (v + 0x9E3779B97F4A7C15) & MASK
    z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & MASK
    z = ((z ^ z >> 27) * 0x94D049BB133111EB) & MASK
    return z ^ z >> 31


def test_bottom_k(spark):
    rows = [(i, f"c{i % 3}", i * 7 + 1, "A", "CGT"[i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "site_id long, contig string, pos long, ref string, alt string")
    key = lambda r: mixed(M.fnv1a64(r[1]) ^ (r[2] * 0xD6E8FEB86659FD93 & MASK) ^ M.fnv1a64(f"{r[3]}>{r[4]}") ^ 91731)
    want = [r[0] for r in sorted(rows, key=key)[:20]]
    assert [r["site_id"] for r in M.bottom_k(df, 20, 91731).orderBy("place").collect()] == want
    sizes = dict(map(tuple, M.nested(M.bottom_k(df, 20, 91731), [5, 20]).groupBy("panel_size").count().collect()))
    assert sizes == {5: 5, 20: 20}


def test_reservoir(spark):
    rng, held = random.Random(7), []
    for i in range(500):
        if i < 20:
            held.append(i)
        elif (j := rng.randint(0, i)) < 20:
            held[j] = i
    df = M.ordinals(spark.range(500).withColumnRenamed("id", "x").orderBy(F.rand(1)), [F.col("x")])
    assert df.where("x <> ordinal").count() == 0
    assert {r["slot"]: r["x"] for r in M.reservoir(df, "ordinal", 20, 7).collect()} == dict(enumerate(held))


def panel(seed=3, n=60, m=9):
    x = np.random.default_rng(seed).integers(-1, 3, (n, m)).astype(float)
    x[x < 0] = np.nan
    x[5] = np.nan
    x[6] = 1
    return x


@pytest.mark.parametrize("words", [64, 1 << 20])
def test_reservoir_replay(monkeypatch, words):
    """Blocks of words decide what one draw after the other decides, across powers of two and beyond 32 bits."""
    monkeypatch.setattr(M, "WORDS", words)
    for first, n, k, seed in [(5, 0, 5, 1), (5, 3, 5, 1), (5, 6, 5, 2), (1, 1_000, 1, 3), (7, 70_000, 7, 91731), (3, 131_073, 3, 5), (3, 131_071, 3, 5), ((1 << 32) - 300, (1 << 32) + 4_000, 1 << 31, 9), (1 << 33, (1 << 33) + 2_000, 1 << 32, 4)]:
        rng, slots = random.Random(seed), {}
        for i in range(first, n):
            if (j := rng.randint(0, i)) < k:
                slots[j] = i
        assert M.replaced(first, n, k, seed) == slots
    assert M.reservoir_slots(3, 5, 1) == {0: 0, 1: 1, 2: 2}


def test_gram_and_components(spark):
    x = panel()
    rows = spark.createDataFrame([([None if np.isnan(v) else float(v) for v in r],) for r in x], "d array<double>").repartition(3)
    g, n = L.gram(rows, "d", 9)
    z = np.where(np.isnan(x), np.nanmean(np.where(np.isnan(x).all(1, keepdims=True), 0, x), axis=1, keepdims=True), x)
    z = z[~np.isnan(x).all(1)]
    z = z[z.std(1) > 0]
    z = (z - z.mean(1, keepdims=True)) / z.std(1, ddof=1, keepdims=True)
    assert n == len(z) and np.allclose(g, z.T @ z)
    s = np.linalg.svd(z, compute_uv=False) ** 2
    scores, ratio = L.principal_components(g, 3)
    assert np.allclose(ratio, (s / s.sum())[:3])
    similarity, rmse = L.procrustes(scores, scores @ np.array([[0, 1, 0], [-1, 0, 0], [0, 0, 1.0]]) * 4 + 2)
    assert similarity == pytest.approx(1, abs=1e-6) and rmse == pytest.approx(0, abs=1e-8)


def test_permutation(spark):
    x, groups = panel(n=80), ["a"] * 4 + ["b"] * 3 + ["c"] * 2
    codes = np.arange(80) // 8
    rows = spark.createDataFrame([("c", int(k), [None if np.isnan(v) else float(v) for v in r]) for k, r in zip(codes, x, strict=True)], "contig string, window_start long, dosages array<double>").repartition(4)
    got = {r["permutation"]: r["max_window_mean"] for r in P.window_nulls(rows, groups, "a", "b", n=20, least=5, seed=1).collect()}
    rng = np.random.default_rng(1)
    for k in range(21):
        p = np.arange(7) if k == 0 else rng.permutation(np.arange(7))
        with np.errstate(all="ignore"):
            d = np.abs(np.nanmean(x[:, p[:4]] / 2, 1) - np.nanmean(x[:, p[4:]] / 2, 1))
            assert got[k] == pytest.approx(max(np.nanmean(d[codes == c]) for c in range(10)))
    row = P.empirical_p(P.window_nulls(rows, groups, "a", "b", n=20, least=5, seed=1)).first()
    null = [got[k] for k in range(1, 21)]
    assert row["p_value"] == pytest.approx((1 + sum(v >= got[0] for v in null)) / 21)
    assert row["null_95"] == pytest.approx(np.quantile(null, 0.95))


def test_permutation_query_draws(spark, small, monkeypatch):
    """The registered test has the reference's 500 labellings, and the observed one."""
    seen, empirical_p = [], P.empirical_p
    monkeypatch.setattr(P, "empirical_p", lambda nulls: seen.append(nulls) or empirical_p(nulls))
    entry.queries()["permutation_null"](spark, small)
    assert sorted(r["permutation"] for r in seen[0].select("permutation").collect()) == list(range(501))


VCF = "\n".join(["##fileformat=VCFv4.2", "##contig=<ID=chr_D_sg_C_1,length=900>", "##contig=<ID=x>", "\t".join("#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT s1 s2 s3".split()), "\t".join("chr_D_sg_C_1 100 . A G 9 PASS . GT:DP 0/1:3 1|1:2 ./.:0".split()), "\t".join("chr_D_sg_C_1 1200 . A G,T 9 PASS . DP:GT 3:0/1 2:0/0 1:0/2".split()), "short\t1"])


def test_vcf(spark, tmp_path):
    (tmp_path / "v.vcf").write_text(VCF)
    text = readers.lines(spark, str(tmp_path))
    names, contigs, fields = readers.vcf_header(text)
    assert names == ["s1", "s2", "s3"]
    assert dict(map(tuple, contigs.collect())) == {"chr_D_sg_C_1": 900, "x": None}
    assert fields.first()["value"] == "VCFv4.2"
    records = readers.dosages(readers.vcf_records(text), [0, 1, 2])
    assert [r["dosages"] for r in records.orderBy("pos").collect()] == [[1, 2, None], [1, 0, None]]
    samples = spark.createDataFrame([(0, "s1", "a"), (1, "s2", "b"), (2, "s3", "b")], "place int, sample_id string, grp string")
    sites = G.site_frequencies(readers.long_cells(records, "pos", samples), "a", "b", keys=("site_id",)).orderBy("site_id").collect()
    assert [(r["called"], r["maf"], r["abs_delta_af"]) for r in sites] == [(2, 0.25, 0.5), (2, 0.25, 0.5)]
    q = window_counts(spark, str(tmp_path), 1000).writeStream.format("memory").outputMode("complete").queryName("landed").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("select window_start, n_variants from landed").collect())) == [(1, 1), (1001, 1)]


def test_other_readers_and_sinks(spark, tmp_path):
    (tmp_path / "g.gff3").write_text("##gff\nref|NC_1.1|\tx\tGene\t5\t9\t.\t+\t.\tgene_id=g1;product=kinase\nNC_1.1\tx\tregion\t1\t99\t.\t+\t.\tID=r\n")
    gene = readers.genes(readers.gff3(readers.lines(spark, str(tmp_path / "g.gff3")))).collect()
    assert [(g["seqid"], g["gene_id"], g["product"]) for g in gene] == [("NC_1.1", "g1", "kinase")]
    records = spark.createDataFrame([("r1", "some text", "ACGT" * 50), ("r2", "", "AC")], "record_id string, description string, sequence string")
    sinks.write_fasta(records, str(tmp_path / "f"))
    back = readers.fasta(spark, str(tmp_path / "f")).orderBy("record_id").select("record_id", "description", "sequence", "length").collect()
    assert [tuple(r) for r in back] == [("r1", "some text", "ACGT" * 50, 200), ("r2", "", "AC", 2)]
    (tmp_path / "b.tsv").write_text("chunk0001|src=100-299\t200\t1\t150\tref|NC_9.1|\t999\t400\t251\t99.5\t150\t200\t0\n")
    hit = readers.blast(spark, str(tmp_path / "b.tsv")).first()
    assert (hit["source_start"], hit["source_end"], hit["target_start"], hit["target_end"], hit["strand"], hit["target_seqid"]) == (100, 249, 251, 400, -1, "NC_9.1")
    (tmp_path / "j.jsonl").write_text('{"assemblyInfo":{"assemblyName":"A"},"accession":"X"}\n\n{"chr":{"note":"a \\"sequence_name\\": b","x":[{"Sequence-Alias":1}]}}\n')
    row = readers.jsonl_inventory(readers.lines(spark, str(tmp_path / "j.jsonl")), ["$.assemblyInfo.assemblyName", "$.accession"]).first()
    assert (row["n_records"], row["assemblyName"], row["accession"], row["has_alias"]) == (2, "A", "X", True)
    (tmp_path / "m.csv").write_text("id,Species,Variety\n a ,Coffea arabica,Wild\n")
    meta = readers.metadata(spark, str(tmp_path / "m.csv"), {"id": "seq_id", "Species": "species_name", "Variety": "variety"}, ["seq_id"]).first()
    assert (meta["seq_id"], meta["analysis_group"]) == ("a", "arabica_wild")
    with pytest.raises(ValueError, match="missing"):
        readers.metadata(spark, str(tmp_path / "m.csv"), {}, ["seq_id"])
    manifest = sinks.write_tables({"records": records}, str(tmp_path / "out"), "csv").first()
    assert (manifest["table"], manifest["rows"], manifest["columns"]) == ("records", 2, 3)
    sinks.write_tables({"records": records}, str(tmp_path / "out2"))
    assert sinks.read_tables(spark, str(tmp_path / "out2"), {"records": ["sequence"]})["records"].count() == 2
    assert '"record_id"' in sinks.status_document(records)


@pytest.mark.parametrize("name", ["window_scan_delta_af", "nearest_value", "overlap_join", "rank_percentile", "grouping_panel", "role_shortlist"])
def test_against_sql(spark, small, name):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    got, want = entry.queries()[name](spark, small).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda d: sorted(repr([None if pd.isna(x) else float(x) if isinstance(x, (int, float)) else x for x in r]) for r in d[cols].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sampling_stability(spark, small):
    from allelix.plans import registry

    rows, who = registry.sampled_panels(spark, small)
    data = {c: np.array([[np.nan if v is None else v for v in r] for r in p["dosages"]], float) for c, p in rows.toPandas().groupby("condition")}
    scores = {c: L.principal_components((z := L.standardised(x)).T @ z, 5)[0] for c, x in data.items()}
    i, j = np.triu_indices(len(who), 1)
    away = {c: np.linalg.norm(s[i] - s[j], axis=1) for c, s in scores.items()}
    got = {r["condition"]: r for r in entry.queries()["sampling_stability"](spark, small).collect()}
    last = "sites_1200"
    assert set(got) == set(scores)
    for c, r in got.items():
        assert r["distance_correlation"] == pytest.approx(np.corrcoef(away[c], away[last])[0, 1], abs=1e-6)
        assert r["similarity"] == pytest.approx(L.procrustes(scores[last], scores[c])[0], abs=1e-6)
    assert got[last]["similarity"] == pytest.approx(1, abs=1e-6) and got[last]["spearman"] == pytest.approx(1)
