"""Alignment summaries against pandas, evidence marts on small cases, and input discovery."""

import gzip
import hashlib
import io
import random
import re
import tarfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from allelix.functions import ranking
from allelix.operators import alignment as A
from allelix.operators import evidence as E
from allelix.operators import linalg
from allelix.operators import reports as T
from allelix.plans import registry
from allelix.sources import discovery, sinks, streams


def covered(rows):
    return len({p for s, e in rows for p in range(s, e + 1)})


def test_chromosome_support(spark, small):
    hits = registry.hits(spark, small).toPandas()
    regions = registry.regions(spark, small).toPandas().set_index("region")
    got = entry.queries()["chromosome_support"](spark, small).toPandas().set_index("region")
    order = dict(by=["bitscore", "length", "pident", "target", "source_start"], ascending=[False, False, False, True, True])
    for name, h in hits.groupby("region"):
        span = regions.loc[name, "region_end"] - regions.loc[name, "region_start"] + 1
        h = h.sort_values(**order)
        best = h.drop_duplicates("query")
        own = h[h["target"] == "T_0"].drop_duplicates("query")
        rest = h[h["target"] != "T_0"].drop_duplicates(["target", "query"])
        r = got.loc[name]
        assert r["top_fraction"] == pytest.approx((best["target"] == "T_0").mean())
        assert r["fraction"] == pytest.approx(covered(zip(own["source_start"], own["source_end"], strict=True)) / span)
        assert r["weighted_identity"] == pytest.approx(np.average(own["pident"], weights=own["length"]))
        assert r["forward_fraction"] == pytest.approx((own["strand"] > 0).mean())
        ranks = [((own[a] + own[b]) / 2).rank() for a, b in (("source_start", "source_end"), ("target_start", "target_end"))]
        assert r["order_spearman"] == pytest.approx(np.corrcoef(*ranks)[0, 1])
        assert r["other"] == pytest.approx(max(covered(zip(g["source_start"], g["source_end"], strict=True)) for _, g in rest.groupby("target")) / span)
        assert r["overall_status"] == "FAIL" and r["chromosome_status"] == "WARN"


@pytest.mark.parametrize("name", ["interval_mapping", "chromosome_support"])
def test_hits_are_read_once(spark, small, name):
    hits = registry.hits(spark, small)
    regions = registry.regions(spark, small).withColumn("expected", F.lit("T_0"))
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        read.add(1)
        return x

    marked = hits.withColumn("pident", counted.asNondeterministic()("pident"))
    assert len(getattr(A, name)(marked, regions).collect()) == regions.count()
    assert read.value == hits.count()


def test_mapping_without_hits(spark, small):
    regions = spark.createDataFrame([("none", 1, 100, "T_0")], "region string, region_start long, region_end long, expected string")
    row = A.interval_mapping(registry.hits(spark, small), regions).first()
    assert (row["status"], row["covered"], row["fraction"], row["dominant"]) == ("FAIL", 0, 0.0, None)


def test_length_match_gaps(spark):
    s = spark.createDataFrame([("a", 1000), ("b", 5), ("c", 0)], "contig string, length long")
    one = A.length_matches(s, spark.createDataFrame([("t", 1010)], "seqid string, target_length long")).collect()
    assert {r["contig"]: (r["seqid"], r["confidence"]) for r in one} == {"a": ("t", "medium"), "b": ("t", "unresolved"), "c": (None, "unresolved")}
    two = A.length_matches(s, spark.createDataFrame([("t", 1010), ("u", 90_000)], "seqid string, target_length long")).where("contig = 'a'").first()
    assert (two["gap"], two["confidence"]) == (pytest.approx(89_000 / 90_000 - 10 / 1010), "high")


def nearest_lengths(sources, targets):
    """Brute force: contig -> (seqid, target_length, rel_diff, gap, confidence)."""
    out = {}
    for contig, n in sources:
        order = sorted((abs(t - n) / max(t, 1), t, k) for k, t in targets) if n > 0 else []
        if not order:
            out[contig] = (None, None, None, None, "unresolved")
            continue
        (rel, t, k), rest = order[0], order[1:]
        gap = rest[0][0] - rel if rest else None
        clear = gap is not None and gap >= 0.01
        grade = "exact" if rel == 0 else "unresolved" if rel > 0.08 else ("high" if clear else "medium") if rel <= 0.03 else "medium" if clear else "low"
        out[contig] = (k, t, round(rel, 9), round(gap, 9) if rest else None, grade)
    return out


def test_length_matches_of_whole_tables(spark, small):
    """Every order has a row, and each one is what comparing all parts gives."""
    orders = spark.read.parquet(f"{small}/orders.parquet").where("o_totalprice >= 1").collect()
    parts = [(r["p_partkey"], (r["p_partkey"] + 1) * (r["p_partkey"] % 97 + 3) * 110) for r in spark.read.parquet(f"{small}/part.parquet").collect()]
    want = nearest_lengths([(str(r["o_orderkey"]), round(float(r["o_totalprice"]) * 100)) for r in orders], parts)
    got = entry.queries()["length_matches_all"](spark, small).collect()
    assert len(got) == len(orders)
    for r in got:
        assert (r["seqid"], r["target_length"], r["confidence"]) == (want[r["contig"]][0], want[r["contig"]][1], want[r["contig"]][4])
        assert (r["rel_diff"], r["gap"]) == tuple(x if x is None else pytest.approx(x, abs=2e-9) for x in want[r["contig"]][2:4])


def test_length_matches_around_ranges(spark):
    """Repeated lengths, ties on both sides, and marks in other ranges than the value's."""
    rng = np.random.default_rng(3)
    for many in (1, 2, 3, 40):
        sources = [(f"s{k}", int(n)) for k, n in enumerate(rng.integers(1, 400, 120))]
        targets = [(f"t{k}", int(n)) for k, n in enumerate(rng.integers(0, 400, many))]
        got = {r["contig"]: r for r in A.length_matches(spark.createDataFrame(sources, "contig string, length long"), spark.createDataFrame(targets, "seqid string, target_length long")).collect()}
        for contig, w in nearest_lengths(sources, targets).items():
            r = got[contig]
            assert (r["seqid"], r["target_length"], r["confidence"]) == (w[0], w[1], w[4])
            assert (r["rel_diff"], r["gap"]) == tuple(x if x is None else pytest.approx(x, abs=2e-9) for x in w[2:4])


def test_whole_hotspot_tables(spark, small):
    """All qualifying sites stand on one of the two sides, and every part is a hotspot."""
    n = registry.good_sites(spark, small).where("abs_delta_af >= 0.3").count()
    a, b = registry.two_sides(spark, small)
    assert sum(r["n_markers"] for side in (a, b) for r in side.collect()) == n
    got = entry.queries()["gene_support_all"](spark, small).collect()
    parts = [(r["p_partkey"], r["p_brand"], r["p_partkey"] * 10, r["p_size"]) for r in spark.read.parquet(f"{small}/part.parquet").collect()]
    near = lambda h: [g for g in parts if g[1] == h[1] and g[2] <= h[2] + h[3] * 200 and g[2] + 500 >= h[2]]
    assert {r["hotspot"]: r["n_genes"] for r in got} == {h[0]: len(near(h)) for h in parts} and len(got) == len(parts)


def plain(text):
    return re.sub("[^a-z0-9]+", "", text.lower())


def best_records(aliases, records):
    """Brute force: alias -> (record_id, score, length difference, unique, method)."""
    out = {}
    for alias, n, tokens in aliases:
        rows = []
        for record, text, m in records:
            whole, off = plain(f"{record} {text}"), abs(m - n)
            score = 100 * bool(plain(alias) and plain(alias) in whole) + 20 * sum(plain(t) != "" and plain(t) in whole for t in tokens) + (80 if off == 0 else 30 if n and off / n < 0.001 else 0)
            if score >= 50:
                rows.append((-score, off, record))
        top = min(rows, default=None)
        how = "unmapped" if top is None else "alias_and_length" if top[0] <= -100 else "exact_length" if top[1] == 0 else "best_available"
        out[alias] = (top[2], -top[0], top[1], sum(r[:2] == top[:2] for r in rows) == 1, how) if top else (None, None, None, None, how)
    return out


def test_alias_matches_of_whole_tables(spark, small):
    """Every supplier has the row that comparing all parts gives."""
    a, r = registry.named_records(spark, small)
    want = best_records([(x["alias"], x["length"], x["tokens"]) for x in a.collect()], [tuple(x) for x in r.collect()])
    got = entry.queries()["alias_matches_all"](spark, small)
    assert {x["alias"]: tuple(x)[1:] for x in got.collect()} == want and len(want) == a.count()
    aliases = [("A-l", 1000, ["x1", "X_1", "zz"]), ("b", 5000, []), ("cc", 5001, ["q"]), ("none", 7, ["-"]), ("two", 40_000, ["r"]), ("three", 2000, ["r", "x", "7"]), ("near", 100_000, [])]
    records = [("r1", "a. l x1", 70), ("r2", "AL", 1000), ("r3", "", 4999), ("r4", "", 5003), ("r5", "", 5003), ("r6", "", 40_000), ("r7", "", 40_000), ("rx7", "", 2002), ("r8", "", 100_100)]
    found = A.alias_matches(spark.createDataFrame(aliases, "alias string, length long, tokens array<string>"), spark.createDataFrame(records, "record_id string, description string, record_length long"))
    assert {x["alias"]: tuple(x)[1:] for x in found.collect()} == best_records(aliases, records)


def test_alias_matches_by_tokens(spark):
    """Short tokens that all texts hold, repeated ones, lengths at the edge of 0.1 %, of nothing and below, NULLs."""
    rng = random.Random(6)
    words = ["1", "a", "b2", "sg", "chr", "unit", "77", "x-9"]
    aliases = [(f"n{k} {rng.choice(words)}", rng.choice([1000, 999, 1001, 20_000, 0, 7]), [rng.choice([*words, "", "--"]) for _ in range(rng.randrange(6))]) for k in range(60)]
    records = [(f"r{k}", " ".join(rng.choice([*words, "n3 1", "n7a", "n9"]) for _ in range(rng.randrange(7))), rng.choice([1000, 999, 1001, 1002, 20_000, 20_019, 20_020, 20_021, 0, -5, 8])) for k in range(90)]
    found = A.alias_matches(spark.createDataFrame(aliases, "alias string, length long, tokens array<string>"), spark.createDataFrame(records, "record_id string, description string, record_length long"))
    assert {x["alias"]: tuple(x)[1:] for x in found.collect()} == best_records(aliases, records)
    odd = spark.createDataFrame([(None, 5, ["a"]), ("q", None, ["a", None, "b", "c"]), ("w", 5, None), ("neg", -5, ["z"])], "alias string, length long, tokens array<string>")
    rows = spark.createDataFrame([("r1", "a b c", None), ("r2", None, 5), (None, "a", 5), ("r9", "z", -5)], "record_id string, description string, record_length long")
    got = {x["alias"]: (x["record_id"], x["score"], x["method"]) for x in A.alias_matches(odd, rows).collect()}
    assert got == {None: (None, None, "unmapped"), "q": ("r1", 60, "best_available"), "w": ("r2", 80, "exact_length"), "neg": ("r9", 100, "alias_and_length")}


def test_routing_and_priority(spark):
    cross = spark.createDataFrame([("sgC", "c1", 100, "t", 200, "high"), ("sgE", "c1", 100, None, None, "unresolved")], "subgenome string, contig string, length long, seqid string, target_length long, confidence string")
    spots = spark.createDataFrame([("x", "c1", "sgC", 10, 20), ("x", "c1", "sgE", 10, 20), ("x", "c2", "sgC", 1, 2)], "contrast string, contig string, subgenome string, min_pos long, max_pos long")
    got = {r["hotspot"]: (r["target_start"], r["target_end"], r["status"]) for r in A.routed(spots, cross).collect()}
    assert got == {"x::c1::sgC": (20, 40, "length_scaled"), "x::c1::sgE": (None, None, "no_paired_contig"), "x::c2::sgC": (None, None, "no_crosswalk")}
    pairs = spark.createDataFrame([("g", 2, True, 50), ("h", 0, False, 100)], "gene string, hits long, coding boolean, overlap_bp long")
    assert {r["gene"]: r["priority"] for r in A.gene_priority(pairs).collect()} == {"g": 2.75, "h": 1.0}


def test_marts(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("b", 2.0, 5.0), ("c", 2.0, 1.0)], "k string, x double, y double")
    assert {r["k"]: r["score"] for r in T.composite(df, "k", {"x": True, "y": False}).collect()} == {"a": pytest.approx(1 / 3), "b": pytest.approx((2.5 / 3 + 0.5) / 2), "c": pytest.approx((2.5 / 3 + 1) / 2)}
    both = T.sectioned({"p": df.select("k"), "q": df.select("k", "x")})
    assert both.where("section = 'p' and x is null").count() == 3 and both.count() == 6
    overview = {(r["scope"], r["value"]): r["n"] for r in E.panel_overview(df.withColumn("z", F.lit(None).cast("string")), ["k", "z"]).collect()}
    assert overview == {("overall", None): 3, ("k", "a"): 1, ("k", "b"): 1, ("k", "c"): 1, ("z", None): 3}


def test_discovery(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    for p in ("deep/er/Data.CSV", "deep/data.csv", "other.txt"):
        (tmp_path / p).write_text("x")
    root = str(tmp_path)
    assert discovery.find(spark, root, ["DATA.csv"]).endswith("deep/data.csv")
    assert discovery.find(spark, root, ["nothing"]) is None
    # Names are a list of preference, and a file directly under the root wins; elsewhere depth comes first, then the
    # path in any case.
    (tmp_path / "b.txt").write_text("x")
    assert discovery.find(spark, root, ["b.txt", "other.txt"]).endswith("/b.txt") and discovery.find(spark, root, ["other.txt", "b.txt"]).endswith("/other.txt")
    assert discovery.find(spark, root, ["B.TXT", "data.csv", "other.txt"]).endswith("/other.txt")
    assert discovery.find(spark, root, ["B.TXT", "data.csv"]).endswith("/b.txt")
    (tmp_path / "Z").mkdir()
    (tmp_path / "Z" / "same.x").write_text("x")
    (tmp_path / "deep" / "SAME.x").write_text("x")
    assert discovery.find(spark, root, ["Same.x"]).endswith("deep/SAME.x")
    assert [r["name"] for r in discovery.with_suffix(spark, root, [".X"]).collect()] == ["SAME.x", "same.x"]
    assert discovery.newest(spark, root, "*.txt").endswith(".txt")
    with tarfile.open(tmp_path / "s.tar.gz", "w:gz") as tar:
        for name in ("a/1_2.tandems.txt", "a/._1_2.aligncoords.gz", "1_2/tandem.csv", "3_4"):
            info = tarfile.TarInfo(name)
            info.size = 3
            tar.addfile(info, io.BytesIO(b"abc"))
    rows = {r["member"]: (r["sidecar"], r["clean_name"], r["genome_a"], r["genome_b"], r["category"]) for r in discovery.archive_members(spark, str(tmp_path / "s.tar.gz")).collect()}
    assert rows == {
        "1_2.tandems.txt": (False, "1_2.tandems.txt", "1", "2", "tandem_duplicates"),
        "._1_2.aligncoords.gz": (True, "1_2.aligncoords.gz", "1", "2", "syntenic_alignment"),
        "tandem.csv": (False, "tandem.csv", "", "", "other"),
        "3_4": (False, "3_4", "3", "4", "other"),
    }


def test_digest_of_files(spark, tmp_path):
    """Files are hashed as they are, compressed ones too, and a manifest names what it was told."""
    data = bytes(range(256)) * 9000
    (tmp_path / "x.gz").write_bytes(gzip.compress(data))
    (tmp_path / "y").write_bytes(data)
    paths = spark.createDataFrame([(f"file:{tmp_path}/{n}",) for n in ("x.gz", "y")], "path string")
    got = {r["path"].rpartition("/")[2]: (r["sha256"], r["length"]) for r in streams.digests(paths).collect()}
    assert got == {n: (hashlib.sha256((tmp_path / n).read_bytes()).hexdigest(), (tmp_path / n).stat().st_size) for n in ("x.gz", "y")}
    row = sinks.write_tables({"t": paths}, str(tmp_path / "out"), "csv", {"t": "two paths"}).first()
    assert (row["description"], row["rows"]) == ("two paths", 2)


def test_procrustes_over_shared_components():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(12, 3))
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    same = linalg.procrustes(x, x @ turn * 5 + 2)
    assert same == (pytest.approx(1, abs=1e-6), pytest.approx(0, abs=1e-6))
    # The wider one is cut to the components that both have; checked by turning, over a grid in two dimensions.
    y = rng.normal(size=(12, 4))
    similarity, rmse = linalg.procrustes(x[:, :2], y)
    a, b = (m - m.mean(0) for m in (x[:, :2], y[:, :2]))
    a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
    turns = [np.array([[np.cos(t), -s * np.sin(t)], [np.sin(t), s * np.cos(t)]]) for t in np.linspace(0, 2 * np.pi, 4001) for s in (1, -1)]
    least = min(np.linalg.norm(a - b @ r) for r in turns)
    assert similarity == pytest.approx(1 - least / 2**0.5, abs=1e-4) and rmse == pytest.approx(least / 24**0.5, abs=1e-4)
    assert all(np.isnan(linalg.procrustes(np.ones((3, 2)), x[:3])))


def test_ranks_of_any_size(spark):
    """Ranks over ranges against windows and pandas, with ties, NULLs and groups."""
    rng = np.random.default_rng(7)
    rows = [(i, None if rng.random() < 0.1 else int(rng.integers(0, 25)), None if rng.random() < 0.1 else "abc"[rng.integers(3)]) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, x long, g string")
    for by in ([], ["g"]):
        for down in (False, True):
            want = df.select("i", ranking.average_rank("x", by, down).alias("a"), ranking.average_rank("x", by, down, "bottom").alias("b"), ranking.min_rank("x", by, down).cast("long").alias("m"), ranking.percentile_rank("x", by, not down).alias("p"))
            got = ranking.with_average_rank(df, "x", "a", by, down)
            got = ranking.with_average_rank(got, "x", "b", by, down, "bottom")
            got = ranking.with_min_rank(got, "x", "m", by, down)
            got = ranking.with_percentile_rank(got, "x", "p", by, not down).select("i", "a", "b", "m", "p")
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    want = pd.DataFrame(rows, columns=["i", "x", "g"]).groupby("g", dropna=False)["x"].median()
    got = {r["g"]: r["m"] for r in ranking.medians(df, "x", ["g"], "m").collect()}
    assert {k or None: v for k, v in got.items()} == {None if pd.isna(k) else k: v for k, v in want.items()}
