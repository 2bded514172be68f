"""Interval algebra against sequential versions."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from allelix.operators import intervals as I

spans = st.lists(st.tuples(st.sampled_from("ab"), st.integers(1, 60), st.integers(0, 15)), max_size=25).map(lambda x: [(k, s, s + n) for k, s, n in x])
few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def merged(rows, gap):
    out = []
    for k in sorted({r[0] for r in rows}):
        last = None
        for _, s, e in sorted(r for r in rows if r[0] == k):
            if last and s <= last[2] + gap + 1:
                last[2] = max(last[2], e)
                last[3] += 1
            else:
                last = [k, s, e, 1]
                out.append(last)
    return sorted(map(tuple, out))


@few
@given(rows=spans, gap=st.sampled_from([0, 3]))
def test_merge(spark, rows, gap):
    df = spark.createDataFrame(rows, "k string, start long, end long")
    assert sorted(map(tuple, I.merged(df, ["k"], max_gap=gap).collect())) == merged(rows, gap)
    assert sorted(map(tuple, I.merged_binned(df, ["k"], 10, max_gap=gap).select("k", "start", "end", "n").collect())) == merged(rows, gap)
    covered = {k: len({p for x, s, e in rows if x == k for p in range(s, e + 1)}) for k in {r[0] for r in rows}}
    assert dict(map(tuple, I.union_length(df, ["k"]).collect())) == covered


def test_merge_across_ranges(spark):
    """A key of many ranges: long intervals that reach over several of them, repeated ones, chains, a NULL key."""
    rng = random.Random(4)
    rows = [("a", 1, 40_000), ("a", 60_000, 60_010), ("b", 5, 6), ("c", 1, 1)] + [("b", 5, 6)] * 300
    rows += [("a", s := rng.randrange(100_000), s + rng.randrange(20)) for _ in range(4_000)] + [("b", 10 + 5 * k, 15 + 5 * k) for k in range(2_000)]
    df = spark.createDataFrame(rows, "k string, start long, end long")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        for gap in (0, 30):
            assert sorted(map(tuple, I.merged(df, ["k"], max_gap=gap).collect())) == merged(rows, gap)
            assert sorted(map(tuple, I.merged_binned(df, ["k"], 500, max_gap=gap).collect())) == merged(rows, gap)
        none = df.withColumn("k", F.when(F.col("k") != "a", F.col("k")))
        assert sorted(tuple(r)[1:] for r in I.merged(none.where("k is null"), ["k"]).collect()) == sorted(r[1:] for r in merged([r for r in rows if r[0] == "a"], 0))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@few
@given(rows=spans)
def test_gaps(spark, rows):
    df = spark.createDataFrame(rows, "k string, start long, end long")
    got = {(k, p) for k, s, e in map(tuple, I.gaps(df, ["k"], 5, 50).collect()) for p in range(s, e + 1)}
    want = {(k, p) for k in {r[0] for r in rows} for p in range(5, 51)} - {(k, p) for k, s, e in rows for p in range(s, e + 1)}
    assert got == want


@few
@given(a=spans, b=spans)
def test_overlaps(spark, a, b):
    da = spark.createDataFrame([(i, *r) for i, r in enumerate(a)], "i int, k string, a_start long, a_end long")
    db = spark.createDataFrame([(i, *r) for i, r in enumerate(b)], "j int, k string, b_start long, b_end long")
    want = sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[0] == y[0] and x[1] <= y[2] and x[2] >= y[1])
    assert sorted(map(tuple, I.overlapping(da, db, "k", 7).select("i", "j").collect())) == want
    assert sorted(r["i"] for r in I.overlapping(da, db, "k", 7, "left_semi").collect()) == sorted({i for i, _ in want})
    points = db.select("k", F.col("b_start").alias("pos"))
    counted = I.points_within(points, da.select(F.col("i").alias("span_id"), "k", F.col("a_start").alias("start"), F.col("a_end").alias("end")), "k", 7)
    assert {r["span_id"]: r["n_points"] for r in counted.collect()} == {i: sum(y[0] == x[0] and x[1] <= y[1] <= x[2] for y in b) for i, x in enumerate(a)}


@few
@given(a=st.lists(st.integers(0, 100), max_size=12), b=st.lists(st.integers(0, 100), max_size=12))
def test_nearest(spark, a, b):
    left = spark.createDataFrame(list(enumerate(map(float, a))), "i int, x double")
    right = spark.createDataFrame(list(enumerate(map(float, b))), "j int, v double")
    got = {r["i"]: (r["nearest"], r["j"]) for r in I.nearest_value(left, right, "x", "v", "j").collect()}
    want = {i: min(((abs(x - v), v, j) for j, v in enumerate(b)), default=None) for i, x in enumerate(a)}
    assert got == {i: (w[1], w[2]) if w else (None, None) for i, w in want.items()}


def test_nearest_of_decimal_fractions(spark, tmp_path):
    """The query: balances in the middle of two others, by decimal places, take the smaller one."""
    import __spark_entry__ as e

    triples = [(-997.48, -996.12, -994.76), (5144.36, 5144.84, 5145.32), (0.01, 0.03, 0.05), (7000.1, 7000.2, 7000.3)]
    spark.createDataFrame([(k, v) for k, (a, _, b) in enumerate(triples) for k, v in ((2 * k, b), (2 * k + 1, a))], "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(k, x) for k, (_, x, _) in enumerate(triples)], "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r["c_custkey"]: (r["nearest"], r["s_suppkey"]) for r in e.queries()["nearest_value"](spark, str(tmp_path)).collect()}
    assert got == {k: (a, 2 * k + 1) for k, (a, _, _) in enumerate(triples)}


def test_chunks(spark):
    def wanted(n, size, overlap, least):
        out, k = [], 0
        for s in range(0, n, max(1, size - overlap)):
            e = min(n, s + size)
            if e - s >= least:
                k += 1
                out.append((k, s + 1, e))
            if e == n:
                break
        return out

    for n in (0, 5, 99, 100, 101, 180, 181, 1000):
        got = I.chunks(spark.createDataFrame([(n,)], "n long"), "n", 100, 20, 6).orderBy("chunk_index").select("chunk_index", "chunk_start", "chunk_end")
        assert list(map(tuple, got.collect())) == wanted(n, 100, 20, 6), n


def test_overlaps_of_any_length(spark):
    """Intervals from one position to the whole contig, over all levels of bins: the same pairs once each, NULL ends, none
    that ends before it starts, empty sides; a long interval stands in a bounded number of bins."""
    rng = random.Random(8)

    def some(n):
        out = [(k, rng.choice("ab"), s := rng.randrange(1, 100_000), s + rng.choice([0, 1, 5, 40, 300, 5_000, 90_000])) for k in range(n)]
        return [*out, (n, "a", 1, 200_000), (n + 1, "a", None, 5), (n + 2, "b", 7, 6), (n + 3, None, 1, 9), (n + 4, "b", 10**12, 10**15), (n + 5, "b", 10**13, 10**13)]

    a, b = some(60), some(45)
    da = spark.createDataFrame(a, "i int, k string, a_start long, a_end long")
    db = spark.createDataFrame(b, "j int, k string, b_start long, b_end long")
    real = lambda x: x[1] is not None and x[2] is not None and x[2] <= x[3]
    want = {(x[0], y[0]): (max(x[2], y[2]), min(x[3], y[3])) for x in a for y in b if real(x) and real(y) and x[1] == y[1] and x[2] <= y[3] and x[3] >= y[2]}
    for width in (1, 7, 21_600):
        got = I.overlapping(da, db, "k", width).collect()
        assert len(got) == len(want) and {(r["i"], r["j"]): (r["overlap_start"], r["overlap_end"]) for r in got} == want
        assert {r["overlap_bp"] - (r["overlap_end"] - r["overlap_start"]) for r in got} == {1}
        assert sorted(r["i"] for r in I.overlapping(da, db, "k", width, "left_semi").collect()) == sorted({i for i, _ in want})
    assert I.overlapping(da.limit(0), db, "k", 7).collect() == I.overlapping(da, db.limit(0), "k", 7, "left_semi").collect() == []
    bins = I._leveled(da, "a_start", "a_end", 7).select(F.size(I._bins(F.col("_level"), "a_start", "a_end", 7)).alias("n"))
    assert bins.agg(F.max("n")).first()[0] <= I.FINER
