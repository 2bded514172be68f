"""Bit planes of genotypes against plain arrays: panels wider than a word, repeated and missing calls, windows that are split."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from allelix.operators import packed, popgen
from allelix.operators import permutation as P


def table(n, m, seed=2):
    x = np.random.default_rng(seed).integers(-1, 3, (n, m)).astype(float)
    x[x < 0] = np.nan
    x[3] = np.nan
    return x


def unpacked(rows, n):
    """planes -> dosages, NaN where nobody called."""
    import pyarrow as pa

    known, *over = (packed.by_sample(p, n) for p in packed.as_planes(pa.array([r["planes"] for r in rows], pa.list_(pa.int64())), n))
    bits = [np.unpackbits(p.view(np.uint8), axis=1, bitorder="little")[:, : len(rows)].T for p in (known, *over)]
    return np.where(bits[0] == 1, sum(b.astype(float) for b in bits[1:]), np.nan)


@pytest.mark.parametrize("m", [5, 64, 130])
def test_planes(spark, m):
    x = table(40, m)
    names = [f"s{k}" for k in range(m)]
    cells = [(i, names[k], None if np.isnan(v) else int(v)) for (i, k), v in np.ndenumerate(x)]
    cells += [(0, "s1", 2), (1, "s2", 0), (1, "other", 1), (2, None, 1)]
    x[0, 1] = np.fmin(x[0, 1], 2)
    x[1, 2] = 0
    df = spark.createDataFrame(cells, "site_id long, sample_id string, dosage int").repartition(3)
    got = packed.packed_sites(df, names).orderBy("site_id").collect()
    assert [r["site_id"] for r in got] == list(range(40))
    assert np.array_equal(unpacked(got, m), x, equal_nan=True)
    arrays = spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(x)], "i int, d array<double>")
    again = arrays.select("i", packed.planes_of("d", m).alias("planes")).orderBy("i").collect()
    assert [r["planes"] for r in again] == [r["planes"] for r in got]


def test_planes_odd(spark):
    df = spark.createDataFrame([(1, "a", 3)], "site_id long, sample_id string, dosage int")
    with pytest.raises(Exception, match="dosage outside 0 to 2: 3"):
        packed.packed_sites(df, ["a"]).collect()
    assert packed.packed_sites(df, ["a"], most=3).first()["planes"] == [1, 1, 1, 1]
    assert packed.packed_sites(df.limit(0), ["a"]).collect() == []
    assert popgen.ibs_pairs(df.limit(0), df.select("sample_id")).collect() == []


def test_permutation_of_wide_panel(spark):
    """Two words of samples, windows in several tasks, a NULL contig, windows below the least number of sites."""
    n, m = 3_000, 90
    x, groups = table(n, m, 7), ["a"] * 30 + ["c"] * 20 + ["b"] * 40
    start = np.where(np.arange(n) < 2_000, 0, np.arange(n) // 100 * 100)
    start[-3:] = 9_999
    rows = spark.createDataFrame([("c" if k % 2 else None, int(s), [None if np.isnan(v) else float(v) for v in r]) for k, (s, r) in enumerate(zip(start, x, strict=True))], "contig string, window_start long, dosages array<double>").repartition(6)
    packed_rows = rows.select("contig", "window_start", packed.planes_of("dosages", m).alias("planes"), F.lit(1).alias("size"))
    both = np.r_[0:30, 50:90]
    rng = np.random.default_rng(3)
    perms = [both, *[rng.permutation(both) for _ in range(10)]]
    keys = start * 2 + np.arange(n) % 2
    for df in (rows, packed_rows):
        got = {r["permutation"]: r["max_window_mean"] for r in P.window_nulls(df, groups, "a", "b", n=10, least=5, seed=3).collect()}
        for k, p in enumerate(perms):
            with np.errstate(all="ignore"):
                d = np.abs(np.nanmean(x[:, p[:30]] / 2, 1) - np.nanmean(x[:, p[30:]] / 2, 1))
            assert got[k] == pytest.approx(max(np.nanmean(d[keys == c]) for c in np.unique(keys) if (keys == c).sum() >= 5))
