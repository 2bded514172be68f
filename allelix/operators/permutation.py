"""Label permutation of the window scan's largest mean difference."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelix.operators import packed


def labellings(n_a: int, eligible: np.ndarray, n: int, seed: int) -> np.ndarray:
    """(n + 1) x len(eligible): columns of the panel, the first n_a of each row being group a; row 0 is observed."""
    rng = np.random.default_rng(seed)
    return np.stack([eligible, *[rng.permutation(eligible) for _ in range(n)]])


CHUNK = 512  # sites that meet all labellings at a time


def window_nulls(sites: DataFrame, groups: list[str], a: str, b: str, n: int = 500, least: int = 5, seed: int = 91731) -> DataFrame:
    """permutation (0: observed) and the largest window mean of |difference|, over windows of ``least`` sites or more.

    sites: contig, window_start, and planes (``packed.packed_sites``) or dosages (array over the panel), which are
    packed first. What is shuffled by window is a site's few words; a window that holds many sites is split between
    tasks by the rebalance. Tasks read windows in order and hold the sums of one at a time; a labelling's counts are AND
    and popcount with its mask, and group b has what group a leaves of the eligible samples."""
    g = np.array(groups)
    ia, ib = np.flatnonzero(g == a), np.flatnonzero(g == b)
    if len(ia) < 2 or len(ib) < 2:
        raise ValueError("each group needs two samples or more")
    both = np.concatenate([ia, ib])
    perms = labellings(len(ia), both, n, seed)
    of_a, eligible = packed.mask(perms[:, : len(ia)], len(g)), packed.mask(both, len(g))
    planes = F.col("planes") if "planes" in sites.columns else packed.planes_of("dosages", len(g))
    numbers = pa.array(np.arange(len(perms)), pa.int32())

    def count(plane: np.ndarray, masks: np.ndarray) -> np.ndarray:
        """Samples of each mask in the plane: sites x masks."""
        return sum(np.bitwise_count(plane[:, w, None] & masks[w]).astype(float) for w in range(len(masks)))

    def differences(x: np.ndarray) -> np.ndarray:
        known, alleles = count(x[0], of_a), sum(count(p, of_a) for p in x[1:])
        all_known, all_alleles = count(x[0], eligible[:, None]), sum(count(p, eligible[:, None]) for p in x[1:])
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.abs(alleles / (2 * known) - (all_alleles - alleles) / (2 * (all_known - known)))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None

        def window() -> pa.RecordBatch:
            contig, start = (pa.repeat(v, len(perms)) for v in now)
            return pa.RecordBatch.from_arrays([contig, start, numbers, *map(pa.array, sums)], names=["contig", "window_start", "permutation", "total", "valid", "size"])

        for whole in batches:
            for batch in (whole.slice(k, CHUNK) for k in range(0, len(whole), CHUNK)):
                delta = differences(packed.as_planes(batch.column(2), len(g)))
                ok = np.isfinite(delta)
                delta[~ok] = 0
                name, at = np.asarray(batch.column(0).dictionary_encode().indices.fill_null(-1)), np.asarray(batch.column(1).fill_null(-1))
                first = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (at[1:] != at[:-1])])
                size = np.diff(np.r_[first, len(batch)])
                for k, total, valid, m in zip(first.tolist(), np.add.reduceat(delta, first), np.add.reduceat(ok.astype(float), first), size, strict=True):
                    key = batch.column(0)[k], batch.column(1)[k]
                    got = np.stack([total, valid, np.full(len(perms), float(m))])
                    if now is not None and now[0].equals(key[0]) and now[1].equals(key[1]):
                        sums = sums + got
                        continue
                    if now is not None:
                        yield window()
                    now, sums = key, got
        if now is not None:
            yield window()

    rows = sites.select("contig", F.col("window_start").cast("long").alias("window_start"), planes.alias("planes"))
    dealt = rows.hint("rebalance", F.col("contig"), F.col("window_start")).sortWithinPartitions("contig", "window_start")
    parts = dealt.mapInArrow(partial, "contig string, window_start long, permutation int, total double, valid double, size double")
    windows = parts.groupBy("contig", "window_start", "permutation").agg(*[F.sum(c).alias(c) for c in ("total", "valid", "size")])
    means = windows.where(F.col("size") >= least).select("permutation", (F.col("total") / F.nullif("valid", F.lit(0.0))).alias("mean"))
    return means.groupBy("permutation").agg(F.max("mean").alias("max_window_mean"))


def empirical_p(nulls: DataFrame) -> DataFrame:
    """observed, its empirical P (1 + hits) / (1 + n), and the null's linear 95 and 99 % quantiles."""
    observed = nulls.where("permutation = 0").select(F.col("max_window_mean").alias("observed"))
    null = nulls.where("permutation > 0 and max_window_mean is not null").crossJoin(F.broadcast(observed))
    return null.agg(
        F.max("observed").alias("observed"),
        ((1 + F.count_if(F.col("max_window_mean") >= F.col("observed"))) / (1 + F.count("*"))).alias("p_value"),
        F.percentile("max_window_mean", F.lit(0.95)).alias("null_95"),
        F.percentile("max_window_mean", F.lit(0.99)).alias("null_99"),
    )
