"""Population genetics over long genotype tables: (site_id, contig, pos, ref, alt, sample_id, grp, dosage); a missing
call is NULL. Everything is aggregates, so sites and samples scale with the cluster."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allelix.functions.ranking import medians
from allelix.functions.scalars import window_start
from allelix.operators import packed

SITE = ("site_id", "contig", "pos")


def site_frequencies(cells: DataFrame, a: str, b: str, n_samples: int | None = None, keys: Sequence[str] = SITE) -> DataFrame:
    """One row for each site: called, call_rate, maf, and the absolute difference of the two groups' mean allele
    frequencies (NULL if a group has no call). n_samples: of the whole panel, where cells are sparse."""
    af = F.col("dosage") / F.lit(2.0)
    in_group = [F.avg(F.when(F.col("grp") == g, af)) for g in (a, b)]
    out = cells.groupBy(*keys).agg(F.count("*").alias("n_cells"), F.count("dosage").alias("called"), F.sum("dosage").alias("alt_sum"), in_group[0].alias("af_a"), in_group[1].alias("af_b"))
    freq = F.col("alt_sum") / F.nullif(2.0 * F.col("called"), F.lit(0.0))
    total = F.lit(n_samples) if n_samples else F.col("n_cells")
    return out.select(*keys, "called", (F.col("called") / total.cast("double")).alias("call_rate"), F.least(freq, 1.0 - freq).alias("maf"), "af_a", "af_b", F.abs(F.col("af_a") - F.col("af_b")).alias("abs_delta_af"))


def passing(sites: DataFrame, call_rate: float = 0.80, maf: float = 0.05) -> DataFrame:
    return sites.where((F.col("called") > 0) & (F.col("call_rate") >= call_rate) & (F.col("maf") >= maf))


def _scan(sites: DataFrame, keys: Sequence[Column], *names: str) -> DataFrame:
    d = F.col("abs_delta_af")
    some = sites.where(d.isNotNull())
    return some.groupBy(*keys).agg(F.count("*").alias("n_markers"), F.avg(d).alias("mean_abs_delta_af"), F.max(d).alias("max_abs_delta_af"), F.sum((d >= 0.75).cast("long")).alias("n_ge_0_75"), F.sum((d >= 0.90).cast("long")).alias("n_ge_0_90"))


def contig_scan(sites: DataFrame) -> DataFrame:
    """Differentiation by contig, ranked. The rank's single window holds one row for each contig."""
    order = [F.desc("n_ge_0_90"), F.desc("n_ge_0_75"), F.desc("mean_abs_delta_af"), F.desc("max_abs_delta_af"), F.asc("contig")]
    return _scan(sites, [F.col("contig")]).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def window_scan(sites: DataFrame, width: int = 1_000_000) -> DataFrame:
    """Differentiation by tumbling window: contig, window_start, window_end and the contig scan's measures."""
    out = _scan(sites, [F.col("contig"), window_start("pos", width).alias("window_start")])
    return out.withColumn("window_end", F.col("window_start") + width - 1)


def ranked_windows(windows: DataFrame) -> DataFrame:
    order = [F.desc("n_ge_0_90"), F.desc("n_ge_0_75"), F.desc("mean_abs_delta_af"), F.asc("contig"), F.asc("window_start")]
    return windows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def top_markers(sites: DataFrame, n: int = 250) -> DataFrame:
    """The n most differentiated sites; ties by maf, then by site."""
    return sites.where("abs_delta_af is not null").orderBy(F.desc("abs_delta_af"), F.desc("maf"), F.asc("site_id")).limit(n)


def interval_summary(markers: DataFrame) -> DataFrame:
    """The contig that holds most of the top markers, and their span there: one row, or one of NULLs and 0."""
    by = markers.groupBy("contig").agg(F.count("*").alias("n_top_markers"), F.min("pos").alias("interval_start"), F.max("pos").alias("interval_end"), F.avg("abs_delta_af").alias("mean_abs_delta_af"), F.max("abs_delta_af").alias("max_abs_delta_af"))
    best = by.orderBy(F.desc("n_top_markers"), F.desc("max_abs_delta_af"), F.desc("mean_abs_delta_af"), F.asc("contig")).limit(1)
    return best.agg(*[F.first(c).alias(c) for c in best.columns if c != "n_top_markers"], F.coalesce(F.first("n_top_markers"), F.lit(0)).alias("n_top_markers"))


def sample_qc(cells: DataFrame) -> DataFrame:
    """Rates by sample; NULL where nothing was called."""
    out = cells.groupBy("sample_id").agg(
        F.count("*").alias("total"),
        F.count("dosage").alias("called"),
        F.sum((F.col("dosage") == 1).cast("long")).alias("het"),
        F.sum((F.col("dosage") > 0).cast("long")).alias("nonref"),
    )
    called = F.nullif(F.col("called"), F.lit(0))
    return out.select("sample_id", "total", "called", (F.col("total") - F.col("called")).alias("missing"), (F.col("called") / F.col("total")).alias("call_rate"), (F.coalesce("het", F.lit(0)) / called).alias("het_rate"), (F.coalesce("nonref", F.lit(0)) / called).alias("nonref_rate"))


def filter_audit(records: DataFrame, **tests: Column) -> DataFrame:
    """One row: how many records there are, and how many meet each test."""
    return records.agg(F.count("*").alias("n_records"), *[F.count_if(F.coalesce(t, F.lit(False))).alias(k) for k, t in tests.items()])


def group_contrasts(cells: DataFrame, pairs: Sequence[tuple[str, str]], top: int, least: int = 1, decimals: int | None = None) -> DataFrame:
    """For each pair of groups the ``top`` sites of largest frequency difference (rounded first, where decimals are
    given), with groups of ``least`` members. Tasks keep their own ``top`` of each pair before these meet."""
    af = cells.where("dosage is not null").groupBy("site_id", "contig", "pos", "grp").agg(F.avg(F.col("dosage") / F.lit(2.0)).alias("af"))
    size = cells.groupBy("grp").agg(F.count_distinct("sample_id").alias("members")).where(F.col("members") >= least)
    af = af.join(size, "grp").select("site_id", "contig", "pos", "grp", "af")
    named = F.map_from_entries(F.collect_list(F.struct("grp", "af")))
    wide = af.groupBy("site_id", "contig", "pos").agg(named.alias("af"))
    each = F.explode(F.array(*[F.struct(F.lit(f"{a}__vs__{b}").alias("contrast"), F.abs(F.try_element_at("af", F.lit(a)) - F.try_element_at("af", F.lit(b))).alias("abs_delta_af")) for a, b in pairs]))
    long = wide.select("site_id", "contig", "pos", each.alias("c")).select("c.*", "site_id", "contig", "pos").where("abs_delta_af is not null")
    if decimals is not None:
        long = long.withColumn("abs_delta_af", F.round("abs_delta_af", decimals))
    place = F.row_number().over(Window.partitionBy("contrast").orderBy(F.desc("abs_delta_af"), F.asc("site_id")))
    return long.withColumn("place", place).where(F.col("place") <= top)


def ibs_pairs(cells: DataFrame, panel: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Identity by state of samples a < b (as strings): mean of 1 - |difference| / 2 over sites called in both. panel:
    the samples (sample_id) to compare; most: the largest dosage. Without either, cells are read once more for it.

    Sites come as bit planes, and a task adds up its own samples x samples sums, which meet by pair: what is shuffled
    grows with the panel, not with pairs of cells. A sample with several calls at a site has the least of them."""
    named = (cells if panel is None else panel).select(F.col("sample_id").cast("string").alias("s")).distinct().orderBy("s").collect()  # the panel
    names = [r["s"] for r in named if r["s"] is not None]
    spark = cells.sparkSession
    if not names:
        return spark.createDataFrame([], "sample_a string, sample_b string, ibs double, n_sites long")
    places = spark.createDataFrame(list(enumerate(names)), "place int, s string")
    if most is None:
        most = int(cells.agg(F.coalesce(F.max("dosage"), F.lit(0)).alias("most")).first()["most"])
    sites = packed.packed_sites(cells.where("dosage is not null"), names, most=most).select("planes")
    n = len(names)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        away, met = np.zeros((n, n), np.int64), np.zeros((n, n), np.int64)
        for batch in batches:
            known, *over = (packed.by_sample(p, n) for p in packed.as_planes(batch.column(0), n, most))
            for k in range(n - 1):
                both = known[k] & known[k + 1 :]
                met[k, k + 1 :] += np.bitwise_count(both).sum(1, dtype=np.int64)
                # |a - b| is the number of thresholds that only one of both reaches.
                for t in over:
                    away[k, k + 1 :] += np.bitwise_count((t[k] ^ t[k + 1 :]) & both).sum(1, dtype=np.int64)
        i, j = np.nonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(away[i, j]), pa.array(met[i, j])], names=["i", "j", "away", "met"])

    sums = sites.mapInArrow(partial, "i int, j int, away long, met long").groupBy("i", "j").agg(F.sum("away").alias("away"), F.sum("met").alias("n_sites"))
    left, right = (places.select(F.col("place").alias(c), F.col("s").alias(name)) for c, name in (("i", "sample_a"), ("j", "sample_b")))
    named = sums.join(F.broadcast(left), "i").join(F.broadcast(right), "j")
    return named.select("sample_a", "sample_b", (1 - F.col("away") / (2.0 * F.col("n_sites"))).alias("ibs"), "n_sites")


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("sample_a", "sample_b", "ibs").unionByName(pairs.select(F.col("sample_b").alias("sample_a"), F.col("sample_a").alias("sample_b"), "ibs"))


def group_ibs(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Both directions of each pair of groups: n, mean, median, min, max and 1 - mean. groups: sample_id, grp."""
    g = groups.select(F.col("sample_id").cast("string").alias("sample_id"), "grp")
    p = both_ways(pairs).join(g.withColumnsRenamed({"sample_id": "sample_a", "grp": "group_a"}), "sample_a").join(g.withColumnsRenamed({"sample_id": "sample_b", "grp": "group_b"}), "sample_b")
    # A pair inside one group counts once.
    p = p.where("group_a <> group_b or sample_a < sample_b")
    return p.groupBy("group_a", "group_b").agg(F.count("*").alias("n_pairs"), F.avg("ibs").alias("mean_ibs"), F.median("ibs").alias("median_ibs"), F.min("ibs").alias("min_ibs"), F.max("ibs").alias("max_ibs"), (1 - F.avg("ibs")).alias("distance"))


def group_affinity(pairs: DataFrame, groups: DataFrame, names: Sequence[str]) -> DataFrame:
    """Each sample's mean identity with every group's members, itself left out: sample_id and a column for a group."""
    g = groups.select(F.col("sample_id").cast("string").alias("sample_b"), "grp")
    return both_ways(pairs).join(g, "sample_b").groupBy(F.col("sample_a").alias("sample_id")).pivot("grp", list(names)).agg(F.avg("ibs"))


def hotspots(markers: DataFrame) -> DataFrame:
    """By (contrast, contig): number, span, mean, median and largest difference, and how many reach 0.75 and 0.90. The
    median is taken from counts by value, so a contig's values are never gathered in one task."""
    d, by = F.col("abs_delta_af"), ["contrast", "contig"]
    out = markers.groupBy(*by).agg(
        F.count("*").alias("n_markers"), F.min("pos").alias("min_pos"), F.max("pos").alias("max_pos"), (F.max("pos") - F.min("pos")).alias("span_bp"),
        F.avg(d).alias("mean_abs_delta_af"), F.max(d).alias("max_abs_delta_af"), F.sum((d >= 0.75).cast("long")).alias("n_ge_0_75"), F.sum((d >= 0.9).cast("long")).alias("n_ge_0_90"),
    )
    return out.join(medians(markers, "abs_delta_af", by, "median_abs_delta_af"), by, "left")


def contrast_overview(markers: DataFrame) -> DataFrame:
    """By contrast: markers, contigs that hold them, mean and largest difference, and how many reach 0.75 and 0.90."""
    d = F.col("abs_delta_af")
    return markers.groupBy("contrast").agg(F.count("*").alias("n_markers"), F.count_distinct("contig").alias("n_contigs"), F.avg(d).alias("mean_abs_delta_af"), F.max(d).alias("max_abs_delta_af"), F.sum((d >= 0.75).cast("long")).alias("n_ge_0_75"), F.sum((d >= 0.9).cast("long")).alias("n_ge_0_90"))


def filter_counts(records: DataFrame, key: str) -> DataFrame:
    """Records by contig or FILTER value, most frequent first (ties by name; NULL is a value)."""
    return records.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(key))
