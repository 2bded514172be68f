"""The sensitivity analysis over all conditions at once: every eligible site is read once, and each task adds up one
Gram matrix for each condition and panel that its sites belong to. All eligible sites are a condition like the samples."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from allelix.functions.ranking import average_rank
from allelix.functions.scalars import interval_jaccard
from allelix.operators.linalg import pearson, principal_components, procrustes

Sample = tuple[str, str]
ALL = "all_eligible"
#: Partial matrices are added in so many groups before these are added.
GROUPS = 64
#: Affinities that are equal to so many places are ties: samples with the same calls, whatever the order of sums.
PLACES = 9


def memberships(sites: DataFrame, sampled: DataFrame, few: bool = True) -> DataFrame:
    """sites (site_id, …) with ``conditions``: the samples (rows of ``sampled``: condition, site_id) that hold a site,
    and ALL. few: samples are bounded by their sizes and broadcast, so that sites aren't shuffled; else which is broadcast
    is left to Spark."""
    held = sampled.groupBy("site_id").agg(F.collect_set("condition").alias("_held"))
    own = F.concat(F.coalesce("_held", F.array().cast("array<string>")), F.array(F.lit(ALL)))
    return sites.join(F.broadcast(held) if few else held, "site_id", "left").withColumn("conditions", own).drop("_held")


def _standard(x: np.ndarray) -> np.ndarray:
    """Rows with missing calls at the row's mean, then z-scored; rows without calls or variance are zero."""
    known = np.isfinite(x)
    n = np.maximum(known.sum(1), 1)
    centred = np.where(known, x - (np.where(known, x, 0).sum(1) / n)[:, None], 0)
    sd = np.sqrt((centred**2).sum(1) / max(x.shape[1] - 1, 1))
    return centred / np.where(sd > 0, sd, np.inf)[:, None]


GRAMS = "condition string, panel_type string, n_sites long, n_variable long, gram binary"


def _summed(table: pa.Table) -> pa.Table:
    total = np.zeros(len(table.column("gram")[0].as_py()) // 8)
    for packed in table.column("gram"):
        total += np.frombuffer(packed.as_buffer())
    n = {c: [int(np.asarray(table.column(c)).sum())] for c in ("n_sites", "n_variable")}
    return pa.table({c: table.column(c).slice(0, 1) for c in ("condition", "panel_type")} | n | {"gram": [total.tobytes()]})


def grams(sites: DataFrame, panels: Mapping[str, Sequence[int]]) -> DataFrame:
    """GRAMS of every condition and panel, from sites (conditions, dosages): samples x samples of standardised calls, and
    the sites, and those that vary, which they come from. panels: places of each one's samples in the dosage arrays.

    What a task keeps is conditions x panels x samples squared; partial matrices are added in groups, then these."""
    places = {name: np.array(list(at), int) for name, at in panels.items()}

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[str, str], list] = {}
        for batch in batches:
            if not len(batch):
                continue
            lists, held = batch.column(1), batch.column(0)
            x = np.asarray(lists.flatten().cast(pa.float64()).fill_null(np.nan)).reshape(len(lists), -1)
            row = np.repeat(np.arange(len(held)), np.asarray(held.value_lengths()))
            names = held.flatten().dictionary_encode()
            codes = np.asarray(names.indices)
            for panel, at in places.items():
                z = _standard(x[:, at])
                varies = z.any(1)
                for code, name in enumerate(names.dictionary.to_pylist()):
                    mine = row[codes == code]
                    own = z[mine]
                    found = totals.setdefault((name, panel), [0, 0, np.zeros((len(at), len(at)))])
                    found[0] += len(mine)
                    found[1] += int(varies[mine].sum())
                    found[2] += own.T @ own
        if totals:
            columns = [[k[0] for k in totals], [k[1] for k in totals], [v[0] for v in totals.values()], [v[1] for v in totals.values()], [v[2].tobytes() for v in totals.values()]]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["condition", "panel_type", "n_sites", "n_variable", "gram"])

    parts = sites.select("conditions", "dosages").mapInArrow(partial, GRAMS).withColumn("_g", F.spark_partition_id() % GROUPS)
    some = parts.groupBy("condition", "panel_type", "_g").applyInArrow(lambda key, t: _summed(t), GRAMS)
    return some.groupBy("condition", "panel_type").applyInArrow(lambda key, t: _summed(t), GRAMS)


COMPONENTS = "condition string, panel_type string, n_sites long, n_variable long, ratios array<double>, scores array<double>, affinities array<double>, separation double"


def components(matrices: DataFrame, samples: Mapping[str, Sequence[Sample]], groups: tuple[str, str], k: int = 5) -> DataFrame:
    """COMPONENTS of each Gram matrix, a row each: explained ratios, scores (samples x components, by rows), affinity of
    each sample (its distance to the first group's centroid less that to the second's) and the centroids' distance; NULL
    where a group has no sample. samples: (sample_id, group) of each panel."""
    of = {panel: np.array([g for _, g in rows]) for panel, rows in samples.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                grp = of[r["panel_type"]]
                scores, ratios = principal_components(np.frombuffer(r["gram"]).reshape(len(grp), -1), k)
                affinity = gap = None
                if all((grp == g).any() for g in groups):
                    a, b = (scores[grp == g].mean(0) for g in groups)
                    affinity, gap = (np.linalg.norm(scores - a, axis=1) - np.linalg.norm(scores - b, axis=1)).tolist(), float(np.linalg.norm(a - b))
                rows.append((ratios.tolist(), scores.ravel().tolist(), affinity, gap))
            lists = [pa.array([r[j] for r in rows], pa.list_(pa.float64())) for j in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *lists, pa.array([r[3] for r in rows], pa.float64())], names=["condition", "panel_type", "n_sites", "n_variable", "ratios", "scores", "affinities", "separation"])

    return matrices.mapInArrow(run, COMPONENTS)


def variances(found: DataFrame) -> DataFrame:
    """condition, panel_type, component (PC1, …), explained_variance_ratio."""
    each = found.select("condition", "panel_type", F.posexplode("ratios").alias("at", "explained_variance_ratio"))
    return each.select("condition", "panel_type", F.concat(F.lit("PC"), (F.col("at") + 1).cast("string")).alias("component"), "explained_variance_ratio")


def sample_scores(found: DataFrame, samples: Mapping[str, Sequence[Sample]], group: str) -> DataFrame:
    """condition, panel_type, sample_id, grp, scores, affinity, rank (by affinity within one group, 1: most)."""
    spark = found.sparkSession
    named = spark.createDataFrame([(panel, at, s, g) for panel, rows in samples.items() for at, (s, g) in enumerate(rows)], "panel_type string, at int, sample_id string, grp string")
    width = (F.size("scores") / F.size("affinities")).cast("int")
    rows = found.where("affinities is not null").withColumn("_k", width).select("condition", "panel_type", "scores", "_k", F.posexplode("affinities").alias("at", "affinity"))
    rows = rows.join(F.broadcast(named), ["panel_type", "at"]).withColumn("scores", F.slice("scores", F.col("at") * F.col("_k") + 1, F.col("_k")))
    within = F.when(F.col("grp") == group, F.round("affinity", PLACES))
    rank = F.rank().over(Window.partitionBy("condition", "panel_type").orderBy(F.desc_nulls_last(within)))
    return rows.select("condition", "panel_type", "sample_id", "grp", "scores", "affinity", F.when(within.isNotNull(), rank).alias("rank"))


def _compared(pairs: DataFrame, keys: list[str], n: dict[str, int], places: Mapping[str, Sequence[int]] | None = None) -> DataFrame:
    """keys, distance_correlation, similarity, rmse of pairs (keys…, panel_type, x, y): y against x. n: samples of a
    panel; places: those of x's rows to take, by panel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                y = np.array(r["y"]).reshape(n[r["panel_type"]], -1)
                x = np.array(r["x"])
                x = x.reshape(len(y), -1) if places is None else x.reshape(n["_whole"], -1)[list(places[r["panel_type"]])]
                i, j = np.triu_indices(len(y), 1)
                dx, dy = (np.linalg.norm(m[i] - m[j], axis=1) for m in (x, y))
                fits = len(dx) >= 3 and dx.std() > 0 and dy.std() > 0
                similarity, rmse = procrustes(x, y)
                rows.append((float(np.corrcoef(dx, dy)[0, 1]) if fits else None, similarity, rmse))
            out = [pa.array([None if v is None or np.isnan(v) else float(v) for v in c], pa.float64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.float64())] * 3
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in keys), *out], names=[*keys, "distance_correlation", "similarity", "rmse"])

    schema = ", ".join(f"{k} string" for k in keys) + ", distance_correlation double, similarity double, rmse double"
    return pairs.select(*dict.fromkeys([*keys, "panel_type", "x", "y"])).mapInArrow(run, schema)


def stability(found: DataFrame, samples: Mapping[str, Sequence[Sample]], baseline: str) -> DataFrame:
    """condition, panel_type, and how a condition's configuration of samples agrees with the baseline's."""
    base = found.where(F.col("condition") == baseline).select("panel_type", F.col("scores").alias("x"))
    pairs = found.join(F.broadcast(base), "panel_type").select("condition", "panel_type", "x", F.col("scores").alias("y"))
    return _compared(pairs, ["condition", "panel_type"], {p: len(rows) for p, rows in samples.items()})


def restricted(found: DataFrame, samples: Mapping[str, Sequence[Sample]], whole: str, part: str, groups: tuple[str, str]) -> DataFrame:
    """condition, and how the part's samples lie in the whole panel's components against their own panel's: correlation
    of distances, Procrustes similarity and rmse, the groups' separation in both, and the second by the first."""
    at = {s: k for k, (s, _) in enumerate(samples[whole])}
    places = [at[s] for s, _ in samples[part]]
    x = found.where(F.col("panel_type") == whole).select("condition", F.col("scores").alias("x"), F.size("scores").alias("_n"))
    y = found.where(F.col("panel_type") == part).select("condition", "panel_type", F.col("scores").alias("y"), F.col("separation").alias("separation_part"))
    pairs = x.join(y, "condition")
    agreed = _compared(pairs, ["condition"], {part: len(places), "_whole": len(at)}, {part: places})
    width = F.floor(F.col("_n") / len(at)).cast("int")

    def centre(group: str):
        """Mean of a group's rows of x."""
        rows = [p for p, (_, g) in zip(places, samples[part], strict=True) if g == group]
        total = F.aggregate(F.array(*map(F.lit, rows)), F.array_repeat(F.lit(0.0), width), lambda acc, r: F.zip_with(acc, F.slice("x", r * width + 1, width), lambda a, b: a + b)) if rows else F.lit(None).cast("array<double>")
        return F.transform(total, lambda v: v / F.lit(float(max(len(rows), 1))))

    square = F.aggregate(F.zip_with(centre(groups[0]), centre(groups[1]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    gaps = pairs.select("condition", F.sqrt(square).alias("separation_whole"), "separation_part")
    return agreed.join(gaps, "condition").withColumn("separation_ratio", F.when(F.col("separation_whole") > 0, F.col("separation_part") / F.col("separation_whole")))


def rank_agreement(scores: DataFrame, baseline: str, best: int = 6) -> DataFrame:
    """condition, panel_type, Spearman correlation of all samples' affinities with the baseline's, and how many of the
    ranked group's best are shared. scores: sample_scores()."""
    base = scores.where(F.col("condition") == baseline).select("panel_type", "sample_id", F.col("affinity").alias("_affinity"), F.col("rank").alias("_rank"))
    both = scores.join(base, ["panel_type", "sample_id"])
    by = ["condition", "panel_type"]
    both = both.withColumns({c: F.round(c, PLACES) for c in ("affinity", "_affinity")})
    ranked = both.select("*", average_rank("affinity", by).alias("a"), average_rank("_affinity", by).alias("b"))
    return ranked.groupBy(*by).agg(pearson("a", "b").alias("spearman"), F.count_if((F.col("rank") <= best) & (F.col("_rank") <= best)).alias("shared_best"))


def intervals(sites: DataFrame, top: int, baseline: str) -> DataFrame:
    """condition, n_sites, and of its ``top`` most differentiated sites (ties by maf, then site): the contig that holds
    most (ties by the largest, then the mean difference, then name), their number and span there, and how these agree
    with the baseline's. sites: conditions, site_id, contig, pos, maf, abs_delta_af. Tasks keep ``top`` sites of each
    condition before these meet."""
    each = sites.select(F.explode("conditions").alias("condition"), "site_id", "contig", "pos", "maf", "abs_delta_af")
    sizes = each.groupBy("condition").agg(F.count("*").alias("n_sites"))
    order = Window.partitionBy("condition").orderBy(F.desc("abs_delta_af"), F.desc("maf"), F.asc("site_id"))
    markers = each.where("abs_delta_af is not null").withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= top)
    by = markers.groupBy("condition", "contig").agg(F.count("*").alias("n_top"), F.min("pos").alias("interval_start"), F.max("pos").alias("interval_end"), F.avg("abs_delta_af").alias("mean_abs_delta_af"), F.max("abs_delta_af").alias("max_abs_delta_af"))
    best = Window.partitionBy("condition").orderBy(F.desc("n_top"), F.desc("max_abs_delta_af"), F.desc("mean_abs_delta_af"), F.asc("contig"))
    first = by.withColumn("_at", F.row_number().over(best)).where("_at = 1").drop("_at")
    rows = sizes.join(first, "condition", "left")
    base = rows.where(F.col("condition") == baseline).select(F.col("contig").alias("_c"), F.col("interval_start").alias("_s"), F.col("interval_end").alias("_e"))
    same = F.coalesce(F.col("contig") == F.col("_c"), F.lit(False))
    met = rows.join(F.broadcast(base), F.lit(True), "left")
    return met.select(
        "condition", "n_sites", F.col("contig").alias("top_contig"), F.coalesce("n_top", F.lit(0)).alias("n_top"), "interval_start", "interval_end", (F.col("interval_end") - F.col("interval_start")).alias("span_bp"),
        "mean_abs_delta_af", "max_abs_delta_af", same.alias("same_top_contig"), F.when(same, interval_jaccard("interval_start", "interval_end", "_s", "_e")).otherwise(0.0).alias("jaccard"),
        (F.col("interval_start") - F.col("_s")).alias("start_shift_bp"), (F.col("interval_end") - F.col("_e")).alias("end_shift_bp"),
    )
