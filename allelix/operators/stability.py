"""How principal components, ranks and intervals hold across sampled conditions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from allelix.functions.ranking import average_rank
from allelix.operators.linalg import pearson, principal_components, procrustes, standardised


def component_scores(rows: DataFrame, condition: str, dosages: str, samples: Sequence[tuple[str, str]], groups: tuple[str, str], k: int = 5) -> DataFrame:
    """condition, sample_id, grp, scores (array), affinity, explained: components of each condition's sites.

    A condition is a bounded sample of sites, so its group is bounded too; the unsampled condition goes through
    linalg.gram(). samples: (sample_id, grp) in the order of the dosage arrays; groups: cultivated, introgressed."""
    ids, grp = [s for s, _ in samples], np.array([g for _, g in samples])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        z = standardised(np.array([[np.nan if v is None else v for v in row] for row in part[dosages]], float))
        scores, ratio = principal_components(z.T @ z, k)
        centre = [scores[grp == g].mean(0) if (grp == g).any() else np.full(scores.shape[1], np.nan) for g in groups]
        away = [np.linalg.norm(scores - c, axis=1) for c in centre]
        return pd.DataFrame({"condition": part[condition].iloc[0], "sample_id": ids, "grp": grp, "scores": list(scores), "affinity": away[0] - away[1], "explained": float(ratio.sum())})

    return rows.groupBy(condition).applyInPandas(run, "condition string, sample_id string, grp string, scores array<double>, affinity double, explained double")


def component_stability(scores: DataFrame, baseline: str) -> DataFrame:
    """condition, distance correlation and Procrustes similarity and rmse against the baseline condition. The baseline
    is a panel's rows, shipped with the function."""
    base = scores.where(F.col("condition") == baseline).select("sample_id", "scores").toPandas().set_index("sample_id")["scores"]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        own = part.set_index("sample_id")["scores"]
        both = [s for s in own.index if s in base.index]
        x, y = np.array([base[s] for s in both]), np.array([own[s] for s in both])
        i, j = np.triu_indices(len(both), 1)
        dx, dy = (np.linalg.norm(m[i] - m[j], axis=1) for m in (x, y))
        fits = len(dx) >= 3 and dx.std() > 0 and dy.std() > 0
        similarity, rmse = procrustes(x, y)
        return pd.DataFrame({"condition": [part["condition"].iloc[0]], "distance_correlation": [float(np.corrcoef(dx, dy)[0, 1]) if fits else None], "similarity": [similarity], "rmse": [rmse]})

    return scores.groupBy("condition").applyInPandas(run, "condition string, distance_correlation double, similarity double, rmse double")


def affinity_ranks(scores: DataFrame, group: str) -> DataFrame:
    """Scores with the rank of affinity inside one group (1: most; NULL elsewhere), by condition."""
    within = F.when(F.col("grp") == group, F.col("affinity"))
    rank = F.rank().over(Window.partitionBy("condition").orderBy(F.desc_nulls_last(within)))
    return scores.select("condition", "sample_id", "grp", "affinity", F.when(within.isNotNull(), rank).alias("rank"))


def rank_agreement(ranks: DataFrame, baseline: str, best: int = 6) -> DataFrame:
    """condition, Spearman correlation of ranked samples with the baseline's, and how many of its best are shared."""
    ranked = ranks.where("rank is not null")
    base = ranked.where(F.col("condition") == baseline).select("sample_id", F.col("affinity").alias("base_affinity"), F.col("rank").alias("base_rank"))
    both = ranked.join(base, "sample_id")
    places = both.select("*", average_rank("affinity", ["condition"]).alias("a"), average_rank("base_affinity", ["condition"]).alias("b"))
    top = lambda c: F.count_if((F.col("rank") <= best) & (F.col(c) <= best))
    return places.groupBy("condition").agg(pearson("a", "b").alias("spearman"), top("base_rank").alias("shared_best"), F.count("*").alias("n_samples"))


def interval_stability(summaries: DataFrame, baseline: str) -> DataFrame:
    """summaries (condition, contig, interval_start, interval_end): Jaccard with the baseline's interval, 0 on another
    contig."""
    from allelix.functions.scalars import interval_jaccard

    base = summaries.where(F.col("condition") == baseline).select(F.col("contig").alias("base_contig"), F.col("interval_start").alias("bs"), F.col("interval_end").alias("be"))
    same = F.col("contig") == F.col("base_contig")
    return summaries.crossJoin(F.broadcast(base)).select("condition", "contig", "interval_start", "interval_end", F.when(same, interval_jaccard("interval_start", "interval_end", "bs", "be")).otherwise(0.0).alias("jaccard"))
