"""The evidence of accessions against pandas, and directions of short lists."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from allelix.operators import accessions as X
from allelix.operators import marts as K

GROUPS = ["arabica_cultivated", "arabica_introgressed", "arabica_wild", "canephora", "eugenioides"]
COLUMNS = [f"{s}_mean_ibs_to_{g}" for s in X.SIDES for g in GROUPS] + [f"delta_{r}_sgC_minus_sgE" for r in ("heterozygosity", "non_reference_rate", "call_rate")]


def wanted(w: pd.DataFrame) -> pd.DataFrame:
    w = w.copy()
    to = lambda s, g: w[f"{s}_mean_ibs_to_{g}"]
    shift = pd.DataFrame({s: to(s, "arabica_introgressed") - to(s, "arabica_cultivated") for s in X.SIDES})
    w["mean_introgressed_shift"] = shift.mean(axis=1)
    w["mean_canephora_affinity"] = pd.DataFrame({s: to(s, "canephora") for s in X.SIDES}).mean(axis=1)
    own, other = to("sgC", "canephora") - to("sgC", "eugenioides"), to("sgE", "eugenioides") - to("sgE", "canephora")
    w["parental_distortion_score"], w["abs_delta_introgressed_shift"] = (own - other).abs(), (shift["sgC"] - shift["sgE"]).abs()
    for r in ("heterozygosity", "non_reference_rate"):
        w[f"abs_delta_{r}"] = w[f"delta_{r}_sgC_minus_sgE"].abs()
    some = w[w["analysis_group"].isin(X.RANKED)].copy()
    for name, c in X.PERCENTILES.items():
        some[f"{name}_percentile"] = some[c].rank(method="average", pct=True)
    for name, parts in X.COMPOSITES.items():
        some[f"{name}_percentile"] = some[[f"{p}_percentile" for p in parts]].mean(axis=1)
    for name in X.COMPOSITES:
        some[f"overall_{name}_rank"] = some[f"{name}_percentile"].rank(method="min", ascending=False)
        some[f"within_group_{name}_rank"] = some.groupby("analysis_group")[f"{name}_percentile"].rank(method="min", ascending=False)
    new = [c for c in some if c.endswith(("_percentile", "_rank"))]
    return w.merge(some[["seq_id", *new]], on="seq_id", how="left")


def test_evidence(spark):
    """Ties, missing measures, accessions without any, groups that aren't ranked, NULL groups."""
    rng = np.random.default_rng(4)
    w = pd.DataFrame({"seq_id": [f"a{k}" for k in range(80)], "analysis_group": rng.choice([*GROUPS, "other"], 80)})
    for c in COLUMNS:
        w[c] = np.where(rng.random(80) < 0.2, np.nan, rng.integers(-6, 7, 80) / 8)
    w.loc[3, COLUMNS] = np.nan
    w.loc[3, "analysis_group"] = "arabica_wild"
    want = wanted(w).set_index("seq_id")
    schema = "seq_id string, analysis_group string, extra long, metric string, " + ", ".join(f"{c} double" for c in COLUMNS)
    rows = [(r["seq_id"], r["analysis_group"], k, "m", *[None if np.isnan(r[c]) else float(r[c]) for c in COLUMNS]) for k, r in w.iterrows()]
    rows += [("none", None, 1, "m", *[0.5] * len(COLUMNS)), (None, "arabica_wild", 2, "m", *[0.25] * len(COLUMNS))]
    out = X.evidence(spark.createDataFrame(rows, schema))
    got = {r["seq_id"]: r.asDict() for r in out.collect()}
    assert len(got) == len(rows) and got["none"]["combined_evidence_percentile"] is got[None]["overall_combined_evidence_rank"] is None
    checked = [c for c in want if c.endswith(("_percentile", "_rank", "_shift", "_affinity", "_score"))]
    for name, row in want.iterrows():
        for c in checked:
            x = got[name][c]
            assert (x is None and np.isnan(row[c])) or x == pytest.approx(row[c], abs=1e-12), (name, c)
    assert got["a5"]["extra"] == 5
    assert X.evidence(spark.createDataFrame([], schema)).collect() == []


def test_list_direction(spark):
    """Means, percentile ranks among the first rows, and shares; no row for an empty list."""
    rows = spark.createDataFrame([("a", 0.9, 3), ("b", 0.7, 3), ("a", 0.5, 1), ("c", 0.1, 9)], "grp string, score double, n long")
    call = lambda df: K.list_direction(df, 3, [F.desc("score")], "kind", "label", "scope", "key", ["score"], ["n"], [F.count_distinct("grp") / F.lit(4)], mean=F.avg("score"), groups=F.count_distinct("grp"), total=F.sum("n"), least=F.min("n")).collect()
    (got,) = call(rows)
    assert got["composite_support_score"] == pytest.approx((0.7 + (2.5 / 3 * 2 + 1 / 3) / 3 + 2 / 4) / 3)
    assert [got[f"support_metric_{k}"] for k in range(1, 5)] == [pytest.approx(0.7), 2, 7, 1] and got["support_metric_2_name"] == "groups"
    assert call(rows.limit(0)) == []
