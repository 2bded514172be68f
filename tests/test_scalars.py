"""Scalar expressions and ranks against values worked out by hand or by pandas."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from allelix.functions import ranking as R
from allelix.functions import scalars as S


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first()["y"]


@pytest.mark.parametrize("call,dosage", [("0/1:3", 1), ("1|1", 2), ("./.", None), (".", None), ("0", None), ("0/2", None), ("", None), (None, None), ("1/1/1", None), ("0/0:9", 0), ("00/1", 1)])
def test_gt_dosage(spark, call, dosage):
    assert one(spark, call, S.gt_dosage("x")) == dosage


@pytest.mark.parametrize("call,dosage", [("0/2", 2.0), ("1", 1.0), ("1/1/1", 3.0), ("./1", None), ("", None)])
def test_gt_dosage_any(spark, call, dosage):
    assert one(spark, call, S.gt_dosage_any("x")) == dosage


def test_gt_not_first(spark):
    df = spark.createDataFrame([("DP:GT", "7:0/1"), ("DP", "7")], "f string, s string")
    got = [r[0] for r in df.select(S.gt_dosage("s", S.format_index("f", "GT"))).collect()]
    assert got == [1, None]


@pytest.mark.parametrize("contig,sub,label", [("chr_D_sg_C_x", "sgC", "Chr4"), ("chr_D_sg_E_x", "sgE", "Chr4"), ("a_sgCC_b", "sgC", "a_sgCC_b"), ("a_sgEE", "sgE", "a_sgEE"), ("a_sgCCx", "unassigned", "a_sgCCx")])
def test_contigs(spark, contig, sub, label):
    assert one(spark, contig, S.subgenome_of("x")) == sub
    assert one(spark, contig, S.chromosome_label("x")) == label


def test_names_and_tokens(spark):
    assert one(spark, " Red-Type 1_sgC", S.name_candidates("x")) == ["Red-Type 1_sgC", "Red-Type 1"]
    assert one(spark, " A-b C.1 ", S.token("x")) == "abc1"
    assert one(spark, "--", S.token("x")) is None


def test_groups(spark):
    df = spark.createDataFrame([("Coffea arabica", "introgressed cultivated"), ("Coffea arabica", None), ("C. canephora", ""), (None, "wild")], "s string, v string")
    assert [r[0] for r in df.select(S.analysis_group("s", "v")).collect()] == ["arabica_introgressed", "arabica_other", "canephora", "other"]


def test_attributes_last_wins(spark):
    assert one(spark, "ID=a;x;k = v=w ;ID=b", S.attributes("x")) == {"ID": "b", "k": "v=w"}
    assert one(spark, None, S.attributes("x")) == {}


def test_chunk_names(spark):
    assert tuple(one(spark, "chunk0002|src=100-299", S.chunk_coordinates("x"))) == (2, 100, 299)
    with pytest.raises(Exception, match="no chunk name"):
        one(spark, "nothing", S.chunk_coordinates("x"))


def test_seqid(spark):
    assert one(spark, "ref|NC_039898.1|", S.seqid("x")) == "NC_039898.1"
    assert one(spark, "| abc |", S.seqid("x")) == "abc"


def test_half_even_transfer(spark):
    df = spark.createDataFrame([(1, 2, 1), (3, 2, 1), (5, 2, 1), (9, 9, 9)], "p long, a long, b long")
    assert [r[0] for r in df.select(S.transferred("p", "a", "b")).collect()] == [1, 1, 1, 9]
    assert spark.range(1).select(S.transferred(F.lit(5), F.lit(2), F.lit(100))).first()[0] == 100


def test_transfer_between_equal_lengths_stays_inside(spark):
    df = spark.createDataFrame([(30, 9, 9), (0, 9, 9), (4, 9, 9), (None, 9, 9)], "p long, a long, b long")
    assert [r[0] for r in df.select(S.transferred("p", "a", "b")).collect()] == [9, 1, 4, None]


def test_confidence_and_gates(spark):
    rows = [(0.0, None), (0.02, 0.02), (0.02, 0.0), (0.05, 0.02), (0.05, None), (0.5, 0.3)]
    df = spark.createDataFrame(rows, "d double, g double")
    assert [r[0] for r in df.select(S.confidence("d", "g")).collect()] == ["exact", "high", "medium", "medium", "low", "unresolved"]
    t, f, n = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    assert tuple(spark.range(1).select(S.gate([t, t]), S.gate([t, n]), S.gate([f, f])).first()) == ("PASS", "WARN", "FAIL")


def test_labels_means(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 3.0), (None, None)], "a double, b double")
    assert [r[0] for r in df.select(S.mean_of("a", "b")).collect()] == [1.5, 3.0, None]
    assert [r[0] for r in df.select(S.median_of("a", "b")).collect()] == [1.5, 3.0, None]
    assert [r[0] for r in df.select(S.sign_label(F.col("a") - F.col("b"))).collect()] == ["sgE", "tie", "tie"]


def test_categories(spark):
    assert one(spark, "NLR kinase", S.first_category("x", S.CATEGORIES, S.OTHER_CATEGORY)) == "Defense receptor"
    assert one(spark, None, S.first_category("x", S.CATEGORIES, S.OTHER_CATEGORY)) == S.OTHER_CATEGORY
    assert one(spark, "a kinase and a channel", S.all_categories("x", S.KEYWORD_RULES)) == "kinase_signaling; transport_membrane"
    assert tuple(one(spark, "Ring ring", S.term_hits("x", ["ring", "bolt"]))) == ("ring", 1)


def test_ranks_as_pandas(spark):
    values = [3.0, 1.0, None, 3.0, 2.0, None]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    s = pd.Series(values)
    got = df.select("i", R.average_rank("x").alias("a"), R.percentile_rank("x").alias("p"), R.average_rank("x", descending=True, nulls="bottom").alias("b"), R.min_rank("x").alias("m")).orderBy("i").toPandas()
    for name, want in (("a", s.rank()), ("p", s.rank(pct=True)), ("b", s.rank(ascending=False, na_option="bottom")), ("m", s.rank(ascending=False, method="min"))):
        assert got[name].astype(float).fillna(-1).tolist() == want.fillna(-1).tolist(), name
