"""Bundles of tables: whole or not there, also when a run fails midway."""

import pytest
from pyspark.sql import functions as F

from allelix.sources import sinks


def folders(path):
    return sorted(p.name for p in path.iterdir() if not p.name.startswith("."))


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_bundle_that_fails_midway(spark, tmp_path, kind):
    path = tmp_path / "bundle"
    one, two = spark.range(3).select(F.col("id").cast("string").alias("x")), spark.createDataFrame([("a", "b")], "y string, z string")
    broken = one.select(F.raise_error(F.concat(F.lit("no "), "x")).cast("string").alias("y"))
    with pytest.raises(Exception, match="no "):
        sinks.write_tables({"one": one, "two": broken}, str(path), kind)
    assert "manifest.json" not in folders(path)
    manifest = {r["table"]: (r["rows"], r["columns"]) for r in sinks.write_tables({"one": one, "two": two}, str(path), kind).collect()}
    assert manifest == {"one": (3, 1), "two": (1, 2)}
    before = folders(path)
    assert len(before) == 2  # the manifest and its version: what failed is gone
    with pytest.raises(Exception, match="no "):
        sinks.write_tables({"one": one.limit(1), "two": broken}, str(path), kind)
    back = sinks.read_tables(spark, str(path), {"one": ["x"], "two": ["y", "z"]})
    assert sorted(r["x"] for r in back["one"].collect()) == ["0", "1", "2"] and back["two"].count() == 1
    # A bundle may be made from the one that it replaces.
    sinks.write_tables({"one": back["one"].where("x <> '1'")}, str(path), kind)
    assert sorted(r["x"] for r in sinks.read_tables(spark, str(path), {"one": ["x"]})["one"].collect()) == ["0", "2"]
    after = folders(path)
    assert len(after) == 2 and after != before
    with pytest.raises(ValueError, match="table two is missing"):
        sinks.read_tables(spark, str(path), {"two": ["y"]})
    with pytest.raises(ValueError, match="missing columns"):
        sinks.read_tables(spark, str(path), {"one": ["w"]})


def test_folders_without_manifest(spark, tmp_path):
    """Tables that others wrote; tables without rows."""
    spark.range(2).write.parquet(f"{tmp_path}/t")
    assert sinks.read_tables(spark, str(tmp_path), {"t": ["id"]})["t"].count() == 2
    empty = sinks.write_tables({"none": spark.range(0)}, str(tmp_path / "e"))
    assert empty.first()["rows"] == 0 and sinks.read_tables(spark, str(tmp_path / "e"), {"none": ["id"]})["none"].count() == 0
