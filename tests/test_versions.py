"""Repairs of a folder: only files with changed rows are written, all others keep path and content; a second repair finds nothing."""

import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haltlens.sources import tables, versions

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("part", T.LongType()), T.StructField("v", T.DoubleType())])
LOCAL = lambda p: "/" + p.split(":", 1)[-1].lstrip("/")


def fix(rows):
    want = F.col("id") * 1.0
    return rows.withColumn("changed", ~F.col("v").eqNullSafe(want)).withColumn("v", want)


def totals(rows):
    return {"totals": rows.agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))}


def digests(paths):
    return {LOCAL(p): hashlib.sha256(Path(LOCAL(p)).read_bytes()).hexdigest() for p in paths}


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_only_changed_files_are_written(spark, tmp_path, kind):
    root = str(tmp_path / "a tree")
    rows = spark.range(0, 80, 1, 8).select("id", (F.col("id") % 8).alias("part"), F.when(F.col("id").isin(11, 12, 55), None).otherwise(F.col("id") * 1.0).alias("v"))
    for half in (0, 1):
        w = rows.filter(F.col("id").between(40 * half, 40 * half + 39)).write
        (w.parquet if kind == "parquet" else lambda p: w.csv(p, header=True))(f"{root}/half-{half}")
    before = versions.files_of(spark, root, kind=kind)
    first = digests(before)
    dry = versions.repair(spark, root, SCHEMA, fix, kind=kind, dry_run=True).collect()
    assert sorted(r.rows_changed for r in dry) == [1, 2] and {r.status for r in dry} == {"dry_run"} and versions.latest(spark, root) == 0
    done = versions.repair(spark, root, SCHEMA, fix, kind=kind, refresh=totals).collect()
    assert sorted(r.rows_changed for r in done) == [1, 2] and versions.latest(spark, root) == 1
    after = versions.files_of(spark, root, kind=kind)
    touched = {LOCAL(r.path) for r in done}
    kept = {p: h for p, h in digests(after).items() if p in first}
    assert kept == {p: h for p, h in first.items() if p not in touched} and len(touched) == 2
    assert digests(before) == first  # the old version's files are as they were
    told = lambda df: sorted((r.id, r.part, r.v) for r in df.collect())
    assert told(versions.read(spark, root, SCHEMA, kind=kind)) == [(i, i % 8, float(i)) for i in range(80)]
    assert sum(r.v is None for r in versions.read(spark, root, SCHEMA, 0, kind=kind).collect()) == 3
    assert tuple(versions.aggregate(spark, root, "totals").first()) == (80, sum(map(float, range(80))))
    calls = []
    again = versions.repair(spark, root, SCHEMA, fix, kind=kind, refresh=lambda r: calls.append(1) or totals(r))
    assert again.count() == 0 and not calls and versions.latest(spark, root) == 1 and versions.files_of(spark, root, kind=kind) == after


def test_two_repairs_of_one_version(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    spark.range(4).select("id", F.lit(0).cast("long").alias("part"), F.lit(0.0).alias("v")).write.parquet(root)
    real = tables.publish

    def late(spark, path, named, kind="parquet"):
        monkeypatch.setattr(tables, "publish", real)
        versions.repair(spark, root, SCHEMA, fix)
        return real(spark, path, named, kind)

    monkeypatch.setattr(tables, "publish", late)
    with pytest.raises(RuntimeError, match="another repair"):
        versions.repair(spark, root, SCHEMA, fix)
    assert sorted(r.v for r in versions.read(spark, root, SCHEMA).collect()) == [0.0, 1.0, 2.0, 3.0] and versions.latest(spark, root) == 1


def test_empty_tree(spark, tmp_path):
    root = str(tmp_path / "e")
    spark.createDataFrame([], SCHEMA).write.parquet(root)
    assert versions.repair(spark, root, SCHEMA, fix).count() == 0 and versions.read(spark, root, SCHEMA).count() == 0


def test_paths_as_listings_and_scans_write_them():
    assert versions._key("file:///a/b") == versions._key("file:/a/b") == "file:/a/b" and versions._key("/a/b:c") == "/a/b:c"
    assert versions._key("store://bucket/a") == "store://bucket/a" != versions._key("store://other/a")
