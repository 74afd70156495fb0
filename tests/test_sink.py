"""Batches under a pinned schema: types that drift, values that do not fit, batches handed over twice, files of bounded size."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from haltlens.streaming import sink


def test_drift_is_cast_or_refused(spark, tmp_path):
    path = str(tmp_path / "s")
    write = sink.pinned_sink(path)
    with pytest.raises(ValueError, match="no batch"):
        sink.read_pinned(spark, path)
    write(spark.createDataFrame([(1, "a", 0.5), (None, None, None)], "id int, name string, x double"), 0)
    write(spark.createDataFrame([("7", 5, Decimal("2.50"))], "id string, name long, x decimal(5,2)").select("x", "name", "id"), 1)
    want = [(None, None, None), (1, "a", 0.5), (7, "5", 2.5)]
    told = lambda: sorted(map(tuple, sink.read_pinned(spark, path).collect()), key=lambda r: (r[0] is not None, r))
    assert told() == want
    for rows, schema in (([("seven", "a", 1.0)], "id string, name string, x double"), ([(2.5, "a", 1.0)], "id double, name string, x double"), ([(2**40, "a", 1.0)], "id long, name string, x double")):
        with pytest.raises(Exception, match="id cannot be int"):
            write(spark.createDataFrame(rows, schema), 2)
    for columns in ("id int, name string", "id int, name string, x double, y int"):
        with pytest.raises(ValueError, match="pinned schema"):
            write(spark.createDataFrame([], columns), 2)
    assert told() == want  # what was refused left nothing
    write(spark.createDataFrame([(3.0, "b", None)], "id double, name string, x double"), 2)
    write(spark.createDataFrame([(99, "again", 0.0)], "id int, name string, x double"), 2)
    assert told()[-2:] == [(3, "b", None), (7, "5", 2.5)]


def test_stream_in_files_of_bounded_size(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(0, 100, 1, 4).select("id", F.repeat(F.lit("x"), 1000).alias("text")).write.parquet(source)
    stream = lambda: spark.readStream.schema("id long, text string").option("maxFilesPerTrigger", 1).parquet(source).writeStream.foreachBatch(sink.pinned_sink(path, most=7)).option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start().awaitTermination()
    stream()
    stream()
    rows = sink.read_pinned(spark, path)
    assert sorted(r.id for r in rows.collect()) == list(range(100))
    sizes = rows.groupBy(F.col("_metadata.file_path")).count().collect()
    assert max(r["count"] for r in sizes) <= 7
    assert len({r[0].rsplit("/", 2)[1] for r in sizes}) == 4  # batches
