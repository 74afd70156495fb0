"""A sink of batches under one pinned schema: the first batch sets it, later ones are cast to it or refused."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haltlens.sources import tables


def pinned_schema(spark: SparkSession, path: str) -> T.StructType | None:
    """The schema of a sink's first batch, as that batch's mark and an empty table keep it; None before it."""
    p, fs = tables._file_system(spark, f"{path.rstrip('/')}/schema/_SUCCESS")
    return spark.read.parquet(f"{path.rstrip('/')}/schema/pin.parquet").schema if fs.exists(p) else None


def cast_to(batch: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema``, by name and in its order. A column that lacks or is not known there is an error, and so is a value that its type cannot hold: nothing turns null."""
    lacking, strange = sorted({f.name for f in schema} - set(batch.columns)), sorted(set(batch.columns) - {f.name for f in schema})
    if lacking or strange or len(batch.columns) != len(schema):
        raise ValueError(f"batch does not fit the pinned schema: lacks {lacking}, has besides {strange}")

    def held(f: T.StructField):
        value = F.col(f"`{f.name}`")
        now = value.try_cast(f.dataType)
        lost = F.concat(F.lit(f"{f.name} cannot be {f.dataType.simpleString()}: "), F.substring(F.coalesce(value.cast("string"), F.lit("")), 1, 100))
        # a fraction cut off by a cast to a whole number is a loss too
        same = now.isNotNull() & (now.cast("double") == value.cast("double")) if isinstance(f.dataType, T.IntegralType) and isinstance(batch.schema[f.name].dataType, T.FractionalType) else now.isNotNull()
        return F.when(value.isNull() | same, now).otherwise(F.raise_error(lost).cast(f.dataType)).alias(f.name)

    return batch.select(*[held(f) if batch.schema[f.name].dataType != f.dataType else F.col(f"`{f.name}`") for f in schema])


def pinned_sink(path: str, *, most: int = 1_000_000) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch goes to a folder named by its id, published at once with a mark, so that a batch that is handed over again after a failure is written once.

    ``most``: rows of a file at most; Spark cuts a larger batch as it writes it. An empty first batch pins its schema too. Columns are nullable under the pin."""
    base = path.rstrip("/")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        schema = pinned_schema(spark, base)
        if schema is None:
            tables.publish(spark, f"{base}/schema", {"pin": batch.limit(0)})
            schema = pinned_schema(spark, base)
        p, fs = tables._file_system(spark, f"{base}/batches/{batch_id:012d}")
        if fs.exists(p.suffix("/_SUCCESS")):
            return
        hidden = f"{base}/.tmp-{batch_id:012d}"
        cast_to(batch, schema).write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", most).parquet(hidden)
        fs.mkdirs(p.getParent())
        fs.delete(p, True)  # an unmarked folder of an earlier try
        if not fs.rename(tables._file_system(spark, hidden)[0], p):
            raise OSError(f"cannot publish batch {batch_id} to {base}")

    return write


def read_pinned(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the sink's published batches, under its schema; an error before the first batch."""
    schema = pinned_schema(spark, path)
    if schema is None:
        raise ValueError(f"no batch was written to {path}")
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path.rstrip('/')}/batches")
