"""Shared plumbing of the training-data operators: inputs, written cut points, column hygiene."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What Unicode-unaware word splitting treats as white space, everywhere in this subpackage.
WORD = r"[^\x20\x09-\x0D]+"
#: The folder of a local session that names none.
_OWN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Read from the session; a temporary one only where none is set and all is one process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        if not _OWN:  # the setting cannot be changed in a running session
            _OWN.append(tempfile.mkdtemp(prefix="haltlens-"))
        base = _OWN[0]
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df``, written as Parquet to the shared folder and read again: lineage ends here and a lost executor costs a re-read."""
    spark = df.sparkSession
    path, schema = new_path(spark, label), df.schema
    df.write.option("compression", "zstd").parquet(path)
    del df
    spark._jvm.System.gc()  # shuffles that nothing can ask for again leave the executors' disks
    out = spark.read.schema(schema).parquet(path)
    out._haltlens_path = path
    return out


def bucketed(df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """As ``written``, dealt into files by ``key``: joins on it move the other side only. A table of a name of its own, below the shared folder."""
    spark = df.sparkSession
    path = new_path(spark, label)
    name = re.sub(r"\W", "_", path.rsplit("/", 1)[-1])
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(name)
    out = spark.table(name)
    out._haltlens_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes what ``written`` wrote, once nothing reads it any more."""
    path = getattr(df, "_haltlens_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns of ``df`` under the operator's own names; all others, whatever they are called, stay out of the plan."""
    return df.select(*[F.col(f"`{c}`").alias(k) for k, c in columns.items()])


def merged(df: DataFrame) -> DataFrame:
    """``df``, to be joined by sort and merge however small it is told to be: files are compressed and arrays counted as one row each, and what is told too small would be gathered by the driver."""
    return df.hint("merge")


def sliced(batches, rows: int = 256):
    """Arrow batches in slices, so that a worker's Python objects stay few however large a batch is."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
