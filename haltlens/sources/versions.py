"""Repair of a folder of files, copy on write by file: what a repair does not change keeps its file, what it changes is written anew, and a version lists the files that hold.

Versions lie in ``_versions`` below the folder, which readers of the folder itself do not see: each is published at once with its list of files and the aggregates that
were refreshed with it. Old files and versions stay, so that any version can be read again. Of two repairs that start from one version, one is published and the other raises.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haltlens.sources import tables


def _published(spark: SparkSession, root: str) -> list[int]:
    p, fs = tables._file_system(spark, f"{root.rstrip('/')}/_versions")
    return [int(name) for name, _ in tables.done_folds(spark, p.toString()) if name.isdigit()] if fs.exists(p) else []


def _place(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/_versions/{version:08d}"


def latest(spark: SparkSession, root: str) -> int:
    """The number of the last published version; 0 for a folder that was never repaired."""
    return max(_published(spark, root), default=0)


def files_of(spark: SparkSession, root: str, version: int | None = None, *, kind: str = "parquet") -> list[str]:
    """The files that hold a version's rows, in order. The list is what the driver needs to plan a scan of them: it grows with files, not rows."""
    version = latest(spark, root) if version is None else version
    if version:
        return sorted(r.path for r in spark.read.parquet(f"{_place(root, version)}/files.parquet").select("path").collect())
    return _listed(spark.read.format(kind).option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{kind}").load(root))


def _listed(df: DataFrame) -> list[str]:
    """A scan's files as paths; Spark names them, here and in ``_metadata``, as addresses, with blanks and the like encoded."""
    return sorted(map(unquote, df.inputFiles()))


def _read(spark: SparkSession, paths: list[str], kind: str, schema: T.StructType) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], schema)
    r = spark.read.schema(schema)
    return r.parquet(*paths) if kind == "parquet" else r.csv(paths, header=True)


def read(spark: SparkSession, root: str, schema: T.StructType, version: int | None = None, *, kind: str = "parquet") -> DataFrame:
    """The rows of a version, the last one unless told."""
    return _read(spark, files_of(spark, root, version, kind=kind), kind, schema)


def aggregate(spark: SparkSession, root: str, name: str) -> DataFrame:
    """An aggregate as the last version that was published left it."""
    return spark.read.parquet(f"{_place(root, latest(spark, root))}/{name}.parquet")


def repair(spark: SparkSession, root: str, schema: T.StructType, fix: Callable[[DataFrame], DataFrame], *, kind: str = "parquet", dry_run: bool = False, refresh: Callable[[DataFrame], dict[str, DataFrame]] | None = None) -> DataFrame:
    """path, rows_changed, status (``dry_run`` or ``updated``) of each file that ``fix`` changes; no row, no new version and no refresh where it changes nothing.

    ``fix`` returns the rows with ``changed`` besides the columns of ``schema``. One pass over the version finds the files, a second reads those alone and writes them
    as their tasks read them, without an exchange. ``refresh`` makes aggregates of the version's rows, published with it."""
    start = latest(spark, root)
    paths = files_of(spark, root, start, kind=kind)
    report = "path string, rows_changed long, status string"
    if not paths:
        return spark.createDataFrame([], report)
    whole = _read(spark, paths, kind, schema)
    found = fix(whole.select("*", F.col("_metadata.file_path").alias("_file"))).filter("changed").groupBy("_file").agg(F.count(F.lit(1)).alias("n")).collect()
    found = [(unquote(r["_file"]), r["n"]) for r in found]
    told = spark.createDataFrame([(path, n, "dry_run" if dry_run else "updated") for path, n in found], report)
    if dry_run or not found:
        return told
    hit = {_key(path) for path, _ in found}
    old, kept = [p for p in paths if _key(p) in hit], [p for p in paths if _key(p) not in hit]
    if len(old) != len(hit):
        raise ValueError("a changed file is not in the version's list")
    new = f"{root.rstrip('/')}/_versions/data-{uuid.uuid4().hex}"
    fixed = fix(_read(spark, old, kind, schema)).select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema])
    w = fixed.write
    w.option("compression", "zstd").parquet(new) if kind == "parquet" else w.csv(new, header=True)
    made = _listed(spark.read.format(kind).load(new))
    listed = spark.createDataFrame([(p, False) for p in kept] + [(p, True) for p in made], "path string, written boolean")
    named = {"files": listed.coalesce(1)} | (refresh(_read(spark, kept + made, kind, schema)) if refresh else {})
    if not tables.publish(spark, _place(root, start + 1), named):
        raise RuntimeError(f"version {start + 1} of {root} was published by another repair")
    return told


def _key(path: str) -> str:
    """A path whose slashes after the scheme are one, as listings and scans differ in them."""
    scheme, colon, rest = path.partition(":")
    return path if not colon or "/" in scheme else f"{scheme}:{rest if rest.startswith('//') and not rest.startswith('///') else '/' + rest.lstrip('/')}"
