"""Tables in and out: dispatch by suffix, column rules, contracts, resumable partitions."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


MESSAGE = _struct(role=_S, content=_S, tools=T.ArrayType(_S), observation=_S)
CONTRACTS = {
    "trajectories": _struct(benchmark=_S, instance_id=_S, traj_id=_S, model_id=_S, resolved=_B, messages=T.ArrayType(MESSAGE), patch=_S),
    "scores": _struct(traj_id=_S, prefix_step_idx=_I, agent=_S, label=_I, p_success=_D, p_failure=_D),
    "policies": _struct(candidate_ord=_L, name=_S, predictor=_S, score_mode=_S, policy_mode=_S, success_thr=_D, failure_thr=_D, min_step=_I, consecutive=_I),
    "decisions": _struct(traj_id=_S, agent=_S, label=_I, n_steps=_L, decided=_B, decision=_S, decision_step=_I, decision_score=_D, prob_success=_D, prob_failure=_D, saved_steps=_L),
}


def suffix_of(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet, csv, tsv, json (a list, one object, or what ``write_table`` wrote) or jsonl, by suffix."""
    r, kind = spark.read, suffix_of(path)
    if schema is not None:
        r = r.schema(schema)
    if kind == "parquet":
        return r.parquet(path)
    if kind in ("csv", "tsv"):
        return r.csv(path, header=True, inferSchema=schema is None, sep="\t" if kind == "tsv" else ",")
    if kind == "json" and not _lines(spark, path):
        return r.json(path, multiLine=True)
    if kind in ("json", "jsonl"):
        return r.json(path)
    raise ValueError(f"no reader for .{kind}")


def _lines(spark: SparkSession, path: str) -> bool:
    """Whether a ``.json`` path holds one object a line: a folder of parts as ``write_table`` leaves it. A file of its own is a list or one object."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory() and any(x.getPath().getName().startswith("part-") for x in fs.listStatus(p))


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """By suffix, as Spark writes it: a folder of parts, committed as a whole with a _SUCCESS mark."""
    w, kind = df.write.mode(mode), suffix_of(path)
    if kind == "parquet":
        w.option("compression", "zstd").parquet(path)
    elif kind in ("csv", "tsv"):
        w.csv(path, header=True, sep="\t" if kind == "tsv" else ",")
    elif kind in ("json", "jsonl"):
        w.json(path)
    else:
        raise ValueError(f"no writer for .{kind}")


def write_json(path: str, payload) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(payload, indent=2, sort_keys=True, ensure_ascii=False) + "\n")


def read_json(path: str):
    return json.loads(Path(path).read_text())


def present(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """Those of the wanted columns that exist, in the order wanted; an error if there are none."""
    found = [c for c in wanted if c in df.columns]
    if not found:
        raise ValueError("none of the requested columns exist")
    return df.select(*[F.col(f"`{c}`") for c in found])


def required(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def canonical(df: DataFrame, aliases: dict[str, str], defaults: dict[str, object] | None = None) -> DataFrame:
    """Columns under their contract names; absent ones with a default."""
    df = df.withColumnsRenamed({old: new for new, old in aliases.items() if old in df.columns and new != old})
    return df.withColumns({k: (v if not isinstance(v, (int, float, str, bool, type(None))) else F.lit(v)) for k, v in (defaults or {}).items() if k not in df.columns})


def completed_folds(spark: SparkSession, base: str, *, done: DataFrame | None = None, excluded: Iterable[str] = ()) -> DataFrame:
    """A fold-partitioned folder (fold_id=...), only folds in ``done`` (fold_id) and not excluded; both prune partitions."""
    df = spark.read.option("basePath", base).parquet(base)
    excluded = list(excluded)
    if excluded:
        df = df.filter(~F.col("fold_id").isin(excluded))
    return df if done is None else df.join(done.select("fold_id").distinct(), "fold_id", "left_semi")


def remaining(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return plan.join(done.select(*keys).distinct(), keys, "left_anti")


def combine(parts: list[DataFrame], *, without: DataFrame | None = None, keys: list[str] | None = None, doubles: Iterable[str] = ()) -> DataFrame:
    """Union by name, missing columns as null; rows whose keys are in ``without`` left out; named columns as doubles."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    if without is not None:
        out = out.join(without.select(*keys).distinct(), keys, "left_anti")
    return out.withColumns({c: F.col(c).try_cast("double") for c in doubles if c in out.columns})


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key that came last: a mergeable maximum, not a sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def files(spark: SparkSession, path: str, pattern: str = "*", *, most: int = 64 << 20) -> DataFrame:
    """A landed folder as path, bytes, sha256; files beyond ``most`` bytes are not read and have no digest."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    small = found.filter(F.col("length") <= most).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return small.unionByName(found.filter(F.col("length") > most).select("path", F.col("length").alias("bytes"), F.lit(None).cast("string").alias("sha256")))


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share; a temporary one only where the session names none and all is one process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        base = tempfile.mkdtemp(prefix="haltlens-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df``, written once to a scratch folder and read from there by all that follows."""
    path, spark = scratch(df.sparkSession, label), df.sparkSession
    write_table(df, f"{path}.parquet")
    return spark.read.schema(df.schema).parquet(f"{path}.parquet")


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def publish(spark: SparkSession, path: str, named: dict[str, DataFrame], kind: str = "parquet") -> bool:
    """Writes tables beside each other and shows them at once: all go to a hidden folder, which is renamed, and then marked as done. False: it was done before."""
    p, fs = _file_system(spark, path)
    mark, hidden = p.suffix("/_SUCCESS"), f"{path.rstrip('/')}.tmp-{uuid.uuid4().hex}"
    if fs.exists(mark):
        return False
    for name, df in named.items():
        write_table(df, f"{hidden}/{name}.{kind}")
    fs.delete(p, True)
    if not fs.rename(_file_system(spark, hidden)[0], p):
        raise OSError(f"cannot publish {path}")
    fs.create(mark, True).close()
    return True


def done_folds(spark: SparkSession, base: str, excluded: Iterable[str] = ()) -> list[tuple[str, str]]:
    """Name and path of each fold folder below ``base`` that is marked as done and not excluded, in order."""
    p, fs = _file_system(spark, base)
    found = [(x.getPath().getName(), x.getPath().toString()) for x in fs.listStatus(p) if x.isDirectory() and fs.exists(x.getPath().suffix("/_SUCCESS"))]
    return sorted(f for f in found if f[0] not in set(excluded))


def read_folds(spark: SparkSession, base: str, names: Iterable[str], *, excluded: Iterable[str] = (), kind: str = "parquet", schemas: dict[str, T.StructType] | None = None) -> dict[str, DataFrame]:
    """Tables of all done folds, each read by one scan, with fold_id and test_model from the folder's name (``<fold_id>__<test_model>``)."""
    folds, out = done_folds(spark, base, excluded), {}
    if not folds:
        raise ValueError(f"no fold is done below {base}")
    for name in names:
        r = spark.read if not schemas or name not in schemas else spark.read.schema(schemas[name])
        paths = [f"{path}/{name}.{kind}" for _, path in folds]
        df = r.parquet(*paths) if kind == "parquet" else r.csv(paths, header=True, inferSchema=not schemas or name not in schemas, sep="\t" if kind == "tsv" else ",")
        fold = F.regexp_extract(F.col("_metadata.file_path"), rf"([^/]+)/{name}\.{kind}/[^/]+$", 1)
        out[name] = df.select("*", F.substring_index(fold, "__", 1).alias("fold_id"), F.regexp_extract(fold, "__(.*)$", 1).alias("test_model"))
    return out


def metadata(df: DataFrame) -> DataFrame:
    """Rows and columns of a table, one row each column; counting reads footers only."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.posexplode(F.array(*[F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type")) for f in df.schema])).alias("position", "c")).select("rows", "position", "c.*")


def peek(df: DataFrame, column: str, default: str | None = None) -> str | None:
    """A column's value in any one row."""
    row = df.select(column).limit(1).first() if column in df.columns else None
    return default if row is None or row[0] is None else row[0]


def prompts(df: DataFrame, *, key: str = "instance_id", problem: str = "problem_statement", hints: str = "hints_text") -> DataFrame:
    """Task texts by instance: the problem and, where there are any, its hints."""
    hint = F.trim(F.coalesce(F.col(hints), F.lit("")))
    return df.select(key, F.concat(F.trim(F.coalesce(F.col(problem), F.lit(""))), F.when(hint != "", F.concat(F.lit("\n\nHints:\n"), hint)).otherwise("")).alias("prompt"))


def agent_column(*names: str) -> Column:
    """The first of several columns that says something: no blank, no 'nan', no hidden name."""
    said = [F.when(~F.trim(F.col(n)).isin("", "nan", "__MISSING__"), F.col(n)) for n in names]
    return F.coalesce(*said)


def records(spark: SparkSession, path: str) -> DataFrame:
    """JSON records of a file, each as text: lines, a list, an object with records, or one object."""
    whole = spark.read.text(path, wholetext=suffix_of(path) != "jsonl").filter(F.trim("value") != "")
    v, many = F.col("value"), "array<string>"
    listed = F.coalesce(F.from_json(F.get_json_object(v, "$.records"), many), F.when(F.trim(v).startswith("["), F.from_json(v, many)), F.array(v))
    return whole.select(F.explode(listed).alias("record"))


def config(path: str) -> dict:
    """A JSON or YAML file of settings; paths in ``paths`` that are not absolute are below the file's folder."""
    if suffix_of(path) in ("yaml", "yml"):
        try:
            import yaml
        except ModuleNotFoundError as e:
            raise ValueError("YAML settings need the yaml module") from e
        out = yaml.safe_load(Path(path).read_text()) or {}
    else:
        out = read_json(path)
    below = lambda x: str(Path(path).resolve().parent / x)
    return out | ({"paths": {k: below(v) for k, v in out["paths"].items()}} if isinstance(out.get("paths"), dict) else {})


def scan_references(spark: SparkSession, path: str, needles: list[str]) -> DataFrame:
    """Lines of text files that hold any of the needles: path, line, needle."""
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\n")).alias("i", "text"))
    hits = F.filter(F.array(*[F.lit(n) for n in needles]), lambda n: F.contains(F.col("text"), n))
    return t.select("path", (F.col("i") + 1).alias("line"), F.explode(hits).alias("needle"))


def markdown(rows: list, columns: list[str]) -> str:
    body = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(body + ["| " + " | ".join("" if r[c] is None else str(r[c]) for c in columns) + " |" for r in rows])
