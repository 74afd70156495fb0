"""Splits, leakage, sampling. Order is an MD5 of seed and key: the same for every run and engine, exact in number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hash_order(seed: int, *cols: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def sample_exact(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """All rows of ``n`` keys, the first in hash order: a bounded top-n, then a semi-join."""
    chosen = rows.select(key).distinct().orderBy(hash_order(seed, key), key).limit(n)
    return rows.join(chosen, key, "left_semi")


def first_in_order(keys: DataFrame, key: str, share: float, seed: int, digits: int = 4) -> DataFrame:
    """A share of distinct ``keys`` (rounded half to even, one at least), the first in hash order. Exact without a global sort: keys are counted by
    the first hexadecimal digits of their hash, which bounds what the driver reads, and only one such bucket is ranked."""
    hashed = keys.select(key, hash_order(seed, key).alias("_h")).withColumn("_b", F.conv(F.substring("_h", 1, digits), 16, 10).cast("int"))
    counts = sorted(hashed.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).collect())
    left, edge = max(1, round(sum(n for _, n in counts) * share)), -1
    for edge, n in counts:
        if n >= left:
            break
        left -= n
    last = hashed.filter(F.col("_b") == edge).withColumn("_r", F.row_number().over(W.partitionBy("_b").orderBy("_h", key))).filter(F.col("_r") <= left)
    return hashed.filter(F.col("_b") < edge).select(key).unionByName(last.select(key))


def leave_one_model(pairs: DataFrame, *, valid_models: int = 3, seed: int = 3571) -> DataFrame:
    """For every fold (a held-out model): its rows test; per instance, up to ``valid_models`` others validate, but one always trains.

    The hash order of an instance's models is the same for all folds, so that it is found once, as an array per instance; a fold only takes its model out of it.
    """
    order = F.transform(F.array_sort(F.collect_set(F.struct(hash_order(seed, "instance_id", "model_id").alias("h"), "model_id"))), lambda x: x["model_id"])
    ordered = pairs.groupBy("instance_id").agg(order.alias("_o"))
    folds = pairs.agg(F.collect_set("model_id").alias("_m"))  # one row, as many values as there are folds
    each = pairs.join(ordered, "instance_id").crossJoin(F.broadcast(folds)).withColumn("test_model", F.explode("_m"))
    own, out = F.array_position("_o", F.col("model_id")), F.array_position("_o", F.col("test_model"))
    others, place = F.size("_o") - (out > 0).cast("int"), own - ((out > 0) & (out < own)).cast("int")
    split = F.when(F.col("model_id") == F.col("test_model"), "test").when(place <= F.least(F.lit(valid_models), others - 1), "valid").otherwise("train")
    return each.withColumn("split", split).drop("_o", "_m")


def holdout_plan(pairs: DataFrame, *, test_models: list[str] | None = None, test_ratio: float = 0.15, valid_ratio: float = 0.15, min_steps: int = 0, seed: int = 7) -> DataFrame:
    """Held-out models test; of the rest a share of instances (rounded half to even, one at least) validates; short runs do not train or validate."""
    if test_models is None:
        test = first_in_order(pairs.select("model_id").distinct(), "model_id", test_ratio, seed).withColumn("_t", F.lit(True))
        p = pairs.join(test, "model_id", "left").withColumn("_t", F.coalesce("_t", F.lit(False)))
    else:
        p = pairs.withColumn("_t", F.col("model_id").isin(test_models))
    valid = first_in_order(p.filter("not _t").select("instance_id").distinct(), "instance_id", valid_ratio, seed + 1).withColumn("_v", F.lit(True))
    short = F.col("n_steps") < min_steps
    split = F.when(F.col("_t"), "test").when(short, "dropped").when(F.col("_v"), "valid").otherwise("train")
    return p.join(valid, "instance_id", "left").withColumn("split", split).drop("_t", "_v")


def masked(rows: DataFrame, sentinel: str = "__MISSING__") -> DataFrame:
    """Model identity hidden from models; the original kept beside it."""
    return rows.withColumns({"orig_model_id": F.col("model_id"), "model_id": F.lit(sentinel)})


def shared_groups(rows: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups found in more than one split."""
    return rows.groupBy(group).agg(F.count_distinct(split).alias("splits")).filter("splits > 1")


def split_summary(rows: DataFrame, by: tuple[str, ...] = ("split",)) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("traj_id").alias("trajectories"), F.count_distinct("instance_id").alias("instances"), F.count_distinct("model_id").alias("models"), F.avg(F.col("label").cast("double")).alias("label_rate"))


def leakage(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per fold: trajectories, models, instances and (instance, model) pairs that more than one split has, and those of them that test has. One pass: each row says its four keys, map-side combined."""
    kinds = {"trajectories": ("traj_id",), "models": ("model_id",), "instances": ("instance_id",), "pairs": ("instance_id", "model_id")}
    said = [F.struct(F.lit(i).alias("kind"), F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols]).alias("key")) for i, cols in enumerate(kinds.values())]
    # numbers, so that the aggregation stays in a hash table
    one = rows.select(*by, *sorted({c for cols in kinds.values() for c in cols}), F.xxhash64("split").alias("_s"), (F.col("split") == "test").cast("int").alias("_t"))
    keys = one.select(*by, "_s", "_t", F.explode(F.array(*said)).alias("k")).select(*by, "k.kind", "k.key", "_s", "_t")
    shared = keys.groupBy(*by, "kind", "key").agg((F.min("_s") != F.max("_s")).alias("c"), (F.max("_t") == 1).alias("t"))
    count = lambda k, more: F.count_if((F.col("kind") == k) & F.col("c") & more)
    out = shared.groupBy(*by).agg(*[x for i, k in enumerate(kinds) for x in (count(i, F.lit(True)).alias(f"shared_{k}"), count(i, F.col("t")).alias(f"shared_{k}_with_test"))])
    return out.withColumn("ok", (F.col("shared_trajectories") == 0) & (F.col("shared_models_with_test") == 0) & (F.col("shared_pairs") == 0))


def materialised(rows: DataFrame, plan: DataFrame, keys: tuple[str, ...], path: str) -> str:
    """``rows`` with the split that ``plan`` (keys and split) gives them, written in one pass to a folder partitioned by split; rows without one stay out. A finished folder
    is left as it is."""
    spark = rows.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        told = rows.drop("split").join(plan.select(*keys, "split"), list(keys))
        told.write.mode("overwrite").option("compression", "zstd").partitionBy("split").parquet(path)
    return path


def read_split(spark, path: str, split: str, columns: tuple[str, ...] | None = None, schema=None) -> DataFrame:
    """One split of a materialised folder: the other partitions, and columns that are not named, are not read."""
    r = spark.read if schema is None else spark.read.schema(schema)
    rows = r.parquet(path).filter(F.col("split") == split)
    return rows if columns is None else rows.select(*columns)


def first_rows(spark, path: str, split: str, n: int, columns: tuple[str, ...] | None = None) -> DataFrame:
    """``n`` rows of a split, as they come first: enough to see types and columns by, and no more of it is read."""
    return read_split(spark, path, split, columns).limit(n)
