"""Table audits: counts, completeness of columns, most frequent values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from haltlens.functions.scalars import number, safe_div


def prefix_audit(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct counts, labels, first-step rows, step range and the 99th percentile of trajectories' last steps."""
    each = rows.groupBy(*by, "traj_id").agg(F.count(F.lit(1)).alias("rows"), F.max("label").alias("label"), F.min("prefix_step_idx").alias("low"), F.max("prefix_step_idx").alias("high"), F.count_if(F.col("prefix_step_idx") == 0).alias("zero"), F.min("agent").alias("agent"))
    return each.groupBy(*by).agg(
        F.sum("rows").cast("long").alias("rows"), F.count(F.lit(1)).alias("trajectories"), F.count_distinct("agent").alias("agents"), F.count_if(F.col("label") == 1).alias("positive_trajectories"),
        F.sum("zero").cast("long").alias("step0_rows"), F.min("low").alias("min_step"), F.max("high").alias("max_step"), F.count_if(F.col("high") == 0).alias("zero_step_only"), F.percentile("high", F.lit(0.99)).alias("p99_max_step"),
    )


def completeness(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: non-null and non-zero counts and percentages. One pass; text that reads as no number counts as 0."""
    each = [F.struct(F.lit(c).alias("column"), F.count(c).alias("non_null"), F.count_if(number(F.col(c).cast("string")) != 0).alias("non_zero")) for c in columns]
    got = rows.agg(F.count(F.lit(1)).alias("rows"), F.array(*each).alias("c")).select("rows", F.explode("c").alias("c")).select("c.*", "rows")
    return got.withColumns({"non_null_pct": 100.0 * safe_div("non_null", "rows"), "non_zero_pct": 100.0 * safe_div("non_zero", "rows")})


def value_counts(rows: DataFrame, columns: list[str], top: int = 50) -> DataFrame:
    """The most frequent values of each column, nulls as '__NULL__'; counted before anything is ranked."""
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("__NULL__")).alias("value")) for c in columns])).alias("x")).select("x.*")
    c = each.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("rank", F.row_number().over(W.partitionBy("column").orderBy(F.desc("n"), "value"))).filter(F.col("rank") <= top)


def models_by_size(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("model_id").agg(F.count_distinct("traj_id").alias("trajectories")).orderBy(F.desc("trajectories"), "model_id")
