"""Adapter views: the engine's contracts over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scores(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Prefix scores of event sequences: traj_id, prefix_step_idx, agent, label, fold_id, p_success, p_failure; ``more``: other columns of the event."""
    # named before the window, so that it, the decision's windows and the last aggregation share one exchange
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "traj_id")
    head = lambda kinds, top: F.when(F.col("event_type").isin(*kinds), F.least(F.lit(1.0), F.col("value") / F.lit(top))).otherwise(0.0)
    order = W.partitionBy("traj_id").orderBy("ts", "event_id")
    return e.select(
        "traj_id",
        (F.row_number().over(order) - 1).cast("int").alias("prefix_step_idx"),
        (F.col("traj_id") % 5).cast("int").alias("agent"),
        (F.col("traj_id") % 2).cast("int").alias("label"),
        (F.col("traj_id") % 3).cast("int").alias("fold_id"),
        head(("purchase", "signup", "view"), 150.0).alias("p_success"),
        head(("error", "view"), 145.0).alias("p_failure"),
        *more,
    )


SCORES = """prefix_scores AS (
  SELECT user_id AS traj_id,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS prefix_step_idx,
         CAST(user_id % 5 AS INT) AS agent, CAST(user_id % 2 AS INT) AS label, CAST(user_id % 3 AS INT) AS fold_id,
         CASE WHEN event_type IN ('purchase','signup','view') THEN least(CAST(1.0 AS DOUBLE), value / CAST(150.0 AS DOUBLE)) ELSE CAST(0.0 AS DOUBLE) END AS p_success,
         CASE WHEN event_type IN ('error','view') THEN least(CAST(1.0 AS DOUBLE), value / CAST(145.0 AS DOUBLE)) ELSE CAST(0.0 AS DOUBLE) END AS p_failure
  FROM events)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns with their characters by component: traj_id, model_id, prefix_step_idx, task, action, feedback, thought, assistant."""
    c = table(spark, sf_dir, "conversations")
    chars = lambda role: F.when(F.col("role") == role, F.length("text")).otherwise(0).cast("long")
    return c.select(
        F.col("conv_id").alias("traj_id"),
        F.concat(F.lit("m"), (F.col("conv_id") % 4).cast("string")).alias("model_id"),
        F.col("turn").cast("int").alias("prefix_step_idx"),
        (F.lit(40) + F.col("conv_id") % 7).cast("long").alias("task_chars"),
        chars("assistant").alias("assistant_chars"),
        chars("user").alias("feedback_chars"),
        chars("system").alias("action_chars"),
        F.lit(0).cast("long").alias("thought_chars"),
    )


TURNS = """turns AS (
  SELECT conv_id AS traj_id, 'm' || CAST(conv_id % 4 AS VARCHAR) AS model_id, CAST(turn AS INT) AS prefix_step_idx,
         CAST(40 + conv_id % 7 AS BIGINT) AS task_chars,
         CAST(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END AS BIGINT) AS assistant_chars,
         CAST(CASE WHEN role = 'user' THEN length(text) ELSE 0 END AS BIGINT) AS feedback_chars,
         CAST(CASE WHEN role = 'system' THEN length(text) ELSE 0 END AS BIGINT) AS action_chars,
         CAST(0 AS BIGINT) AS thought_chars
  FROM conversations)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model and instance pairs for splits, from orders: traj_id, model_id, instance_id, n_steps, label."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("traj_id"),
        F.concat(F.lit("model"), (F.col("o_custkey") % 7).cast("string")).alias("model_id"),
        F.concat(F.lit("inst"), (F.col("o_orderkey") % 200).cast("string")).alias("instance_id"),
        (F.col("o_orderkey") % 13).cast("int").alias("n_steps"),
        (F.col("o_orderkey") % 2).cast("int").alias("label"),
    )


PAIRS = """pairs AS (
  SELECT o_orderkey AS traj_id, 'model' || CAST(o_custkey % 7 AS VARCHAR) AS model_id, 'inst' || CAST(o_orderkey % 200 AS VARCHAR) AS instance_id,
         CAST(o_orderkey % 13 AS INT) AS n_steps, CAST(o_orderkey % 2 AS INT) AS label FROM orders)"""
