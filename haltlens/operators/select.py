"""Choosing a policy on validation results: tiers, then sort keys, then the order of generation; one window per fold and target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What a selection may use besides the target: largest drop of the strict tier, savings the fallback needs, precision of success decisions.
VARIANTS = ("drop_capped", "two_tier", "tie_broken", "guarded")


def select_policy(grid: DataFrame, targets: DataFrame, *, by: tuple[str, ...] = ("fold_id",), variant: str = "drop_capped", max_abs_drop_pp: float | None = None, min_save_pct: float = 0.0, guard_pct: float | None = None) -> DataFrame:
    """The chosen row of ``grid`` (accuracy, saved steps and drop in percent, candidate_ord) per group and target, with selection_status.

    Strict: accuracy reaches the target, something is saved, and the drop is within its cap. Fallback: accuracy alone, saving at least
    ``min_save_pct`` (drop_capped and guarded). Else the highest accuracy among those that save, or among all.
    """
    acc, drop, save = F.coalesce("decision_accuracy_pct", F.lit(-100.0)) / 100.0, F.abs("resolve_rate_drop_pp"), F.coalesce("pct_steps_saved", F.lit(0.0))
    w = grid.crossJoin(F.broadcast(targets.select("target"))).withColumns({"_acc": acc, "_drop": drop, "_save": save})
    ok = F.col("_acc") >= F.col("target")
    if variant == "guarded":
        ok = ok & (F.coalesce("precision_success_pct", F.lit(0.0)) >= F.lit(guard_pct if guard_pct is not None else 0.0))
    strict = ok & (F.col("_save") > 0)
    if variant == "drop_capped" and max_abs_drop_pp is not None:
        strict = strict & (F.col("_drop") <= max_abs_drop_pp)
    middle = ok & (F.col("_save") >= min_save_pct) if variant in ("drop_capped", "guarded") else F.lit(False)
    tier = F.when(strict, 0).when(middle, 1).when(F.col("_save") > 0, 2).otherwise(3)
    w = w.withColumn("_tier", tier)
    good = F.col("_tier") < 2
    keys: list[Column] = [F.col("_tier"), F.when(good, -F.col("_save")).otherwise(-F.col("_acc")), F.col("_drop"), F.when(good, -F.col("_acc")).otherwise(-F.col("_save"))]
    if variant == "tie_broken":
        keys += [F.abs(F.col("success_thr") - F.col("failure_thr")), -F.col("success_thr"), -F.col("failure_thr")]
    chosen = w.withColumn("_rank", F.row_number().over(W.partitionBy(*by, "target").orderBy(*keys, "candidate_ord"))).filter("_rank = 1")
    status = F.when(F.col("_tier") == 0, "strict").when(F.col("_tier") == 1, "fallback_accuracy_only").otherwise("fallback_highest_accuracy")
    return chosen.withColumn("selection_status", status).drop("_acc", "_drop", "_save", "_tier", "_rank")


def first_per(rows: DataFrame, keys: tuple[str, ...], *order: Column | str, n: int = 1) -> DataFrame:
    return rows.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") <= n).drop("_rank")


def diverse_top(rows: DataFrame, group: str, n: int, *order: Column, key: str = "traj_id") -> DataFrame:
    """The best of each group first, then whatever is best, n in all. Only a best row of each group and the first n of all leave their tasks."""
    best = first_per(rows, (group,), *order)
    rest = rows.orderBy(*order).limit(n).join(best.select(key), key, "left_anti")
    both = best.withColumn("_later", F.lit(False)).unionByName(rest.withColumn("_later", F.lit(True)))
    return both.orderBy("_later", *order).limit(n).drop("_later")


def eligible_folds(pairs: DataFrame, *, min_trajectories: int, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Models with their trajectories, whether they make a fold, and why not."""
    c = pairs.groupBy("model_id").agg(F.count_distinct("traj_id").alias("trajectories"))
    reason = F.when(F.col("model_id").isin(*excluded) if excluded else F.lit(False), "excluded").when(F.col("trajectories") < min_trajectories, "too_few_trajectories").otherwise("eligible")
    return c.withColumn("reason", reason).withColumn("eligible", F.col("reason") == "eligible")
