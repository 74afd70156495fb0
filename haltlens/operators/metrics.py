"""Counts and rates over decisions. Counts add up, so that every level (agent, fold, all) is one aggregation with map-side combine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haltlens.functions.scalars import pct, safe_div

COUNTS = ("original_total", "original_resolved", "true_positives", "false_positives", "true_negatives", "false_negatives", "decided_success", "decided_failure", "undecided", "total_saved_steps", "total_steps")


def counters() -> list[Column]:
    """Confusion, coverage and savings counters of decision rows."""
    d, y = F.col("decision"), F.col("label") == 1
    return [
        F.count(F.lit(1)).alias("original_total"),
        F.count_if(y).alias("original_resolved"),
        F.count_if((d == "success") & y).alias("true_positives"),
        F.count_if((d == "success") & ~y).alias("false_positives"),
        F.count_if((d == "failure") & ~y).alias("true_negatives"),
        F.count_if((d == "failure") & y).alias("false_negatives"),
        F.count_if(d == "success").alias("decided_success"),
        F.count_if(d == "failure").alias("decided_failure"),
        F.count_if(d == "undecided").alias("undecided"),
        F.sum("saved_steps").cast("long").alias("total_saved_steps"),
        F.sum("n_steps").cast("long").alias("total_steps"),
    ]


def with_rates(counts: DataFrame, *, percent: bool = True, empty: float | None = None) -> DataFrame:
    """Derived rates; ``empty`` is what a rate with a zero denominator reads (null by default)."""
    scale = 100.0 if percent else 1.0
    rate = lambda n, d: safe_div(scale * F.col(n), d, empty)
    tag = "_pct" if percent else ""
    c = counts.withColumns({"n_decided": F.col("decided_success") + F.col("decided_failure"), "adjusted_resolved": F.col("original_resolved") - F.col("false_negatives") + F.col("false_positives"), "_right": F.col("true_positives") + F.col("true_negatives")})
    return c.withColumns({
        f"coverage{tag}": rate("n_decided", "original_total"),
        f"decision_accuracy{tag}": rate("_right", "n_decided"),
        f"precision_success{tag}": rate("true_positives", "decided_success"),
        f"precision_failure{tag}": rate("true_negatives", "decided_failure"),
        "original_resolve_rate": safe_div("original_resolved", "original_total"),
        "adjusted_resolve_rate": safe_div("adjusted_resolved", "original_total"),
        f"resolve_rate_drop{'_pp' * percent}": scale * safe_div(F.col("false_negatives") - F.col("false_positives"), "original_total"),
        f"resolve_rate_change{'_pp' * percent}": scale * safe_div(F.col("false_positives") - F.col("false_negatives"), "original_total"),
        f"{'pct_' * percent}steps_saved": rate("total_saved_steps", "total_steps"),
    }).drop("_right")


def summarize(decisions: DataFrame, by: tuple[str, ...] = (), **rates) -> DataFrame:
    return with_rates(decisions.groupBy(*by).agg(*counters()), **rates)


def rollup(decisions: DataFrame, by: str = "agent") -> DataFrame:
    """One row per value and one for all of them ('ALL'), from one aggregation."""
    c = decisions.rollup(by).agg(F.grouping(by).alias("_all"), *counters())
    return with_rates(c.withColumn(by, F.when(F.col("_all") == 1, "ALL").otherwise(F.col(by).cast("string"))).drop("_all"))


def originals(scores: DataFrame, by: str = "agent") -> DataFrame:
    """Full-run baseline: the last step's label of each trajectory, counted per agent."""
    last = scores.groupBy("traj_id").agg(F.max_by("label", "prefix_step_idx").alias("label"), F.max_by(by, "prefix_step_idx").alias(by))
    return last.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.sum("label").cast("long").alias("resolved"), F.avg(F.col("label").cast("double")).alias("resolve_rate"))


def agent_quality(decisions: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Precision, recall and F1 of both directions, times 100; null where undefined."""
    c = decisions.groupBy(*by).agg(*counters())
    f1 = lambda p, r: F.when(p + r > 0, 2 * p * r / (p + r))
    tp, fp, tn, fn = (F.col(x) for x in ("true_positives", "false_positives", "true_negatives", "false_negatives"))
    c = c.withColumns({"success_precision": pct(tp, tp + fp), "success_recall": pct(tp, "original_resolved"), "failure_precision": pct(tn, tn + fn), "failure_recall": pct(tn, F.col("original_total") - F.col("original_resolved"))})
    return c.withColumns({"success_f1": f1(F.col("success_precision"), F.col("success_recall")), "failure_f1": f1(F.col("failure_precision"), F.col("failure_recall"))})


def over_folds(rows: DataFrame, by: tuple[str, ...] = (), fold: str = "fold_id", empty: float = 0.0) -> DataFrame:
    """Fold rows (with counters) to one row: sums, count-weighted rates, weighted and plain mean of the absolute change."""
    change = 100.0 * safe_div(F.col("false_positives") - F.col("false_negatives"), "original_total", None)
    got = rows.withColumn("_x", F.abs(change)).groupBy(*by).agg(
        F.count_distinct(fold).alias("folds"),
        *[F.sum(c).cast("long").alias(c) for c in COUNTS],
        safe_div(F.sum(F.col("_x") * F.col("original_total")), F.sum("original_total")).alias("mean_abs_change_pp"),
        F.avg("_x").alias("plain_mean_abs_change_pp"),
    )
    return with_rates(got, empty=empty)


def mean_abs_from_parts(parts: DataFrame, by: tuple[str, ...], value: str, weight: str) -> DataFrame:
    """Weighted mean of absolute values; the plain mean where the weights sum to 0."""
    v, w = F.abs(F.col(value)), F.col(weight)
    return parts.groupBy(*by).agg(F.when(F.sum(w) > 0, F.sum(v * w) / F.sum(w)).otherwise(F.avg(v)).alias("mean_abs"))


def shifts(rows: DataFrame, by: tuple[str, ...], value: str) -> DataFrame:
    v = F.col(value)
    return rows.groupBy(*by).agg(F.avg(v).alias("mean_shift"), F.avg(F.abs(v)).alias("mean_abs_shift"), F.max(F.abs(v)).alias("max_abs_shift"))


def threshold_summary(selected: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Least, median and largest selected thresholds and how often both heads have the same."""
    out = []
    for c in ("success_thr", "failure_thr"):
        out += [F.min(c).alias(f"min_{c}"), F.percentile(c, F.lit(0.5)).alias(f"median_{c}"), F.max(c).alias(f"max_{c}")]
    return selected.groupBy(*by).agg(F.count(F.lit(1)).alias("folds"), *out, F.count_if(F.round("success_thr", 10) == F.round("failure_thr", 10)).alias("same_threshold"))


def single_value(rows: DataFrame, by: tuple[str, ...], column: str) -> DataFrame:
    """The one value of a column in each group; raises if there are several."""
    one = F.when(F.count_distinct(column) <= 1, F.any_value(column)).otherwise(F.raise_error(F.lit(f"{column} varies within a group")))
    return rows.groupBy(*by).agg(one.alias(column))


def repaired(rows: DataFrame) -> DataFrame:
    """Metrics recomputed from counters; ``changed`` says where stored values differed."""
    from haltlens.functions.scalars import isclose

    adjusted = F.col("original_resolved") - F.col("false_negatives") + F.col("false_positives")
    rate = safe_div(adjusted, "original_total")
    drop = 100.0 * (safe_div("original_resolved", "original_total") - rate)
    same = isclose(F.col("adjusted_resolved"), adjusted) & isclose(F.col("adjusted_resolve_rate"), rate) & isclose(F.col("resolve_rate_drop_pp"), drop)
    return rows.withColumn("changed", ~same).withColumns({"adjusted_resolved": adjusted, "adjusted_resolve_rate": rate, "resolve_rate_drop_pp": drop})


def signal_lift(rows: DataFrame, signals: list[str]) -> DataFrame:
    """For each boolean signal of at-risk rows: how often a stop follows, against the base rate. Rows: signals, stops, decision."""
    each = rows.select("traj_id", "stops", "decision", F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.coalesce(F.col(s), F.lit(False)).alias("on")) for s in signals])).alias("x")).select("traj_id", "stops", "decision", "x.*")
    g = each.groupBy("signal").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("on").alias("signal_rows"), F.count_if("stops").alias("stop_rows"),
        F.count_if(F.col("on") & F.col("stops")).alias("signal_stops"), F.count_if(F.col("on") & F.col("stops") & (F.col("decision") == "success")).alias("signal_success"),
        F.count_distinct(F.when(F.col("on"), F.col("traj_id"))).alias("signal_trajectories"),
    )
    p, base = safe_div("signal_stops", "signal_rows", None), safe_div("stop_rows", "rows", None)
    return g.withColumns({"p_stop": p, "base_p_stop": base, "lift": F.try_divide(p, base), "share_of_stops": safe_div("signal_stops", "stop_rows", None)})


def at_risk(scores: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows up to and including the decision (all rows of undecided trajectories), and whether the stop is on the row."""
    d = decisions.select("traj_id", "decided", "decision", "decision_step")
    j = scores.join(d, "traj_id").filter(~F.col("decided") | (F.col("prefix_step_idx") <= F.col("decision_step")))
    return j.withColumn("stops", F.col("decided") & (F.col("prefix_step_idx") == F.col("decision_step")))


def audit_decisions(decisions: DataFrame, stored: DataFrame, by: str) -> DataFrame:
    """Recomputed counters beside stored ones, and whether all agree."""
    names = [c for c in COUNTS if c in stored.columns]
    now = decisions.groupBy(by).agg(*counters())
    j = now.join(stored.select(by, *[F.col(c).alias(f"stored_{c}") for c in names]), by, "full_outer")
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"stored_{c}"))
    return j.select(by, *names, same.alias("agrees"))
