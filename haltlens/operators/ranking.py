"""Rank stability: competition and ordinal ranks, rank changes, Spearman's rho, preserved pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from haltlens.functions.scalars import not_nan, safe_div


def ranked(rows: DataFrame, by: tuple[str, ...], item: str, before: str, after: str, *, method: str = "min") -> DataFrame:
    """rank_before, rank_after, rank_change (positive is a rise); method 'min' shares ranks, 'first' breaks ties by item. NaN ranks last, as null."""
    r = rows.withColumns({before: not_nan(before), after: not_nan(after)})
    by_ = by or (F.lit(0),)
    if method == "min":
        rank = lambda c: F.rank().over(W.partitionBy(*by_).orderBy(F.desc_nulls_last(c)))
    else:
        rank = lambda c: F.row_number().over(W.partitionBy(*by_).orderBy(F.desc_nulls_last(c), item))
    return r.withColumns({"rank_before": rank(before), "rank_after": rank(after)}).withColumn("rank_change", F.col("rank_before") - F.col("rank_after"))


def stability(ranks: DataFrame, by: tuple[str, ...], item: str) -> DataFrame:
    """Spearman's rho (average ranks of ties), same top item, all ranks same, largest and mean shift."""
    avg = lambda c: F.rank().over(W.partitionBy(*by).orderBy(c)) + (F.count(F.lit(1)).over(W.partitionBy(*by, c)) - 1) / 2.0
    r = ranks.withColumns({"_a": avg("rank_before"), "_b": avg("rank_after")})
    shift = F.abs("rank_change")
    return r.groupBy(*by).agg(
        F.count(F.lit(1)).alias("items"),
        F.when(F.count(F.lit(1)) > 1, F.try_divide(F.covar_pop("_a", "_b"), F.stddev_pop("_a") * F.stddev_pop("_b"))).alias("spearman_rho"),
        (F.min_by(item, F.struct("rank_before", item)) == F.min_by(item, F.struct("rank_after", item))).alias("same_top"),
        F.bool_and(shift == 0).alias("same_ranks"),
        F.max(shift).alias("max_shift"),
        F.avg(shift).alias("mean_shift"),
    )


def pair_order(rows: DataFrame, by: tuple[str, ...], item: str, before: str, after: str) -> DataFrame:
    """Pairs of items that keep, or reverse, their order. Items are agents or models: tens in a group."""
    a, b = rows.alias("a"), rows.alias("b")
    on = F.col(f"a.{item}") < F.col(f"b.{item}")
    for k in by:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    x, y = F.signum(F.col(f"a.{before}") - F.col(f"b.{before}")), F.signum(F.col(f"a.{after}") - F.col(f"b.{after}"))
    g = a.join(b, on).select(*[F.col(f"a.{k}").alias(k) for k in by], x.alias("x"), y.alias("y")).filter("x <> 0 AND y <> 0").groupBy(*by)
    c = g.agg(F.count(F.lit(1)).alias("pair_comparable"), F.count_if(F.col("x") == F.col("y")).alias("pair_preserved"))
    return c.withColumns({"pair_reversed": F.col("pair_comparable") - F.col("pair_preserved"), "pair_preserve_rate": safe_div("pair_preserved", "pair_comparable", None)})
