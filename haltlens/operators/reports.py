"""Report tables: order by a list, leading columns, templates, totals, timings, and the index of splits."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haltlens.functions.scalars import pct, safe_div


def position(column: str, order: Iterable[str]) -> Column:
    """A value's place in a list; what the list has not comes after it."""
    values = list(order)
    place = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column))
    return F.when(place > 0, place).otherwise(len(values) + 1).cast("int")


def in_order(rows: DataFrame, column: str, order: Iterable[str], *then: str) -> DataFrame:
    """Rows in the order of a list, unlisted values last by name."""
    return rows.orderBy(position(column, order), column, *then)


def with_meta(rows: DataFrame, **meta) -> DataFrame:
    """Constant columns first, then those of the rows that have not these names."""
    return rows.select(*[F.lit(v).alias(k) for k, v in meta.items()], *[F.col(f"`{c}`") for c in rows.columns if c not in meta])


def display(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The columns to show, of those that exist, under their headings."""
    return rows.select(*[F.col(f"`{c}`").alias(h) for c, h in columns.items() if c in rows.columns])


def template(rows: DataFrame, keys: tuple[str, ...], **blank: str) -> DataFrame:
    """One row for each different key, with empty columns of given types to be filled in."""
    return rows.select(*keys).distinct().select(*keys, *[F.lit(None).cast(t).alias(c) for c, t in blank.items()])


def with_total(rows: DataFrame, by: str, name: str, sums: Iterable[str]) -> DataFrame:
    """Rows and one that sums them up (distinct counts of the rows are added as they are)."""
    sums = list(sums)
    return rows.select(by, *sums).unionByName(rows.agg(*[F.sum(c).cast(rows.schema[c].dataType).alias(c) for c in sums]).select(F.lit(name).alias(by), *sums))


def normalised_summary(rows: DataFrame, shares: Iterable[str]) -> DataFrame:
    """Percent columns from shares where there are none, and the change of the resolve rate made anew from the counts."""
    add = {f"{c}_pct": 100.0 * F.col(c) for c in shares if c in rows.columns and f"{c}_pct" not in rows.columns}
    return rows.withColumns(add | {"resolve_rate_change_pp": 100.0 * safe_div(F.col("false_positives") - F.col("false_negatives"), "original_total", None)})


def at_threshold(rows: DataFrame, column: str, value: float) -> DataFrame:
    """Rows whose threshold is a number, but for rounding."""
    return rows.filter(F.abs(F.col(column) - value) < 1e-8)


def split_index(summary: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Folds of split summaries in one row: how many, whether all are sound, means of rows."""
    return summary.groupBy(*by).agg(F.count_distinct("test_model").alias("folds"), F.bool_and("ok").alias("all_ok"), F.avg(F.col("rows").cast("double")).alias("mean_rows"), F.sum("rows").cast("long").alias("rows"))


def timings(rows: DataFrame, seconds: str, work: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean, median, 95th percentile and throughput of measured times."""
    s = F.col(seconds)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("repeats"), (1000 * F.avg(s)).alias("mean_ms"), (1000 * F.percentile(s, F.lit(0.5))).alias("median_ms"), (1000 * F.percentile(s, F.lit(0.95))).alias("p95_ms"), safe_div(F.sum(work), F.sum(s), None).alias("per_second"))


def timed(spark: SparkSession, do: Callable[[], DataFrame], repeats: int = 5) -> DataFrame:
    """A plan run some times over, its rows counted: seconds and rows of each run."""
    seen = []
    for _ in range(repeats):
        began = time.perf_counter()
        n = do().count()
        seen.append((time.perf_counter() - began, n))
    return spark.createDataFrame(seen, "seconds double, rows long")


def coverage(rows: DataFrame, by: str) -> DataFrame:
    """Decided share of each group, in percent."""
    return rows.groupBy(by).agg(pct(F.count_if("decided"), F.count(F.lit(1))).alias("coverage_pct"))
