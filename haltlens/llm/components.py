"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is an aggregation with map-side combine and an equi-join by sort and merge; the edges of a hub are never gathered in one place. Each
round is written to the shared folder, so that lineage stays short and a lost executor costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, merged, written


def _mark(edges: DataFrame) -> tuple[int, int, int]:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h % 1_000_000_007), F.sum(h.bitwiseXOR(F.col("u")) % 998_244_353)).first())


def _least(edges: DataFrame) -> DataFrame:
    return edges.join(merged(edges.groupBy("u").agg(F.min("v").alias("least"))), "u")


def components(edges: DataFrame, label: str) -> DataFrame:
    """``edges`` (u long, v long; no nulls) to (node, root): every node of an edge, with the smallest node it can reach."""
    pairs = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = written(pairs, f"{label}-edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.least("least", "u").alias("v")).filter("u <> v").distinct()
        small = _least(large)
        small = small.filter("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(small.select("u", F.col("least").alias("v"))).distinct()
        after = written(small, f"{label}-edges")
        dropped(now)
        now, last = after, mark
        mark = _mark(now)
        if mark == last:
            break
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
