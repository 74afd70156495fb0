"""Sides of joins that grow with the tables are not gathered by the driver, whatever Spark takes their size for."""

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from haltlens.llm import components, queries, simhash_dedup

DATA = "/root/testdata/sf0.001"


@pytest.fixture()
def told_small(spark):
    """All sides count as small."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def joins(df):
    """The kinds of joins that run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {k for k in ("BroadcastHashJoin", "BroadcastNestedLoopJoin", "SortMergeJoin") if k in plan}


def test_cells_of_fingerprints_are_merged(told_small):
    fps = told_small.range(200).select(F.xxhash64("id").alias("fp"))
    fps = fps.unionByName(fps.select(F.col("fp").bitwiseXOR(F.lit(5)).alias("fp")))
    assert joins(simhash_dedup.links(fps)) == {"SortMergeJoin"} and simhash_dedup.links(fps).distinct().count() == 200


def test_edges_are_merged(told_small):
    edges = told_small.range(1, 50).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    assert joins(components._least(edges)) == {"SortMergeJoin"}
    assert {tuple(r) for r in components.components(edges, "test").collect()} == {(i, 0) for i in range(50)}


def test_near_duplicates_are_merged(told_small):
    assert joins(queries.QUERIES["op10_simhash_dedup"](told_small, DATA)) == {"SortMergeJoin"}


def test_stages_merge_what_grows(told_small):
    """Of all that the pipeline runs, only groups of the quality rules (their estimates, and what leads to them) are sent to all."""
    shared, sc = told_small._jsparkSession.sharedState().statusStore(), told_small.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    before = shared.executionsList().size()
    assert corpus_pipeline.run(told_small, DATA).count() > 0
    sc.listenerBus().waitUntilEmpty()
    plans = shared.executionsList()
    plans = [plans.apply(i).physicalPlanDescription() for i in range(before, plans.size())]
    keys = {re.sub(r"#\d+L?", "", k) for p in plans for k in re.findall(r"BroadcastHashJoin.*\nLeft keys \[\d+\]: \[(.*)\]", p)}
    assert keys == {"grp", "lg", "pair", "grp, start"}
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastNestedLoopJoin" in p for p in plans)
