"""The token cache: what changed is counted anew, all else is not, and shards can be put together."""

import random

import pytest
from pyspark.sql import functions as F

from haltlens.operators import tokens


def test_cache_follows_content(spark, tmp_path):
    rows = [(t, "m", i, f"text {t} {i}") for t in range(6) for i in range(3)]
    steps = spark.createDataFrame(rows, "traj_id long, model_id string, prefix_step_idx int, text string")
    calls = []

    def count(df):
        calls.append(sorted(r[0] for r in df.select("traj_id").distinct().collect()))
        return df.select("traj_id", "model_id", "prefix_step_idx", F.length("text").cast("long").alias("context_tokens"))

    path, settings = str(tmp_path / "cache"), {"a": 1}
    same = lambda df: sorted((r.traj_id, r.prefix_step_idx, r.context_tokens) for r in tokens.cached(spark, path, df, count, settings).collect())
    want = lambda df: sorted((r.traj_id, r.prefix_step_idx, len(r.text)) for r in df.collect())
    assert same(steps.filter("traj_id < 4")) == want(steps.filter("traj_id < 4"))
    edited = steps.withColumn("text", F.when((F.col("traj_id") == 2) & (F.col("prefix_step_idx") == 1), "another text").otherwise(F.col("text")))
    assert same(edited) == want(edited)
    assert same(edited.orderBy(F.desc("text"))) == want(edited)  # order does not matter
    assert same(steps) == want(steps)  # counts of the first text are still there
    assert calls == [[0, 1, 2, 3], [2, 4, 5], [], []]
    assert tokens.compacted(spark, path, steps, settings) == 4 and same(steps) == want(steps) and calls[-1] == []
    assert tokens.compacted(spark, path, steps, {"other": 2}) == 0


def test_digest_is_free_of_order_and_sees_nulls(spark):
    digest = lambda rows: [r.digest for r in tokens.content_digest(spark.createDataFrame(rows, "traj_id long, a string, b string")).collect()]
    assert digest([(1, "x", None), (1, "y", "z")]) == digest([(1, "y", "z"), (1, "x", None)])
    assert len({digest(x)[0] for x in ([(1, "x", None)], [(1, None, "x")], [(1, "x", "")], [(1, "x", None), (1, "x", None)], [(1, "x", None)] * 3)}) == 5


PRETOKENS = r"[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"


def _counter(kind):
    if kind == "words":
        return lambda: lambda t: len(t.split())

    def make():
        import regex

        p = regex.compile(PRETOKENS)
        return lambda t: sum(1 + len(m.group().encode()) // 4 for m in p.finditer(t))

    return make


@pytest.mark.parametrize("kind, border", [("words", r"(?=\s)"), ("pieces", r"(?<=\p{L})(?=\s\p{L})")])
def test_incremental_counts_equal_whole_prefixes(spark, kind, border):
    """Steps without a border, empty and null ones, astral letters, white space at both ends."""
    rng = random.Random(8)
    bits = ["a", "bc", " ", "  ", "\n", "12", "!?", "\U00010400\U00010401", "\u4e2d\u6587", "\t", " word", " \n x", "\r\n", "\U0001f600"]
    rows = []
    for t in range(60):
        for i in range(rng.randint(1, 12)):
            text = rng.choice([None, "", "ok", "!!", "".join(rng.choice(bits) for _ in range(rng.randint(1, 3))), "".join(rng.choice(bits) for _ in range(rng.randint(1, 40)))])
            rows.append((t, "m", i, text))
    steps = spark.createDataFrame(rows, "traj_id long, model_id string, prefix_step_idx int, text string").repartition(5)
    told = lambda df: sorted(map(tuple, df.collect()))
    whole = told(tokens.full_prefix_tokens(steps, _counter(kind)))
    assert told(tokens.incremental_prefix_tokens(steps, _counter(kind), border=border)) == whole
    assert len({r[3] for r in whole}) > 20


def test_incremental_work_is_linear(spark):
    """Characters handed to the counter: at most three times the text; texts are exchanged once, numbers once."""
    steps = spark.createDataFrame([(1, "m", i, "some words of a step " * 5) for i in range(200)], "traj_id long, model_id string, prefix_step_idx int, text string")
    p = tokens.incremental_pieces(steps, border=r"(?=\s)")
    n = p.agg(*[F.sum(F.length(c)) for c in ("_open", "_settled", "_closed")]).first()
    assert sum(n) < 3 * 200 * 105
    plan = tokens.incremental_prefix_tokens(steps, _counter("words"), border=r"(?=\s)")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("ArrowEvalPython") == 1
