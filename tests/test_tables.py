import json

import pytest
from pyspark.sql import functions as F

from haltlens.functions import scalars as X
from haltlens.operators import audit, metrics, ranking, select, splits, tokens
from haltlens.sources import tables


@pytest.mark.parametrize("kind", ["parquet", "csv", "tsv", "json", "jsonl"])
def test_round_trip(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a"), (2, "b,c\td"), (3, "é [x]"), (4, None), (5, "{")], "i int, s string").repartition(3)
    path = str(tmp_path / f"t.{kind}")
    want = sorted(((r.i, r.s) for r in df.collect()), key=repr)
    tables.write_table(df, path)
    assert sorted(((r.i, r.s) for r in tables.read_table(spark, path, df.schema).select("i", "s").collect()), key=repr) == want
    if kind == "json":
        (tmp_path / "own.json").write_text('[{"i": 1, "s": "a"},\n {"i": 2, "s": "b"}]')
        (tmp_path / "one.json").write_text('{\n"i": 1, "s": "a"}')
        assert [tables.read_table(spark, str(tmp_path / f)).count() for f in ("own.json", "one.json")] == [2, 1]


def test_rules_for_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "i int, s string")
    assert tables.present(df, ["s", "x"]).columns == ["s"]
    for bad in (lambda: tables.present(df, ["x"]), lambda: tables.required(df, ["x"]), lambda: tables.read_table(spark, "a.xyz"), lambda: tables.write_table(df, "a.xyz")):
        with pytest.raises(ValueError):
            bad()
    tables.write_json(str(tmp_path / "a/b.json"), {"b": 1, "a": [2]})
    assert tables.read_json(str(tmp_path / "a/b.json")) == {"b": 1, "a": [2]}
    assert "| 1 | a |" in tables.markdown(df.collect(), ["i", "s"])


def test_folds_and_files(spark, tmp_path):
    base = str(tmp_path / "runs")
    spark.range(9).withColumn("fold_id", F.col("id") % 3).write.partitionBy("fold_id").parquet(base)
    done = spark.createDataFrame([(0,), (1,)], "fold_id int")
    assert sorted({r.fold_id for r in tables.completed_folds(spark, base, done=done, excluded=[1]).collect()}) == [0]
    assert tables.remaining(spark.createDataFrame([(1,), (5,)], "fold_id int"), done, ["fold_id"]).collect()[0].fold_id == 5
    (tmp_path / "x.txt").write_text("one\ntwo lib.old\n")
    assert [(r.line, r.needle) for r in tables.scan_references(spark, str(tmp_path / "x.txt"), ["lib.old", "none"]).collect()] == [(2, "lib.old")]
    assert tables.files(spark, str(tmp_path), "*.txt").first().bytes == 16


def test_numbers(spark):
    df = spark.createDataFrame([(float("nan"), 0.0, "x", 2.5), (0.96, 2.0, "3", 3.5), (None, None, "inf", 0.5)], "s double, d double, t string, h double")
    r = df.select(X.at_least("s", 0.95).alias("hit"), X.safe_div(F.lit(1.0), "d").alias("q"), X.number("t").alias("n"), X.half_even("h", 0).alias("e"), X.isclose("s", "s").alias("same")).collect()
    assert [x.hit for x in r] == [False, True, False] and [x.q for x in r] == [0.0, 0.5, 0.0] and [x.n for x in r] == [0.0, 3.0, 0.0]
    assert [x.e for x in r] == [2.0, 4.0, 0.0] and all(x.same for x in r)


def test_texts(spark):
    df = spark.createDataFrame([("a&amp;b\x00", "a B c"), ("", " "), (None, "a b c")], "x string, y string")
    r = df.select(X.clean_text("x", 2).alias("c"), X.token_jaccard("y", F.lit("A b c")).alias("j"), X.nearly_equal("x", "y").alias("n"), X.joined_context("x", "y").alias("t"), X.method_severity("x").alias("v")).collect()
    assert [x.c for x in r] == ["a&\n[TRUNCATED]", "", ""] and [x.j for x in r] == [1.0, 0.0, 1.0] and [x.n for x in r] == [False, True, False]
    with pytest.raises(Exception):
        df.select(X.tokenizer_family("y", {"zzz": "z"})).collect()


def test_tokens(spark):
    steps = spark.createDataFrame([(1, "m", i, 8, 4 * n, 0, 0, 0) for i, n in enumerate((1, 2, 3))], "traj_id long, model_id string, prefix_step_idx int, task_chars long, action_chars long, feedback_chars long, assistant_chars long, thought_chars long")
    t = tokens.prefix_tokens(tokens.component_tokens(steps)).orderBy("prefix_step_idx").collect()
    assert [r.context_tokens for r in t] == [4, 7, 11] and [r.future_context_saved for r in t] == [18, 11, 0] and t[0].baseline_context == 22
    text = spark.createDataFrame([("x " * 50,), (None,), ("a b",)], "s string")
    assert [r[0] for r in text.select(tokens.count_tokens("s", lambda: lambda t: len(t.split()), direct=10, chunk=20, exact=200)).collect()] == [50, 0, 2]
    assert text.select(tokens.count_tokens("s", lambda: lambda t: len(t.split()), direct=10, chunk=20, exact=50, sample=10)).first()[0] == 50
    with pytest.raises(Exception):
        tokens.attach(spark.createDataFrame([(9,)], "traj_id long"), steps.select("traj_id"), ("traj_id",)).collect()
    a, b = (tokens.cache_meta(steps.orderBy(F.desc("prefix_step_idx") if i else "prefix_step_idx")).first() for i in (0, 1))
    assert a == b and a.ids == 1


def test_ranks(spark):
    r = spark.createDataFrame([(0, "a", 50.0, 1.0), (0, "b", 50.0, 3.0), (0, "c", 40.0, float("nan"))], "g int, item string, x double, y double")
    low = {x.item: (x.rank_before, x.rank_after) for x in ranking.ranked(r, ("g",), "item", "x", "y").collect()}
    assert low == {"a": (1, 2), "b": (1, 1), "c": (3, 3)}
    assert {x.item: x.rank_before for x in ranking.ranked(r, (), "item", "x", "y", method="first").collect()} == {"a": 1, "b": 2, "c": 3}
    one = ranking.ranked(r.filter("item = 'a'"), ("g",), "item", "x", "y")
    assert ranking.stability(one, ("g",), "item").first().spearman_rho is None


def test_splits_and_selection(spark):
    p = spark.createDataFrame([(i, f"m{i % 4}", f"i{i % 9}", 5, i % 2) for i in range(60)], "traj_id long, model_id string, instance_id string, n_steps int, label int")
    s = splits.leave_one_model(p)
    assert s.filter("split = 'test' AND model_id <> test_model").count() == 0 and splits.leakage(s, ("test_model",)).filter("not ok").count() == 0
    h = splits.holdout_plan(p, test_ratio=0.25)
    assert h.filter("split = 'test'").select("model_id").distinct().count() == 1 and splits.shared_groups(h.filter("split <> 'test'"), "instance_id").count() == 0
    assert splits.sample_exact(p, "traj_id", 7, 1).count() == 7
    grid = spark.createDataFrame([(0, 0, 90.0, 5.0, 1.0), (0, 1, 90.0, 5.0, 1.0), (0, 2, None, 0.0, 0.0)], "fold_id int, candidate_ord long, decision_accuracy_pct double, pct_steps_saved double, resolve_rate_drop_pp double")
    t = spark.createDataFrame([(0.85,), (0.99,)], "target double")
    got = {r.target: (r.candidate_ord, r.selection_status) for r in select.select_policy(grid, t).collect()}
    assert got == {0.85: (0, "strict"), 0.99: (0, "fallback_highest_accuracy")}
    assert audit.value_counts(p.withColumn("n", F.lit(None).cast("int")), ["n"]).first().value == "__NULL__"
    with pytest.raises(Exception):
        metrics.single_value(p, ("model_id",), "instance_id").collect()


def test_records_of_any_shape(spark, tmp_path):
    shapes = {"a.json": '[{"x": 1}, {"x": 2}]', "b.json": '{"records": [{"x": 3}], "n": 1}', "c.json": '{"x": 4}', "d.jsonl": '{"x": 5}\n\n{"x": 6}\n'}
    for name, text in shapes.items():
        (tmp_path / name).write_text(text)
    got = [[json.loads(r.record)["x"] for r in tables.records(spark, str(tmp_path / name)).collect()] for name in shapes]
    assert got == [[1, 2], [3], [4], [5, 6]]


def test_settings(tmp_path):
    (tmp_path / "a.yaml").write_text("paths:\n  runs: out/runs\n  raw: /raw\ntargets: [0.9]\n")
    pytest.importorskip("yaml")
    c = tables.config(str(tmp_path / "a.yaml"))
    assert c == {"paths": {"runs": str(tmp_path / "out/runs"), "raw": "/raw"}, "targets": [0.9]}
    assert [X.flag(x) for x in (None, " ", "Yes", "0", "on")] == [False, False, True, False, True] and X.flag(None, True)


def test_peek_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([("a", None)], "x string, y string")
    assert (tables.peek(df, "x"), tables.peek(df, "y", "d"), tables.peek(df, "z", "d")) == ("a", "d", "d")
    (tmp_path / "big.bin").write_bytes(b"x" * 100)
    (tmp_path / "small.bin").write_bytes(b"x")
    assert {r.bytes: r.sha256 is None for r in tables.files(spark, str(tmp_path), most=50).collect()} == {100: True, 1: False}
    with pytest.raises(ValueError):
        tables.read_folds(spark, str(tmp_path), ["summary"])


def test_stages_go_on_where_they_ended(spark, tmp_path):
    from haltlens.plans import stages
    from haltlens.sources import adapters

    s, run = adapters.scores(spark, "/root/testdata/sf0.001"), str(tmp_path / "run")
    assert stages.run_stages(spark, s, run, targets=[0.6], last="splits") == ["plan", "audit", "splits"]
    assert stages.run_stages(spark, s, run, targets=[0.6]) == ["sweep", "summary"] and stages.run_stages(spark, s, run, targets=[0.6]) == []
    assert tables.read_table(spark, f"{run}/summary/summary.parquet").first().folds == 3
    with pytest.raises(ValueError):
        stages.run_stages(spark, s, run, targets=[0.6], last="none")


def test_token_modes(spark):
    steps = spark.createDataFrame([(1, "m", i, "a b", 3, 0, 0, 0, 0) for i in range(3)], "traj_id long, model_id string, prefix_step_idx int, text string, task_chars long, action_chars long, feedback_chars long, assistant_chars long, thought_chars long")
    words = lambda: lambda t: len(t.split())
    assert sorted(r.context_tokens for r in tokens.token_rows(steps, "model", words).collect()) == [2, 4, 6]
    assert sorted(r.context_tokens for r in tokens.token_rows(steps.withColumn("task_text", F.lit("x y z")), "component_sum_approx", words).collect()) == [3, 3, 3]
    with pytest.raises(ValueError):
        tokens.token_rows(steps, "model")


def test_splits_in_one_pass(spark, tmp_path):
    from haltlens.operators import splits

    spark.range(100).selectExpr("id AS traj_id", "id % 7 AS n", "'x' AS text").write.parquet(str(tmp_path / "rows"))
    spark.range(90).selectExpr("id AS traj_id", "CASE WHEN id < 60 THEN 'train' WHEN id < 75 THEN 'valid' ELSE 'test' END AS split").write.parquet(str(tmp_path / "plan"))
    rows, plan = spark.read.parquet(str(tmp_path / "rows")), spark.read.parquet(str(tmp_path / "plan"))
    path = splits.materialised(rows, plan, ("traj_id",), str(tmp_path / "out"))
    assert {s: splits.read_split(spark, path, s).count() for s in ("train", "valid", "test", "none")} == {"train": 60, "valid": 15, "test": 15, "none": 0}
    scan = splits.read_split(spark, path, "test", ("n",))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in scan and "ReadSchema: struct<n:bigint>" in scan and scan.count("FileScan") == 1
    before = sorted(p.name for p in (tmp_path / "out").rglob("*.parquet"))
    assert splits.materialised(rows.limit(0), plan, ("traj_id",), path) == path and sorted(p.name for p in (tmp_path / "out").rglob("*.parquet")) == before
    assert splits.first_rows(spark, path, "valid", 3).count() == 3
    told = rows.drop("split").join(plan.select("traj_id", "split"), ["traj_id"])._jdf.queryExecution().executedPlan().toString()
    assert told.count("FileScan") == 2  # the rows once, the plan once
