"""Plans that hold at size: what grows with the tables is not gathered by the driver, nor computed again for each pass."""

from haltlens.operators import policy
from haltlens.plans import catalog, stages
from haltlens.sources import adapters, tables

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_versions_are_joined_without_a_broadcast(spark):
    got = _plan(catalog.QUERIES["repaired_tree"](spark, SF))
    assert "SortMergeJoin [o_orderkey" in got


def test_what_a_fold_learns_from_is_made_once(spark):
    got = _plan(catalog.QUERIES["model_fold"](spark, SF))
    assert "Window" not in got and "/examples-" in got


def test_stored_scores_move_before_they_meet_the_policies(spark):
    kept = tables.kept(stages.with_part(adapters.scores(spark, SF)), "scores")
    targets = spark.createDataFrame([(0.55,)], "target double")
    plan = _plan(stages.sweep(stages.by_trajectory(kept), catalog._candidates(spark), targets, max_abs_drop_pp=5.0, min_save_pct=10.0)[1])
    assert "Exchange hashpartitioning(traj_id" in plan and "candidate_ord" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning(traj_id" in x)
    assert policy.MANY >= 16  # these are replayed


def test_policies_are_replayed_once(spark):
    got = _plan(catalog.QUERIES["model_run"](spark, SF))
    assert "/counts-" in got and "/scored-" not in got and "Window [min" not in got


def test_runs_are_parsed_in_as_many_tasks_as_are_set(spark):
    got = _plan(catalog.QUERIES["parse_layouts"](spark, SF))
    by = [x for x in got.splitlines() if "Exchange hashpartitioning" in x]
    assert len(by) == 2 and all("REPARTITION_BY_NUM" in x for x in by)
