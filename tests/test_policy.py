import math
import random

import pytest

from haltlens.operators import metrics, policy

NAN = float("nan")
INF = float("inf")
#: name: steps (index: success, failure), rule, decision, step
CASES = {
    "first hit": ({0: (0.1, 0.1), 1: (0.96, 0.2), 2: (0.99, 0.1)}, {}, "success", 1),
    "failure at once": ({0: (0.1, 0.97)}, {}, "failure", 0),
    "larger margin": ({0: (0.96, 0.98)}, {}, "failure", 0),
    "tie is success": ({0: (0.97, 0.97)}, {}, "success", 0),
    "none": ({0: (0.5, 0.5), 1: (0.6, 0.4)}, {}, "undecided", -1),
    "inclusive": ({0: (0.95, 0.0)}, {}, "success", 0),
    "NaN never hits": ({0: (NAN, 0.1), 1: (0.96, 0.1)}, {}, "success", 1),
    "gaps": ({0: (0.1, 0.1), 5: (0.96, 0.1), 9: (0.1, 0.1)}, {}, "success", 5),
    "a miss resets": ({0: (0.96, 0.1), 1: (0.1, 0.1), 2: (0.97, 0.1), 3: (0.98, 0.1)}, {"consecutive": 2}, "success", 3),
    "a turn resets": ({0: (0.99, 0.96), 1: (0.96, 0.99)}, {"consecutive": 2}, "undecided", -1),
    "own runs": ({0: (0.99, 0.96), 1: (0.96, 0.99)}, {"consecutive": 2, "streak": "independent"}, "failure", 1),
    "first step": ({0: (0.99, 0.1), 1: (0.1, 0.1), 2: (0.1, 0.96)}, {"min_step": 2}, "failure", 2),
    "one head": ({0: (0.1, 0.99), 1: (0.96, 0.99)}, {"mode": "success_only", "failure_thr": INF}, "success", 1),
    "abstain": ({0: (0.97, 0.99), 1: (0.96, 0.1)}, {"conflict": "abstain"}, "success", 1),
    "opposite": ({0: (0.96, 0.6), 1: (0.97, 0.4)}, {"opposite_max": 0.5}, "success", 1),
    "complement": ({0: (0.95, 0.2), 1: (0.95, 0.05)}, {"success_thr": 0.9, "failure_thr": 0.9, "complement": True}, "success", 1),
}


def frame(spark, steps_by_traj):
    rows = [(t, i, 0, t % 2, float(s), float(f)) for t, steps in steps_by_traj.items() for i, (s, f) in steps.items()]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "traj_id long, prefix_step_idx int, agent int, label int, p_success double, p_failure double")


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    steps, rule, decision, step = CASES[name]
    r = policy.decide(frame(spark, {1: steps}), **{"success_thr": 0.95, "failure_thr": 0.95} | rule).first()
    assert (r.decision, r.decision_step) == (decision, step)
    if decision == "undecided":
        assert r.decision_score is None and r.saved_steps == 0


def test_saved_steps(spark):
    steps, *_ = CASES["gaps"]
    assert [policy.decide(frame(spark, {1: steps}), success_thr=0.95, failure_thr=0.95, saved=s).first().saved_steps for s in ("after", "indexed")] == [1, 0]


def scan(steps, ts, tf, min_step, k, independent):
    last = streak = rs = rf = 0
    for i in sorted(steps):
        s, f = steps[i]
        if i < min_step:
            continue
        hs, hf = not math.isnan(s) and s >= ts, not math.isnan(f) and f >= tf
        rs, rf = (rs + 1) * hs, (rf + 1) * hf
        margin = "success" if s - ts >= f - tf else "failure"
        if independent:
            if rs >= k or rf >= k:
                return (margin if rs >= k and rf >= k else "success" if rs >= k else "failure"), i
            continue
        d = margin if hs and hf else "success" if hs else "failure" if hf else None
        streak = streak + 1 if d and d == last else int(d is not None)
        last = d
        if d and streak >= k:
            return d, i
    return "undecided", -1


def random_steps(rng, n=120):
    levels = [0.0, 0.2, 0.3, 0.5, 0.7, 0.9, 0.95, 1.0, NAN]
    out = {}
    for t in range(n):
        at, steps = 0, {}
        for _ in range(rng.randint(1, 14)):
            steps[at] = (rng.choice(levels), rng.choice(levels))
            at += rng.choice((1, 1, 1, 2, 5))
        out[t] = steps
    return out


@pytest.mark.parametrize("k", [1, 2, 3])
@pytest.mark.parametrize("independent", [False, True])
def test_against_a_plain_scan(spark, k, independent):
    rng = random.Random(k)
    trajs = random_steps(rng)
    df = frame(spark, trajs).cache()
    for ts, tf, m in ((0.3, 0.3, 0), (0.5, 0.9, 2), (0.95, 0.2, 1)):
        got = {r.traj_id: (r.decision, r.decision_step) for r in policy.decide(df, success_thr=ts, failure_thr=tf, min_step=m, consecutive=k, streak="independent" if independent else "shared").collect()}
        assert got == {t: scan(s, ts, tf, m, k, independent) for t, s in trajs.items()}
        if not independent:
            folded = {r.traj_id: (r.decision, r.decision_step) for r in policy.decide_folded(df, success_thr=ts, failure_thr=tf, min_step=m, consecutive=k).collect()}
            assert folded == got


def test_grid_equals_single_policies(spark):
    trajs = random_steps(random.Random(9))
    df = frame(spark, trajs).cache()
    t = [0.2, 0.5, 0.9]
    got = {(r.traj_id, r.success_thr, r.failure_thr): (r.decision, r.decision_step) for r in policy.cartesian_grid(df, t, t).collect()}
    assert got == {(i, a, b): scan(s, a, b, 0, 1, False) for i, s in trajs.items() for a in t for b in t}


def test_counts_add_up(spark):
    df = frame(spark, random_steps(random.Random(4)))
    d = policy.decide(df, success_thr=0.5, failure_thr=0.5)
    for r in metrics.rollup(d).collect():
        assert r.true_positives + r.false_positives + r.true_negatives + r.false_negatives + r.undecided == r.original_total
        assert r.total_saved_steps <= r.total_steps
        assert r.adjusted_resolved == r.original_resolved - r.false_negatives + r.false_positives


def test_empty_and_unknown(spark):
    empty = frame(spark, {1: {0: (0.1, 0.1)}}).limit(0)
    assert policy.decide(empty, success_thr=0.5, failure_thr=0.5).count() == 0
    assert metrics.rollup(policy.decide(empty, success_thr=0.5, failure_thr=0.5)).filter("agent <> 'ALL'").count() == 0
    with pytest.raises(ValueError):
        policy.score_column("success", "other", "p")


def test_policies_as_a_table(spark):
    c = policy.policy_candidates(spark, low=30, high=90, by=30, shape="cartesian", consecutive=(1, 2))
    assert c.count() == 18 and c.select("name").distinct().count() == 18
    trajs = random_steps(random.Random(5), 30)
    df = frame(spark, trajs)
    rules = {r.candidate_ord: r for r in c.collect()}
    for r in policy.evaluate(df, c).collect():
        p = rules[r.candidate_ord]
        assert (r.decision, r.decision_step) == scan(trajs[r.traj_id], p.success_thr, p.failure_thr, p.min_step, p.consecutive, False)


def exchanges(spark, name):
    from haltlens.plans import catalog

    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    lines = [x.split("- ")[-1] for x in plan.split("\n")]
    return sum(x.startswith("Exchange hashpartitioning") for x in lines), sum("FileScan" in x for x in lines)


@pytest.mark.parametrize("name, most, scans", [("policy_decisions", 1, 1), ("policy_streak", 1, 1), ("policy_by_agent", 2, 1), ("policy_grid", 2, 1), ("policy_grid_full", 2, 1), ("policy_evaluation", 2, 1), ("split_leakage", 4, 4)])
def test_one_exchange_by_trajectory(spark, name, most, scans):
    """One exchange serves windows and decisions; what comes on top is the last aggregation."""
    found = exchanges(spark, name)
    assert found[0] <= most and found[1] <= scans


def test_evaluate_equals_decide_for_streaks_and_clashes(spark):
    """Every policy looked up from one row a trajectory decides as a replay of that policy alone; ties, NaN, nulls, first steps and single heads included."""
    rng = random.Random(9)
    levels = [0.2, 0.3, 0.3, 0.5, 0.5, 0.7, 0.9, 0.9, 1.0, float("nan"), None]
    rows = [(t, i + (i > 4), t % 3, t % 2, rng.choice(levels), rng.choice(levels)) for t in range(60) for i in range(rng.randint(1, 25))]
    df = spark.createDataFrame(rows, "traj_id long, prefix_step_idx int, agent int, label int, p_success double, p_failure double")
    cases = [(ts, tf, m, k, mode) for ts in (0.3, 0.5, 0.9) for tf in (0.3, 0.7, 0.95) for m in (0, 3) for k in (1, 2, 3) for mode in ("dual",)] + [(0.5, 0.3, 0, 2, "success_only"), (0.3, 0.5, 3, 1, "failure_only")]
    policies = spark.createDataFrame([(i, mode, ts, tf, m, k) for i, (ts, tf, m, k, mode) in enumerate(cases)], "candidate_ord long, policy_mode string, success_thr double, failure_thr double, min_step int, consecutive int")
    cols = ("traj_id", "agent", "label", "n_steps", "decided", "decision", "decision_step", "decision_score", "saved_steps")
    plain = lambda r: tuple(None if isinstance(r[c], float) and math.isnan(r[c]) else r[c] for c in cols)
    for saved in ("after", "indexed"):
        got = {}
        for r in policy.evaluate(df, policies, saved=saved).collect():
            got.setdefault(r.candidate_ord, set()).add(plain(r))
        for i, (ts, tf, m, k, mode) in list(enumerate(cases))[:: 1 if saved == "after" else 9]:
            want = policy.decide(df, success_thr=ts, failure_thr=tf, min_step=m, consecutive=k, mode=mode, saved=saved).collect()
            assert got[i] == set(map(plain, want)), cases[i]
    assert policy.evaluate(df.limit(0), policies).count() == 0


def test_no_prefix_meets_a_policy(spark, tmp_path):
    spark.range(50).selectExpr("id % 5 AS traj_id", "CAST(id AS INT) AS prefix_step_idx", "0 AS agent", "1 AS label", "0.5D AS p_success", "0.4D AS p_failure").write.parquet(str(tmp_path / "s"))
    c = policy.policy_candidates(spark, low=30, high=99, shape="cartesian", consecutive=(1, 2, 3))
    assert c.count() == 14_700
    plan = policy.evaluate(spark.read.parquet(str(tmp_path / "s")), c)._jdf.queryExecution().executedPlan().toString()
    above, _, below = plan.partition("BroadcastNestedLoopJoin")
    # all policies, as one row, meet one row a trajectory: what is below the join is the aggregation by trajectory
    scores = below.split("BroadcastExchange")[0]
    assert "ObjectHashAggregate" in scores and "Join" not in scores and "Join" not in above
    assert plan.count("Exchange hashpartitioning") == 1
