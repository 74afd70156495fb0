"""Early-stop decisions: one ordered scan per trajectory, as windows and one aggregation on the same partitioning.

A head hits when its score reaches its threshold; the step where a direction has held for ``consecutive`` steps decides. Steps before
``min_step`` come first in order and hit nothing, so that they neither count nor reset. Thresholds and rules may be numbers or
columns, so that a table of policies joined to the scores is replayed by the same plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from haltlens.functions.scalars import at_least

INF = float("inf")
Number = float | int | Column


def _lit(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def score_column(head: str, score_mode: str, predictor: str) -> str:
    """Name of a stored probability."""
    if score_mode not in ("raw", "calibrated"):
        raise ValueError(f"unknown score mode {score_mode}")
    return f"prob_{'cal_' * (score_mode == 'calibrated')}safe_{head}__{predictor}"


def predictors(columns: list[str], score_mode: str) -> list[str]:
    """Those that have both heads."""
    start = {h: score_column(h, score_mode, "") for h in ("success", "failure")}
    heads = [{c[len(s) :] for c in columns if c.startswith(s)} for s in start.values()]
    return sorted(heads[0] & heads[1])


def long_scores(wide: DataFrame, keys: list[str], score_modes: tuple[str, ...] = ("raw", "calibrated")) -> DataFrame:
    """Wide probability columns to rows: keys, predictor, score_mode, p_success, p_failure."""
    each = [F.struct(F.lit(p).alias("predictor"), F.lit(m).alias("score_mode"), F.col(score_column("success", m, p)).cast("double").alias("p_success"), F.col(score_column("failure", m, p)).cast("double").alias("p_failure")) for m in score_modes for p in predictors(wide.columns, m)]
    return wide.select(*keys, F.explode(F.array(*each)).alias("h")).select(*keys, "h.*")


def fired(
    scores: DataFrame,
    *,
    success_thr: Number,
    failure_thr: Number,
    min_step: Number = 0,
    consecutive: Number = 1,
    mode: str | Column = "dual",
    streak: str = "shared",
    conflict: str = "margin",
    opposite_max: Number | None = None,
    complement: bool = False,
    keys: tuple[str, ...] = ("traj_id",),
    step: str = "prefix_step_idx",
) -> DataFrame:
    """``scores`` with direction (1 success, -1 failure, 0 none) and whether the rule fires on the row.

    mode: dual, success_only or failure_only. streak: 'shared' (one direction at a time; a miss or a turn starts anew) or
    'independent' (each head counts its own hits). conflict, when both hit: 'margin' (the larger distance above its threshold; a tie
    is success) or 'abstain' (neither). opposite_max: a head hits only while the other is below it. complement: below 1 - threshold, success first.
    """
    s, f = F.col("p_success").cast("double"), F.col("p_failure").cast("double")
    ts, tf, m = _lit(success_thr).cast("double"), _lit(failure_thr).cast("double"), _lit(mode)
    open_ = F.col(step) >= _lit(min_step)
    hit_s, hit_f = at_least(s, ts) & (m != "failure_only") & open_, at_least(f, tf) & (m != "success_only") & open_
    if opposite_max is not None:
        hit_s, hit_f = hit_s & (f < _lit(opposite_max)), hit_f & (s < _lit(opposite_max))
    if complement:
        hit_s, hit_f = hit_s & (f < F.lit(1.0) - ts), hit_f & (s < F.lit(1.0) - tf)
    first = F.lit(True) if complement else (s - ts) >= (f - tf)
    rows = scores.withColumns({"_s": hit_s, "_f": hit_f})
    order = W.partitionBy(*keys).orderBy(step)
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    single = isinstance(consecutive, int) and consecutive == 1
    if streak == "independent" and not single:
        rows = rows.withColumn("_n", F.row_number().over(order))
        run = lambda c: F.col("_n") - F.coalesce(F.max(F.when(~F.col(c), F.col("_n"))).over(upto), F.lit(0))
        rows = rows.withColumns({"_s": run("_s") >= _lit(consecutive), "_f": run("_f") >= _lit(consecutive)})
    both = F.lit(0) if conflict == "abstain" else F.when(first, 1).otherwise(-1)
    rows = rows.withColumn("direction", F.when(F.col("_s") & F.col("_f"), both).when(F.col("_s"), 1).when(F.col("_f"), -1).otherwise(0))
    if single or streak == "independent":
        return rows.withColumn("fires", F.col("direction") != 0).drop("_s", "_f", "_n")
    rows = rows.withColumn("_n", F.row_number().over(order)).withColumn("_turn", F.when(~F.col("direction").eqNullSafe(F.lag("direction").over(order)), F.col("_n")))
    length = F.col("_n") - F.max("_turn").over(upto) + 1
    return rows.withColumn("fires", (F.col("direction") != 0) & (length >= _lit(consecutive))).drop("_s", "_f", "_n", "_turn")


def decide(scores: DataFrame, *, keys: tuple[str, ...] = ("traj_id",), step: str = "prefix_step_idx", saved: str = "after", carry: tuple[str, ...] = ("agent",), **rule) -> DataFrame:
    """One row per trajectory: carried columns, label, n_steps, decided, decision, decision_step, decision_score, both probabilities, saved_steps.

    saved: 'after' counts rows later than the decision; 'indexed' is n_steps - decision_step - 1, at least 0.
    """
    rows = fired(scores, keys=keys, step=step, **rule)
    rows = rows.withColumn("_at", F.min(F.when(F.col("fires"), F.col(step))).over(W.partitionBy(*keys)))
    at = F.col(step) == F.col("_at")
    pick = lambda c: F.max(F.when(at & F.col("fires"), c))
    after = F.sum((F.col(step) > F.col("_at")).cast("long"))
    got = rows.groupBy(*keys).agg(
        *[F.min_by(c, step).alias(c) for c in carry],
        F.min_by("label", step).alias("label"),
        F.count(F.lit(1)).alias("n_steps"),
        F.max("_at").alias("_at"),
        pick(F.col("direction")).alias("_d"),
        pick(F.col("p_success").cast("double")).alias("prob_success"),
        pick(F.col("p_failure").cast("double")).alias("prob_failure"),
        after.alias("_after"),
    )
    decided = F.col("_at").isNotNull()
    n = F.col("_after") if saved == "after" else F.greatest(F.col("n_steps") - F.col("_at") - 1, F.lit(0))
    return got.select(
        *keys,
        *carry,
        "label",
        "n_steps",
        decided.alias("decided"),
        F.when(F.col("_d") == 1, "success").when(F.col("_d") == -1, "failure").otherwise("undecided").alias("decision"),
        F.coalesce("_at", F.lit(-1)).cast("int").alias("decision_step"),
        F.when(F.col("_d") == 1, F.col("prob_success")).when(F.col("_d") == -1, F.col("prob_failure")).alias("decision_score"),
        "prob_success",
        "prob_failure",
        F.coalesce(F.when(decided, n), F.lit(0)).cast("long").alias("saved_steps"),
    )


def decide_folded(scores: DataFrame, *, success_thr: float, failure_thr: float, min_step: int = 0, consecutive: int = 1) -> DataFrame:
    """The shared-streak rule as a fold over each trajectory's sorted array: traj_id, decision, decision_step. For short trajectories and as a second opinion."""
    steps = F.sort_array(F.collect_list(F.struct("prefix_step_idx", "p_success", "p_failure")))
    zero = F.struct(F.lit(0).alias("last"), F.lit(0).alias("streak"), F.lit(0).alias("decided"), F.lit(-1).alias("at"))

    def fold(acc: Column, x: Column) -> Column:
        hs, hf = at_least(x["p_success"], success_thr), at_least(x["p_failure"], failure_thr)
        d = F.when(x["prefix_step_idx"] < min_step, 0).when(hs & hf, F.when(x["p_success"] - success_thr >= x["p_failure"] - failure_thr, 1).otherwise(-1)).when(hs, 1).when(hf, -1).otherwise(0)
        n = F.when(d == 0, 0).when(d == acc["last"], acc["streak"] + 1).otherwise(1)
        done = acc["decided"] != 0
        wins = ~done & (n >= consecutive)
        return F.struct(d.alias("last"), n.alias("streak"), F.when(wins, d).otherwise(acc["decided"]).alias("decided"), F.when(wins, x["prefix_step_idx"]).otherwise(acc["at"]).alias("at"))

    got = scores.groupBy("traj_id").agg(F.aggregate(steps, zero, fold).alias("a"))
    return got.select("traj_id", F.when(F.col("a.decided") == 1, "success").when(F.col("a.decided") == -1, "failure").otherwise("undecided").alias("decision"), F.col("a.at").alias("decision_step"))


def policy_candidates(spark, *, low: int, high: int, by: int = 1, shape: str = "symmetric", min_steps: tuple[int, ...] = (0,), consecutive: tuple[int, ...] = (1,), score_modes: tuple[str, ...] = ("raw",), predictors: tuple[str, ...] = ("p",)) -> DataFrame:
    """Policies over thresholds low/100 .. high/100: 'symmetric', 'cartesian', 'success_only' or 'failure_only'; candidate_ord keeps the order of generation."""
    grid = spark.range(1).select(F.explode(F.sequence(F.lit(low), F.lit(high), F.lit(by))).alias("i"))
    t = F.col("i") / 100.0
    if shape == "cartesian":
        grid = grid.crossJoin(F.broadcast(grid.select(F.col("i").alias("j")))).select(t.alias("success_thr"), (F.col("j") / 100.0).alias("failure_thr"))
    else:
        grid = grid.select((F.lit(INF) if shape == "failure_only" else t).alias("success_thr"), (F.lit(INF) if shape == "success_only" else t).alias("failure_thr"))
    mode = shape if shape.endswith("_only") else "dual"
    for name, values in (("min_step", min_steps), ("consecutive", consecutive), ("score_mode", score_modes), ("predictor", predictors)):
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    shown = lambda c: F.when(F.col(c) == F.lit(INF), "inf").otherwise(F.format_string("%.4f", F.col(c)))
    name = F.concat_ws("_", "score_mode", "predictor", F.lit(mode), shown("success_thr"), shown("failure_thr"), F.concat(F.lit("m"), "min_step"), F.concat(F.lit("k"), "consecutive"))
    order = W.orderBy("predictor", "score_mode", "min_step", "consecutive", "success_thr", "failure_thr")
    # one partition, but only of the grid itself: a few thousand rows at most
    return grid.select((F.row_number().over(order) - 1).cast("long").alias("candidate_ord"), name.alias("name"), "predictor", "score_mode", F.lit(mode).alias("policy_mode"), "success_thr", "failure_thr", "min_step", "consecutive")


#: Different pairs of streak length and first step that are looked up; with more of them each row meets each policy.
STREAKS = 32
#: Up to so many policies rows are replayed, in compiled code; more are looked up.
MANY = 32


def evaluate(scores: DataFrame, policies: DataFrame, *, keys: tuple[str, ...] = ("traj_id",), most: int = 100_000, **rule) -> DataFrame:
    """Decisions of every trajectory under every policy.

    Over MANY policies under the usual rule (shared streaks, margin) meet no prefix: see ``_looked_up``. Fewer, other rules, and tables of over ``most`` policies replay each row for each policy; up to
    ``most`` policies are then sent to all executors, a larger table is joined by blocks. Both ways decide alike."""
    cols = ["candidate_ord", "policy_mode", "success_thr", "failure_thr", "min_step", "consecutive"]
    longest, n, streaks = policies.agg(F.max("consecutive"), F.count(F.lit(1)), F.size(F.collect_set(F.struct("consecutive", "min_step")))).first()
    small = policies.select(*cols)
    usual = rule.get("streak", "shared") == "shared" and rule.get("conflict", "margin") == "margin" and rule.get("opposite_max") is None and not rule.get("complement")
    if usual and MANY < n <= most and streaks <= STREAKS:
        # little data, much work: as many tasks as the session is set to
        scores = scores.repartition(int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
        return _looked_up(scores, small, keys, **{k: rule[k] for k in ("step", "saved", "carry") if k in rule})
    each = scores.crossJoin(F.broadcast(small) if n <= most else small)
    return decide(each, keys=(*keys, "candidate_ord"), success_thr=F.col("success_thr"), failure_thr=F.col("failure_thr"), min_step=F.col("min_step"), consecutive=1 if longest == 1 else F.col("consecutive"), mode=F.col("policy_mode"), **rule)


def _looked_up(scores: DataFrame, policies: DataFrame, keys: tuple[str, ...], *, step: str = "prefix_step_idx", saved: str = "after", carry: tuple[str, ...] = ("agent",)) -> DataFrame:
    """One row a trajectory, from which the decisions of all policies are read: one exchange, and never prefixes times policies.

    A head has hit k steps in a row where the least of its last k scores reaches the threshold, so that the records of that sliding minimum tell the first such step of every
    threshold. Nothing fires before the earlier of the two heads' steps, and it fires there unless the margin rule gave one of those k steps to the other head. Where it did, that one pair of trajectory
    and policy is replayed from those k steps on: a few steps first, and all that follow only if none of them fires.
    """
    effective = lambda head, other: F.when(F.col("policy_mode") == f"{other}_only", F.lit(INF)).otherwise(F.col(f"{head}_thr").cast("double"))
    p = policies.select("candidate_ord", effective("success", "failure").alias("ts"), effective("failure", "success").alias("tf"), F.col("consecutive").cast("int").alias("k"), F.col("min_step").cast("int").alias("m"))
    told = p.agg(F.sort_array(F.collect_set(F.struct("k", "m"))).alias("streaks"), F.sort_array(F.collect_set("ts")).alias("ts"), F.sort_array(F.collect_set("tf")).alias("tf")).first()
    streaks, thresholds = [tuple(x) for x in told["streaks"]], {"s": told["ts"], "f": told["tf"]}
    place = lambda values, c: (F.array_position(F.array(*[F.lit(float(v)) for v in values]), F.col(c)) - 1).cast("int")
    which = (F.array_position(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).alias("m")) for k, m in streaks]), F.struct("k", "m")) - 1).cast("int")
    table = p.select(F.struct("candidate_ord", "ts", "tf", "k", "m", place(thresholds["s"], "ts").alias("si"), place(thresholds["f"], "tf").alias("fi"), which.alias("w")).alias("p")).agg(F.collect_list("p").alias("policies")).withColumn("_one", F.lit(1))

    known = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(-INF)), F.lit(-INF))
    order = W.partitionBy(*keys).orderBy(step)
    rows = scores.withColumns({"_s": known("p_success"), "_f": known("p_failure"), "_n": F.row_number().over(order)})
    here = F.struct(F.col("_n").alias("n"), F.col(step).alias("at"), F.col("p_success").cast("double").alias("ps"), F.col("p_failure").cast("double").alias("pf"), F.col("_s").alias("s"), F.col("_f").alias("f"))
    least = {}
    for w, (k, m) in enumerate(streaks):
        for head in ("s", "f"):
            open_ = F.when(F.col(step) >= m, F.col(f"_{head}")).otherwise(F.lit(-INF))
            least[f"_{head}{w}"] = F.when(F.col("_n") >= k, F.min(open_).over(order.rowsBetween(1 - k, 0)) if k > 1 else open_).otherwise(F.lit(-INF))
    rows = rows.withColumns(least)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({f"{c}r": F.when((F.col(c) > F.coalesce(F.max(c).over(before), F.lit(-INF))), F.struct(here.alias("x"), F.col(c).alias("v"))) for c in least})
    in_order = lambda c: F.array_sort(F.collect_list(c))
    one = rows.groupBy(*keys).agg(
        *[F.min_by(c, step).alias(c) for c in carry], F.min_by("label", step).alias("label"), F.count(F.lit(1)).alias("n_steps"),
        in_order(here).alias("_steps"),
        *[in_order(f"{c}r").alias(c) for c in least],
    )
    first = lambda head, w: F.transform(F.array(*[F.lit(float(t)) for t in thresholds[head]]), lambda t: F.get(F.filter(f"_{head}{w}", lambda r: r["v"] >= t), F.lit(0))["x"])
    hits = one.select(*keys, *carry, "label", "n_steps", "_steps", *[F.array(*[first(h, w) for w in range(len(streaks))]).alias(f"_{h}") for h in ("s", "f")], F.lit(1).alias("_one"))
    hit = "struct<n:int,at:bigint,ps:double,pf:double,d:int>"
    as_hit = lambda x, d: F.struct(x["n"].cast("int").alias("n"), x["at"].cast("bigint").alias("at"), x["ps"].alias("ps"), x["pf"].alias("pf"), d.cast("int").alias("d"))
    success = lambda x, p: x["s"] - p["ts"] >= x["f"] - p["tf"]
    start = F.struct(F.lit(-1).alias("n"), F.lit(0).alias("d"), F.lit(0).alias("run"), F.lit(None).cast(hit).alias("hit"))

    def replayed(steps: Column, p: Column) -> Column:
        def one(acc: Column, x: Column) -> Column:
            hs, hf = (x["s"] >= p["ts"]) & (x["at"] >= p["m"]), (x["f"] >= p["tf"]) & (x["at"] >= p["m"])
            d = F.when(hs & hf, F.when(success(x, p), 1).otherwise(-1)).when(hs, 1).when(hf, -1).otherwise(0)
            run = F.when(d == 0, 0).when((d == acc["d"]) & (x["n"] == acc["n"] + 1), acc["run"] + 1).otherwise(1)
            fires = acc["hit"].isNull() & (d != 0) & (run >= p["k"])
            return F.struct(x["n"].cast("int").alias("n"), d.cast("int").alias("d"), run.cast("int").alias("run"), F.when(fires, as_hit(x, d)).otherwise(acc["hit"]).alias("hit"))

        return F.aggregate(steps, start, one)["hit"]

    def met(p: Column) -> Column:
        """Of a policy the first step at which each head has hit often enough."""
        return F.struct(p.alias("p"), F.get(F.get("_s", p["w"]), p["si"]).alias("s"), F.get(F.get("_f", p["w"]), p["fi"]).alias("f"))

    def ahead(x: Column) -> Column:
        """The head that is first, and where its streak began."""
        s, f = x["s"], x["f"]
        d = F.when(f["n"].isNull() | (s["n"] < f["n"]), 1).when(s["n"].isNull() | (f["n"] < s["n"]), -1).when(success(s, x["p"]), 1).otherwise(-1)
        until = F.least(s["n"], f["n"])
        return F.struct(x["p"].alias("p"), F.when(d == 1, s).otherwise(f).alias("x"), d.alias("d"), until.alias("until"), F.greatest(until - x["p"]["k"] + 1, F.lit(1)).cast("int").alias("begin"))

    def decided_by(y: Column) -> Column:
        p = y["p"]
        kept = (p["k"] == 1) | F.forall(F.slice("_steps", y["begin"], p["k"]), lambda x: F.when(y["d"] == 1, (x["f"] < p["tf"]) | success(x, p)).otherwise((x["s"] < p["ts"]) | ~success(x, p)))
        again = F.coalesce(replayed(F.slice("_steps", y["begin"], 4 * p["k"] + 8), p), replayed(F.slice("_steps", y["begin"], F.size("_steps")), p))
        return F.struct(p["candidate_ord"].alias("candidate_ord"), F.when(y["until"].isNull(), F.lit(None).cast(hit)).when(kept, as_hit(y["x"], y["d"])).otherwise(again).alias("h"))

    # all policies of a trajectory are decided within its row, so that what leaves it is small
    every = F.transform(F.transform(F.transform("policies", met), ahead), decided_by)
    done = hits.join(F.broadcast(table), "_one").select(*keys, *carry, "label", "n_steps", F.explode(every).alias("p")).select(*keys, *carry, "label", "n_steps", F.col("p.candidate_ord").alias("candidate_ord"), F.col("p.h").alias("_h"))
    d, decided = F.col("_h.d"), F.col("_h").isNotNull()
    n = F.col("n_steps") - F.col("_h.n") if saved == "after" else F.greatest(F.col("n_steps") - F.col("_h.at") - 1, F.lit(0))
    return done.select(
        *keys, "candidate_ord", *carry, "label", "n_steps", decided.alias("decided"),
        F.when(d == 1, "success").when(d == -1, "failure").otherwise("undecided").alias("decision"), F.coalesce("_h.at", F.lit(-1)).cast("int").alias("decision_step"),
        F.when(d == 1, F.col("_h.ps")).when(d == -1, F.col("_h.pf")).alias("decision_score"), F.col("_h.ps").alias("prob_success"), F.col("_h.pf").alias("prob_failure"), F.coalesce(F.when(decided, n), F.lit(0)).cast("long").alias("saved_steps"),
    )


def cartesian_grid(scores: DataFrame, success_thrs: list[float], failure_thrs: list[float]) -> DataFrame:
    """Decisions for all pairs of thresholds (one step, margin rule): traj_id, success_thr, failure_thr, label, agent, n_steps, decision, decision_step, saved_steps.

    A trajectory becomes one row with its records; first hits of each head are looked up there once per threshold, and their pairs leave
    that row: one exchange, whatever the number of thresholds, and never prefixes times pairs.
    """
    clean = scores.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(-INF)), F.lit(-INF)) for c in ("p_success", "p_failure")})
    before = W.partitionBy("traj_id").orderBy("prefix_step_idx").rowsBetween(W.unboundedPreceding, -1)
    new = lambda c: F.coalesce(F.col(c) > F.max(c).over(before), F.lit(True))
    step = F.struct(F.col("prefix_step_idx").alias("at"), F.col("p_success").alias("s"), F.col("p_failure").alias("f"))
    rows = clean.withColumn("_r", F.when(new("p_success") | new("p_failure"), step))
    one = rows.groupBy("traj_id").agg(F.count(F.lit(1)).alias("n_steps"), F.min_by("label", "prefix_step_idx").alias("label"), F.min_by("agent", "prefix_step_idx").alias("agent"), F.array_sort(F.collect_list("_r")).alias("_r"))
    thresholds = lambda values: F.array(*[F.lit(float(t)) for t in values])
    first = lambda values, head: F.transform(thresholds(values), lambda t: F.struct(t.alias("thr"), F.get(F.filter("_r", lambda r: r[head] >= t), F.lit(0)).alias("hit")))
    hits = one.select("traj_id", "agent", "label", "n_steps", first(success_thrs, "s").alias("_s"), first(failure_thrs, "f").alias("_f"))
    pairs = hits.select("traj_id", "agent", "label", "n_steps", "_f", F.explode("_s").alias("s")).select("traj_id", "agent", "label", "n_steps", "s", F.explode("_f").alias("f"))
    ts, tf, s, f = F.col("s.thr"), F.col("f.thr"), F.col("s.hit"), F.col("f.hit")
    tie = F.when(s["s"] - ts >= s["f"] - tf, 1).otherwise(-1)
    d = F.when(s.isNull() & f.isNull(), 0).when(f.isNull() | (s["at"] < f["at"]), 1).when(s.isNull() | (f["at"] < s["at"]), -1).otherwise(tie)
    at = F.least(s["at"], f["at"])
    return pairs.select("traj_id", "agent", "label", "n_steps", ts.alias("success_thr"), tf.alias("failure_thr"), F.when(d == 1, "success").when(d == -1, "failure").otherwise("undecided").alias("decision"), F.coalesce(at, F.lit(-1)).alias("decision_step"), F.when(at.isNull(), 0).otherwise(F.greatest(F.col("n_steps") - at - 1, F.lit(0))).cast("long").alias("saved_steps"))


def outcome() -> Column:
    success, failure, solved = F.col("decision") == "success", F.col("decision") == "failure", F.col("label") == 1
    return F.when(success & solved, "TP").when(success, "FP").when(failure & solved, "FN").when(failure, "TN").when(solved, "undecided_success").otherwise("undecided_failure")
