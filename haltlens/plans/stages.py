"""A whole experiment in stages over stored scores: plan, audit, splits, sweep, summary; each stage reads what the one before published.

Stages write tables to a run folder, each folder at once with a mark when it is done, so that a run that was cut off goes on with the first stage without a mark.
Policies are chosen on the validation part of a fold and replayed on its test part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haltlens.operators import audit, features, metrics, policy, select, splits
from haltlens.sources import tables

SWEEPS = ("symmetric", "cartesian", "complement", "modes")


def with_part(scores: DataFrame, seed: int = 5, valid: str = "8") -> DataFrame:
    """Trajectories of a fold as validation or test, by the first digit of their hash."""
    return scores.withColumn("part", F.when(F.substring(splits.hash_order(seed, "traj_id"), 1, 1) < valid, "valid").otherwise("test"))


#: Prefixes of a task that meets all policies.
ROWS = 100_000


def by_trajectory(scores: DataFrame) -> DataFrame:
    """Stored scores, dealt by trajectory in parts of about ROWS prefixes: they move before they meet the policies, not as many times as there are policies, and a task's share does not grow."""
    least = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return scores.repartition(max(least, -(-scores.count() // ROWS)), "traj_id")


def sweep(scores: DataFrame, candidates: DataFrame, targets: DataFrame, **rules) -> tuple[DataFrame, DataFrame]:
    """``scores`` with part: the chosen policies of each fold and target, and what they come to on the test part."""
    return choose(counted(scores, candidates), candidates, targets, **rules)


def counted(scores: DataFrame, candidates: DataFrame) -> DataFrame:
    """What every policy comes to on each fold's parts. ``choose`` reads it for each part: where scores are many it is kept, so that they are replayed once."""
    got = policy.evaluate(scores, candidates, carry=("agent", "fold_id", "part"))
    return metrics.summarize(got, ("candidate_ord", "fold_id", "part"))


def choose(counts: DataFrame, candidates: DataFrame, targets: DataFrame, **rules) -> tuple[DataFrame, DataFrame]:
    """Policies chosen by the counts of the validation part, and their counts on the test part."""
    known = counts.filter("part = 'valid'").join(candidates.select("candidate_ord", "success_thr", "failure_thr"), "candidate_ord")
    chosen = select.select_policy(known, targets, **rules).select("fold_id", "target", "candidate_ord", "success_thr", "failure_thr", "selection_status")
    return chosen, chosen.join(counts.filter("part = 'test'").drop("part"), ["fold_id", "candidate_ord"])


def sweep_modes(scores: DataFrame, threshold: float) -> DataFrame:
    """Both heads against either alone, at one threshold: counters and rates by mode."""
    out = None
    for mode in ("dual", "success_only", "failure_only"):
        d = policy.decide(scores, success_thr=policy.INF if mode == "failure_only" else threshold, failure_thr=policy.INF if mode == "success_only" else threshold, mode=mode)
        one = metrics.summarize(d).select(F.lit(mode).alias("policy_mode"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def sweep_complement(scores: DataFrame, thresholds: list[float]) -> DataFrame:
    """The rule in which the other head is below one minus the threshold, at each of some thresholds."""
    s = scores.withColumn("thr", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    return metrics.summarize(policy.decide(s, keys=("traj_id", "thr"), success_thr=F.col("thr"), failure_thr=F.col("thr"), complement=True), ("thr",))


def stages(spark: SparkSession, scores: DataFrame, targets: list[float], **rules) -> dict[str, Callable[[str], dict[str, DataFrame]]]:
    """Each stage's tables, by the run folder."""
    read = lambda run, stage, name: tables.read_table(spark, f"{run}/{stage}/{name}.parquet")
    candidates = lambda: policy.policy_candidates(spark, low=50, high=95, by=15, min_steps=(0, 5), consecutive=(1, 2))

    def swept(run: str) -> dict[str, DataFrame]:
        candidates = read(run, "plan", "candidates")
        counts = tables.kept(counted(by_trajectory(read(run, "splits", "scores")), candidates), "counts")
        chosen, results = choose(counts, candidates, read(run, "plan", "targets"), **rules)
        return {"chosen": chosen, "results": results}

    def summed(run: str) -> dict[str, DataFrame]:
        results = read(run, "sweep", "results")
        return {"summary": metrics.over_folds(results, ("target",)), "chosen": read(run, "sweep", "chosen")}

    return {
        "plan": lambda run: {"candidates": candidates(), "targets": spark.createDataFrame([(t,) for t in targets], "target double")},
        "audit": lambda run: {"prefixes": audit.prefix_audit(scores, ("fold_id",))},
        "splits": lambda run: {"scores": with_part(scores)},
        "sweep": swept,
        "summary": summed,
    }


def run_stages(spark: SparkSession, scores: DataFrame, run: str, *, targets: list[float], last: str = "summary", **rules) -> list[str]:
    """Runs the stages up to ``last`` that have no mark in the folder ``run``; returns those that it ran."""
    all_stages = stages(spark, scores, targets, **rules)
    if last not in all_stages:
        raise ValueError(f"unknown stage {last}")
    ran = []
    for name, make in all_stages.items():
        if (name, f"{run}/{name}") not in _done(spark, run):
            tables.publish(spark, f"{run}/{name}", make(run))
            ran.append(name)
        if name == last:
            return ran
    return ran


def train_folds(spark: SparkSession, folds: Iterable[tuple[str, str]], rows: Callable[[str], DataFrame], f: features.FeatureSet, run: str, *, threads: int = 4, keep: tuple[str, ...] = ("traj_id", "prefix_step_idx", "split", "label"), predictor: str = "gbt", **options) -> list[str]:
    """The train stage: for each of ``folds`` (fold_id, test_model) without a mark below ``run``, heads fitted on the train rows of ``rows(test_model)``, calibrated on its valid rows, and
    the probabilities of valid and test rows published as ``<fold_id>__<test_model>/scores.parquet``. Returns the folders that it made.

    ``threads`` folds run at a time in one session, each in a scheduler pool of its own (shared fairly where spark.scheduler.mode is FAIR), so that the tail of one fold's small jobs
    leaves executors to the others. A fold is published by itself: one that fails leaves the others' marks, the first error is raised when all have ended, and the next run does what is missing."""
    done = {name for name, _ in _done(spark, run)}
    todo = [(name, model) for name, model in ((f"{fold}__{model}", model) for fold, model in folds) if name not in done]

    def one(name: str, model: str) -> bool:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        try:
            scored, _ = features.run_fold(rows(model), f, predictor=predictor, **options)
            columns = [*keep, *[f"prob_{c}safe_{h}__{predictor}" for h in ("success", "failure") for c in ("", "cal_")]]
            return tables.publish(spark, f"{run}/{name}", {"scores": scored.select(*columns)})
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max_workers=max(1, threads)) as pool:
        running = [(name, pool.submit(inheritable_thread_target(spark)(one), name, model)) for name, model in todo]
    failed = [e for _, r in running if (e := r.exception())]
    if failed:
        raise failed[0]
    return [name for name, r in running if r.result()]


def _done(spark: SparkSession, run: str) -> set[tuple[str, str]]:
    p, fs = tables._file_system(spark, run)
    return {(n, f"{run}/{n}") for n, _ in tables.done_folds(spark, run)} if fs.exists(p) else set()
