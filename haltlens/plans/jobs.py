"""Jobs of an experiment: which folds and profiles there are, which of them are done, and how one is run in a process of its own with limits."""

from __future__ import annotations

import os
import resource
import subprocess
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haltlens.sources import tables


@dataclass(frozen=True)
class Job:
    """A run of the command line over one fold's scores."""

    scores: str
    run: str
    targets: tuple[float, ...] = (0.75, 0.85, 0.95)
    last: str = "summary"

    def command(self) -> list[str]:
        return [sys.executable, "-m", "haltlens.cli", "stages", self.scores, self.run, "--last", self.last, *(x for t in self.targets for x in ("--target", str(t)))]


def plan(folds: DataFrame, profiles: dict[str, list[str]]) -> DataFrame:
    """Every eligible fold (model_id) under every variant of every profile: fold_id, test_model, profile, variant."""
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("profile"), F.lit(v).alias("variant")) for p, vs in profiles.items() for v in vs])).alias("j")
    return folds.select(F.col("model_id").alias("test_model"), each).select(F.concat_ws("__", F.regexp_replace("test_model", "[^A-Za-z0-9_.-]+", "_"), "j.variant").alias("fold_id"), "test_model", "j.profile", "j.variant")


def missing(spark: SparkSession, jobs: DataFrame, base: str) -> DataFrame:
    """Jobs whose folder below ``base`` has no mark."""
    done = [(name,) for name, _ in tables.done_folds(spark, base)]
    return tables.remaining(jobs, spark.createDataFrame(done, "fold_id string"), ["fold_id"])


def run_job(command: list[str], *, execute: bool = True, threads: int = 1, seconds: float | None = None, memory_kb: int | None = None) -> int | None:
    """Runs a command with capped threads, time and address space; None (and nothing run) if not to be executed."""
    if not execute:
        return None
    env = os.environ | {k: str(threads) for k in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS")}
    limit = (lambda: resource.setrlimit(resource.RLIMIT_AS, (memory_kb * 1024,) * 2)) if memory_kb else None
    try:
        return subprocess.run(command, env=env, timeout=seconds, preexec_fn=limit, check=False).returncode
    except subprocess.TimeoutExpired:
        return 124
