"""The train stage over folds: what failed is done by the next run, nothing else is."""

import threading

import numpy as np
import pytest

from haltlens.operators import features
from haltlens.plans import stages
from haltlens.sources import tables


def test_a_cut_run_fits_only_the_rest(spark, tmp_path):
    rng, run = np.random.default_rng(4), str(tmp_path / "run")
    made = [(t, i, t % 2, float(t % 2 + rng.normal()), ("train", "train", "valid", "test")[t % 4 if t % 8 < 4 else (t + 1) % 4]) for t in range(80) for i in range(3)]
    data = spark.createDataFrame(made, "traj_id long, prefix_step_idx int, label int, x double, split string").selectExpr("*", "1.0D AS sample_weight")
    f, folds, asked, lock = features.FeatureSet(("x",)), [(str(k), f"m{k}") for k in range(3)], [], threading.Lock()

    def rows(broken):
        def of(model):
            with lock:
                asked.append((model, spark.sparkContext.getLocalProperty("spark.scheduler.pool")))
            if model == broken:
                raise OSError("cut off")
            return data

        return of

    with pytest.raises(OSError, match="cut off"):
        stages.train_folds(spark, folds, rows("m1"), f, run, threads=2, kind="lr", predictor="lr", min_step=1)
    assert sorted(asked) == [(f"m{k}", f"{k}__m{k}") for k in range(3)] and [n for n, _ in tables.done_folds(spark, run)] == ["0__m0", "2__m2"]
    asked.clear()
    assert stages.train_folds(spark, folds, rows(None), f, run, threads=2, kind="lr", predictor="lr", min_step=1) == ["1__m1"]
    assert asked == [("m1", "1__m1")]
    asked.clear()
    assert stages.train_folds(spark, folds, rows(None), f, run) == [] and not asked
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None
    got = tables.read_folds(spark, run, ["scores"])["scores"].toPandas()
    held = [m for m in made if m[4] in ("valid", "test")]
    assert len(got) == 3 * len(held) and sorted(got.test_model.unique()) == ["m0", "m1", "m2"]
    # one number and a linear head: scores must rank every fold's rows exactly as that number does (it is larger for label 1)
    x = {(m[0], m[1]): m[3] for m in made}
    for _, fold in got.groupby("test_model"):
        xs = np.array([x[k] for k in zip(fold.traj_id, fold.prefix_step_idx)])
        assert (np.diff(fold.prob_safe_success__lr.to_numpy()[np.argsort(xs)]) >= 0).all() and fold.prob_safe_success__lr.nunique() == len(fold)
        assert (np.diff(fold.prob_safe_failure__lr.to_numpy()[np.argsort(xs)]) <= 0).all()
