"""Boosted trees against a plain trainer that scans every cut, one split at a time."""

import hashlib
import math

import numpy as np
import pytest

from haltlens.operators import boosting as B
from haltlens.operators import features


def plain(x, y, w, k, names, p):
    """Bins given; the trees of a trainer in plain loops without sampling of rows."""
    margin, trees = np.full(len(y), math.log((w * y).sum() / (w * (1 - y)).sum())), []
    pull = lambda g, h: max(abs(g) / B.UNIT - p.l1, 0.0) ** 2 / (h / B.UNIT + p.l2)
    for t in range(p.rounds):
        prob = 1 / (1 + np.exp(-margin))
        g, h = np.floor(w * (prob - y) * B.UNIT + 0.5).astype(int), np.floor(w * prob * (1 - prob) * B.UNIT + 0.5).astype(int)
        order = sorted(range(len(names)), key=lambda i: hashlib.md5(f"{p.seed}/{t}/{names[i]}".encode()).digest())
        columns = sorted(order[: max(1, math.ceil(p.column_share * len(names)))])

        def best(at):
            found = []
            for i in columns:
                for b in np.unique(x[at, i])[:-1]:
                    left, right = at[x[at, i] <= b], at[x[at, i] > b]
                    if min(len(left), len(right)) >= p.least_leaf and min(h[left].sum(), h[right].sum()) >= p.least_hessian * B.UNIT:
                        gain = pull(g[left].sum(), h[left].sum()) + pull(g[right].sum(), h[right].sum()) - pull(g[at].sum(), h[at].sum())
                        if gain > 0:
                            found.append((-gain, i, int(b), left, right))
            return min(found, key=lambda f: f[:3], default=None)

        leaves, inner = {"": np.arange(len(y))}, {}
        while len(leaves) < p.leaves:
            can = sorted((f[0], len(path), path) for path, at in leaves.items() if (f := best(at)))
            if not can:
                break
            path = can[0][2]
            _, i, b, left, right = best(leaves.pop(path))
            inner[path] = (i, b, len(left), len(right))
            leaves |= {path + "0": left, path + "1": right}
        trees.append(inner)
        for at in leaves.values():
            s = g[at].sum() / B.UNIT
            margin[at] -= p.rate * math.copysign(max(abs(s) - p.l1, 0), s) / (h[at].sum() / B.UNIT + p.l2)
    return trees, 1 / (1 + np.exp(-margin))


@pytest.mark.parametrize("p", [B.Params(rounds=3, leaves=8, least_leaf=10, rate=0.3, bins=16), B.Params(rounds=2, leaves=5, least_leaf=40, l1=2.0, l2=5.0, column_share=0.5, bins=400)])
def test_trees_equal_a_plain_trainer(spark, p):
    rng = np.random.default_rng(3)
    a, b, c = rng.normal(0, 1, 600).round(2), rng.integers(0, 6, 600).astype(float), rng.exponential(50, 600)
    y = (a + (b > 3) * (c > 40) * 2 + rng.normal(0, 0.5, 600) > 0.5).astype(int)
    b[rng.random(600) < 0.1] = np.nan
    w = rng.choice((0.5, 1.0, 2.0), 600)
    data = [(i, float(a[i]), None if np.isnan(b[i]) else float(b[i]), float(c[i]), "no number", int(y[i]), float(w[i])) for i in range(600)]
    df = spark.createDataFrame([*data, (9999, 0.0, 0.0, 0.0, "1", None, 1.0)], "id long, a double, b double, c double, d string, y int, w double").repartition(5)
    names = ("a", "b", "c", "d")
    m = B.fit(df, names, "y", ("id",), p, "w")
    x = B._binned(np.stack([a, b, c, np.full(600, np.nan)], 1), m.cuts)
    for v, cuts, bins in ((a, m.cuts[0], x[:, 0]), (c, m.cuts[2], x[:, 2])):
        assert len(cuts) <= p.bins and cuts[-1] == v.max() and all(np.diff(cuts) > 0)
        if p.bins < 100:
            assert np.bincount(bins)[1:].max() < 3 * 600 / p.bins
    assert m.cuts[1] == [0, 1, 2, 3, 4, 5] and m.cuts[3] == []
    trees, prob = plain(x, y, w, None, names, p)
    assert [{k: (s.feature, s.bin, s.left[2], s.right[2]) for k, s in inner.items()} for inner, _ in m.trees] == trees
    got = {r.id: r.probability for r in m.scored(df.filter("y IS NOT NULL")).collect()}
    assert np.allclose([got[i] for i in range(600)], prob, atol=1e-9)


def test_one_class_no_rows_and_samples(spark):
    df = spark.range(400).selectExpr("id", "id % 20 AS a", "CAST(id % 20 > 9 AS INT) AS y")
    for part, want in (("y = 1", 1.0), ("y = 0", 0.0), ("false", 0.0)):
        m = B.fit(df.filter(part), ("a",), "y", ("id",))
        assert not m.trees and {r.probability for r in m.scored(df).collect()} == {want}
    p = B.Params(rounds=2, leaves=2, row_share=0.5, rate=0.5)
    m = B.fit(df, ("a",), "y", ("id",), p)
    assert m.splits() == B.fit(df.repartition(7), ("a",), "y", ("id",), p).splits()
    assert all(s["cut"] == 9 and 120 < s["n_left"] + s["n_right"] < 280 for s in m.splits()) and len(m.splits()) == 2
    assert m.scored(df.filter("false")).count() == 0
    none = B.fit(df, ("a",), "y", ("id",), B.Params(rounds=1, least_leaf=300))
    assert not none.trees and {round(r.probability, 9) for r in none.scored(df).collect()} == {0.5}


def test_heads_of_a_fold(spark):
    rng = np.random.default_rng(6)
    made = [(t, i, t % 2, float(t % 2 + rng.normal() / 4), "ab"[t % 2], ("train", "train", "valid", "test")[t // 2 % 4]) for t in range(320) for i in range(4)]  # a leaf takes 50 rows: of 80 first steps a side
    data = spark.createDataFrame(made, "traj_id long, prefix_step_idx int, label int, x double, c string, split string").selectExpr("*", "1.0D AS sample_weight")
    out, _ = features.run_fold(data, features.FeatureSet(("x", "prefix_step_idx"), ("c",)), predictor="t", kind="leafwise", min_step=1, rounds=4)
    rows = out.collect()
    assert {r.split for r in rows} == {"valid", "test"} and len(rows) == 640
    for head, want in (("success", 1), ("failure", 0)):
        p = {s: [r[f"prob_safe_{head}__t"] for r in rows if (r.label == want and r.prefix_step_idx >= 1) == s] for s in (True, False)}
        assert min(p[True]) > max(p[False])
