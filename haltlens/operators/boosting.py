"""Boosted trees for a binary target: leaf-wise growth on second-order histograms, with L1 and L2 terms and a least leaf.

Values are binned once, at most ``bins`` a feature, and the rows carry their bins and margin. To split nodes takes one aggregation
by (node, feature, bin), combined before its exchange, so that what is shuffled and ranked is bounded by nodes, features and bins. Trees
grow best first: the leaf with the largest gain is split next. One aggregation looks at the children of as many of the best leaves as
splits are left, since no other leaf can be split before them; so a tree takes about as many aggregations as it is deep, and is the
same as one grown a split at a time. The driver holds one split a node.

Gradients are summed as whole numbers (units of 1/``UNIT``), so that neither the order of rows nor lost executors change a split; ties go
to the first feature, then the lowest bin. Rows are rewritten with their margin once a round, to the session's shared folder.

Defined results: missing values (null, NaN, infinite, no number) are a bin below all others; a feature without a value, or with one only, is never split at; rows without a
target are left out of training; one class, or too few rows for a split, gives trees without splits or none; repeated rows count as often as they occur.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from haltlens.sources import tables

UNIT = 1 << 20
#: Cells in which a feature's values are counted for its bins.
CELLS = 65_536


@dataclass(frozen=True)
class Params:
    rounds: int = 100
    rate: float = 0.05
    leaves: int = 31
    l1: float = 0.1
    l2: float = 1.0
    least_leaf: int = 50
    least_hessian: float = 1e-3
    row_share: float = 1.0
    column_share: float = 0.9
    bins: int = 255
    seed: int = 0


@dataclass(frozen=True)
class Split:
    feature: int
    bin: int
    gain: float
    left: tuple[int, int, int]  # gradient and hessian in units, rows
    right: tuple[int, int, int]


@dataclass
class Model:
    features: tuple[str, ...]
    cuts: list[list[float]]
    start: float
    rate: float
    trees: list[tuple[dict[str, Split], dict[str, float]]] = field(default_factory=list)

    def splits(self) -> list[dict]:
        """A row for each split: tree, node (its path from the root, 0 for left), feature, the largest value that goes left (none: missing ones only), gain, rows on each side."""
        out = []
        for t, (inner, _) in enumerate(self.trees):
            for path, s in inner.items():
                out.append({"tree": t, "node": path, "feature": self.features[s.feature], "cut": self.cuts[s.feature][s.bin - 1] if s.bin else None, "gain": s.gain, "n_left": s.left[2], "n_right": s.right[2]})
        return out

    def margins(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.start)
        for inner, values in self.trees:
            todo = [("", np.arange(len(bins)))]
            while todo:
                path, at = todo.pop()
                if path in values:
                    out[at] += values[path]
                else:
                    left = bins[at, inner[path].feature] <= inner[path].bin
                    todo += [(path + "0", at[left]), (path + "1", at[~left])]
        return out

    def scored(self, rows: DataFrame, column: str = "probability") -> DataFrame:
        """``rows`` with the probability of target 1."""

        @F.pandas_udf("double")
        def of(x: pd.Series) -> pd.Series:
            return pd.Series(1 / (1 + np.exp(-self.margins(_binned(np.array(x.tolist(), float).reshape(len(x), len(self.features)), self.cuts)))))

        return rows.withColumn(column, of(_values(self.features)))


def _values(features: tuple[str, ...]) -> Column:
    """The features as one array of doubles; missing ones are NaN."""
    known = lambda v: F.when(F.abs(v) < F.lit(math.inf), v).otherwise(F.lit(math.nan))
    return F.array(*[known(F.col(f).try_cast("double")) for f in features])


def _binned(x: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    """Bin 0 for missing values, else the first bin whose largest value is no smaller; above all of them the last."""
    out = np.zeros(x.shape, np.int32)
    for i, c in enumerate(cuts):
        if c:
            out[:, i] = np.where(np.isnan(x[:, i]), 0, np.minimum(np.searchsorted(c, x[:, i]), len(c) - 1) + 1)
    return out


def feature_cuts(rows: DataFrame, features: tuple[str, ...], bins: int = 255) -> list[list[float]]:
    """The largest value of each bin of each feature: bins of about equal counts over cells of its values (finer towards its least), a cell each where there are no more cells than bins."""
    x = rows.select(F.posexplode(_values(features)).alias("i", "x")).filter(~F.isnan("x"))
    ends = x.groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    share = (F.col("x") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    cells = x.join(F.broadcast(ends), "i").groupBy("i", F.coalesce(F.floor((CELLS - 1) * F.sqrt(F.sqrt(share))), F.lit(0)).alias("cell")).agg(F.count(F.lit(1)).alias("c"), F.max("x").alias("top"))
    per = W.partitionBy("i")
    up = cells.withColumns({"before": F.sum("c").over(per.orderBy("cell")) - F.col("c"), "all": F.sum("c").over(per), "nth": F.row_number().over(per.orderBy("cell")), "n": F.count(F.lit(1)).over(per)})
    up = up.withColumn("bin", F.when(F.col("n") <= bins, F.col("nth").cast("long")).otherwise(F.expr(f"before * {bins} div all")))
    out: list[list[float]] = [[] for _ in features]
    for r in up.groupBy("i", "bin").agg(F.max("top").alias("top")).orderBy("i", "bin").collect():  # at most features x bins
        out[r.i].append(r.top)
    return out


def _route(path: str, wanted: list[str], known: dict[str, Split | None]) -> Column:
    """Which of the wanted nodes a row falls into, by its bins."""
    if path in wanted:
        return F.lit(wanted.index(path))
    if not any(w.startswith(path) for w in wanted):
        return F.lit(None).cast("int")
    s = known[path]
    return F.when(F.col("bins")[s.feature] <= s.bin, _route(path + "0", wanted, known)).otherwise(_route(path + "1", wanted, known))


def _pull(g: Column, h: Column, p: Params) -> Column:
    g = F.greatest(F.abs(g) / UNIT - p.l1, F.lit(0.0))
    return g * g / (h / UNIT + p.l2)


def best_splits(data: DataFrame, wanted: list[str], known: dict[str, Split | None], columns: list[int], p: Params) -> dict[str, Split | None]:
    """The best split of each of the wanted nodes of ``data`` (bins, g, h), or none."""
    sums = data.select(_route("", wanted, known).alias("node"), "g", "h", F.array(*[F.struct(F.lit(i).alias("i"), F.col("bins")[i].alias("bin")) for i in columns]).alias("x"))
    sums = sums.filter("node IS NOT NULL").select("node", "g", "h", F.explode("x").alias("x")).groupBy("node", "x.i", "x.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("n"))
    per = W.partitionBy("node", "i")
    cut = sums.select("node", "i", "bin", *[F.sum(c).over(per.orderBy("bin")).alias(f"l{c}") for c in "ghn"], *[F.sum(c).over(per).alias(f"a{c}") for c in "ghn"])
    cut = cut.withColumns({f"r{c}": F.col(f"a{c}") - F.col(f"l{c}") for c in "ghn"})
    cut = cut.filter((F.least("ln", "rn") >= max(1, p.least_leaf)) & (F.least("lh", "rh") >= p.least_hessian * UNIT))
    c = F.col
    cut = cut.withColumn("gain", _pull(c("lg"), c("lh"), p) + _pull(c("rg"), c("rh"), p) - _pull(c("ag"), c("ah"), p)).filter("gain > 0")
    best = cut.groupBy("node").agg(F.max(F.struct("gain", (-c("i")).alias("i"), (-c("bin")).alias("bin"), "lg", "lh", "ln", "rg", "rh", "rn")).alias("b"))
    out: dict[str, Split | None] = dict.fromkeys(wanted)
    for r in best.select("node", "b.*").collect():  # one row a node
        out[wanted[r.node]] = Split(-r.i, -r.bin, r.gain, (r.lg, r.lh, r.ln), (r.rg, r.rh, r.rn))
    return out


def grow(data: DataFrame, columns: list[int], p: Params) -> dict[str, Split]:
    """The splits of one tree, best first."""
    best = best_splits(data, [""], {}, columns, p)
    leaves, inner = [""], {}
    while len(leaves) < p.leaves:
        able = sorted((x for x in leaves if best[x]), key=lambda x: (-best[x].gain, len(x), x))
        if not able:
            break
        first, left = able[0], p.leaves - len(leaves)
        if first + "0" not in best and left > 1:
            best |= best_splits(data, [c + s for c in able[:left] if c + "0" not in best for s in "01"], best, columns, p)
        inner[first] = best[first]
        leaves.remove(first)
        leaves += [first + "0", first + "1"]
    return inner


def leaf_values(inner: dict[str, Split], p: Params) -> dict[str, float]:
    out = {}
    for path, s in inner.items():
        for side, (g, h, _) in (("0", s.left), ("1", s.right)):
            if path + side not in inner:
                g /= UNIT
                out[path + side] = -p.rate * math.copysign(max(abs(g) - p.l1, 0.0), g) / (h / UNIT + p.l2)
    return out


def _value(path: str, inner: dict[str, Split], values: dict[str, float]) -> Column:
    if path in values:
        return F.lit(values[path])
    s = inner[path]
    return F.when(F.col("bins")[s.feature] <= s.bin, _value(path + "0", inner, values)).otherwise(_value(path + "1", inner, values))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fit(rows: DataFrame, features: tuple[str, ...], label: str, key: tuple[str, ...], p: Params = Params(), weight: str | None = None) -> Model:
    """``rows`` with a 0/1 ``label``; ``key``: columns by whose hash rows are sampled in each round."""
    spark = rows.sparkSession
    used = rows.filter(F.col(label).isNotNull())
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    cuts = feature_cuts(used, features, p.bins)

    def run(batches):
        for b in batches:
            x = np.asarray(b.column("x").flatten().to_numpy(zero_copy_only=False), float).reshape(b.num_rows, len(features))
            bins = _binned(x, cuts)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(bins) + 1, dtype=np.int32) * len(features)), pa.array(bins.ravel()))
            yield pa.RecordBatch.from_arrays([flat, b.column("y"), b.column("w"), b.column("k")], ["bins", "y", "w", "k"])

    base = used.select(_values(features).alias("x"), F.col(label).cast("double").alias("y"), w.alias("w"), F.xxhash64(*key).alias("k"))
    total = base.agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("y")).first()
    mean = total.y / total.w if total.w else 0.0
    if not 0 < mean < 1:  # one class
        return Model(features, cuts, math.inf if mean else -math.inf, p.rate)
    model = Model(features, cuts, math.log(mean / (1 - mean)), p.rate)
    folder, old = tables.scratch(spark, "boosted"), None
    data = base.mapInArrow(run, "bins array<int>, y double, w double, k long").withColumn("margin", F.lit(model.start))
    for t in range(p.rounds):
        path = f"{folder}/{t}"
        data.write.parquet(path)
        data = spark.read.schema(data.schema).parquet(path)
        if old:
            _delete(spark, old)
        old, prob = path, 1 / (1 + F.exp(-F.col("margin")))
        whole = lambda v: F.floor(v * UNIT + 0.5)
        seen = data.filter(F.pmod(F.xxhash64("k", F.lit(p.seed), F.lit(t)), F.lit(UNIT)) < p.row_share * UNIT)
        rank = sorted(range(len(features)), key=lambda i, t=t: hashlib.md5(f"{p.seed}/{t}/{features[i]}".encode()).digest())
        columns = sorted(rank[: max(1, math.ceil(p.column_share * len(features)))])
        inner = grow(seen.select("bins", whole(F.col("w") * (prob - F.col("y"))).alias("g"), whole(F.col("w") * prob * (1 - prob)).alias("h")), columns, p)
        if not inner:
            if p.row_share >= 1 and p.column_share >= 1:
                break
            continue
        values = leaf_values(inner, p)
        model.trees.append((inner, values))
        data = data.withColumn("margin", F.col("margin") + _value("", inner, values))
    if old:
        _delete(spark, folder)
    return model
