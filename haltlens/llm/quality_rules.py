"""Quality rules: base counts per document, then robust multivariate outliers per language and source.

Each document's counts become a short vector of transformed statistics. For each (language, source) the minimum covariance
determinant (MCD) estimate of centre and scatter is searched from several deterministic starts (Hubert et al., 2012: medians and absolute
deviations alone, with the correlations of bounded scores, with those of spatial signs). Each start takes concentration steps over *all* rows: the share
``support`` of rows nearest to the centre gives the next centre and scatter, until the determinant falls no more (each step but the last lowers its log
by more than ``FALL``, and the floors bound it below, so that steps end by themselves); the start with the least determinant wins. A document is rejected if its Mahalanobis distance under that estimate exceeds the chi-square quantile ``quantile``.

Every step is a map-side-combined aggregation of 1 + p + p(p+1)/2 sums per group and start, about the last centre, so a source with a third of all
rows costs no more than any other, and rows are never shuffled by group: estimates are sent to them (if there are over ``SENT`` of them, joined). The
nearest rows are told by a mergeable histogram of log distances, 256 bins an octave; rows of the bin in which the share ends count with the weight that
makes the share exact, so ties share alike. Medians, from which starts come, are exact medians of the values cut to 1/``GRID``, by a histogram, so that no
order of merging changes them. Groups below ``min_group`` rows pool by language, then together; a pool still below it is judged by
the estimate of all rows of the table (if there are five for each statistic; else documents stay). ``pool`` says which estimate judged a row.

Defined results: null text counts as no words (so it fails the base rule); null language or source is a group of its own;
repeated rows and ties count as often as they occur; very long texts are counted whole, a few at a time; an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, merged, only, sliced, written

_WORD = re.compile(WORD)
_SYMBOLS = re.compile(r"[#*$%&|<>]")
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
#: Smallest standard deviation that a statistic is credited with, in the order of ``vector``. A group in which a statistic hardly varies would otherwise reject the first document that differs at all.
FLOOR = (0.08, 0.35, 0.35, 0.12)
P = len(FLOOR)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
BINS = 256  # per doubling of the squared distance
#: Estimates sent to all executors; more are joined.
SENT = 100_000
STARTS = 3
#: A start ends when a step lowers the log of its determinant by no more than this.
FALL = 1e-9
#: Cells to a unit in which medians are told; all statistics lie between -1 and 50.
GRID = 4096


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = _WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif _WORD.search(line):
            seen.add(line)
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(first := set(windows)) < len(windows):
        more, first = set(), set()
        for w in windows:
            (more if w in first else first).add(w)
        end = 0
        for i, w in enumerate(windows):
            if w in more:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return len(words), sum(map(len, words)), len(_SYMBOLS.findall(text)), dup, repeated


def _stats(batches):
    for b in sliced(batches):
        rows = [text_stats(t) for t in b.column("text").to_pylist()]
        cols = list(zip(*rows)) if rows else [()] * 5
        keep = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(c, pa.int64()) for c in cols], keep + [x.split()[0] for x in STATS.split(", ")])


def document_stats(docs: DataFrame, keep: str = "doc_id long, lang string, source string") -> DataFrame:
    """The base counts of every row of ``docs`` (columns of ``keep`` and text)."""
    return docs.mapInArrow(_stats, f"{keep}, {STATS}")


def vector() -> list[Column]:
    """Transformed statistics: mean word length and symbol density on log scales, repeated lines on a log scale, repeated wording as an angle."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log((F.col("word_chars") + 1) / n),
        F.log1p(100 * F.col("n_symbols") / n),
        F.log1p(F.col("n_dup_lines").cast("double")),
        F.asin(F.sqrt(F.least(F.col("n_repeat_words") / n, F.lit(1.0)))),
    ]


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def chi2_cdf(x: float, k: float) -> float:
    if x <= 0:
        return 0.0
    a, h = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= h / n
        total += term
    return min(1.0, total * math.exp(-h + a * math.log(h) - math.lgamma(a)))


def chi2_quantile(q: float, k: float) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < q else (lo, mid)
    return hi


_ESTIMATE = ", ".join(["grp string", "start int", "logdet double", "done boolean", *[f"m{i} double" for i in range(P)], *[f"w{i}_{j} double" for i, j in PAIRS]])
_NAMES = [x.split()[0] for x in _ESTIMATE.split(", ")]


def _estimate(grp: pa.Array, start: np.ndarray, done: np.ndarray, centre: np.ndarray, scatter: np.ndarray, logdet: np.ndarray | None = None) -> pa.RecordBatch:
    logdet = np.linalg.slogdet(scatter)[1] if logdet is None else logdet
    inv = np.linalg.inv(scatter)
    return pa.RecordBatch.from_arrays([grp, pa.array(start, pa.int32()), pa.array(logdet), pa.array(done), *[pa.array(np.ascontiguousarray(centre[:, i])) for i in range(P)], *[pa.array(np.ascontiguousarray(inv[:, i, j])) for i, j in PAIRS]], _NAMES)


def _symmetric(d: dict, name: str) -> np.ndarray:
    out = np.zeros((len(d[f"{name}0_0"]), P, P))
    for i, j in PAIRS:
        out[:, i, j] = out[:, j, i] = d[f"{name}{i}_{j}"]
    return out


def _columns(b: pa.RecordBatch) -> dict:
    return {c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names if c != "grp"}


def _started(batches):
    """Medians, deviations and cross products of bounded scores and of signs to a first estimate for each start."""
    for b in batches:
        d = _columns(b)
        centre, spread = (np.stack([d[f"{c}{i}"] for i in range(P)], 1) for c in "ma")
        for k in range(STARTS):
            like = np.broadcast_to(np.eye(P), (len(centre), P, P)).copy() if k == 0 else _symmetric(d, "tu"[k - 1])
            size = np.sqrt(np.maximum(np.einsum("nii->ni", like), 1e-12))
            like = like / size[:, :, None] / size[:, None, :] * 0.999 + 0.001 * np.eye(P)
            yield _estimate(b.column("grp"), np.full(len(centre), k), np.zeros(len(centre), bool), centre, spread[:, :, None] * like * spread[:, None, :], np.full(len(centre), np.inf))


def _stepped(scale: float):
    """Sums about the last centre to the next estimate; ``scale`` makes the scatter consistent. A start is done when its determinant falls no more; then its last estimate stays."""

    def run(batches):
        for b in batches:
            d = _columns(b)
            n = d["n"].astype(float)
            shift = np.stack([d[f"s{i}"] / n for i in range(P)], 1)
            scatter = (_symmetric(d, "q") / n[:, None, None] - shift[:, :, None] * shift[:, None, :]) * scale + np.diag(np.square(FLOOR))
            logdet = np.linalg.slogdet(scatter)[1]
            worse = logdet >= d["logdet"] - FALL
            old = np.linalg.inv(_symmetric(d, "w"))
            centre = np.stack([d[f"m{i}"] for i in range(P)], 1)
            yield _estimate(b.column("grp"), d["start"], worse, np.where(worse[:, None], centre, centre + shift), np.where(worse[:, None, None], old, scatter), np.where(worse, d["logdet"], logdet))

    return run


def _distance(rows: DataFrame, estimate: DataFrame, how: str = "inner") -> DataFrame:
    d = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(P)]
    return rows.join(estimate, "grp", how).withColumn("d2", sum(((1 if i == j else 2) * F.col(f"w{i}_{j}") * d[i] * d[j] for i, j in PAIRS), F.lit(0.0)))


def medians(values: DataFrame, names: list[str]) -> DataFrame:
    """grp and, under each of ``names``, the lower median of that column of ``values`` cut down to 1/GRID; what is shuffled and ordered is counts of cells."""
    cells = values.select("grp", F.posexplode(F.array(*[F.floor(GRID * F.col(c)) for c in names])).alias("i", "cell")).groupBy("grp", "i", "cell").agg(F.count(F.lit(1)).alias("c"))
    per = W.partitionBy("grp", "i")
    upto = cells.withColumns({"upto": F.sum("c").over(per.orderBy("cell")), "all": F.sum("c").over(per)})
    mid = upto.filter("2 * upto >= all AND 2 * (upto - c) < all")
    return mid.groupBy("grp").agg(*[F.max(F.when(F.col("i") == i, F.col("cell") / F.lit(float(GRID)))).alias(c) for i, c in enumerate(names)])


def mcd(fit: DataFrame, groups: int, support: float) -> DataFrame:
    """grp, logdet, m<i> and w<i>_<j> (inverse scatter) of each group of ``fit`` (grp, x<i>): the least determinant that the starts reach."""
    sent = (lambda df: F.broadcast(df)) if groups * STARTS <= SENT else merged
    mid = written(medians(fit, [f"x{i}" for i in range(P)]).withColumnsRenamed({f"x{i}": f"m{i}" for i in range(P)}), "op5-medians")
    away = fit.join(sent(mid), "grp").select("grp", *[F.abs(F.col(f"x{i}") - F.col(f"m{i}")).alias(f"a{i}") for i in range(P)])
    dev = medians(away, [f"a{i}" for i in range(P)]).join(sent(mid), "grp")
    dev = written(dev.select("grp", *[f"m{i}" for i in range(P)], *[F.sqrt(F.pow(1.4826 * F.col(f"a{i}"), 2) + FLOOR[i] ** 2).alias(f"a{i}") for i in range(P)]), "op5-deviations")
    z = fit.join(sent(dev), "grp").select("grp", *[((F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"a{i}")).alias(f"z{i}") for i in range(P)])
    z = z.withColumn("r", F.greatest(F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)), F.lit(0.0))), F.lit(1e-9)))
    like = z.groupBy("grp").agg(*[F.avg(F.tanh(f"z{i}") * F.tanh(f"z{j}")).alias(f"t{i}_{j}") for i, j in PAIRS], *[F.avg(F.col(f"z{i}") * F.col(f"z{j}") / (F.col("r") * F.col("r"))).alias(f"u{i}_{j}") for i, j in PAIRS])
    now = written(dev.join(sent(like), "grp").mapInArrow(_started, _ESTIMATE), "op5-start")
    scale = support / chi2_cdf(chi2_quantile(support, P), P + 2)
    final = []
    per = W.partitionBy("grp", "start")
    while not now.isEmpty():
        near = _distance(fit, sent(now)).withColumn("bin", F.floor(BINS * F.log2(F.col("d2") + 1e-12)).cast("int"))
        counts = near.groupBy("grp", "start", "bin").agg(F.count(F.lit(1)).alias("c"))
        upto = counts.withColumns({"upto": F.sum("c").over(per.orderBy("bin")), "share": support * F.sum("c").over(per)})
        edge = upto.filter("upto >= share AND upto - c < share").select("grp", "start", F.col("bin").alias("edge"), ((F.col("share") - F.col("upto") + F.col("c")) / F.col("c")).alias("part"))
        held = near.join(sent(edge), ["grp", "start"]).filter("bin <= edge").withColumn("k", F.when(F.col("bin") < F.col("edge"), 1.0).otherwise(F.col("part")))
        held = held.withColumns({f"y{i}": F.col(f"x{i}") - F.col(f"m{i}") for i in range(P)})
        sums = held.groupBy("grp", "start").agg(F.sum("k").alias("n"), *[F.sum(F.col("k") * F.col(f"y{i}")).alias(f"s{i}") for i in range(P)], *[F.sum(F.col("k") * F.col(f"y{i}") * F.col(f"y{j}")).alias(f"q{i}_{j}") for i, j in PAIRS])
        now = written(sums.join(sent(now.drop("done")), ["grp", "start"]).mapInArrow(_stepped(scale), _ESTIMATE), "op5-estimate")
        final.append(now.filter("done"))
        now = now.filter("NOT done")
    every = reduce(DataFrame.unionByName, final, now.limit(0))
    rest = [c for c in _NAMES if c not in ("grp", "start", "done")]
    return written(every.groupBy("grp").agg(F.min_by(F.struct(*rest), F.struct("logdet", "start")).alias("e")).select("grp", "e.*"), "op5-final")


def verdicts(stats: DataFrame, *, support: float = 0.75, quantile: float = 1 - 1e-6, min_group: int = 200) -> DataFrame:
    """``stats`` (lang, source and the base counts, written already) with base_failed, pool, d2, cutoff and kept."""
    null = F.lit("\x00")
    lang, pair = F.coalesce("lang", null), F.concat_ws("\x01", F.coalesce("lang", null), F.coalesce("source", null))
    rows = stats.select("*", base_failed().alias("base_failed"), *[v.alias(f"x{i}") for i, v in enumerate(vector())], pair.alias("pair"), lang.alias("lg"))
    passed = rows.filter(~F.col("base_failed"))
    sizes = written(passed.groupBy("pair", "lg").agg(F.count(F.lit(1)).alias("c")), "op5-sizes")
    small = F.when(F.col("c") < min_group, F.col("c"))
    pools = sizes.groupBy("lg").agg(F.sum(small).alias("pooled"))
    everyone = sizes.agg(F.sum("c").alias("all"), F.count(F.lit(1)).alias("pairs")).first()
    sent = (lambda df: F.broadcast(df)) if everyone.pairs <= SENT else merged
    rest = sizes.join(sent(pools), "lg").filter((F.col("c") < min_group) & (F.col("pooled") < min_group)).agg(F.sum("c")).first()[0] or 0
    last = "\x03" if rest >= min_group else "\x04"
    names = sizes.join(sent(pools), "lg").select("pair", F.when(F.col("c") >= min_group, F.col("pair")).when(F.col("pooled") >= min_group, F.concat(F.lit("\x02"), "lg")).otherwise(last).alias("grp"))
    names = written(names, "op5-groups")
    rows = rows.drop("lg").join(sent(names), "pair", "left").drop("pair")
    fit = rows.filter(~F.col("base_failed")).select("grp", *[f"x{i}" for i in range(P)])
    if rest and last == "\x04":
        fit = fit.filter("grp <> '\x04'").unionByName(fit.withColumn("grp", F.lit("\x04"))) if (everyone["all"] or 0) >= 5 * P else fit.filter("grp <> '\x04'")
    estimate = mcd(fit, everyone.pairs, support).drop("logdet").withColumn("pool", F.col("grp"))
    out = _distance(rows, sent(estimate), "left").withColumn("cutoff", F.lit(chi2_quantile(quantile, P)))
    return out.select(*stats.columns, "base_failed", "pool", "d2", "cutoff", (~F.col("base_failed") & F.coalesce(F.col("d2") <= F.col("cutoff"), F.lit(True))).alias("kept"))


def quality(docs: DataFrame, **params) -> DataFrame:
    """Counts, distance and verdict for each row of ``docs`` (doc_id, text, lang, source)."""
    rows = only(docs, doc_id="doc_id", lang="lang", source="source", text="text")
    return verdicts(written(document_stats(rows), "op5-stats"), **params)
