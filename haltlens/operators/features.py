"""Features and models on Spark ML: text, categories and numbers to one vector, two heads, calibration, scores.

The heads' targets are an assumption of this engine (no definition is published): from ``min_step`` on, a prefix of a solved
trajectory is safe to call success, one of an unsolved trajectory safe to call failure; earlier prefixes are neither.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, CountVectorizerModel, ElementwiseProduct, NGram, Normalizer, OneHotEncoder, RegexTokenizer, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haltlens.functions.scalars import number
from haltlens.operators import boosting
from haltlens.operators.factors import TruncatedSVD
from haltlens.sources import tables


@dataclass(frozen=True)
class FeatureSet:
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    text: tuple[str, ...] = ()
    min_df: int = 5
    vocabulary: int = 30_000
    factors: int = 0
    profiles: dict[str, tuple[str, ...]] = field(default_factory=dict)


def columns_for(columns: list[str], preset: str) -> list[str]:
    """'process' leaves reference answers (gold_*) out; 'rich' keeps all."""
    if preset not in ("process", "rich"):
        raise ValueError(f"unknown preset {preset}")
    return [c for c in columns if preset == "rich" or not c.startswith("gold_")]


def safe_targets(rows: DataFrame, min_step: int = 10) -> DataFrame:
    late = F.col("prefix_step_idx") >= min_step
    return rows.withColumns({"y_success": (late & (F.col("label") == 1)).cast("double"), "y_failure": (late & (F.col("label") == 0)).cast("double")})


def balanced_weights(rows: DataFrame, label: str, weight: str = "sample_weight") -> DataFrame:
    """Weights times n / (2 n_class); the classes are counted here, once, not by each pass over the rows. Rows without a class go, but count in n."""
    n = {r[0]: r[1] for r in rows.groupBy(label).agg(F.count(F.lit(1))).collect()}
    total, of = sum(n.values()), F.lit(None).cast("long")
    for value, c in n.items():
        if value is not None:
            of = F.when(F.col(label) == value, F.lit(c).cast("long")).otherwise(of)
    return rows.filter(F.col(label).isNotNull()).withColumn(weight, F.col(weight) * F.lit(total).cast("long") / (2 * of))


def _category(c: str) -> list:
    return [StringIndexer(inputCol=c, outputCol=f"{c}_ix", handleInvalid="keep", stringOrderType="alphabetAsc"), OneHotEncoder(inputCol=f"{c}_ix", outputCol=f"{c}_hot", dropLast=True, handleInvalid="keep")]


def _terms(c: str) -> list:
    """Words of a text and pairs of neighbouring ones."""
    return [RegexTokenizer(inputCol=c, outputCol=f"{c}_w", pattern=r"\w\w+", gaps=False), NGram(n=2, inputCol=f"{c}_w", outputCol=f"{c}_2"), SQLTransformer(statement=f"SELECT *, concat({c}_w, {c}_2) AS {c}_t FROM __THIS__")]


def _assembler(f: FeatureSet) -> VectorAssembler:
    return VectorAssembler(inputCols=[*(f"{c}_num" for c in f.numeric), *(f"{c}_hot" for c in f.categorical), *(f"{c}_f" if f.factors else f"{c}_v" for c in f.text)], outputCol="features")


def feature_pipeline(f: FeatureSet) -> Pipeline:
    """Numbers; one-hot categories (unseen ones all zero); TF-IDF of one- and two-word terms with 1 + log counts, unit length; with ``factors``, as many coordinates on the largest singular vectors in place of the terms."""
    stages = [x for c in f.categorical for x in _category(c)]
    for c in f.text:
        stages += [*_terms(c), CountVectorizer(inputCol=f"{c}_t", outputCol=f"{c}_n", minDF=f.min_df, vocabSize=f.vocabulary), IDF(inputCol=f"{c}_n", outputCol=f"{c}_i"), Normalizer(inputCol=f"{c}_i", outputCol=f"{c}_v")]
        if f.factors:
            stages.append(TruncatedSVD(inputCol=f"{c}_v", outputCol=f"{c}_f", k=f.factors))
    return Pipeline(stages=[*stages, _assembler(f)])


def _weighted_terms(rows: DataFrame, c: str, f: FeatureSet) -> PipelineModel:
    """The text stages of ``feature_pipeline`` as fitted on ``rows``; each different text is split once, whatever the rows that have it."""
    texts = tables.kept(rows.groupBy(c).agg(F.count(F.lit(1)).alias("_rows")), "texts")
    once, t = PipelineModel(_terms(c)), F.col(f"{c}_t")
    told = lambda terms, uses, docs: F.transform(terms, lambda x: F.struct(x.alias("term"), F.lit(uses).alias("uses"), F.lit(docs).alias("docs")))
    each = once.transform(texts).select("_rows", F.explode(F.concat(told(t, 1, 0), told(F.array_distinct(t), 0, 1))).alias("x"))
    n = each.groupBy("x.term").agg(F.sum(F.col("_rows") * F.col("x.uses")).alias("uses"), F.sum(F.col("_rows") * F.col("x.docs")).alias("docs"))
    known = n.filter(F.col("docs") >= f.min_df).orderBy(F.desc("uses"), "term").limit(f.vocabulary).collect()
    if not known:
        return Pipeline(stages=feature_pipeline(FeatureSet(text=(c,), min_df=f.min_df, vocabulary=f.vocabulary)).getStages()[:-1]).fit(rows)
    total = texts.agg(F.sum("_rows")).first()[0]
    counts = CountVectorizerModel.from_vocabulary([r["term"] for r in known], inputCol=f"{c}_t", outputCol=f"{c}_n")
    idf = ElementwiseProduct(scalingVec=Vectors.dense([math.log((total + 1.0) / (r["docs"] + 1.0)) for r in known]), inputCol=f"{c}_n", outputCol=f"{c}_i")
    return PipelineModel([*_terms(c), counts, idf, Normalizer(inputCol=f"{c}_i", outputCol=f"{c}_v")])


def fit_features(rows: DataFrame, f: FeatureSet) -> PipelineModel:
    """``feature_pipeline`` fitted on ``rows``, its stages by column; terms of equal counts may lie in another order."""
    if f.factors:
        return feature_pipeline(f).fit(rows)
    return PipelineModel([*[Pipeline(stages=_category(c)).fit(rows) for c in f.categorical], *[_weighted_terms(rows, c, f) for c in f.text], _assembler(f)])


#: So many different texts are sent to all tasks with their vectors; with more, each row's text is made a vector by itself.
TEXTS = 10_000


def featured(rows: DataFrame, f: FeatureSet, model: PipelineModel) -> DataFrame:
    """``rows`` with the features of a model of ``fit_features``: a few texts that many rows share become vectors once. Passes over ``rows`` to see whether they are few."""
    if f.factors:
        return model.transform(rows)
    kept, n = rows.columns, len(f.categorical)
    for c, stages in zip(f.text, model.stages[n : n + len(f.text)]):
        texts = tables.kept(rows.select(c).distinct(), "texts")
        if texts.count() <= TEXTS:
            rows = rows.join(F.broadcast(stages.transform(texts).select(c, f"{c}_v")), c, "left")
        else:
            rows = stages.transform(rows)
    return PipelineModel([*model.stages[:n], model.stages[-1]]).transform(rows).select(*kept, "features")


def prepared(rows: DataFrame, f: FeatureSet) -> DataFrame:
    return rows.withColumns({f"{c}_num": number(c) for c in f.numeric} | {c: F.coalesce(F.col(c).cast("string"), F.lit("__NULL__" if c in f.categorical else "")) for c in (*f.categorical, *f.text)})


def _spread(rows: DataFrame, width: int) -> DataFrame:
    """The features as columns _f0, _f1, ..."""
    return rows.withColumn("_a", vector_to_array("features")).withColumns({f"_f{i}": F.col("_a")[i] for i in range(width)})


@dataclass
class Head:
    """A fitted head: a model, or the constant where training saw one class, and its calibration."""

    model: object | None
    constant: float | None = None
    slope: float | None = None
    shift: float | None = None
    iterations: int | None = None
    converged: bool | None = None

    def scored(self, rows: DataFrame, raw: str, calibrated: str) -> DataFrame:
        if self.model is None:
            rows = rows.withColumn(raw, F.lit(float(self.constant)))
        else:
            kept = rows.columns
            if isinstance(self.model, boosting.Model):
                rows = self.model.scored(_spread(rows, len(self.model.features)), raw).select(*kept, raw)
            else:
                rows = self.model.transform(rows).withColumn(raw, vector_to_array("probability")[1]).select(*kept, raw)
        fitted = F.col(raw) if self.slope is None else 1 / (1 + F.exp(-(F.lit(self.slope) * F.col(raw) + F.lit(self.shift))))
        return rows.withColumn(calibrated, fitted)


def fit_head(train: DataFrame, label: str, *, kind: str = "gbt", seed: int = 0, weight: str = "sample_weight", rounds: int = 20) -> Head:
    """``kind``: lr (logistic), gbt (Spark's trees, by level) or leafwise (``boosting``)."""
    classes = [r[0] for r in train.select(label).distinct().limit(3).collect()]
    if len(classes) == 1:
        return Head(None, float(classes[0]))
    if kind == "lr":
        lr = LogisticRegression(labelCol=label, weightCol=weight, maxIter=100, regParam=0.01)
        m = lr.fit(train)
        return Head(m, iterations=m.summary.totalIterations, converged=m.summary.totalIterations < lr.getMaxIter())
    if kind == "leafwise":  # for features of a bounded width: numbers, categories, factors of texts
        width = train.select(F.size(vector_to_array("features"))).first()[0]
        return Head(boosting.fit(_spread(train, width), tuple(f"_f{i}" for i in range(width)), label, ("features",), boosting.Params(rounds=rounds, seed=seed), weight))
    return Head(GBTClassifier(labelCol=label, weightCol=weight, maxIter=rounds, maxDepth=5, seed=seed).fit(train))


def calibrate(head: Head, valid: DataFrame, label: str, weight: str = "sample_weight") -> Head:
    """Platt's sigmoid on validation scores; left as it is where they show one class."""
    rows = head.scored(valid, "_raw", "_same").select(F.col("_raw"), label, weight, array_to_vector(F.array("_raw")).alias("_v"))
    if head.model is None or rows.select(label).distinct().count() < 2:
        return head
    m = LogisticRegression(featuresCol="_v", labelCol=label, weightCol=weight).fit(rows)
    return replace(head, slope=float(m.coefficients[0]), shift=float(m.intercept))


def run_fold(rows: DataFrame, f: FeatureSet, *, predictor: str = "gbt", kind: str = "gbt", min_step: int = 10, rounds: int = 20) -> tuple[DataFrame, PipelineModel]:
    """``rows`` with split (train, valid, test): fitted on train, calibrated on valid; valid and test with their probability columns."""
    # each fit passes over its rows many times: what these are made from is read and exchanged once
    data = tables.kept(safe_targets(prepared(rows, f), min_step), "examples")
    features = fit_features(data.filter("split = 'train'"), f)
    learnt = tables.kept(featured(data, f, features), "examples-features")
    out = learnt.filter("split in ('valid', 'test')")
    for i, head in enumerate(("success", "failure")):
        y = f"y_{head}"
        h = calibrate(fit_head(learnt.filter("split = 'train'"), y, kind=kind, seed=97 * i, rounds=rounds), learnt.filter("split = 'valid'"), y)
        out = h.scored(out, f"prob_safe_{head}__{predictor}", f"prob_cal_safe_{head}__{predictor}")
    return out.drop("features"), features


def one_hot(rows: DataFrame, column: str, vocabulary: list[str]) -> DataFrame:
    """A column of 0 and 1 for each value of a given vocabulary; other values, and none, are all 0."""
    return rows.withColumns({f"{column}={v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in vocabulary})


def run_variants(rows: DataFrame, variants: dict[str, FeatureSet], *, label: str = "y_success", min_step: int = 10) -> tuple[DataFrame, list[dict]]:
    """One logistic head for each set of features, classes balanced: valid and test rows with prob_<variant>, and for each variant its iterations and whether they converged."""
    rows = tables.kept(safe_targets(rows, min_step), "examples")
    data = balanced_weights(rows.filter("split = 'train'"), label)
    out, told = rows.filter("split in ('valid', 'test')"), []
    for name, f in variants.items():
        model = fit_features(prepared(data, f), f)
        learnt = tables.kept(featured(prepared(data, f), f, model).select("features", "sample_weight", label), "features")
        head = fit_head(learnt, label, kind="lr")
        kept = out.columns
        out = head.scored(model.transform(prepared(out, f)), f"prob_{name}", f"_cal_{name}").select(*kept, f"prob_{name}")
        told.append({"variant": name, "iterations": head.iterations, "converged": head.converged, "constant": head.constant})
    return out, told
