"""Singular values and vectors against numpy's, from dense and sparse rows."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import types as T

from haltlens.operators import factors, features

SCHEMA = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("x", VectorUDT())])


def frame(spark, a, parts=5):
    row = lambda r: Vectors.sparse(len(r), [(int(j), float(r[j])) for j in np.flatnonzero(r)])
    return spark.createDataFrame([(i, Vectors.dense(r) if i % 7 == 0 else row(r)) for i, r in enumerate(a)], SCHEMA).repartition(parts)


def sparse(rng, n, d, share=0.1):
    return rng.standard_normal((n, d)) * (rng.random((n, d)) < share)


@pytest.mark.parametrize("n, d, k", [(300, 80, 10), (60, 200, 20), (40, 12, 11)])
def test_values_and_projection_as_numpy(spark, monkeypatch, n, d, k):
    monkeypatch.setattr(factors, "ENTRIES", 100)
    a = sparse(np.random.default_rng(n), n, d)
    a[3] = 0
    df = frame(spark, a)
    model = factors.TruncatedSVD(inputCol="x", outputCol="f", k=k).fit(df)
    f = model.factors
    _, s, v = np.linalg.svd(a)
    assert f.converged and f.passes <= 40
    np.testing.assert_allclose(f.values, s[:k], rtol=1e-6)
    v = v[:k].T * np.sign((v[:k].T * f.vectors).sum(axis=0))
    got = {r.id: r.f.toArray() for r in model.transform(df).select("id", "f").collect()}
    np.testing.assert_allclose(np.array([got[i] for i in range(n)]), a @ v, atol=1e-5)
    assert (f.vectors[np.abs(f.vectors).argmax(axis=0), range(k)] > 0).all()


def test_rank_and_repeated_values(spark):
    rng = np.random.default_rng(1)
    low = rng.standard_normal((50, 3)) @ rng.standard_normal((3, 30))
    f = factors.TruncatedSVD(inputCol="x", outputCol="f", k=8).fit(frame(spark, low)).factors
    assert len(f.values) == 3 and f.converged
    np.testing.assert_allclose(f.values, np.linalg.svd(low, compute_uv=False)[:3], rtol=1e-6)
    same = np.vstack([np.eye(20)] * 3)  # every singular value is the root of three
    f = factors.TruncatedSVD(inputCol="x", outputCol="f", k=5).fit(frame(spark, same)).factors
    np.testing.assert_allclose(f.values, [3**0.5] * 5, rtol=1e-9)
    np.testing.assert_allclose(f.vectors.T @ f.vectors, np.eye(5), atol=1e-9)


def test_nothing_to_fit(spark):
    svd = factors.TruncatedSVD(inputCol="x", outputCol="f", k=4)
    for rows in ([], [(0, None)], [(0, Vectors.dense([1.0, 2.0, 3.0]))], [(i, Vectors.dense([1.0, float(i)])) for i in range(9)], [(i, Vectors.sparse(6, [])) for i in range(9)]):
        df = spark.createDataFrame(rows, SCHEMA)
        model = svd.fit(df)
        assert len(model.factors.values) == 0
        assert [None if r.f is None else len(r.f) for r in model.transform(df).collect()] == [None if x is None else 0 for _, x in rows]


def test_nulls_pass_and_add_nothing(spark):
    a = sparse(np.random.default_rng(2), 30, 9, 0.5)
    df = frame(spark, a).unionByName(spark.createDataFrame([(99, None)], SCHEMA))
    model = factors.TruncatedSVD(inputCol="x", outputCol="f", k=3).fit(df)
    np.testing.assert_allclose(model.factors.values, np.linalg.svd(a, compute_uv=False)[:3], rtol=1e-6)
    assert model.transform(df).filter("id = 99").first().f is None


def test_texts_by_factors(spark):
    rng = np.random.default_rng(3)
    words = [f"word{i}" for i in range(40)]
    rows = [(" ".join(rng.choice(words[20 * (i % 2) : 20 * (i % 2) + 25], 12)), float(i)) for i in range(60)]
    df = features.prepared(spark.createDataFrame(rows, "text string, n double"), features.FeatureSet(("n",), (), ("text",), min_df=2, factors=6))
    model = features.feature_pipeline(features.FeatureSet(("n",), (), ("text",), min_df=2, factors=6)).fit(df)
    out = model.transform(df).select("text_v", "features").collect()
    x = np.array([r.text_v.toArray() for r in out])
    s = np.linalg.svd(x, compute_uv=False)
    assert all(len(r.features) == 7 for r in out)
    np.testing.assert_allclose(np.linalg.norm([r.features.toArray()[1:] for r in out], axis=0), s[:6], rtol=1e-5)
