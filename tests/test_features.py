"""Features fitted by different texts against Spark's own fits over all rows, and what a pass over examples holds."""

import numpy as np
from pyspark.sql import functions as F

from haltlens.operators import features
from haltlens.plans import catalog

SF = "/root/testdata/sf0.001"
TEXTS = ["", "a", "one", "One two", "one two one two", "x  yy\nzz yy zz", "ÉTÉ çà K22 one", "two one"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_counted_once_fit_as_all_rows_do(spark, monkeypatch):
    rows = [(i, TEXTS[i % 8], "ab"[i % 2], float(i)) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, text string, c string, n double")
    for least, vocabulary in ((1, 100), (30, 100)):
        f = features.FeatureSet(("n",), ("c",), ("text",), min_df=least, vocabulary=vocabulary)
        x = features.prepared(df, f)
        plain, model = features.feature_pipeline(f).fit(x), features.fit_features(x, f)
        terms, mine = plain.stages[5].vocabulary, model.stages[1].stages[3].vocabulary
        assert sorted(terms) == sorted(mine)
        order = [0, 1, 2, 3, *(4 + mine.index(t) for t in terms)]  # a number, three categories, terms
        want = {r.id: r.features.toArray() for r in plain.transform(x).select("id", "features").collect()}
        unseen = features.prepared(df.unionByName(spark.createDataFrame([(99, "two new words", "z", 1.0)], df.schema)), f)
        for few in (features.TEXTS, 0):
            monkeypatch.setattr(features, "TEXTS", few)
            got = features.featured(unseen, f, model)
            assert got.columns == [*unseen.columns, "features"]
            at = {r.id: r.features.toArray() for r in got.select("id", "features").collect()}
            assert len(at) == 91 and all(len(v) == len(order) for v in at.values())
            for i, v in want.items():
                np.testing.assert_allclose(at[i][order], v, rtol=1e-12)
        monkeypatch.undo()


def test_the_largest_terms_are_kept(spark):
    df = spark.createDataFrame([("aa aa aa bb",), ("bb cc",), ("bb",)] * 4, "text string")
    model = features.fit_features(df, features.FeatureSet(text=("text",), min_df=1, vocabulary=2))
    assert model.stages[0].stages[3].vocabulary == ["aa", "bb"]


def test_classes_are_counted_before_the_passes(spark):
    df = spark.createDataFrame([(1.0, 2.0)] * 6 + [(0.0, 1.0)] * 3 + [(None, 1.0)], "y double, sample_weight double")
    got = features.balanced_weights(df, "y")
    assert "Join" not in _plan(got) and "Exchange" not in _plan(got)
    assert {(r[0], r[1]) for r in got.collect()} == {(1.0, 2.0 * 10 / 12), (0.0, 1.0 * 10 / 6)} and got.count() == 9


def test_examples_are_numbered_once(spark):
    got = catalog._examples(spark, SF)
    assert "Join" not in _plan(got) and _plan(got).count("Window [") == 1
    n, keys = got.agg(F.count(F.lit(1)), F.count_distinct("traj_id", "prefix_step_idx")).first()
    assert n == keys == spark.read.parquet(f"{SF}/events.parquet").filter("user_id IS NOT NULL").count()
