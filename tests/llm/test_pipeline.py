import re

import corpus_pipeline
from haltlens.llm import queries, simhash_dedup

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, docs, odd, empty, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "pii", "packing"]
    now, sizes = docs, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, DATA)
        now.write.parquet(str(tmp_path / str(i)))
        now = spark.read.parquet(str(tmp_path / str(i)))
        sizes.append(now.count())
        if i < 4:
            assert now.columns == docs.columns
            assert now.select("doc_id").distinct().count() == now.count()
        if name == "near dedup":
            assert simhash_dedup.near_duplicates(now).filter("doc_id <> component_id").count() == 0
        if name == "pii":
            before = spark.read.parquet(str(tmp_path / str(i - 1)))
            mails = {m for r in before.collect() for m in re.findall(r"[\w.]+@[\w.]+\.com", r.text)}
            assert mails and not any(m in r.text for r in now.collect() for m in mails)
    assert docs.count() > sizes[0] >= sizes[1] >= sizes[2] == sizes[3] <= sizes[4]


def test_run_equals_stages(spark, tmp_path):
    now = spark.read.parquet(f"{DATA}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, DATA).write.parquet(str(tmp_path / str(i)))
        now = spark.read.parquet(str(tmp_path / str(i)))
    whole = corpus_pipeline.run(spark, DATA)
    assert whole.columns == now.columns and sorted(map(tuple, whole.collect())) == sorted(map(tuple, now.collect()))


def test_rows_not_ids_decide(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(1, good), (1, "too short"), (1, good), (None, good + " end"), (2, None), (3, good.upper()), (4, " ".join(f"other{i}" for i in range(90)))]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.quality(spark, docs, DATA).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "1", "3", "4", "None"] and all(len(r.text) > 99 for r in kept)
    one = corpus_pipeline.near_dedup(spark, docs, DATA).collect()
    assert sorted(str(r.doc_id) for r in one if len(r.text or "") > 99) == ["1", "4"] and sum(r.doc_id == 2 for r in one) + sum(r.text == "too short" for r in one) == 2


def test_line_dedup_keeps_what_is_left(spark):
    footer = "this is a footer of many sites"
    rows = [(1, footer), (2, f"{footer}\nroses red\nviolets blue"), (3, f"{footer}\n世界中の人々"), (4, f"{footer}\n---")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, DATA).collect()}
    assert got == {1: footer, 2: "roses red\nviolets blue", 3: "世界中の人々"}


def test_odd_rows(spark, odd, empty, docs):
    rows = odd.withColumn("n_chars", odd.n_lines.cast("long"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0, name
        out = stage(spark, rows, DATA)
        if name == "packing":  # the very long text is many pieces; nothing of any row is lost
            assert out.agg({"length": "sum"}).first()[0] == sum(len((r.text or "").encode()) + 1 for r in rows.collect())
        else:
            assert out.columns == docs.select("doc_id", "text", "lang", "source", "n_chars").columns and out.count() <= rows.count(), name


def test_queries_name_all_operators():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))


def test_nulls_in_other_places_are_other_rows(spark):
    rows = spark.createDataFrame([(1, "t", None, "x"), (1, "t", "x", None), (1, None, "t", "x"), (None, "t", "x", None), (1, "t", None, "x")], "doc_id long, text string, lang string, source string")
    assert rows.select(corpus_pipeline._row()).distinct().count() == rows.select(corpus_pipeline._check()).distinct().count() == 4
    stay = corpus_pipeline.near_dedup(spark, rows.selectExpr("*", "1L AS n_chars"), "").collect()
    assert sorted((r.doc_id, r.text or "") for r in stay) == [(1, ""), (1, "t")]
