from haltlens.operators import policy
from haltlens.sources import adapters
from haltlens.streaming import decider

DATA = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    s = adapters.scores(spark, DATA).cache()
    # three files, steps out of order among them, and one sent twice
    parts = [s.filter("prefix_step_idx % 3 = 1"), s.filter("prefix_step_idx % 3 = 0"), s.filter("prefix_step_idx % 3 = 2").unionByName(s.filter("prefix_step_idx = 0"))]
    for i, p in enumerate(parts):
        p.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = decider.decide_stream(stream, success_thr=0.3, failure_thr=0.3, min_step=2, consecutive=2).writeStream.format("memory").queryName("decided").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.traj_id: (r.decision, r.decision_step) for r in spark.table("decided").collect()}
    batch = policy.decide(s, success_thr=0.3, failure_thr=0.3, min_step=2, consecutive=2).filter("decided")
    assert got == {r.traj_id: (r.decision, r.decision_step) for r in batch.collect()}


def test_text_ids_and_gaps():
    import pandas as pd

    class State:
        exists, hasTimedOut, kept = False, False, None

        def update(self, x):
            self.kept, self.exists = x, True

        def remove(self):
            self.exists = False

        def setTimeoutDuration(self, ms):
            self.ms = ms

        get = property(lambda self: self.kept)

    run, state = decider.decider(0.9, 0.9, 0, 2, 1000), State()
    frame = pd.DataFrame({"prefix_step_idx": [0, 3, 7], "p_success": [0.1, 0.95, 0.95], "p_failure": [0.0, 0.0, 0.0]})
    assert list(run(("a::1",), iter([frame]), state)) == [] and state.exists
    state.hasTimedOut = True
    (out,) = run(("a::1",), iter([]), state)
    assert out.iloc[0].tolist() == ["a::1", "success", 7, 0] and not state.exists


def test_stream_of_text_ids(spark, tmp_path):
    rows = spark.createDataFrame([("x::1", 0, 0.99, 0.0), ("y", 0, 0.1, 0.2)], "traj_id string, prefix_step_idx int, p_success double, p_failure double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = decider.decide_stream(stream, success_thr=0.9, failure_thr=0.9).writeStream.format("memory").queryName("texts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("texts").collect()] == [("x::1", "success", 0, 0)]
