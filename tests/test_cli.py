from haltlens import cli
from haltlens.sources import adapters, tables

DATA = "/root/testdata/sf0.001"


def test_lists_and_checks(capsys, tmp_path):
    assert cli.main(["queries"]) == 0 and "policy_by_agent" in capsys.readouterr().out
    assert cli.main(["preflight", str(tmp_path)]) == 0 and cli.main(["preflight", str(tmp_path / "none")]) == 1


def test_policy_command(spark, tmp_path, capsys):
    adapters.scores(spark, DATA).write.parquet(str(tmp_path / "s.parquet"))
    tables.write_json(str(tmp_path / "p.json"), {"one": {"success_thr": "inf", "failure_thr": 0.6, "mode": "failure_only"}})
    assert cli.main(["policy", str(tmp_path / "s.parquet"), str(tmp_path / "out"), "--preset", f"{tmp_path}/p.json:one"]) == 0
    d = tables.read_table(spark, str(tmp_path / "out/decisions.parquet"))
    assert d.filter("decision = 'success'").count() == 0 and d.filter("decision = 'failure'").count() > 0
    assert tables.read_json(str(tmp_path / "out/policy.json"))["success_thr"] == "inf"
    assert cli.main(["run", "outcomes", DATA, "--out", str(tmp_path / "o.csv")]) == 0


def test_leakage_and_normalize(spark, tmp_path):
    rows = [(1, "m", "i", "train", 1), (2, "n", "j", "test", 0)]
    spark.createDataFrame(rows, "traj_id long, model_id string, instance_id string, split string, label int").write.parquet(str(tmp_path / "a.parquet"))
    assert cli.main(["leakage", str(tmp_path / "a.parquet")]) == 0
    spark.createDataFrame([(1, "m", "i", "train", 1), (1, "m", "i", "test", 0)], "traj_id long, model_id string, instance_id string, split string, label int").write.parquet(str(tmp_path / "b.parquet"))
    assert cli.main(["leakage", str(tmp_path / "b.parquet")]) == 1
    (tmp_path / "raw.jsonl").write_text('{"row_idx": 1, "resolved": true, "steps": "[]"}\n')
    assert cli.main(["normalize", str(tmp_path / "raw.jsonl"), str(tmp_path / "n")]) == 0


def test_jobs(tmp_path):
    import sys

    from haltlens.plans import jobs

    assert jobs.Job("s", "r", (0.9,)).command()[1:] == ["-m", "haltlens.cli", "stages", "s", "r", "--last", "summary", "--target", "0.9"]
    assert jobs.run_job(["none such"], execute=False) is None
    assert jobs.run_job([sys.executable, "-c", "import os, sys; sys.exit(int(os.environ['OMP_NUM_THREADS']))"], threads=3) == 3
    assert jobs.run_job([sys.executable, "-c", "import time; time.sleep(9)"], seconds=0.2) == 124
    assert jobs.run_job([sys.executable, "-c", "bytearray(1 << 31)"], memory_kb=1 << 20) != 0


def test_stages_command(spark, tmp_path, capsys):
    adapters.scores(spark, DATA).write.parquet(str(tmp_path / "s.parquet"))
    tables.write_json(str(tmp_path / "rules.json"), {"targets": [0.6], "max_abs_drop_pp": 5.0})
    assert cli.main(["stages", str(tmp_path / "s.parquet"), str(tmp_path / "run"), "--settings", str(tmp_path / "rules.json")]) == 0 and "summary" in capsys.readouterr().out
    assert cli.main(["folds", str(tmp_path / "run"), str(tmp_path / "o.parquet"), "--exclude", "plan", "--exclude", "audit", "--exclude", "splits", "--exclude", "sweep"]) == 0
    assert tables.read_table(spark, str(tmp_path / "o.parquet")).first().fold_id == "summary"
