"""Command line: list and run queries, apply a policy to a score table, audit splits, normalise raw runs, check a setup.

python -m haltlens.cli queries
python -m haltlens.cli run policy_by_agent DATA_DIR [--out PATH]
python -m haltlens.cli policy SCORES OUT --success 0.95 --failure 0.95 [--min-step N] [--consecutive K] [--mode dual] [--preset FILE:NAME]
python -m haltlens.cli leakage SPLITS
python -m haltlens.cli normalize RAW OUT --benchmark generic
python -m haltlens.cli preflight PATH... [--warn PATH]
python -m haltlens.cli stages SCORES RUN [--last summary] [--target T]... [--settings FILE]
python -m haltlens.cli folds BASE OUT --table NAME [--exclude FOLD]...
"""

from __future__ import annotations

import argparse
import importlib.util
import os
import sys

from haltlens.sources import tables


def session(name: str = "haltlens"):
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()


def preset(where: str) -> dict:
    """One entry of a JSON or YAML file of policies: FILE:NAME. Thresholds may be the text 'inf'."""
    path, _, name = where.rpartition(":")
    p = tables.config(path)[name]
    return {k: float(v) if k.endswith("_thr") else v for k, v in p.items()}


def preflight(paths: list[str], warn: list[str] = ()) -> list[dict]:
    """Needed modules and given paths, each found or not; what is only to be warned of is not required."""
    found = lambda m: importlib.util.find_spec(m) is not None
    rows = [{"what": m, "kind": "module", "required": m != "yaml", "ok": found(m)} for m in ("pyspark", "pyarrow", "pandas", "numpy", "yaml")]
    rows += [{"what": p, "kind": "path", "required": p not in warn, "ok": os.path.exists(p)} for p in [*paths, *warn]]
    return [r | {"status": "ok" if r["ok"] else "missing" if r["required"] else "warning"} for r in rows]


def apply_policy(spark, scores: str, out: str, rule: dict) -> None:
    """Decisions, per-agent and overall rows, each a table in ``out``, and the rule beside them."""
    from haltlens.operators import metrics, policy

    s = tables.required(tables.read_table(spark, scores), ["traj_id", "prefix_step_idx", "agent", "label", "p_success", "p_failure"])
    d = policy.decide(s, **rule)
    tables.write_table(d, f"{out}/decisions.parquet")
    d = tables.read_table(spark, f"{out}/decisions.parquet")
    tables.write_table(metrics.rollup(d), f"{out}/summary.csv")
    tables.write_json(f"{out}/policy.json", {k: str(v) if v == float("inf") else v for k, v in rule.items()})


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="haltlens")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("queries")
    r = sub.add_parser("run")
    r.add_argument("query")
    r.add_argument("data")
    r.add_argument("--out")
    a = sub.add_parser("policy")
    a.add_argument("scores")
    a.add_argument("out")
    a.add_argument("--preset")
    a.add_argument("--success", type=float, default=0.95)
    a.add_argument("--failure", type=float, default=0.95)
    a.add_argument("--min-step", type=int, default=0)
    a.add_argument("--consecutive", type=int, default=1)
    a.add_argument("--mode", choices=("dual", "success_only", "failure_only"), default="dual")
    sub.add_parser("leakage").add_argument("splits")
    n = sub.add_parser("normalize")
    n.add_argument("raw")
    n.add_argument("out")
    n.add_argument("--benchmark", default="generic")
    f = sub.add_parser("preflight")
    f.add_argument("paths", nargs="*")
    f.add_argument("--warn", action="append", default=[])
    g = sub.add_parser("stages")
    g.add_argument("scores")
    g.add_argument("run")
    g.add_argument("--last", default="summary")
    g.add_argument("--target", type=float, action="append")
    g.add_argument("--settings", help="JSON or YAML: targets, and rules of the selection")
    h = sub.add_parser("folds")
    h.add_argument("base")
    h.add_argument("out")
    h.add_argument("--table", default="summary")
    h.add_argument("--exclude", action="append", default=[])
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "queries":
        from haltlens.plans import catalog

        for name, f in catalog.QUERIES.items():
            print(f"{name}: {' '.join((f.__doc__ or '').split())}")
        return 0
    if a.command == "preflight":
        rows = preflight(a.paths, a.warn)
        print(tables.markdown(rows, ["what", "kind", "required", "status"]))
        return int(any(r["status"] == "missing" for r in rows))
    spark = session()
    if a.command == "run":
        from haltlens.plans import catalog

        df = catalog.QUERIES[a.query](spark, a.data)
        tables.write_table(df, a.out) if a.out else df.show(50, truncate=False)
    elif a.command == "policy":
        rule = preset(a.preset) if a.preset else {"success_thr": a.success, "failure_thr": a.failure, "min_step": a.min_step, "consecutive": a.consecutive, "mode": a.mode}
        apply_policy(spark, a.scores, a.out, rule)
    elif a.command == "stages":
        from haltlens.plans import stages

        rules = tables.config(a.settings) if a.settings else {}
        targets = a.target or rules.pop("targets", [0.75, 0.85, 0.95])
        rules.pop("targets", None)
        print("\n".join(stages.run_stages(spark, tables.read_table(spark, a.scores), a.run, targets=targets, last=a.last, **rules)))
    elif a.command == "folds":
        tables.write_table(tables.read_folds(spark, a.base, [a.table], excluded=a.exclude)[a.table], a.out)
    elif a.command == "leakage":
        from haltlens.operators import splits

        df = tables.read_table(spark, a.splits)
        df = df if "traj_id" in df.columns else df.withColumnRenamed("group_id", "traj_id")
        found = splits.leakage(df)
        found.show(truncate=False)
        return int(not found.first()["ok"])
    elif a.command == "normalize":
        from haltlens.operators import parse

        raw = tables.read_table(spark, a.raw)
        t = parse.normalised(raw, a.benchmark)
        tables.write_table(t, f"{a.out}/trajectories.parquet")
        parse.quality_audit(tables.read_table(spark, f"{a.out}/trajectories.parquet")).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
