"""The stop decision on a stream: each trajectory's scan as keyed state.

The rule needs steps in order, so rows wait in state until every step before them has come; a row at or below the last step that was
taken is late and only counted. A trajectory emits once, when it decides. With ``timeout_ms`` a trajectory that has been silent for so long ends
(processing time; such a query never runs out of batches, so that it is for continuous triggers): what still waits is taken in order, over gaps, as the batch operator does, and
its state goes, decided or not. Without it, a decided one leaves a mark of fixed size, so that it does not decide anew, and steps behind a gap wait.
The result on a complete stream equals the batch operator's. Ids may be of any type.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "decision string, decision_step int, late_rows int"
STATE = "next int, last int, streak int, late int, steps array<int>, success array<double>, failure array<double>, done boolean"


def direction(s: float, f: float, success_thr: float, failure_thr: float) -> int:
    hit_s, hit_f = not math.isnan(s) and s >= success_thr, not math.isnan(f) and f >= failure_thr
    if hit_s and hit_f:
        return 1 if s - success_thr >= f - failure_thr else -1
    return int(hit_s) - int(hit_f)


def decider(success_thr: float, failure_thr: float, min_step: int, consecutive: int, timeout_ms: int | None):
    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        nxt, last, streak, late, steps, ss, fs, done = state.get if state.exists else (0, 0, 0, 0, [], [], [], False)
        waiting = {i: (s, f) for i, s, f in zip(steps, ss, fs)}
        ended = state.hasTimedOut
        for frame in () if ended else frames:
            for i, s, f in zip(frame["prefix_step_idx"], frame["p_success"], frame["p_failure"]):
                if done or i < nxt or i in waiting:
                    late += 1
                else:
                    waiting[int(i)] = (float(s), float(f))
        while waiting and not done and (ended or nxt in waiting):
            nxt = min(waiting) if ended else nxt
            row = waiting.pop(nxt)
            d = 0 if nxt < min_step else direction(*row, success_thr, failure_thr)
            streak = 0 if d == 0 else streak + 1 if d == last else 1
            last = d
            if streak >= consecutive and d:
                done = True
                yield pd.DataFrame({"traj_id": [key[0]], "decision": ["success" if d > 0 else "failure"], "decision_step": [nxt], "late_rows": [late]})
            nxt += 1
        if ended:
            state.remove()
            return
        left = {} if done else waiting
        state.update((nxt, last, streak, late, list(left), [x[0] for x in left.values()], [x[1] for x in left.values()], done))
        if timeout_ms is not None:
            state.setTimeoutDuration(timeout_ms)

    return run


def decide_stream(scores: DataFrame, *, success_thr: float, failure_thr: float, min_step: int = 0, consecutive: int = 1, timeout_ms: int | None = None) -> DataFrame:
    """Decisions of a stream of scores (traj_id, prefix_step_idx from 0, p_success, p_failure)."""
    rows = scores.selectExpr("traj_id", "cast(prefix_step_idx as int) prefix_step_idx", "cast(p_success as double) p_success", "cast(p_failure as double) p_failure")
    run = decider(success_thr, failure_thr, min_step, consecutive, timeout_ms)
    out = f"traj_id {rows.schema['traj_id'].dataType.simpleString()}, {OUT}"
    return rows.groupBy("traj_id").applyInPandasWithState(run, out, STATE, "append", GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
