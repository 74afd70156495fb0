"""Change points against the plain recursion over all cuts, and on odd rows."""

import datetime
import math
import random

import numpy as np
import pytest

from haltlens.llm import change_points


def plain(q, penalty, least):
    """(best cost, segments, starts from the last segment backwards) of a series, by trying every border before every border."""
    n, s, z = len(q), [0], [0]
    for x in q:
        s.append(s[-1] + x)
        z.append(z[-1] + x * x)
    best = {0: (0, 0, ())}
    for j in range(1, n + 1):
        ways = []
        for i in range(0, j - min(least, n) + 1):
            if i in best and (j == n or n - j >= least):
                m, total, squares = j - i, s[j] - s[i], z[j] - z[i]
                v = 1 + (m * squares - total * total) // (m * m)
                ways.append((best[i][0] + m * math.floor(1000 * math.log(v)) + (penalty if i else 0), best[i][1] + 1, (i, *best[i][2])))
        if ways:
            best[j] = min(ways)
    return best[n]


@pytest.mark.parametrize("penalty", [20_000, 500, 20, 0])
def test_equals_all_cuts(penalty):
    rng = random.Random(penalty)
    series = []
    for _ in range(150):
        n, q = rng.choice([1, 2, 6, 7, 8, 13, 14, 15, 20, 40, 80]), []
        while len(q) < n:
            level = rng.choice([0, 0, 3, 50, 1000])
            q += [rng.choice([level, level, level + rng.randint(0, level + 1)]) for _ in range(rng.randint(1, 20))]
        series.append(np.array(q[:n]))
    for q, found in zip(series, change_points.segments(series, penalty)):
        assert (found[0][6], found[0][5], tuple(x[0] for x in reversed(found))) == plain(q.tolist(), penalty, 7)
        assert sum(x[1] for x in found) == len(q) and sum(x[2] for x in found) == q.sum()


def test_sums_beyond_64_bits():
    q = [10**12 + i * 10**11 for i in range(30)] + [5] * 10
    found = change_points.segments([np.array(q)])[0]
    assert (found[0][6], found[0][5], tuple(x[0] for x in reversed(found))) == plain(q, 20_000, 7)


def test_odd_rows(spark):
    day = lambda i: datetime.datetime(2024, 1, 1, 23, 59) + datetime.timedelta(days=i)
    rows = [(1, day(i), 5 if i < 20 else 900, "kept", "x") for i in range(40)]
    rows += rows[:3] + [(None, day(3), 2, "kept", "x"), (None, day(1), 7, "kept", None), (2, None, 4, "kept", "x"), (3, day(0), None, "kept", "x"), (4, day(0), 9, "gone", "x"), (5, day(0), 1, None, "x"), (6, day(9), 3, "kept", "x")]
    df = spark.createDataFrame(rows, "series long, at timestamp_ntz, q int, flag string, days string")
    got = change_points.change_points(df, "series", "at", "q", where=df.flag == "kept")
    assert got.columns == ["series", *[x.split()[0] for x in change_points.SEGMENTS.split(", ")]]
    by = {}
    for r in got.collect():
        by.setdefault(r.series, []).append(r)
    assert set(by) == {None, 1, 6}
    q = [10 if i < 3 else 5 if i < 20 else 900 for i in range(40)]
    best = plain(q, 20_000, 7)
    assert (by[1][0].best_cost, by[1][0].n_segments) == best[:2] and [r.first_day - 19723 for r in sorted(by[1], key=lambda r: r.segment_no)] == list(reversed(best[2]))
    assert [(r.n_days, r.total, r.first_day) for r in by[None]] == [(3, 9, 19724)] and [(r.n_days, r.total, r.spread, r.cost) for r in by[6]] == [(1, 3, 1, 0)]
    assert change_points.change_points(df.limit(0), "series", "at", "q").count() == 0
    with pytest.raises(ValueError):
        change_points.change_points(df, "series", "at", "q", penalty=-1)


def test_nothing_whole_goes_to_one_place(spark):
    df = spark.range(100).selectExpr("id % 3 AS series", "timestamp_ntz'2024-01-01' AS at", "1 AS q")
    plan = change_points.change_points(df, "series", "at", "q")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Broadcast" not in plan and "partial_sum" in plan
