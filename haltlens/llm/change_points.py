"""Penalised change points of daily series, by Dijkstra over the DAG of days.

A node is a border between days, an edge a segment: from border i to border j it costs ``n * floor(1000 ln V)`` for the n = j - i days
(V is 1 + the floored variance), plus ``penalty`` if it does not begin the series. Edges are never negative and never listed
beforehand: those that leave a border are made when the border leaves the heap, which is ordered by cost, then by number of segments. A border
keeps the least key it was reached by; among equal keys the earliest predecessor, so that ties end with fewest segments, then
with the earliest starts, compared from the last segment backwards. Edges that cannot come below the best end known so far are not pushed.

Spark sums quantities per series and day (partial sums before the shuffle, so a series with a third of all rows arrives as one number a day and task)
and gathers each series' days, whose number is that of its days and not of its rows. A task then takes several series at a time: each has a heap of its own,
and the edges of all borders that leave their heaps in one turn are made by one array operation. Nothing goes to the driver or is broadcast.

Defined results: rows without quantity or day are not taken; a null series key is one series of its own; repeated rows count as often as they occur; a series
shorter than ``least`` days is one segment; sums that leave 64 bits are computed with Python's integers; an empty table gives no rows; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only

PENALTY, LEAST = 20_000, 7
#: Days (of all series together, padded) that one turn of a task holds.
CELLS = 1 << 18
_FAR = np.iinfo(np.int64).max
SEGMENTS = "segment_no int, first_day long, n_days long, total long, spread long, cost long, n_segments long, best_cost long"


def daily(rows: DataFrame, series: str, at: str, amount: str) -> DataFrame:
    """series, day (since 1970) and q, the sum of the amounts of the day."""
    taken = only(rows, series=series, at=at, amount=amount).filter(F.col("at").isNotNull() & F.col("amount").isNotNull())
    return taken.groupBy("series", F.unix_date(F.to_date("at")).cast("long").alias("day")).agg(F.sum(F.col("amount").cast("long")).alias("q"))


def _spread(n, s, q):
    return 1 + (n * q - s * s) // (n * n)


def _thousand_ln(v: np.ndarray) -> np.ndarray:
    if v.dtype == object:
        return np.array([math.floor(1000 * math.log(x)) for x in v.ravel().tolist()], dtype=object).reshape(v.shape)
    return np.floor(1000 * np.log(v.astype(np.float64))).astype(np.int64)


def _sums(series: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Running sums and sums of squares, one row a series; 64 bits where they do, else Python's integers."""
    width = max(map(len, series)) + 1
    largest = max(sum(abs(x) for x in q.tolist()) for q in series)
    kind = np.int64 if width * largest * largest < 1 << 62 else object
    s, z = np.zeros((len(series), width), kind), np.zeros((len(series), width), kind)
    for i, q in enumerate(series):
        q = q.astype(kind)
        s[i, 1 : len(q) + 1] = np.cumsum(q)
        z[i, 1 : len(q) + 1] = np.cumsum(q * q)
    return s, z


def segments(series: list[np.ndarray], penalty: int = PENALTY, least: int = LEAST) -> list[list[tuple[int, int, int, int, int, int, int]]]:
    """Of each series (a value a day): its segments as (first, days, total, spread, cost, number of segments, best cost)."""
    if not series:
        return []
    s, z = _sums(series)
    size = np.array([len(q) for q in series])
    short = np.minimum(least, size)
    width = s.shape[1]
    cost, count = np.full((len(series), width), _FAR), np.full((len(series), width), _FAR)
    before = np.full((len(series), width), -1)
    cost[:, 0] = count[:, 0] = 0
    done = np.zeros((len(series), width), bool)
    heaps: list[list] = [[(0, 0, 0)] for _ in series]
    active = list(range(len(series)))
    while active:
        here, still = [], []
        for v in active:
            heap = heaps[v]
            while True:
                _, _, i = heapq.heappop(heap)
                if not done[v, i]:
                    break
            done[v, i] = True
            if i < size[v]:
                still.append(v)
                here.append(i)
        active = still
        if not active:
            break
        vs, at = np.array(active), np.array(here)
        # the edges that leave these borders: at least ``least`` days long, and leaving as many or none
        first = int((at + short[vs]).min())
        ends = np.arange(first, width)
        n = ends[None, :] - at[:, None]
        rest = size[vs][:, None] - ends[None, :]
        valid = (n >= short[vs][:, None]) & ((rest == 0) | (rest >= least))
        days = np.maximum(n, 1)
        days = days.astype(s.dtype) if s.dtype == object else days
        v = _spread(days, s[vs][:, first:] - s[vs, at][:, None], z[vs][:, first:] - z[vs, at][:, None])
        # outside the valid edges the sums mean nothing
        edge = days * _thousand_ln(np.where(valid, v, 1))
        key = cost[vs, at][:, None] + edge.astype(np.int64) + np.where(at > 0, penalty, 0)[:, None]
        known = cost[vs, size[vs]][:, None]
        useful = valid & (key + np.where(rest > 0, penalty, 0) <= known)
        segs = (count[vs, at] + 1)[:, None]
        c, k = cost[vs][:, first:], count[vs][:, first:]
        better = useful & ((key < c) | ((key == c) & (segs < k)))
        level = useful & (key == c) & (segs == k) & (at[:, None] < before[vs][:, first:])
        row, col = np.nonzero(level)
        before[vs[row], col + first] = at[row]
        row, col = np.nonzero(better)
        to, new, fewer = vs[row], key[row, col], segs[row, 0]
        cost[to, col + first], count[to, col + first], before[to, col + first] = new, fewer, at[row]
        for x in zip(to.tolist(), new.tolist(), fewer.tolist(), (col + first).tolist()):
            heapq.heappush(heaps[x[0]], x[1:])
    out = []
    for v in range(len(series)):
        found, end = [], int(size[v])
        while end > 0:
            i = int(before[v, end])
            n, total, squares = end - i, int(s[v, end]) - int(s[v, i]), int(z[v, end]) - int(z[v, i])
            spread = _spread(n, total, squares)
            found.append((i, n, total, spread, n * math.floor(1000 * math.log(spread))))
            end = i
        best = sum(x[4] for x in found) + penalty * (len(found) - 1)
        out.append([(*x, len(found), best) for x in reversed(found)])
    return out


def _solve(penalty: int, least: int):
    def run(batches):
        for b in batches:
            days = b.column("days")
            ends = days.offsets.to_numpy()
            inside = days.values
            day, q = (inside.field(i).to_numpy() for i in (0, 1))
            spans = [int(day[j - 1] - day[i]) + 1 for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
            order = sorted(range(len(spans)), key=spans.__getitem__)  # series of like length share a turn
            while order:
                take = 1
                while take < len(order) and (take + 1) * spans[order[take]] <= CELLS:
                    take += 1
                turn, order = order[:take], order[take:]
                series, first = [], []
                for v in turn:
                    i, j = int(ends[v]), int(ends[v + 1])
                    full = np.zeros(spans[v], np.int64)
                    full[day[i:j] - day[i]] = q[i:j]
                    series.append(full)
                    first.append(int(day[i]))
                rows = [(v, k + 1, day0 + at, *rest) for v, day0, found in zip(turn, first, segments(series, penalty, least)) for k, (at, *rest) in enumerate(found)]
                cols = list(zip(*rows))
                kinds = [pa.int32(), *[pa.int64()] * 7]
                yield pa.RecordBatch.from_arrays([b.column("series").take(pa.array(cols[0])), *[pa.array(c, t) for c, t in zip(cols[1:], kinds)]], ["series", *[x.split()[0] for x in SEGMENTS.split(", ")]])

    return run


def change_points(rows: DataFrame, series: str, at: str, amount: str, penalty: int = PENALTY, least: int = LEAST, where: Column | None = None) -> DataFrame:
    """The cheapest segments of each series of ``rows`` (those of ``where``): sums of ``amount`` a day of ``at``, days without any 0. Columns: ``series`` under its own name, and SEGMENTS."""
    if least < 1 or penalty < 0:
        raise ValueError("segments of a day at least, and no negative penalty")
    days = daily(rows if where is None else rows.filter(where), series, at, amount)
    kind = dict(days.dtypes)["series"]
    gathered = days.groupBy("series").agg(F.sort_array(F.collect_list(F.struct("day", "q"))).alias("days"))
    return gathered.mapInArrow(_solve(penalty, least), f"series {kind}, {SEGMENTS}").withColumnRenamed("series", series)


#: The same in DuckDB, over sale_lines: the least key of every border from all earlier ones, then the way back.
SQL = """
WITH RECURSIVE taken AS (
  SELECT vendor_id, date_diff('day', DATE '1970-01-01', CAST(shipped_at AS DATE)) AS day, CAST(sum(quantity) AS HUGEINT) AS q
  FROM sale_lines WHERE flag = 'kept' AND quantity IS NOT NULL AND shipped_at IS NOT NULL GROUP BY 1, 2),
span AS (SELECT vendor_id, min(day) AS lo, max(day) AS hi FROM taken GROUP BY 1),
every_day AS (SELECT vendor_id, lo, unnest(range(lo, hi + 1)) AS day FROM span),
filled AS (SELECT e.vendor_id, e.lo, e.day, coalesce(t.q, 0) AS q FROM every_day e LEFT JOIN taken t ON t.vendor_id IS NOT DISTINCT FROM e.vendor_id AND t.day = e.day),
running AS (SELECT vendor_id, lo, day, sum(q) OVER w AS s, sum(q * q) OVER w AS z FROM filled WINDOW w AS (PARTITION BY vendor_id ORDER BY day)),
series AS (SELECT vendor_id, lo, count(*) AS n, list_prepend(CAST(0 AS HUGEINT), list(CAST(s AS HUGEINT) ORDER BY day)) AS s, list_prepend(CAST(0 AS HUGEINT), list(CAST(z AS HUGEINT) ORDER BY day)) AS z FROM running GROUP BY 1, 2),
walk AS (
  SELECT vendor_id, lo, n, s, z, 0 AS j, [{'c': CAST(0 AS BIGINT), 'k': CAST(0 AS BIGINT), 'p': CAST(-1 AS BIGINT)}] AS best FROM series
  UNION ALL
  SELECT vendor_id, lo, n, s, z, j + 1, list_append(best, list_min(list_transform(
    list_filter(range(0, greatest(0, j + 2 - least(7, n))), lambda i: best[i + 1] IS NOT NULL AND (j + 1 = n OR n - j - 1 >= 7)),
    lambda i: {'c': best[i + 1].c + CASE WHEN i > 0 THEN 20000 ELSE 0 END
        + (j + 1 - i) * CAST(floor(1000 * ln(CAST(1 + ((j + 1 - i) * (z[j + 2] - z[i + 1]) - (s[j + 2] - s[i + 1]) * (s[j + 2] - s[i + 1])) // CAST((j + 1 - i) * (j + 1 - i) AS HUGEINT) AS DOUBLE))) AS BIGINT),
      'k': best[i + 1].k + 1, 'p': CAST(i AS BIGINT)})))
  FROM walk WHERE j < n),
back AS (
  SELECT vendor_id, lo, n, s, z, best, CAST(n AS BIGINT) AS e, best[n + 1].p AS b FROM walk WHERE j = n
  UNION ALL
  SELECT vendor_id, lo, n, s, z, best, b, best[b + 1].p FROM back WHERE b > 0),
parts AS (
  SELECT vendor_id, lo, b, e - b AS m, s[e + 1] - s[b + 1] AS total, best[n + 1].k AS n_segments, best[n + 1].c AS best_cost, best[e + 1].k AS segment_no,
    1 + ((e - b) * (z[e + 1] - z[b + 1]) - (s[e + 1] - s[b + 1]) * (s[e + 1] - s[b + 1])) // CAST((e - b) * (e - b) AS HUGEINT) AS spread FROM back)
SELECT vendor_id, CAST(segment_no AS INTEGER) AS segment_no, CAST(lo + b AS BIGINT) AS first_day, CAST(m AS BIGINT) AS n_days, CAST(total AS BIGINT) AS total,
  CAST(spread AS BIGINT) AS spread, CAST(m * floor(1000 * ln(CAST(spread AS DOUBLE))) AS BIGINT) AS cost, CAST(n_segments AS BIGINT) AS n_segments, CAST(best_cost AS BIGINT) AS best_cost
FROM parts
"""
