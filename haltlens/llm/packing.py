"""Best-fit packing into sequences of several permitted lengths.

Items are packed in descending length. An item goes into the open bin with the least room that still holds it. Where none does,
a bin is opened of the size whose projected cost per token is least: for each permitted size that holds the item, the rest of
the bin is filled in thought with the largest remaining items that fit, and cost is divided by that content. In the end each bin is downsized
to the smallest permitted length that holds its contents.

Scale: rows are dealt by a hash of id and length to shards of about ``shard_items`` items, each packed on its own; shards only carry ids and lengths.
The number of shards follows the row count, so that a shard's memory is bounded at any size, and shards hold a
like mix of lengths, so that what is lost against one global packing is a few open bins a shard.

A document longer than the largest size is cut into pieces of that size and a remainder; all pieces are packed.

Defined results: an item of length 0 is packed like any other (it takes no room); a null length counts as 0; a null id is packed;
repeated rows are packed once each; no rows give no bins. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZES = (1024, 2048, 4096, 8192, 16384)


def costs(sizes: tuple[int, ...], per_sequence: int = 16, attention: float = 1 / 65536) -> dict[int, float]:
    """Cost of a sequence of each length: its positions, a constant, and a share that grows with the square as attention does."""
    return {s: s + per_sequence + attention * s * s for s in sizes}


def pack(lengths: list[int], cost: dict[int, float]) -> list[tuple[int, int, int]]:
    """For each item (bin, offset in it, bin size). Deterministic; no length exceeds the largest size."""
    sizes = sorted(cost)
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    left: dict[int, int] = {}  # how many unpacked items have a length
    for n in lengths:
        left[n] = left.get(n, 0) + 1
    have = sorted(left)  # lengths that some unpacked item has
    open_bins: list[tuple[int, int]] = []  # (room, bin), ascending
    used: list[int] = []
    out: list[tuple[int, int, int]] = [(0, 0, 0)] * len(lengths)

    def projected(size: int, item: int) -> float:
        room, taken = size - item, {}
        i = bisect_left(have, room + 1) - 1
        while i >= 0 and room > 0:
            n = have[i]
            if n == 0:
                break
            if (k := min(left[n] - taken.get(n, 0), room // n)) > 0:
                room -= k * n
                taken[n] = taken.get(n, 0) + k
            i = min(i, bisect_left(have, room + 1)) - 1
        return cost[size] / max(1, size - room)

    for i in order:
        n = lengths[i]
        left[n] -= 1
        if not left[n]:
            have.pop()  # the largest: items come in descending order
        at = bisect_left(open_bins, (n, -1))
        if at < len(open_bins):
            room, b = open_bins.pop(at)
        else:
            room = min((s for s in sizes if s >= n), key=lambda s: (projected(s, n), -s))
            b = len(used)
            used.append(0)
        out[i] = (b, used[b], 0)
        used[b] += n
        insort(open_bins, (room - n, b))
    final = [next(s for s in sizes if s >= u) for u in used]
    return [(b, at, final[b]) for b, at, _ in out]


def pieces(docs: DataFrame, length: Column, largest: int) -> DataFrame:
    """doc_id, piece, start and length of every stretch of at most ``largest`` positions."""
    n = F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0))
    cut = docs.select("doc_id", n.alias("n")).select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.col("n") - 1, F.lit(0)) / largest).cast("long"))).alias("piece"))
    return cut.select("doc_id", "piece", (F.col("piece") * largest).alias("start"), F.least(F.col("n") - F.col("piece") * largest, F.lit(largest)).alias("length"))


PACKED = "doc_id long, piece long, start long, length long, bin_id string, bin_offset long, bin_size long"


def best_fit(docs: DataFrame, length: Column, *, cost: dict[int, float] | None = None, shard_items: int = 4_000) -> DataFrame:
    """Every piece of every row of ``docs`` (doc_id and what ``length`` reads) with its bin, its place there and the bin's final length."""
    cost = cost or costs(SIZES)
    items = pieces(docs, length, max(cost))
    shards = max(1, -(-items.count() // shard_items))

    def run(key, group):
        rows = group.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("length", "ascending")])
        placed = pack(rows.column("length").to_pylist(), cost)
        b, at, size = zip(*placed)
        shard = key[0].as_py()
        cols = [rows.column(c) for c in ("doc_id", "piece", "start", "length")]
        return pa.table([*cols, pa.array([f"{shard}-{x}" for x in b]), pa.array(at, pa.int64()), pa.array(size, pa.int64())], [x.split()[0] for x in PACKED.split(", ")])

    dealt = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "length"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(run, PACKED)
