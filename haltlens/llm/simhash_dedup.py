"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits, and each segment is mapped to its number of set bits. The Manhattan
distance of two such count vectors never exceeds the Hamming distance of the fingerprints, so a range join on the vectors finds
every pair, and an exact comparison of the fingerprints confirms it.

The range join runs on a grid: the vector falls into two halves of 16 counts; two vectors within distance r have a half within
r // 2. Each half of a vector is placed into its own grid cell and, for r // 2 = 2, into the cells one step away along each
axis, so that halves within distance 2 share a cell. Counts are held in unary (01 is one, 11 is two), so that the distance is
the number of differing bits and a step is a flipped bit. A pair is taken in one role only: at distance 0 in the common
own cell, at 1 in the own cell of the smaller fingerprint, at 2 in a cell between. Rows grow linearly with the number of
*different* fingerprints; of unrelated fingerprints about 1 pair in 27,000 shares a half, and the comparison is part of the join.

Defined results: null text is empty text, whose fingerprint is zero and links like any other; a null doc_id keeps its
fingerprint and takes the component's smallest known id; repeated rows stay rows; very long texts are hashed
whole, a few at a time; an empty table stays empty; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import merged, only, sliced, written
from .components import components

#: Hashes turned to bits at a time; 64 bytes each.
STEP = 1 << 15


def majority(hashes: list[int]) -> int:
    """The signed 64-bit number whose bits are those set in over half of the hashes."""
    if not hashes:
        return 0
    a = np.array(hashes, "<u8")
    ones = np.zeros(64, np.int64)
    for p in range(0, len(a), STEP):
        ones += np.unpackbits(a[p : p + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(a), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Of ASCII-lower-cased words' shingles, repeats included; a text with fewer words is one shingle, one without any has 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return majority([h(joined, seed)])
    ends = list(accumulate(map((1).__add__, map(len, words))))
    return majority([h(joined[a : b - 1], seed) for a, b in zip([0, *ends], ends[shingle - 1 :])])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and fp (long) of every row."""

    def run(batches):
        for b in sliced(batches):
            fp = [fingerprint(t.as_py(), shingle, seed) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return only(docs, doc_id="doc_id", text="text").mapInArrow(run, "doc_id long, fp long")


def _counts(fp: Column) -> Column:
    """Bits of each two-bit segment in sorted order: its count, in unary."""
    low = F.lit(0x5555555555555555)
    half = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(half).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(half).bitwiseAND(low), 1))


def _cells(half: Column, part: int, step: bool) -> Column:
    """The cells of one half: an array of (cell, role); role 0 is its own."""
    key = lambda c: c.bitwiseOR(F.lit(part << 32))
    own = F.struct(key(half).alias("cell"), F.lit(0).alias("role"))
    if not step:
        return F.array(own)
    bit = lambda i: half.bitwiseAND(F.lit(1 << i)) != 0
    # a low bit may turn while the high one is off, a high bit while the low one is on
    turn = [F.when(bit(i ^ 1) == bool(i & 1), F.struct(key(half.bitwiseXOR(F.lit(1 << i))).alias("cell"), F.lit(1).alias("role"))) for i in range(32)]
    return F.array_compact(F.array(own, *turn))


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """Pairs u < v of different fingerprints (``fps``: fp long, distinct) that differ in at most ``distance`` bits; a pair may come twice or four times, none is missing."""
    if not 0 <= distance <= 5:
        raise ValueError("two halves with one step reach distances of 5 at most")
    step = distance // 2 >= 1
    both = F.lit(0xFFFFFFFF)
    c = _counts(F.col("fp"))
    placed = fps.select("fp", F.explode(F.concat(_cells(c.bitwiseAND(both), 0, step), _cells(F.shiftrightunsigned(c, 32), 1, step))).alias("at")).select("fp", F.col("at.cell").alias("cell"), F.col("at.role").alias("role"))
    # some fifty rows of each: their files tell nothing of it
    a, b = placed.alias("a"), merged(placed).alias("b")
    apart = _counts(F.col("a.fp")).bitwiseXOR(_counts(F.col("b.fp")))
    apart = F.when(F.col("a.cell") < F.lit(1 << 32), F.bit_count(apart.bitwiseAND(both))).otherwise(F.bit_count(F.shiftrightunsigned(apart, 32)))
    near = (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance)
    once = (F.col("a.role") <= F.col("b.role")) & (F.col("a.role") + F.col("b.role") == apart)
    return a.join(b, (F.col("a.cell") == F.col("b.cell")) & near & once).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def classes(fps: DataFrame, distance: int = 4) -> DataFrame:
    """``fps`` (doc_id, fp; written already) to doc_id, fp, component_id: the smallest doc_id reachable over links."""
    each = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "op10-each")
    roots = written(components(links(each.select("fp"), distance), "op10").select(F.col("node").alias("fp"), "root"), "op10-roots")
    rooted = each.join(merged(roots), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.join(merged(rooted.groupBy("root").agg(F.min("first").alias("component_id"))), "root").select("fp", "component_id")
    return fps.join(merged(named), "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, *, shingle: int = 4, distance: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp and component_id of every row of ``docs`` (doc_id, text)."""
    return classes(written(fingerprints(docs, shingle, seed), "op10-fingerprints"), distance)
