"""Document fingerprints by consistent weighted sampling (Ioffe, 2010), in DataFrame functions only.

A document's terms are its lower-cased words, weighted by how often they occur. For each term and each of ``samples`` draws, hashes
of term and draw give r and c from Gamma(2, 1) and b from (0, 1). With weight S: t = floor(ln S / r + b), ln a = ln c - r (t - b + 1).
The draw takes the term of least a together with its t; two documents agree in a draw with the probability that equals
the generalised Jaccard similarity of their weighted terms, sum of minima over sum of maxima. A fingerprint is the 32-bit hashes of the drawn (term, t).

Plan: the neighbour of each document comes from range buckets of ids (a window per bucket, and one over the buckets' bounds, of
which there are as many as partitions). Text travels once: both joins read one exchange by document key. Everything after the
second join (words, weights per term, draws) needs no further exchange, as the key is the partitioning. A draw is one min() of a long that
holds ln a above and the hash below, so that both aggregations keep fixed-width buffers and generated code.

Defined results: null text is empty text; an empty text has no terms, its fingerprint is all zeros, like only to another such
one (1.0); rows of one doc_id are told apart by their text and ordered by its hash, exact repeats share one result each; a null doc_id sorts before all
others; a single document is its own next one; very long texts are taken whole; an empty table stays empty; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import only, written

SAMPLES = 32
_LOW32 = 0xFFFFFFFF
_BITS21 = (1 << 21) - 1


def _uniforms(h: Column, k: int, n: int) -> list[Column]:
    """Numbers in (0, 1) of 21 bits, three from each hash of the term and the draw."""
    out = []
    for j in range(-(-n // 3)):
        x = F.xxhash64(h, F.lit(2 * k + j))
        out += [(F.shiftrightunsigned(x, s).bitwiseAND(F.lit(_BITS21)) + F.lit(0.5)) * F.lit(1.0 / (1 << 21)) for s in (0, 21, 42)]
    return out[:n]


def _draw(h: Column, log_weight: Column, k: int) -> Column:
    """ln a in fixed point, above; the hash of term and t, below."""
    u1, u2, u3, u4, b = _uniforms(h, k, 5)
    r = -F.log(u1 * u2)
    t = F.floor(log_weight / r + b)
    log_a = F.log(-F.log(u3 * u4)) - r * (t - b + 1)
    return F.shiftleft(((log_a + 512) * (1 << 21)).cast("long"), 32).bitwiseOR(F.xxhash64(h, t).bitwiseAND(F.lit(_LOW32)))


def _terms(text: Column) -> Column:
    """Hashes of the words of a text (of empty strings, which a leading separator leaves, none)."""
    return F.transform(F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def likeness(a: Column, b: Column) -> Column:
    """Share of agreeing draws; null signatures stand for no terms."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same / F.size(a)).cast("double")


def spelled(sig: Column, samples: int = SAMPLES) -> Column:
    return F.coalesce(F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), ""), F.lit("0" * 8 * samples))


def neighbours(docs: DataFrame) -> DataFrame:
    """k1, k2 (key), n_chars, p1, p2: the next key in descending order; after the last comes the first. ``docs``: k1, k2, text."""
    ids = docs.select("k1", "k2", F.length("text").cast("long").alias("n_chars")).distinct()
    dealt = written(ids.repartitionByRange("k1", "k2").withColumn("bucket", F.spark_partition_id()), "op7-ids")
    inside = W.partitionBy("bucket").orderBy("k1", "k2")
    key = F.struct("k1", "k2")
    ends = dealt.groupBy("bucket").agg(F.max(key).alias("last"))
    across = W.orderBy("bucket")
    bounds = ends.select("bucket", F.coalesce(F.lag("last").over(across), F.max("last").over(across.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("before"))
    lagged = dealt.select("bucket", "k1", "k2", "n_chars", F.lag(key).over(inside).alias("p"))
    return lagged.join(bounds, "bucket").select("k1", "k2", "n_chars", F.coalesce("p", "before").alias("p")).select("k1", "k2", "n_chars", F.col("p.k1").alias("p1"), F.col("p.k2").alias("p2"))


#: A SHA-256 in pieces of 13, 13, 13, 13 and 12 hexadecimal digits, each a non-negative long.
_PIECES = ((1, 13), (14, 13), (27, 13), (40, 13), (53, 12))


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of ``docs`` (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    rows = only(docs, doc_id="doc_id", text="text").select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k1"), text.alias("text"))
    rows = rows.withColumn("k2", F.xxhash64("text"))
    near = written(neighbours(rows), "op7-next")
    whole = rows.select("k1", "k2", "text")
    # what each document gives to the one whose next it is; repeats give the same
    wanted = near.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.col("k1").alias("o1"), F.col("k2").alias("o2"), F.floor(F.col("n_chars") / 3).cast("int").alias("take"))
    heads = whole.join(wanted, ["k1", "k2"]).select(F.col("o1").alias("k1"), F.col("o2").alias("k2"), "take", F.substring("text", F.lit(1), F.col("take")).alias("head"))
    both = whole.join(heads, ["k1", "k2"]).select("k1", "k2", "text", F.concat(F.substring("text", F.lit(1), F.length("text") - F.col("take")), "head").alias("edited"))
    sha = F.sha2(F.col("edited").cast("binary"), 256)
    facts = F.array(*[F.conv(F.substring(sha, at, n), 16, 10).cast("long") for at, n in _PIECES])
    sides = F.array(
        F.struct(F.lit(0).alias("side"), _terms(F.col("text")).alias("terms")),
        F.struct(F.lit(1).alias("side"), _terms(F.col("edited")).alias("terms")),
        *[F.struct(F.lit(2 + i).alias("side"), F.array(facts[i]).alias("terms")) for i in range(len(_PIECES))],
    )
    terms = both.select("k1", "k2", F.explode(sides).alias("s")).select("k1", "k2", F.col("s.side").alias("side"), F.explode("s.terms").alias("term"))
    weights = terms.groupBy("k1", "k2", "side", "term").agg(F.count(F.lit(1)).alias("n"))
    log_weight = F.log(F.col("n").cast("double"))
    drawn = weights.groupBy("k1", "k2", "side").agg(F.max("term").alias("fact"), *[F.min(_draw(F.col("term"), log_weight, k)).alias(f"m{k}") for k in range(samples)])
    sig = F.array(*[F.col(f"m{k}").bitwiseAND(F.lit(_LOW32)) for k in range(samples)])
    drawn = drawn.select("k1", "k2", "side", "fact", F.when(F.col("side") < 2, sig).alias("sig"))
    side = lambda i, c: F.max(F.when(F.col("side") == i, F.col(c)))
    digest = F.concat(*[F.lpad(F.lower(F.hex(side(2 + i, "fact"))), n, "0") for i, (_, n) in enumerate(_PIECES)])
    each = written(drawn.groupBy("k1", "k2").agg(side(0, "sig").alias("sig"), side(1, "sig").alias("edited"), digest.alias("edited_sha256")), "op7-drawn")
    found = near.join(each, ["k1", "k2"]).join(each.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("sig").alias("next")), ["p1", "p2"])
    out = found.select("k1", "k2", "n_chars", "edited_sha256", spelled(F.col("sig"), samples).alias("fingerprint"), spelled(F.col("edited"), samples).alias("edited_fingerprint"), likeness(F.col("sig"), F.col("edited")).alias("near_edited"), likeness(F.col("sig"), F.col("next")).alias("near_next"))
    return rows.select("doc_id", "k1", "k2").join(out, ["k1", "k2"]).drop("k1", "k2")
