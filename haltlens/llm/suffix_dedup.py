"""Exact substring deduplication by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Removed is each byte covered by a string of ``length`` bytes that also starts in a document with a smaller doc_id. Repeated strings
are found in shards: the shard's text is sorted by suffix (as deep as the threshold needs), transformed, and the intervals of ever
longer strings are extended backwards, breadth first (Beller et al., 2013), which yields the common prefixes of neighbouring
suffixes by increasing value. Expansion stops at the threshold; neighbours without a value then share at least ``length`` bytes.

So that equal strings meet in one shard, every ``length``-byte window is dealt by its anchor, the least hash of its GRAM-byte
parts. Windows in a row with one anchor travel as one piece. Before texts move, anchors alone are compared: 32-bit hashes per bucket tell
which occur in two documents, and only windows of such anchors become pieces (equal windows have equal anchors, so none
is lost; a chance collision only adds a piece). Equal pieces are merged per slice before they move and again in their shard.

Steps, each an aggregation or join by slice, bucket or shard: slices of about four megabytes of documents, written once; anchors
by bucket; their repeats back by slice; pieces by shard; covered stretches back by slice. The slices themselves lie in files by slice and are never exchanged. Buckets and shards grow with the input, so
that a task's memory does not. Work is linear in the text, and in the repeated text for the transform: a piece all of whose occurrences are equal and
that shares no stretch beside its anchor with another piece is covered or not by its least document alone, and is left out of it.

Defined results: null text is empty; texts shorter than ``length`` lose nothing; rows of equal doc_id are no source for each other; a null
doc_id counts as larger than all others; bytes are UTF-8; a slice holds one document at least, however long it is; other columns, whatever their names, are
ignored; no documents give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, only, written

GRAM = 16
SLICE = 1 << 22
BUCKET_ANCHORS = 400_000
SHARD_BYTES = 3 << 19
LAST = (1 << 63) - 1
_U = np.uint64
_M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)


# ---- anchors


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every GRAM bytes, by doubling; wrapping arithmetic."""
    h = b.astype(np.uint64)
    step = 1
    while step < GRAM:
        low, high = h[:-step], h[step:]
        h = (low * _M1 ^ (high >> _U(29))) + high
        h ^= h >> _U(31)
        step *= 2
    h = h * _M2
    return h ^ (h >> _U(32))


def window_anchors(b: np.ndarray, length: int) -> np.ndarray:
    """The anchor of every window of ``length`` bytes; computed in stretches that stay in the processor's cache."""
    w = length - GRAM + 1
    out = np.empty(max(0, len(b) - length + 1), np.uint64)
    for p in range(0, len(out), 1 << 15):
        m = gram_hashes(b[p : p + (1 << 15) + length - 1])
        step = 1
        while step * 2 <= w:
            m = np.minimum(m[:-step], m[step:])
            step *= 2
        if w > step:
            m = np.minimum(m[: len(m) - (w - step)], m[w - step :])
        out[p : p + (1 << 15)] = m[: 1 << 15]
    return out


class Slice:
    """Documents of one slice: numbers to order by, ids, lengths and bytes."""

    def __init__(self, blob: bytes):
        data = zstandard.ZstdDecompressor().decompress(blob)
        n = int(np.frombuffer(data, "<i8", 1)[0])
        self.ids = np.frombuffer(data, "<i8", n, 8)
        self.null = np.frombuffer(data, "u1", n, 8 + 8 * n)
        self.lengths = np.frombuffer(data, "<i8", n, 8 + 9 * n)
        self.bytes = np.frombuffer(data, "u1", -1, 8 + 17 * n) if len(data) > 8 + 17 * n else np.empty(0, np.uint8)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.order = np.where(self.null.astype(bool), LAST, self.ids)

    @staticmethod
    def packed(ids: list, texts: list[bytes]) -> bytes:
        head = [np.array([len(ids)], "<i8"), np.array([0 if i is None else i for i in ids], "<i8"), np.array([i is None for i in ids], "u1"), np.array([len(t) for t in texts], "<i8")]
        return zstandard.ZstdCompressor(level=1).compress(b"".join([*(h.tobytes() for h in head), *texts]))

    def runs(self, length: int):
        """Windows in a row with one anchor: document, first byte (in the slice), number of windows, anchor."""
        doc, at, n, anchor = [], [], [], []
        for i in np.flatnonzero(self.lengths >= length).tolist():
            m = window_anchors(self.bytes[self.starts[i] : self.ends[i]], length)
            first = np.concatenate([[0], np.flatnonzero(m[1:] != m[:-1]) + 1])
            doc.append(np.full(len(first), i, np.int64))
            at.append(first + self.starts[i])
            n.append(np.diff(np.append(first, len(m))))
            anchor.append(m[first])
        join = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        return join(doc, np.int64), join(at, np.int64), join(n, np.int64), join(anchor, np.uint64)


def slices(docs: DataFrame) -> DataFrame:
    def run(batches):
        part, seq, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + seq]), pa.array([size]), pa.array([Slice.packed(ids, texts)], pa.binary())], ["slice", "size", "blob"])

        for b in batches:
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
                data = (t.as_py() or "").encode()
                ids.append(d)
                texts.append(data)
                size += len(data)
                if size >= SLICE or len(ids) >= 1 << 15:
                    yield flush()
                    seq, ids, texts, size = seq + 1, [], [], 0
        if ids:
            yield flush()

    return only(docs, doc_id="doc_id", text="text").mapInArrow(run, "slice long, size long, blob binary")


def _anchors(runs, buckets: int):
    """Of a slice's runs: different anchors in order of (bucket, hash), the bucket bounds, and whether two documents of the slice share each."""
    doc, _, _, anchor = runs
    bucket = (anchor >> _U(32)) % _U(buckets)
    low = anchor & _U(0xFFFFFFFF)
    key = bucket << _U(32) | low
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    new = np.append(True, key[1:] != key[:-1]) if len(key) else np.empty(0, bool)
    first = np.flatnonzero(new)
    shared = (np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)) if len(first) else np.empty(0, bool)
    return key[first], shared


def _payload(buckets: int, length: int):
    def run(batches):
        for b in batches:
            for s, blob in zip(b.column("slice").to_pylist(), b.column("blob")):
                key, shared = _anchors(Slice(blob.as_py()).runs(length), buckets)
                at = np.searchsorted(key >> _U(32), np.arange(buckets + 1, dtype=np.uint64))
                low = key.astype(np.uint32)
                full = np.flatnonzero(np.diff(at))
                hashes = [low[at[i] : at[i + 1]].tobytes() for i in full.tolist()]
                bits = [np.packbits(shared[at[i] : at[i + 1]]).tobytes() for i in full.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(np.full(len(full), s)), pa.array(hashes, pa.binary()), pa.array(bits, pa.binary())], ["bucket", "slice", "hashes", "shared"])

    return run


def _repeats(key, group):
    """Which hashes of each slice occur in two documents anywhere; slices without any are left out."""
    hashes = [np.frombuffer(x, "<u4") for x in group.column("hashes").to_pylist()]
    own = [np.unpackbits(np.frombuffer(x, "u1"), count=len(h)).astype(bool) for x, h in zip(group.column("shared").to_pylist(), hashes)]
    flat = np.concatenate(hashes)
    order = np.argsort(flat, kind="stable")
    same = flat[order][1:] == flat[order][:-1]
    sorted_flag = np.append(same, False) | np.append(False, same)
    flag = np.empty(len(flat), bool)
    flag[order] = sorted_flag
    flag |= np.concatenate(own)
    ends = np.cumsum([len(h) for h in hashes])
    out = [(s, np.packbits(f).tobytes()) for s, f in zip(group.column("slice").to_pylist(), np.split(flag, ends[:-1])) if f.any()]
    return pa.table({"slice": pa.array([s for s, _ in out], pa.int64()), "bucket": pa.array([key[0].as_py()] * len(out), pa.int32()), "bits": pa.array([x for _, x in out], pa.binary())})


PIECES = "shard int, slice long, packed binary"


def _packed(*parts: bytes) -> bytes:
    """Byte strings as one, compressed together: closer than a shuffle's own compression does."""
    return zstandard.ZstdCompressor(level=3).compress(b"".join([np.array([len(x) for x in parts], "<i8").tobytes(), *parts]))


def _unpacked(blob: bytes, n: int) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    cut = (np.cumsum(np.frombuffer(data, "<i8", n)) + 8 * n).tolist()
    return [data[i:j] for i, j in zip([8 * n, *cut], cut)]


def _pieces(buckets: int, shards: int, length: int):
    """Pieces of one slice by shard: different texts with their sizes; for each occurrence the piece, the first byte and which of the documents' numbers is its own."""

    def run(batches):
        for b in batches:
            for s, blob, at_bucket in zip(b.column("slice").to_pylist(), b.column("blob"), b.column("marks").to_pylist()):
                part = Slice(blob.as_py())
                runs = part.runs(length)
                key, _ = _anchors(runs, buckets)
                at = np.searchsorted(key >> _U(32), np.arange(buckets + 1, dtype=np.uint64))
                flag = np.zeros(len(key), bool)
                for m in at_bucket:
                    i, j = at[m["bucket"]], at[m["bucket"] + 1]
                    flag[i:j] = np.unpackbits(np.frombuffer(m["bits"], "u1"), count=j - i)
                doc, first, n, anchor = runs
                full = ((anchor >> _U(32)) % _U(buckets)) << _U(32) | (anchor & _U(0xFFFFFFFF))
                chosen = np.flatnonzero(flag[np.searchsorted(key, full)])
                shard = ((anchor[chosen] * _M1) >> _U(33)) % _U(shards)
                order = np.argsort(shard, kind="stable")
                chosen, shard = chosen[order], shard[order]
                data = part.bytes.tobytes()
                begin, size, docs = first[chosen].tolist(), (n[chosen] + length - 1).tolist(), doc[chosen]
                rows = []
                cuts = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else [], len(shard)).astype(int)
                for i, j in zip(cuts[:-1], cuts[1:]):
                    known: dict[bytes, int] = {}
                    which = [known.setdefault(data[a : a + k], len(known)) for a, k in zip(begin[i:j], size[i:j])]
                    mine, own = np.unique(docs[i:j], return_inverse=True)
                    places = np.diff(first[chosen[i:j]], prepend=0)  # in order within a shard: small numbers
                    rows.append((int(shard[i]), s, _packed(b"".join(known), np.array([len(x) for x in known], "<u4").tobytes(), np.array(which, "<u4").tobytes(), places.astype("<u4").tobytes(), own.astype("<u2").tobytes(), part.order[mine].astype("<i8").tobytes())))
                cols = list(zip(*rows)) if rows else [[]] * 3
                kinds = [pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in PIECES.split(", ")])

    return run


# ---- the transform


def suffix_order(t: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``t`` (small non-negative numbers) sorted by the next ``depth`` or more symbols; equal ones in any order."""
    bits = max(1, int(t.max()).bit_length()) if len(t) else 1
    per = 63 // bits
    key = np.zeros(len(t), np.uint64)
    padded = np.concatenate([t, np.zeros(per, t.dtype)]).astype(np.uint64)
    for i in range(per):
        key = key << _U(bits) | padded[i : i + len(t)]
    have = per
    while True:
        order = np.argsort(key)
        if have >= depth:
            return order
        ranked = key[order]
        rank = np.empty(len(t), np.uint64)
        rank[order] = np.cumsum(np.append(False, ranked[1:] != ranked[:-1]), dtype=np.uint64)
        if int(rank[order[-1]]) == len(t) - 1:
            return order
        nxt = np.zeros(len(t), np.uint64)
        nxt[:-have] = rank[have:] + _U(1) if have < len(t) else nxt[:-have]
        key = rank << _U(32) | nxt
        have *= 2


def bounded_groups(t: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For ``t``, whose last symbol is 0 and stands nowhere else: its suffix order and, for each place in it, whether it begins a group: neighbours in a group share ``length`` symbols."""
    n = len(t)
    order = suffix_order(t, length + 1)
    left = t[order - 1]  # the transform; before the first symbol stands the end
    by_symbol = np.argsort(left.astype(np.uint16), kind="stable")
    lf = np.empty(n, np.int64)
    lf[by_symbol] = np.arange(n)
    symbol = left[by_symbol]
    same = symbol[1:] == symbol[:-1]
    before, after = np.full(n, -1, np.int64), np.full(n, n, np.int64)  # nearest places with the same symbol
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    after[by_symbol[:-1][same]] = by_symbol[1:][same]
    border = np.zeros(n + 1, bool)  # border[i]: the common prefix of places i - 1 and i is known, and short
    border[0] = border[n] = True
    low, high = np.array([0]), np.array([n - 1])
    for _ in range(length):
        wide = high > low
        single = lf[low[~wide]]
        a, b = low[wide], high[wide]
        size = b - a + 1
        if len(a):
            inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)
            starts = np.sort(lf[inner[before[inner] < np.repeat(a, size)]])
            ends = np.sort(lf[inner[after[inner] > np.repeat(b, size)]])
        else:
            starts = ends = np.empty(0, np.int64)
        low, high = np.concatenate([starts, single]), np.concatenate([ends, single])
        fresh = ~border[high + 1]
        border[high[fresh] + 1] = True
        low, high = low[fresh], high[fresh]
        if not len(low):
            break
    return order, border[:n]


def _may_share(raw: np.ndarray, begin: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """Which pieces may have a window in common with another one.

    A window reaches ``half`` bytes beyond its anchor on one side at least, so that equal windows of two pieces agree in the anchor with
    those bytes before it or after it. A piece that agrees with none in either is out; one in which the anchor stands twice stays in.
    """
    half = (length - GRAM + 1) // 2
    wide = GRAM + half
    grams = np.full(len(raw), ~_U(0))
    for p in range(0, len(raw), 1 << 15):
        h = gram_hashes(raw[p : p + (1 << 15) + GRAM - 1])[: 1 << 15]
        grams[p : p + len(h)] = h
    inside = np.arange(len(raw)) - np.repeat(begin, sizes + 1) <= np.repeat(sizes - GRAM, sizes + 1)
    grams[~inside] = ~_U(0)
    least = np.minimum.reduceat(grams, begin)
    hit = np.flatnonzero(grams == np.repeat(least, sizes + 1))
    of = np.searchsorted(begin, hit, side="right") - 1
    at = hit[np.searchsorted(of, np.arange(len(begin)))]
    stays = np.bincount(of, minlength=len(begin)) > 1
    # polynomial hashes of any stretch, from sums
    power = np.concatenate([[_U(1)], np.cumprod(np.full(len(raw), _M1))])
    back = np.concatenate([[_U(1)], np.cumprod(np.full(len(raw), _U(pow(int(_M1), -1, 1 << 64))))])
    sums = np.concatenate([[_U(0)], np.cumsum(raw.astype(np.uint64) * power[:-1] + power[:-1])])
    left, right = np.flatnonzero(at - half >= begin), np.flatnonzero(at + wide <= begin + sizes)
    a, b = at[left] - half, at[right]
    keys = np.concatenate([(sums[a + wide] - sums[a]) * back[a] * _U(2), (sums[b + wide] - sums[b]) * back[b] * _U(2) + _U(1)])
    of = np.concatenate([left, right])
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    stays[of[order[1:][same]]] = True
    stays[of[order[:-1][same]]] = True
    return stays


def _stretches(raw: np.ndarray, begin: np.ndarray, sizes: np.ndarray, least: np.ndarray, length: int):
    """Of pieces with their least documents: the stretches (piece, first and last window) that a still smaller document has, by the transform."""
    # 0 ends the text, once; 1 ends a piece; the bytes that occur follow
    used = np.zeros(258, np.int64)
    t = np.append(raw.astype(np.int64) + 2, 0)
    t[begin + sizes] = 1
    used[np.unique(t)] = 1
    t = (np.cumsum(used) - 1)[t]
    order, border = bounded_groups(t, length)
    # of each window the least document that has it; positions too near a piece's end are no windows
    windows = np.full(len(t), LAST)
    span = sizes - length + 1
    piece = np.repeat(np.arange(len(sizes)), span)
    inside = np.arange(len(piece)) - np.repeat(np.cumsum(span) - span, span) + begin[piece]
    windows[inside] = least[piece]
    first = np.flatnonzero(border)
    low = np.minimum.reduceat(windows[order], first)
    source = np.empty(len(t), np.int64)
    source[order] = np.repeat(low, np.diff(np.append(first, len(t))))
    gone = source[inside] < least[piece]
    new = np.append(True, piece[1:] != piece[:-1])
    edge = np.flatnonzero(gone & (np.append(True, ~gone[:-1]) | new))
    stop = np.flatnonzero(gone & (np.append(~gone[1:], True) | np.append(new[1:], True)))
    return piece[edge], inside[edge] - begin[piece[edge]], inside[stop] - begin[piece[edge]]


def _covered(length: int):
    """Covered stretches by slice. An occurrence in a later document than its piece's least one is covered whole; only the least one's depends on other pieces."""

    def run(key, group):
        pieces: dict[bytes, int] = {}
        which, number, at, home = [], [], [], []
        for r in group.to_batches():
            for s, packed in zip(r.column("slice").to_pylist(), r.column("packed")):
                text, size, piece, first, doc, numbers = _unpacked(packed.as_py(), 6)
                cut = np.concatenate([[0], np.cumsum(np.frombuffer(size, "<u4"), dtype=np.int64)]).tolist()
                ids = np.array([pieces.setdefault(text[i:j], len(pieces)) for i, j in zip(cut, cut[1:])], np.int64)
                which.append(ids[np.frombuffer(piece, "<u4")])
                at.append(np.cumsum(np.frombuffer(first, "<u4"), dtype=np.int64))
                number.append(np.frombuffer(numbers, "<i8")[np.frombuffer(doc, "<u2")])
                home.append(np.full(len(which[-1]), s))
        which, number, at, home = map(np.concatenate, (which, number, at, home))
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        begin = np.cumsum(sizes + 1) - sizes - 1
        least = np.full(len(pieces), LAST)
        np.minimum.at(least, which, number)
        stays = np.flatnonzero(_may_share(np.frombuffer(b"\n".join(pieces) + b"\n", "u1"), begin, sizes, length))
        later = number > least[which]
        out = [(home[later], at[later], at[later] + sizes[which[later]])]
        if len(stays):
            texts = list(pieces)
            raw = np.frombuffer(b"\n".join([texts[i] for i in stays.tolist()]) + b"\n", "u1")
            size = sizes[stays]
            of, a, b = _stretches(raw, np.cumsum(size + 1) - size - 1, size, least[stays], length)
            n = np.bincount(of, minlength=len(stays))
            place = np.zeros(len(pieces), np.int64)
            place[stays] = n
            occurs = np.flatnonzero(~later & (place[which] > 0))
            place[stays] = np.cumsum(n) - n
            n_each = np.bincount(stays[of], minlength=len(pieces))[which[occurs]]
            each = np.repeat(occurs, n_each)
            j = place[which[each]] + np.arange(len(each)) - np.repeat(np.cumsum(n_each) - n_each, n_each)
            out.append((home[each], at[each] + a[j], at[each] + b[j] + length))
        s, a, b = (np.concatenate(x) for x in zip(*out))
        by = np.argsort(s, kind="stable")
        s, a, b = s[by], a[by], b[by]
        cut = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.empty(0, np.int64)
        spans = [np.stack([x, y], 1).astype("<u4").tobytes() for x, y in zip(np.split(a, cut[1:]), np.split(b, cut[1:]))] if len(s) else []
        return pa.table({"slice": pa.array(s[cut], pa.int64()), "spans": pa.array(spans, pa.binary())})

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _kept(texts: bool):
    def run(batches):
        for b in batches:
            for blob, spans in zip(b.column("blob"), b.column("spans").to_pylist()):
                s = Slice(blob.as_py())
                delta = np.zeros(len(s.bytes) + 1, np.int64)
                for x in spans or ():
                    p = np.frombuffer(x, "<u4").reshape(-1, 2)
                    np.add.at(delta, p[:, 0], 1)
                    np.add.at(delta, p[:, 1], -1)
                gone = np.cumsum(delta[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(gone)])
                rise = gone & np.append(True, ~gone[:-1]) if len(gone) else gone
                rise[s.starts[s.lengths > 0]] = gone[s.starts[s.lengths > 0]]
                rises = np.concatenate([[0], np.cumsum(rise)])
                kept = [s.bytes[i:j][~gone[i:j]].tobytes() for i, j in zip(s.starts, s.ends)]
                cols = [pa.array(s.ids, mask=s.null.astype(bool)), pa.array(s.lengths), pa.array(total[s.ends] - total[s.starts]), pa.array(rises[s.ends] - rises[s.starts]), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.binary())] * texts, [x.split()[0] for x in RESULT.split(", ")] + ["kept"] * texts)

    return run


def deduplicated(docs: DataFrame, *, length: int = 50, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs`` (doc_id, text); ``texts`` adds the kept bytes."""
    if length < GRAM:
        raise ValueError("anchors are parts of the repeated string")
    # texts meet twice what was found in them; they lie by slice, so that only the findings move
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    held = bucketed(slices(docs), "op4-slices", "slice", max(16, -(-size // (2 * SLICE))))
    buckets, shards = max(1, -(-size // (BUCKET_ANCHORS * 20))), max(1, -(-size // SHARD_BYTES))
    blobs = held.select("slice", "blob")
    anchors = blobs.mapInArrow(_payload(buckets, length), "bucket int, slice long, hashes binary, shared binary")
    marks = anchors.groupBy("bucket").applyInArrow(_repeats, "slice long, bucket int, bits binary")
    marks = written(marks.groupBy("slice").agg(F.collect_list(F.struct("bucket", "bits")).alias("marks")), "op4-marks")
    pieces = blobs.join(marks, "slice").mapInArrow(_pieces(buckets, shards, length), PIECES)
    spans = written(pieces.groupBy("shard").applyInArrow(_covered(length), "slice long, spans binary").groupBy("slice").agg(F.collect_list("spans").alias("spans")), "op4-spans")
    return blobs.join(spans, "slice", "left").mapInArrow(_kept(texts), RESULT + ", kept binary" * texts)
