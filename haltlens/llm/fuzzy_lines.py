"""Fuzzy line deduplication: SimHash of normalised lines, pigeonhole block join, edit similarity, one occurrence per group.

A line is normalised (ASCII and Unicode case folded, digits to 0, punctuation and repeated white space dropped; in scripts without spaces each
character is a word). Lines that normalise alike are one *wording*. Wordings link if the edit similarity of their words, 1 - (words inserted,
deleted or replaced) / words of the longer, is at least ``similarity``. Of each connected group only the first line stays (smallest doc_id, then line number).

Two joins propose the pairs that are verified:

- ``duplicate_lines``, the named method: the SimHash of a wording is the majority of its different words' XXH64 hashes; two meet if theirs differ
  in at most 3 bits. The 64 bits fall into five blocks, of which two agree, and each pair of blocks is a cell's key. An edit of one word in twenty
  already moves more bits than that in four lines of five, and at similarity 0.8 about 13 of the 64 bits differ, so that no number of blocks
  that one could afford finds such lines: the method named does not give right results here.
- ``every_duplicate_line`` (``every``), which the registered query and the pipeline use: a line of more than SHORT words is looked for by the KEYS
  least hashes of its threes of neighbouring words, a shorter one by all its pairs. Two lines of similarity 0.8 share half of these threes or
  more, so that they miss one another only if eight in a row of the least ones are all edited: at most 0.7 % at exactly 0.8, next to none above, and
  none at all in lines of up to 14 words. Cells are found on packed keys, 14 bytes each, are cut where sizes cannot go together, and
  hold each wording once a stretch of texts, so that copies do not gather there. Size and the parities of word counts sort out
  most of the pairs that cannot be similar; first come each member and its cell's least one, then all others of which it is not yet known that
  they are of one group. Lines of fewer than ``min_words`` words are grouped by their exact normal form, digits as they are.

A wording is known by a 64-bit hash; a second one tells chance collisions, whose lines then stay. For the edit distance a word is one of a million
signs, so that a pair just beyond the limit passes by chance about once in a thousand.

Defined results: null text stays null and has no lines; very long texts are read whole, some four megabytes of texts at a time; a document whose
lines all go keeps an empty text; an empty table stays empty; a null doc_id sorts after all others as "first"; rows with the same id and the same
text count as one document and keep the same lines; columns other than the text are handed through, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import islice
from operator import ne

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import dropped, merged, only, sliced, written
from .components import components

_ODD = re.compile(r"[^\w\s\x00-\x7f]")
#: ASCII as it is normalised: letters lower, digits 0, line ends kept, all else that is no letter a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c if c == 10 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: The same with digits as they are: short lines that differ in a number are no copies.
_EXACT = bytes(c if 48 <= c <= 57 else x for c, x in enumerate(_TABLE))
#: Han, kana, Thai, Lao, Burmese and Khmer.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
#: Of a text's characters beyond ASCII, at most so many kinds are replaced one by one.
KINDS = 32
_ASCII = bytes(range(128))
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))  # first bit and number of bits
DISTANCE = 3
#: Wordings whose SimHash a task keeps.
KNOWN = 200_000
#: Keys of a kind by which a line is looked for, and words of a short line.
KEYS, SHORT = 8, 12
#: No longer looked at, as no word is told to be frequent any more; tests set it.
OFTEN = 16
#: Bits of a line's parities, as they travel and as they are made of the words.
PARITY, WIDE = 256, 1024
#: Pairs compared at a time.
BLOCK = 1 << 20
#: Bytes of text looked at together, and for each bucket of keys.
BYTES, BUCKET = 1 << 22, 1 << 24
_U = np.uint64
#: Masks of the first 0 to 8 bytes of a number.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_CELL = np.dtype([("wording", "<u8"), ("key", "<u4"), ("size", "<u2")])
#: Words hashed before bits are counted.
STEP = 1 << 15


def normal_bytes(text: str, table: bytes = _TABLE) -> bytes:
    """A text, normalised but for repeated spaces; in scripts without spaces each character is a word."""
    if not text.isascii():
        text = text.casefold()
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        # few kinds of characters beyond ASCII: looked at once each, not at every place
        kinds = set(text.encode().translate(None, _ASCII).decode())
        if len(kinds) > KINDS:
            text = _UNSPACED.sub(r" \g<0> ", _ODD.sub(" ", text))
        else:
            for c in kinds:
                if _ODD.match(c):
                    text = text.replace(c, " ")
                elif _UNSPACED.match(c):
                    text = text.replace(c, f" {c} ")
    return text.encode().translate(table)


def normal_lines(text: str, table: bytes = _TABLE) -> list[list[bytes]]:
    """The words of each line of a text, normalised."""
    return [line.split() for line in normal_bytes(text, table).split(b"\n")]


def normalised(line: str) -> str:
    """The normal form of one line."""
    return b" ".join(normal_lines(line)[0]).decode()


def simhashes(lines: list[list[bytes]]) -> np.ndarray:
    """The signed 64-bit majority hash of the different words of each list (none of them empty)."""
    digest, out = xxhash.xxh64_digest, [np.empty(0, np.int64)]
    flat: list[bytes] = []
    ends: list[int] = []

    def flush():
        bits = np.unpackbits(np.frombuffer(b"".join(flat), np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, np.array([0, *ends[:-1]]), axis=0, dtype=np.int32)
        size = np.diff(ends, prepend=0)
        out.append(np.packbits(2 * ones > size[:, None], axis=1).view(">i8")[:, 0])

    for words in lines:
        flat += map(digest, set(words))  # different ones: frequent words would make all long lines alike
        ends.append(len(flat))
        if len(flat) >= STEP:
            flush()
            flat, ends = [], []
    if ends:
        flush()
    return np.concatenate(out).astype(np.int64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(29))) * _U(0x9E3779B97F4A7C15)
    return h ^ (h >> _U(32))


class Words:
    """The words of a batch of normalised texts as arrays: two 64-bit hashes of each, and of each line its text, place in it, first word, number of words and two hashes."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts) + b"\n" + bytes(8)
        raw = np.frombuffer(self.data, np.uint8, len(self.data) - 8)
        space = (raw == 32) | (raw == 10)
        edge = np.flatnonzero(space != np.append(True, space[:-1]))  # a word begins, ends, begins ...
        begin, size = edge[::2].copy(), edge[1::2] - edge[::2]
        eight = np.ndarray(len(raw), "<u8", self.data, strides=(1,))
        v = eight[begin] & _FIRST[np.minimum(size, 8)]
        self.h, self.g = _mixed(v), _mixed((v ^ _U(77)) * _U(0xA24BAED4963EE407))
        left, offset = np.flatnonzero(size > 8), 8
        while len(left):  # eight bytes of each longer word at a time
            rest = size[left] - offset
            v = eight[begin[left] + offset] & _FIRST[np.minimum(rest, 8)]
            self.h[left], self.g[left] = _mixed(self.h[left] + v), _mixed((self.g[left] ^ v) * _U(0xA24BAED4963EE407))
            left, offset = left[rest > 8], offset + 8
        ends = np.flatnonzero(raw == 10)
        self.stop = ends
        self.first = np.searchsorted(begin, np.append(0, ends[:-1]))
        self.n = np.diff(np.append(self.first, len(begin)))
        of_text = np.cumsum([t.count(b"\n") + 1 for t in texts])
        self.text = np.searchsorted(of_text, np.arange(len(ends)), side="right")
        self.number = np.arange(len(ends)) - np.append(0, of_text)[self.text]
        self.line = np.repeat(np.arange(len(ends)), self.n)
        self.at = np.arange(len(begin)) - self.first[self.line]
        power = np.cumprod(np.full(int(self.n.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
        self.wording, self.check = (_mixed(self.summed(h * power[self.at]) + self.n.astype(np.uint64)) for h in (self.h, self.g))

    def summed(self, x: np.ndarray, of=np.add) -> np.ndarray:
        """Sums over the words of each line."""
        out = np.zeros(len(self.n), x.dtype)
        full = np.flatnonzero(self.n)
        if len(full):
            out[full] = of.reduceat(x, self.first[full])
        return out

    def form(self, line: int) -> bytes:
        return b" ".join(self.data[self.stop[line - 1] + 1 if line else 0 : self.stop[line]].split())

    def keys(self, lines: np.ndarray, common: np.ndarray | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
        """Lines and keys of ``lines``. In lines of more than SHORT words (and those that may be similar to them) the KEYS least hashes of its
        different threes of neighbouring words; in shorter ones all its different pairs, so that no list of
        frequent words (``common``, which callers may still hand over) bears on them."""
        wanted = np.zeros(len(self.n), bool)
        wanted[lines] = True
        two = np.flatnonzero((self.at > 0) & (wanted & (self.n <= SHORT))[self.line])
        pair = _mixed(self.h[:-1] * _U(0xD6E8FEB86659FD93) ^ (self.h[1:] + _U(0x632BE59BD9B4E019)))  # of each word and the one before
        three = _mixed(pair[1:] ^ self.h[:-2] * _U(0xA24BAED4963EE407))
        # most that cannot be among the least go before the sort, unless too few would be left
        long = wanted & (self.n >= SHORT * similarity)
        most = (np.minimum(4 * KEYS / np.maximum(self.n, 1), 0.999) * 2.0**64).astype(np.uint64)
        there = ((self.at > 1) & np.repeat(long, self.n))[2:]
        low = there & (three < np.repeat(most, self.n)[2:])
        few = np.bincount(self.line[2:][low], minlength=len(self.n)) < 2 * KEYS
        low |= there & np.repeat(few, self.n)[2:]
        of = np.concatenate([2 * self.line[two], 2 * self.line[2:][low] + 1])
        key = np.concatenate([pair[two - 1], three[low]])
        bits = int(of.max(initial=0)).bit_length()
        order = np.argsort(of.astype(np.uint64) << _U(64 - bits) | key >> _U(bits)) if bits else np.argsort(key)  # one number sorts faster than two
        of, key = of[order], key[order]
        new = np.append(True, (of[1:] != of[:-1]) | (key[1:] != key[:-1]))[: len(of)]
        of, key = of[new], key[new]
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)])
        least = (np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of)))) < KEYS) | (of & 1 == 0)
        return of[least] // 2, key[least]

    def parities(self, lines: np.ndarray) -> np.ndarray:
        """As bytes, a row of PARITY bits for each of ``lines``: bit i is set if an odd number of its words have hash i."""
        bit, of = _U(1) << (self.h & _U(63)), self.h >> _U(6) & _U(PARITY // 64 - 1)
        return np.stack([self.summed(np.where(of == _U(i), bit, _U(0)), np.bitwise_xor)[lines] for i in range(PARITY // 64)], 1).view(np.uint8)


def by_size(column: pa.Array, limit: int):
    """Bounds of the stretches of a text column that hold about ``limit`` bytes each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // limit
    cuts = np.flatnonzero(np.diff(size, prepend=-1, append=-1))
    return zip(cuts.tolist(), cuts[1:].tolist())


def row_key() -> Column:
    """Tells rows apart: id and text together, so that a null or repeated id does no harm."""
    return F.xxhash64("doc_id", "text")


def line_hashes(docs: DataFrame, min_words: int) -> DataFrame:
    """rk, doc_id, line_no, looked (how many such lines the text has), wording and simhash of each line of at least ``min_words`` words of every text (``docs``: rk, doc_id, text)."""

    def run(batches):
        known: dict[int, int] = {}  # of wordings met before
        for b in sliced(batches):
            rows, ids, numbers, looked, hashes, new, words = [], [], [], [], [], [], []
            if len(known) > KNOWN:
                known.clear()
            for r, d, t in zip(b.column("rk").to_pylist(), b.column("doc_id").to_pylist(), b.column("text")):
                long = [(i, w) for i, w in enumerate(normal_lines(t.as_py() or "")) if len(w) >= min_words]
                for i, w in long:
                    rows.append(r)
                    ids.append(d)
                    numbers.append(i)
                    looked.append(len(long))
                    h = xxhash.xxh64_intdigest(b" ".join(w))
                    hashes.append(h)
                    if h not in known:
                        known[h] = 0
                        new.append(h)
                        words.append(w)
            known.update(zip(new, simhashes(words).tolist()))
            cols = [pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(looked, pa.int32()), pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array([known[h] for h in hashes], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["rk", "doc_id", "line_no", "looked", "wording", "simhash"])

    return docs.mapInArrow(run, "rk long, doc_id long, line_no int, looked int, wording long, simhash long")


def _keys(h: Column) -> Column:
    block = lambda at, n: F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << n) - 1))
    pairs = [(i, j) for i in range(5) for j in range(i + 1, 5)]
    return F.array(*[F.shiftleft(block(*BLOCKS[i]), 17).bitwiseOR(F.shiftleft(block(*BLOCKS[j]), 4)).bitwiseOR(F.lit(k)) for k, (i, j) in enumerate(pairs)])


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def block_cells(hashes: DataFrame) -> DataFrame:
    """Of ``hashes`` (simhash, distinct): key, simhash and leader (the least SimHash) of each block cell that holds two or more."""
    placed = hashes.select("simhash", F.explode(_keys(F.col("simhash"))).alias("key"))
    cell = W.partitionBy("key")
    return placed.select("key", "simhash", F.min("simhash").over(cell).alias("leader"), F.count(F.lit(1)).over(cell).alias("c")).filter("c > 1").drop("c")


def _confirmed(pairs: DataFrame, norms: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (u, v: wordings) whose normal forms are similar enough."""
    form = lambda w, x: norms.select(F.col("wording").alias(w), F.col("norm").alias(x))

    def run(batches):
        for b in batches:
            for i, j in by_size(b.column("x"), BYTES):
                part = b.slice(i, j - i)
                ok = [within(x, y, int((1 - similarity) * max(len(x), len(y)) + 1e-9)) for x, y in zip(part.column("x").to_pylist(), part.column("y").to_pylist())]
                yield part.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(merged(form("u", "x")), "u").join(merged(form("v", "y")), "v").select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def within(x: str, y: str, allowed: int) -> bool:
    """Whether the edit distance of two texts is ``allowed`` at most. Texts of one length that differ in few places are, texts
    that share too few words, in whatever order, are not; for others the distance is taken by bits (Myers, 1999; Hyyro, 2003) between the ends they share."""
    if abs(len(x) - len(y)) > allowed:
        return False
    if len(x) == len(y) and sum(map(ne, x, y)) <= allowed:
        return True
    if max(len(x), len(y)) - sum(min(x.count(c), y.count(c)) for c in set(x) & set(y)) > allowed:
        return False
    low, high = 0, min(len(x), len(y))
    while low < high and x[low] == y[low]:
        low += 1
    end = 0
    while end < high - low and x[-1 - end] == y[-1 - end]:
        end += 1
    x, y = sorted((x[low : len(x) - end], y[low : len(y) - end]), key=len)
    if len(y) <= allowed or not x:
        return len(y) <= allowed
    at: dict[str, int] = {}
    for i, c in enumerate(x):
        at[c] = at.get(c, 0) | 1 << i
    full, last, score = (1 << len(x)) - 1, 1 << len(x) - 1, len(x)
    up, down, most = full, 0, allowed + len(y)
    for c in y:
        here = at.get(c, 0)
        across = here | down
        diagonal = (((here & up) + up) ^ up) | here
        more, less = down | full & ~(diagonal | up), up & diagonal
        most -= 1
        if more & last:
            score += 1
        elif less & last:
            score -= 1
        if score > most:  # too many for the words that are left
            return False
        more = more << 1 | 1
        up, down = (less << 1 | ~(across | more)) & full, more & across & full
    return score <= allowed


def _sign(word: bytes) -> str:
    """A word as one character beyond the basic plane: an edit distance of such texts counts words (two words share a sign once in a million)."""
    return chr(0x10000 + xxhash.xxh32_intdigest(word) % 0xFFFFE)


def _normal_forms(batches):
    for b in sliced(batches):
        words = ["".join(map(_sign, normal_lines(t)[0])) for t in b.column("line").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("wording"), pa.array(words, pa.string())], ["wording", "norm"])


def _signs(batches):
    """As ``_normal_forms``, many lines at a time."""
    for b in batches:
        for i, j in by_size(b.column("line"), BYTES):
            part = b.slice(i, j - i)
            w = Words([normal_bytes(t).replace(b"\n", b" ") for t in part.column("line").to_pylist()])
            text = (w.h % _U(0xFFFFE) + _U(0x10000)).astype("<u4").tobytes().decode("utf-32-le")
            ends = np.cumsum(w.n).tolist()
            yield pa.RecordBatch.from_arrays([part.column("wording"), pa.array([text[x:y] for x, y in zip([0, *ends], ends)], pa.string())], ["wording", "norm"])


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "rk", "line_no")


def _cut(batches):
    """Of texts the lines that are asked for (``at``: line_no and wording of each)."""
    for b in batches:
        for i, j in by_size(b.column("text"), BYTES):
            part = b.slice(i, j - i)
            at = part.column("at").flatten()
            numbers = iter(at.field("line_no").to_pylist())
            lines = []
            for t, n in zip(part.column("text").to_pylist(), pc.list_value_length(part.column("at")).to_pylist()):
                parts = t.split("\n")
                lines += [parts[k] for k in islice(numbers, n)]
            yield pa.RecordBatch.from_arrays([at.field("wording"), pa.array(lines, pa.string())], ["wording", "line"])


def _norms(docs: DataFrame, named: DataFrame, forms=_normal_forms) -> DataFrame:
    """wording and norm of ``named`` (wording, first)."""
    places = named.groupBy("first.rk").agg(F.collect_list(F.struct("first.line_no", "wording")).alias("at"))
    found = docs.select("rk", "text").join(places.hint("shuffle_hash"), "rk").select("text", "at")
    return written(found.mapInArrow(lambda batches: forms(_cut(batches)), "wording long, norm string").dropDuplicates(["wording"]), "op9-norms")


def _gone(lines: DataFrame, wordings: DataFrame, links: DataFrame) -> DataFrame:
    """rk, looked and line_no of each line that goes: of each group of linked wordings the first line stays."""
    roots = components(links, "op9")
    named = wordings.join(merged(roots.select(F.col("node").alias("wording"), "root")), "wording", "left").filter("root IS NOT NULL OR n > 1").select("wording", "first", F.coalesce("root", "wording").alias("root"), "n")
    keep = named.groupBy("root").agg(F.min("first").alias("keep"), F.sum("n").alias("n")).filter("n > 1").drop("n")
    going = named.join(merged(keep), "root").select("wording", "keep")
    first = (F.col("rk") == F.col("keep.rk")) & (F.col("line_no") == F.col("keep.line_no"))
    return lines.join(merged(going), "wording").filter(~first).select("rk", "looked", "line_no")


def duplicate_lines(docs: DataFrame, *, similarity: float = 0.8, min_words: int = 5) -> DataFrame:
    """rk, looked and line_no of each line of ``min_words`` words that goes, of ``docs`` (rk, doc_id, text)."""
    lines = written(line_hashes(docs, min_words), "op9-lines")
    wordings = written(lines.groupBy("wording").agg(F.min(_place()).alias("first"), F.first("simhash").alias("simhash"), F.count(F.lit(1)).alias("n")), "op9-wordings")
    each = written(wordings.groupBy("simhash").agg(F.min("wording").alias("rep"), F.count(F.lit(1)).alias("c")), "op9-simhashes")
    cells = written(block_cells(each.select("simhash")), "op9-cells")
    # members with a near other in their cell: all that follows is about these, and wordings that share a SimHash
    near = cells.alias("a").join(cells.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.simhash") != F.col("b.simhash")) & (_apart("a.simhash", "b.simhash") <= DISTANCE), "left_semi")
    near = written(near, "op9-near")
    wanted = near.select("simhash").unionByName(each.filter("c > 1").select("simhash")).distinct()
    named = written(wordings.join(wanted, "simhash").join(each.select("simhash", "rep"), "simhash").select("simhash", "wording", "rep", "first"), "op9-wanted")
    norms = _norms(docs, named)
    # first a star per cell and per SimHash: as many pairs as there are members. It joins most groups whole.
    star = near.filter((F.col("simhash") != F.col("leader")) & (_apart("simhash", "leader") <= DISTANCE)).select("simhash", "leader").distinct()
    star = star.join(each.select("simhash", F.col("rep").alias("u")), "simhash").join(each.select(F.col("simhash").alias("leader"), F.col("rep").alias("v")), "leader").select("u", "v")
    first = written(_confirmed(star.unionByName(named.filter("wording <> rep").select(F.col("wording").alias("u"), F.col("rep").alias("v"))), norms, similarity), "op9-star")
    up = written(components(first, "op9-once").select(F.col("node").alias("wording"), "root"), "op9-once-roots")
    rooted = written(named.join(up, "wording", "left").select("simhash", "wording", F.coalesce("root", "wording").alias("root")), "op9-rooted")
    # then every other pair, where the two sides are not yet known to be of one group
    label = rooted.groupBy("simhash").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    marked = near.join(label, "simhash")
    apart = (F.col("a.low") != F.col("a.high")) | (F.col("b.low") != F.col("b.high")) | (F.col("a.low") != F.col("b.low"))
    rest = marked.alias("a").join(marked.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.simhash") < F.col("b.simhash")) & (_apart("a.simhash", "b.simhash") <= DISTANCE) & apart)
    rest = rest.select(F.col("a.simhash").alias("a"), F.col("b.simhash").alias("b")).distinct().unionByName(label.filter("low <> high").select(F.col("simhash").alias("a"), F.col("simhash").alias("b")))
    side = lambda h, w, r: rooted.select(F.col("simhash").alias(h), F.col("wording").alias(w), F.col("root").alias(r))
    rest = rest.join(side("a", "u", "ru"), "a").join(side("b", "v", "rv"), "b").filter("ru <> rv AND (a <> b OR u < v)").select("u", "v")
    return _gone(lines, wordings, first.unionByName(_confirmed(rest, norms, similarity)))


LINES = "rk long, doc_id long, line_no int, looked int, wording long, check long, size int, parity binary, bucket int, cells binary"


def line_keys(docs: DataFrame, similarity: float, min_words: int) -> DataFrame:
    """rk, doc_id, line_no, looked (how many lines with a word the text has), wording and check (two hashes of it) of each line with a word of every text; where a stretch of texts first has a wording of ``min_words`` words its size and parities. Also rows of keys: bucket and cells (key, wording and size of each, packed)."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET))

    def run(batches):
        for b in batches:
            for i, j in by_size(b.column("text"), BYTES):
                part = b.slice(i, j - i)
                texts = [t or "" for t in part.column("text").to_pylist()]
                w = Words([normal_bytes(t) for t in texts])
                full = np.flatnonzero(w.n)
                wording, check, size = w.wording, w.check, w.n
                # short lines that differ in a number are no copies
                exact: dict[int, list] = {}
                for k in np.flatnonzero((size > 0) & (size < min_words)).tolist():
                    if b"0" in w.form(k):
                        of = int(w.text[k])
                        form = exact.setdefault(of, normal_lines(texts[of], _EXACT))[int(w.number[k])]
                        wording[k], check[k] = xxhash.xxh64_intdigest(b" ".join(form), 1), xxhash.xxh64_intdigest(b" ".join(form), 2)
                _, new = np.unique(wording[full], return_index=True)
                new = full[new]
                new = np.sort(new[size[new] >= min_words])
                old = np.ones(len(size), bool)
                old[new] = False
                mask = old[full]
                ends = np.append(0, np.cumsum(~mask) * (PARITY // 8)).astype(np.int32)
                parity = pa.Array.from_buffers(pa.binary(), len(full), [pa.array(~mask).buffers()[1], pa.py_buffer(ends), pa.py_buffer(w.parities(new).tobytes())])
                rows = [part.column(c).take(pa.array(w.text[full])) for c in ("rk", "doc_id")]
                looked = np.bincount(w.text[full], minlength=len(texts)).astype(np.int32)[w.text[full]]
                cols = [*rows, pa.array(w.number[full].astype(np.int32)), pa.array(looked), pa.array(wording[full].view(np.int64)), pa.array(check[full].view(np.int64)), pa.array(size[full].astype(np.int32), mask=mask), parity]
                yield pa.RecordBatch.from_arrays([*cols, pa.nulls(len(full), pa.int32()), pa.nulls(len(full), pa.binary())], [x.split()[0] for x in LINES.split(", ")])
                line, key = w.keys(new, None, similarity)
                packed = np.empty(len(key), _CELL)
                packed["key"], packed["wording"], packed["size"] = key & _U(0xFFFFFFFF), wording[line], np.minimum(size[line], 0xFFFF)
                to = ((key >> _U(32)) % _U(buckets)).astype(np.int32)
                order = np.argsort(to, kind="stable")
                to, packed = to[order], packed[order]
                at = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.empty(0, int), len(to))
                empty = [pa.nulls(len(at) - 1, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*empty, pa.array(to[at[:-1]], pa.int32()), pa.array([packed[x:y].tobytes() for x, y in zip(at, at[1:])], pa.binary())], [x.split()[0] for x in LINES.split(", ")])

    return docs.mapInArrow(run, LINES)


def _members(similarity: float):
    def run(key, group):
        """Of a bucket's cells, each cut where the sizes of neighbours are too far apart, the members that are not alone: cell and wording."""
        c = np.concatenate([np.frombuffer(x, _CELL) for x in group.column("cells").to_pylist()])
        c = c[np.lexsort((c["wording"], c["size"], c["key"]))]
        c = c[np.append(True, (c["key"][1:] != c["key"][:-1]) | (c["wording"][1:] != c["wording"][:-1]))]
        size = c["size"].astype(np.int64)
        first = np.flatnonzero(np.append(True, (c["key"][1:] != c["key"][:-1]) | (np.diff(size) > np.floor((1 - similarity) * size[1:] + 1e-9))))
        n = np.diff(np.append(first, len(c)))
        cell = np.repeat((key[0].as_py() << 34) + first, n)
        w = c["wording"].astype(np.uint64).view(np.int64)
        more = np.repeat(n > 1, n)
        return pa.table({"key": pa.array(cell[more]), "wording": pa.array(w[more])})

    return run


def _near(u: np.ndarray, v: np.ndarray, size: np.ndarray, parity: np.ndarray, similarity: float) -> np.ndarray:
    """What holds for any two that are similar enough: an edit changes the parity of two words at most, of one where it changes the length."""
    out = np.empty(len(u), bool)
    for p in range(0, len(u), BLOCK // 8):
        x, y = u[p : p + BLOCK // 8], v[p : p + BLOCK // 8]
        allowed, longer = np.floor((1 - similarity) * np.maximum(size[x], size[y]) + 1e-9).astype(np.int64), np.abs(size[x] - size[y])
        out[p : p + BLOCK // 8] = (longer <= allowed) & (np.bitwise_count(parity[x] ^ parity[y]).sum(1, dtype=np.int64) <= 2 * allowed - longer)
    return out


def _arrays(group: pa.Table) -> list[np.ndarray]:
    """Key, wording, root, size and parities of the members of some cells, by key and size."""
    group = group.sort_by([("key", "ascending"), ("size", "ascending")])
    parity = np.frombuffer(b"".join(group.column("parity").to_pylist()), "<u8").reshape(-1, PARITY // 64)
    return [*(group.column(c).to_numpy() for c in ("key", "wording", "root")), group.column("size").to_numpy().astype(np.int64), parity]


def _stars(similarity: float):
    def run(key, group):
        """Each member with its cell's least wording, where the two may be similar. Where not, but the member may be similar to others of the cell, it and these, each with itself."""
        cell, wording, _, size, parity = _arrays(group)
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        n = np.diff(np.append(first, len(cell)))
        order = np.lexsort((wording, cell))
        lead = np.repeat(order[first], n)
        u, v = np.flatnonzero(wording != wording[lead]), lead[wording != wording[lead]]
        ok = _near(u, v, size, parity, similarity)
        pairs = [np.stack([wording[u[ok]], wording[v[ok]]], 1)]
        begin, end = _window(cell, first, size, similarity)
        n = end - begin
        for far in _blocks(u[~ok], n):
            a = np.repeat(far, n[far])
            b = np.arange(len(a)) + np.repeat(begin[far] - (np.cumsum(n[far]) - n[far]), n[far])
            a, b = a[a != b], b[a != b]
            fit = _near(a, b, size, parity, similarity)
            either = wording[np.unique(np.concatenate([a[fit], b[fit]]))]
            pairs.append(np.stack([either, either], 1))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        return pa.table({"u": pa.array(pairs[:, 0].copy()), "v": pa.array(pairs[:, 1].copy())})

    return run


def _window(cell: np.ndarray, first: np.ndarray, size: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """For each member the stretch of its cell that holds all of a size that may be similar (members by cell and size; ``first`` of each cell)."""
    at = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(cell)))) << 32
    low, high = np.ceil(similarity * size - 1e-6).astype(np.int64), np.floor(size / similarity + 1e-6).astype(np.int64)
    return np.searchsorted(at | size, at | low, "left"), np.searchsorted(at | size, at | high, "right")


def _blocks(members: np.ndarray, n: np.ndarray):
    """``members`` in stretches of about BLOCK pairs, ``n`` for each."""
    upto = np.cumsum(n[members])
    return np.split(members, np.unique(np.searchsorted(upto, np.arange(BLOCK, int(upto[-1]), BLOCK)))) if len(members) else []


def _unsettled(key, group):
    """Of a bucket's members (key, wording, root) those of cells that hold more than one root."""
    group = group.sort_by([("key", "ascending")])
    cell, root = group.column("key").to_numpy(), group.column("root").to_numpy()
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    mixed = np.repeat(np.minimum.reduceat(root, first) != np.maximum.reduceat(root, first), np.diff(np.append(first, len(cell))))
    return group.filter(pa.array(mixed)).select(["key", "wording", "root"])


def _linked(similarity: float):
    def run(key, group):
        """Of a bucket's members with their words: every two of a cell that may be similar are looked at until they are known to be of one group, and the links that join two groups are
        returned, one fewer than there are roots at most. Of pairs that are no links none leaves the cell."""
        norm = group.column("norm").to_pylist()
        size = np.fromiter(map(len, norm), np.int64, len(norm))
        cell, wording, root = (group.column(c).to_numpy() for c in ("key", "wording", "root"))
        order = np.lexsort((wording, size, cell))
        cell, wording, root, size, norm = cell[order], wording[order], root[order], size[order], [norm[i] for i in order.tolist()]
        # words told apart by more bits than travel with a member: many near misses end here
        parity = np.zeros((len(norm), WIDE // 64), "<u8")
        for p in range(0, len(norm), 1 << 12):
            part = slice(p, p + (1 << 12))
            sign = np.frombuffer("".join(norm[part]).encode("utf-32-le"), "<u4").astype(np.int64)
            odd = np.bincount(np.repeat(np.arange(len(size[part])), size[part]) * WIDE + sign % WIDE, minlength=len(size[part]) * WIDE) & 1
            parity[part] = np.packbits(odd.astype(bool)).view("<u8").reshape(-1, WIDE // 64)
        _, group_of = np.unique(root, return_inverse=True)
        parent = list(range(int(group_of.max()) + 1))

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        after = _window(cell, first, size, similarity)[1] - np.arange(len(cell)) - 1
        links, seen = [], set()
        for some in _blocks(np.arange(len(cell)), after):
            if not len(some):
                continue
            now = np.fromiter(map(find, range(len(parent))), np.int64, len(parent))[group_of]
            n = after[some]
            u = np.repeat(some, n)
            v = u + 1 + np.arange(len(u)) - np.repeat(np.cumsum(n) - n, n)
            apart = now[u] != now[v]
            u, v = u[apart], v[apart]
            ok = _near(u, v, size, parity, similarity)
            for a, b in zip(u[ok].tolist(), v[ok].tolist()):
                x, y = find(group_of[a]), find(group_of[b])
                if x == y or (pair := (min(wording[a], wording[b]), max(wording[a], wording[b]))) in seen:
                    continue
                if within(norm[a], norm[b], int((1 - similarity) * max(size[a], size[b]) + 1e-9)):
                    parent[x] = y
                    links.append(pair)
                elif len(seen) < BLOCK:  # not compared again in another cell of the bucket
                    seen.add(pair)
        return pa.table({"u": pa.array([u for u, _ in links], pa.int64()), "v": pa.array([v for _, v in links], pa.int64())})

    return run


def every_duplicate_line(docs: DataFrame, *, similarity: float = 0.8, min_words: int = 5) -> DataFrame:
    """``duplicate_lines`` over the lines that share one of their least pairs of words, whatever their SimHashes; also exact copies of lines of fewer than ``min_words`` words."""
    if min_words - int((1 - similarity) * min_words + 1e-9) < 2:
        raise ValueError("similar lines must share two words at least")
    keyed = written(line_keys(docs, similarity, min_words), "op9-lines")
    lines = keyed.filter("bucket IS NULL").select("rk", "doc_id", "line_no", "looked", "wording", "check", "size", "parity")
    members = written(keyed.filter("bucket IS NOT NULL").select("bucket", "cells").groupBy("bucket").applyInArrow(_members(similarity), "key long, wording long"), "op9-members")
    # where two wordings have one hash (a chance of one in 2^64 for each two), their lines stay
    wordings = lines.groupBy("wording").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("n"), F.max("size").alias("size"), F.max("parity").alias("parity"), F.min("check").alias("c"), F.max("check").alias("d"))
    wordings = written(wordings.filter("c = d").drop("c", "d"), "op9-wordings")
    lines = written(lines.select("rk", "looked", "line_no", "wording"), "op9-places")
    dropped(keyed)
    about = ("wording", "size", "parity")
    placed = written(members.join(merged(wordings.select(*about)), "wording"), "op9-placed")
    dropped(members)
    wordings = wordings.select("wording", "first", "n")
    deal = F.shiftright("key", 34)
    # first each cell's members with its least: that joins most groups whole
    star = written(placed.select("key", *about, F.col("wording").alias("root")).groupBy(deal).applyInArrow(_stars(similarity), "u long, v long").distinct(), "op9-near")
    # words are fetched of these only: whatever pair comes up later is of members near their least one, or named with themselves
    wanted = star.select(F.col("u").alias("wording")).unionByName(star.select(F.col("v").alias("wording"))).distinct()
    norms = _norms(docs, wordings.join(merged(wanted), "wording").select("wording", "first"), _signs)
    first = written(_confirmed(star.filter("u <> v"), norms, similarity), "op9-star")
    # a step towards the least of each group tells which members are known to be of one
    ends = first.select("u", "v").unionByName(first.select(F.col("v").alias("u"), F.col("u").alias("v")))
    up = ends.groupBy("u").agg(F.min("v").alias("v"))
    up = up.alias("a").join(merged(up).alias("b"), F.col("a.v") == F.col("b.u")).select(F.col("a.u").alias("wording"), F.least("a.u", "a.v", "b.v").alias("root"))
    rooted = placed.select("key", "wording").join(merged(up), "wording", "left").select("key", "wording", F.coalesce("root", "wording").alias("root"))
    # cells that are not of one group yet: their members that have words meet again, with these
    unsettled = rooted.groupBy(deal).applyInArrow(_unsettled, "key long, wording long, root long").join(merged(norms), "wording")
    return _gone(lines, wordings, first.unionByName(unsettled.groupBy(deal).applyInArrow(_linked(similarity), "u long, v long")))


def without_lines(docs: DataFrame, *, similarity: float = 0.8, min_words: int = 5, every: bool = False) -> DataFrame:
    """``docs`` (doc_id, text and whatever else) with duplicate lines dropped from the text; more columns: n_lines, n_dropped, and, where lines went, n_left, the lines looked at that stay (they replace columns of these names). ``every``: by ``every_duplicate_line``, as the queries do; else by ``duplicate_lines``, within DISTANCE bits of SimHash."""
    plain = docs.drop("n_lines", "n_dropped", "n_left")
    lines = (every_duplicate_line if every else duplicate_lines)(only(plain, doc_id="doc_id", text="text").select(row_key().alias("rk"), "doc_id", "text"), similarity=similarity, min_words=min_words)
    gone = lines.groupBy("rk").agg(F.collect_set("line_no").alias("__haltlens_gone"), F.max("looked").alias("__haltlens_looked"))
    joined = plain.withColumn("__haltlens_rk", row_key()).join(gone.withColumnRenamed("rk", "__haltlens_rk").hint("shuffle_hash"), "__haltlens_rk", "left").drop("__haltlens_rk")
    joined = joined.withColumn("__haltlens_parts", F.split("text", "\n"))
    gone, parts = F.col("__haltlens_gone"), F.col("__haltlens_parts")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)  # by hash, in order
    lines_left = F.transform(stay, lambda i: F.get(parts, i))
    text = F.when(gone.isNull(), F.col("text")).otherwise(F.array_join(lines_left, "\n"))
    return joined.select(
        *[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in plain.columns],
        F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"),
        (F.col("__haltlens_looked") - F.size("__haltlens_gone")).cast("long").alias("n_left"),
    )
