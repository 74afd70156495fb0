"""Token-id files: static range asymmetric numeral system over shared frequency tables, in independent interleaved blocks.

File format: a Parquet folder of blocks in ascending doc_id order, beside one frequency table. One pass counts ids of all
documents; counts are scaled to a power of two (every id that occurs keeps at least 1). A block holds whole documents; its ids
are dealt in turn to up to ``lanes`` interleaved coders with 63-bit states and 32-bit words, so that encoding and decoding are
vector operations. Each block carries its document directory, the coder states at checkpoints every ``every`` steps (decoding
may start at any of them, several at a time), and CRC-32 checksums of ids and words; blocks decode independently.

Block bytes: magic, header of 8 unsigned 64-bit numbers (documents, ids, lanes, words, checkpoint distance, checkpoints,
CRC of ids, CRC of words), null mask and doc_ids, lengths, word offset and states of each checkpoint, words; little-endian.

Defined results: null or empty text is the end id alone; a null doc_id sorts first and is kept; rows with equal doc_id stay
apart, ordered by their ids; no documents give no blocks. A block larger than the target is one very long document; texts are
tokenized some eight megabytes at a time. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import new_path, only, written

MAGIC = b"HLRANS01"
SCALE = 20  # bits of the frequency total
LOW = np.uint64(1 << 31)  # smallest state
_U = np.uint64
#: Pieces whose ids a worker keeps; at most twice as many are held.
CACHED = 400_000
#: Bytes of text tokenized at a time (more if one text is longer).
BYTES = 1 << 23


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**SCALE; each id that occurs has one of at least 1."""
    total = 1 << SCALE
    live = np.flatnonzero(counts)
    if len(live) > total:
        raise ValueError("more different ids than the frequency total")
    out = np.zeros(len(counts), np.uint32)
    if not len(live):
        return out
    share = counts[live].astype(np.float64) * (total / counts.sum())
    f = np.maximum(1, np.floor(share)).astype(np.int64)
    short = total - int(f.sum())
    if short > 0:
        f[np.argmax(f)] += short
    while short < 0:  # taken from the largest, where it costs least
        i = int(np.argmax(f))
        take = min(-short, max(1, int(f[i]) // 2))
        f[i] -= take
        short += take
    out[live] = f
    return out


class Table:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq.astype(np.uint64))[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


def _lanes(n: int, lanes: int) -> int:
    return max(1, min(lanes, n // 256))


def encode_block(ids: np.ndarray, table: Table, doc_ids: list, lengths: np.ndarray, *, lanes: int = 1024, every: int = 128) -> bytes:
    n = len(ids)
    k = _lanes(n, lanes)
    steps = -(-n // k)
    f, c = table.freq[ids], table.start[ids]
    if n and not f.all():
        raise ValueError("an id without frequency")
    x = np.full(k, LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[np.ndarray] = []
    emitted: list[int] = []
    with np.errstate(over="ignore"):
        for s in range(steps - 1, -1, -1):
            fs, cs = f[s * k : (s + 1) * k], c[s * k : (s + 1) * k]
            y = x[: len(fs)]
            full = y >= fs << _U(63 - SCALE)
            w = y[full].astype(np.uint32)
            words.append(w)
            emitted.append(len(w))
            y = np.where(full, y >> _U(32), y)
            q = y // fs
            x[: len(fs)] = (q << _U(SCALE)) + (y - q * fs) + cs
            if s % every == 0:
                marks.append(x.copy())
    before = np.concatenate([[0], np.cumsum(emitted[::-1])]).astype(np.uint64)
    at = before[0:steps:every]
    stream = np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)
    head = np.array([len(doc_ids), n, k, len(stream), every, len(marks), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(stream.tobytes())], "<u8")
    null = np.packbits(np.array([d is None for d in doc_ids], bool))
    numbers = np.array([0 if d is None else d for d in doc_ids], "<i8")
    return b"".join([MAGIC, head.tobytes(), null.tobytes(), numbers.tobytes(), lengths.astype("<u4").tobytes(), at.astype("<u8").tobytes(), *[m.astype("<u8").tobytes() for m in marks[::-1]], stream.astype("<u4").tobytes()])


class Block:
    """A parsed block; ``ids(a, b)`` decodes the stretch between two checkpoints."""

    def __init__(self, data: bytes, table: Table):
        if data[:8] != MAGIC:
            raise ValueError("not a block")
        docs, self.n, self.k, n_words, self.every, marks, self.ids_crc, words_crc = map(int, np.frombuffer(data, "<u8", 8, 8))
        at = 72
        null = np.unpackbits(np.frombuffer(data, np.uint8, -(-docs // 8), at), count=docs)
        at += -(-docs // 8)
        numbers = np.frombuffer(data, "<i8", docs, at)
        at += 8 * docs
        self.lengths = np.frombuffer(data, "<u4", docs, at)
        at += 4 * docs
        self.words_at = np.frombuffer(data, "<u8", marks, at)
        at += 8 * marks
        self.states = np.frombuffer(data, "<u8", marks * self.k, at).reshape(marks, self.k)
        at += 8 * marks * self.k
        self.words = np.frombuffer(data, "<u4", n_words, at)
        if zlib.crc32(self.words.tobytes()) != words_crc:
            raise ValueError("damaged words")
        self.doc_ids = [None if z else int(d) for z, d in zip(null, numbers)]
        self.marks, self.table = marks, table

    def stretch(self, mark: int) -> np.ndarray:
        """Ids from one checkpoint to the next."""
        t, k = self.table, self.k
        first, last = mark * self.every * k, min(self.n, (mark + 1) * self.every * k)
        out = np.empty(last - first, np.uint32)
        x, at = self.states[mark].copy(), int(self.words_at[mark])
        mask, scale = _U((1 << SCALE) - 1), _U(SCALE)
        for p in range(0, last - first, k):
            y = x[: min(k, last - first - p)]
            slot = y & mask
            sym = t.symbol[slot]
            out[p : p + len(y)] = sym
            y = t.freq[sym] * (y >> scale) + slot - t.start[sym]
            low = np.flatnonzero(y < LOW)
            y[low] = (y[low] << _U(32)) | self.words[at : at + len(low)]
            at += len(low)
            x[: len(y)] = y
        return out

    def ids(self) -> np.ndarray:
        out = np.concatenate([self.stretch(m) for m in range(self.marks)]) if self.marks else np.empty(0, np.uint32)
        if zlib.crc32(out.astype("<u4").tobytes()) != self.ids_crc:
            raise ValueError("damaged ids")
        return out


@lru_cache(maxsize=1)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


class Kept(dict):
    """A table of at most CACHED entries in two generations: what was not asked for since the table was last full goes."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: bytes) -> bytes:
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(self) >= CACHED:
            self.old = dict(self)
            self.clear()
        self[key] = out
        return out


class Pieces:
    """Ids, as bytes, of texts, by way of their chunks between ASCII white space and the pieces that the tokenizer splits these into anyway; pieces are encoded by the library when first met."""

    def __init__(self, path: str):
        self.tok, self.width = tokenizer(path), _width(path)
        self.model, self.code = self.tok.model, "H" if self.width == "<u2" else "I"
        config = json.loads(self.tok.to_str())
        # the short cuts below hold for this normaliser and splitter; any other tokenizer encodes whole texts
        kinds = [n["type"] for n in (config["normalizer"] or {}).get("normalizers", [])]
        split = [n.get("pattern", {}).get("Regex") for n in (config["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.known = kinds == ["NFC", "Replace", "Lowercase"] and split == [SPLIT, None]
        self.special = [a["content"] for a in config["added_tokens"]]
        self.pieces = Kept(self.piece)

    def chunk(self, chunk: bytes) -> bytes:
        if chunk.isalpha():
            return self.pieces[chunk]
        if _BEYOND.search(text := chunk.decode()):
            return self.library(text)
        return b"".join(map(self.pieces.__getitem__, _PIECE.findall(chunk)))

    def piece(self, piece: bytes) -> bytes:
        if piece.isalpha():  # ASCII letters: one word, which normaliser and splitter leave as it is
            ids = [t.id for t in self.model.tokenize(piece.decode())]
        elif _WORD.fullmatch(text := piece.decode()):  # a word as well; the model reads its bytes as signs of their own
            ids = [t.id for t in self.model.tokenize(text.lower().encode().decode("latin-1").translate(_SIGNS))]
        else:
            return self.library(text)
        return array(self.code, ids).tobytes()

    def library(self, text: str) -> bytes:
        return array(self.code, self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def of(self, text: str) -> bytes:
        if not self.known or any(s in text for s in self.special):
            return self.library(text)
        return b"".join(map(self.chunk, text.encode().lower().split()))

    def all(self, texts: pa.Array, end_id: int) -> pa.Array:
        """The ids of each text and the end id, as bytes; each different chunk is looked up once."""
        texts = pc.fill_null(texts, "")
        special = any(pc.any(pc.match_substring(texts, s)).as_py() for s in self.special)
        if not self.known or special:
            end = array(self.code, [end_id]).tobytes()
            return pa.array([self.of(t.as_py()) + end for t in texts], pa.binary())
        chunks = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        coded = chunks.flatten().cast(pa.binary()).dictionary_encode()
        met = self.pieces.get
        ids = [met(c) or self.chunk(c) for c in coded.dictionary.to_pylist()]
        width = array(self.code).itemsize
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // width
        flat, begin = np.frombuffer(b"".join(ids), self.width), np.cumsum(size) - size
        which = coded.indices.to_numpy()
        n = size[which]
        ends = np.cumsum(n)
        out = flat[np.arange(int(n.sum())) + np.repeat(begin[which] - (ends - n), n)]
        to = np.append(0, ends)[chunks.offsets.to_numpy() - chunks.offsets[0].as_py()]
        out = np.insert(out, to[1:], end_id)
        offsets = ((to + np.arange(len(to))) * width).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


#: The splitting rule for which ``Pieces`` may split first. Neither its matches nor the normalisation reach across ASCII white space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Chunks with characters beyond printable ASCII, white space and Latin-1 letters are not split further; in others the rule is this.
_BEYOND = re.compile("[^\t-\r -~\xc0-\xd6\xd8-\xf6\xf8-\xff]")
_WORD = re.compile("[a-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
#: Byte-level vocabularies write the bytes that are no visible Latin-1 signs as the characters from 256 on, in order.
_SIGNS = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b))}
_PIECE = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\xff]+|[0-9]|[!-/:-@\[-`{-~]+")


@lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(maxsize=4)
def _width(path: str) -> str:
    return "<u2" if tokenizer(path).get_vocab_size() <= 65536 else "<u4"


def tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id and ids (binary, 2 or 4 bytes each by vocabulary size) of every row, end id appended."""

    def run(batches):
        known = pieces(path)
        for b in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // BYTES
            cuts = np.flatnonzero(np.diff(size, prepend=-1, append=-1))
            for i, j in zip(cuts, cuts[1:]):
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), known.all(part.column("text"), end_id)], ["doc_id", "ids"])

    return only(docs, doc_id="doc_id", text="text").mapInArrow(run, "doc_id long, ids binary")


def frequency_table(tokens: DataFrame, width: str, size: int) -> np.ndarray:
    """Counts of all ids, scaled. What reaches the driver is one number per vocabulary entry and task, summed on the executors first."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            for p in range(0, b.num_rows, 2000):
                joined = b"".join(b.column("ids").slice(p, 2000).to_pylist())
                total += np.bincount(np.frombuffer(joined, width), minlength=size)
        live = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array(total[live], pa.int64())], ["id", "n"])

    counts = np.zeros(size, np.int64)
    for r in tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["id"]] = r["n"]
    return scaled(counts)


BLOCKS = "part int, seq long, n_ids long, block binary"


def write(docs: DataFrame, out: str, tokenizer_path: str, *, end_id: int = 1, block_ids: int = 1 << 18, lanes: int = 1024, every: int = 128) -> None:
    """Tokenizes ``docs`` and writes the token-id file ``out`` (a folder with ``table`` and ``blocks``)."""
    spark = docs.sparkSession
    size, width = tokenizer(tokenizer_path).get_vocab_size(), _width(tokenizer_path)
    tokens = written(tokenized(docs, tokenizer_path, end_id), "op3-tokens")
    freq = frequency_table(tokens, width, size)
    spark.createDataFrame([(bytearray(freq.astype("<u4").tobytes()),)], "freq binary").coalesce(1).write.parquet(f"{out}/table")

    def run(batches):
        table, part, seq = Table(freq), TaskContext.get().partitionId(), 0
        doc_ids, held, n = [], [], 0

        def flush():
            ids = np.frombuffer(b"".join(held), width).astype(np.uint32)
            data = encode_block(ids, table, doc_ids, np.array([len(h) // np.dtype(width).itemsize for h in held]), lanes=lanes, every=every)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([n], pa.int64()), pa.array([data], pa.binary())], ["part", "seq", "n_ids", "block"])

        for b in batches:
            for d, i in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist()):
                doc_ids.append(d)
                held.append(i)
                n += len(i) // np.dtype(width).itemsize
                if n >= block_ids:
                    yield flush()
                    doc_ids, held, n, seq = [], [], 0, seq + 1
        if held:
            yield flush()

    ordered = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(f"{out}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a token-id file, in any order: doc_id, start, n_tokens, ids_crc32."""
    freq = np.frombuffer(spark.read.parquet(f"{path}/table").first()["freq"], "<u4")
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    sizes = blocks.select("part", "seq", "n_ids")
    # ids before each block: within its part by a window on the part, and before its part from one total per part
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", before.alias("base"))
    inside = F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", "seq", inside.alias("inside")).join(parts, "part").select("part", "seq", (F.col("base") + F.col("inside")).alias("block_start"))

    def run(batches):
        table = Table(freq)
        for b in batches:
            for start, data in zip(b.column("block_start").to_pylist(), b.column("block")):
                k = Block(data.as_py(), table)
                ids = k.ids().astype("<u4")
                ends = np.cumsum(k.lengths, dtype=np.int64)
                begins = ends - k.lengths
                crc = [zlib.crc32(ids[i:j].tobytes()) for i, j in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(k.doc_ids, pa.int64()), pa.array(begins + start, pa.int64()), pa.array(k.lengths.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.drop("n_ids").join(starts, ["part", "seq"]).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_path: str, **params) -> DataFrame:
    """Writes ``docs`` as a token-id file in the shared folder and returns what ``read`` finds there."""
    out = new_path(docs.sparkSession, "op3-file")
    write(docs, out, tokenizer_path, **params)
    return read(docs.sparkSession, out)
