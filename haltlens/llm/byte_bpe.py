"""Byte-level BPE by backtracking: exact merge results in linear time, without running the merges.

The vocabulary's byte strings, read as Latin-1, go into an Aho-Corasick automaton that finds the longest token at every byte
position of a match of the splitting pattern. From left to right the longest token is taken; it may stand after its
predecessor only if the merge order would not have merged across their border. If not, shorter prefixes are tried, and if none
stands, the predecessor is taken back and its end position is marked dead, so that each position is left at most once. Border
compatibility is memoised. Encodings of matches that recur are kept in a bounded table per Python worker.

Defined results: null text is empty text, which has no ids (digest of the empty string); special-token strings are ordinary
text; texts of any length are encoded whole, one pattern match at a time, a few texts at a time; repeated rows give repeated results; an empty table stays
empty; a null doc_id is kept; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import only, sliced

#: Matches whose encodings a worker keeps; the table starts anew beyond it.
CACHED = 400_000
#: Border verdicts that a worker keeps.
BORDERS = 1_000_000


class BacktrackingBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split = regex.compile(pattern).findall
        self.ranks = ranks
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.bytes[i] = b
        self.pair: dict[tuple[int, int], int] = {}
        self.parts = [(i, i) for i in range(len(self.bytes))]
        self.shorter = [-1] * len(self.bytes)
        self.automaton = ahocorasick.Automaton()
        self.borders: dict[tuple[int, int], bool] = {}
        for i, b in enumerate(self.bytes):
            if not b:
                continue
            self.automaton.add_word(b.decode("latin-1"), (len(b), i))
            for j in range(len(b) - 1, 0, -1):
                if (p := ranks.get(b[:j], -1)) >= 0:
                    self.shorter[i] = p
                    break
            for j in range(1, len(b)):
                x, y = ranks.get(b[:j], i), ranks.get(b[j:], i)
                if x < i and y < i and self._stands(x, y):
                    self.pair[x, y] = i
                    self.parts[i] = (x, y)
                    break
        self.automaton.make_automaton()
        self.borders.clear()
        self.known: dict[str, tuple[tuple[int, ...], str]] = {}

    def _stands(self, a: int, b: int) -> bool:
        """Whether the merges leave a border between tokens a and b: none that joins across it comes before those that build a or b."""
        pair, parts, limit = self.pair, self.parts, 1 << 60
        while pair.get((a, b), limit) >= limit:
            left, right = parts[a][1], parts[b][0]
            if left == a and right == b:
                return True
            if right == b or (a > b and left != a):
                limit, a = a, left
            else:
                limit, b = b + 1, right
        return False

    def stands(self, a: int, b: int) -> bool:
        known = self.borders.get((a, b))
        if known is None:
            if len(self.borders) >= BORDERS:
                self.borders.clear()
            known = self.borders[a, b] = self._stands(a, b)
        return known

    def encode_match(self, data: bytes) -> tuple[int, ...]:
        """Ids of one match of the splitting pattern."""
        if (whole := self.ranks.get(data)) is not None:
            return (whole,)
        n = len(data)
        longest = [-1] * (n + 1)
        size = [0] * (n + 1)
        for end, (length, i) in self.automaton.iter(data.decode("latin-1")):
            at = end + 1 - length
            if length > size[at]:
                size[at], longest[at] = length, i
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        lengths, shorter, borders, stands = self.bytes, self.shorter, self.borders, self.stands
        while at < n:
            last = out[-1] if out else -1
            while True:
                if token < 0:  # nothing stands here: take the predecessor back
                    alive[at] = 0
                    out.pop()
                    at -= len(lengths[last])
                    token = last
                    break
                end = at + len(lengths[token])
                if alive[end] and (last < 0 or (ok if (ok := borders.get((last, token))) is not None else stands(last, token))):
                    out.append(token)
                    at, token = end, longest[end]
                    break
                token = shorter[token]
        return tuple(out)

    def encode_text(self, text: str) -> tuple[list[int], str]:
        """Ids of a whole text, and the same as decimals."""
        ids: list[int] = []
        said: list[str] = []
        known = self.known
        for m in self.split(text):
            got = known.get(m)
            if got is None:
                new = self.encode_match(m.encode())
                got = (new, " ".join(map(str, new)))
                if len(known) >= CACHED:
                    known.clear()
                known[m] = got
            ids += got[0]
            said.append(got[1])
        return ids, " ".join(said)

    def encode(self, text: str) -> list[int]:
        return self.encode_text(text)[0]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> BacktrackingBPE:
    """One per worker process; the vocabulary is part of the installed tokenizer package, as on every executor."""
    return BacktrackingBPE(read_ranks(path), pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array<int>) of every row of ``docs``."""

    def run(batches):
        c = codec(ranks_path, pattern)
        for b in sliced(batches):
            ids = [c.encode(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return only(docs, doc_id="doc_id", text="text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(rows: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and bytes (binary) of every row of ``rows`` (doc_id, ids); null ids are no ids."""

    def run(batches):
        c = codec(ranks_path, pattern)
        for b in sliced(batches):
            data = [c.decode(i or ()) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "bytes"])

    return only(rows, doc_id="doc_id", ids="ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encodes and decodes every whole text in one pass; digests of both, so that the ids need not leave the worker."""

    def run(batches):
        c = codec(ranks_path, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in sliced(batches):
            n, of_ids, of_text = [], [], []
            for t in b.column("text"):
                ids, said = c.encode_text(t.as_py() or "")
                n.append(len(ids))
                of_ids.append(sha(said.encode()))
                of_text.append(sha(c.decode(ids)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return only(docs, doc_id="doc_id", text="text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
