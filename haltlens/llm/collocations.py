"""Phrase collocations from depth-limited count tries.

Each task counts its documents in runs: a run is a trie of language, first, second and third word, and every node holds how often its path occurs.
A run is serialised sorted (in preorder, words by their bytes) and written. Runs are then merged k ways by prefix range in rounds of ``FAN``: boundaries, taken from evenly
spaced paths of the runs, cut each range into as many ranges as it has runs, ``FAN`` at most, each run is cut at them, and up to ``FAN`` parts of a range are merged into one. What a merge holds
is about the size of one run in every round, however large the input, and a range may begin at any depth, so that neither a hot word nor a hot pair
has to stay whole. A part also carries the nodes above its first path, with their counts, so that a walk up the merged trie always
gives the left parts of a phrase and its language's number of words.

The right part of a phrase is found by its suffix link: its last words are a phrase themselves, with a node that counts at least as often. Links
join the frequent nodes alone; a three-word phrase gets its last word from the node of its last two.

Scores are exact (decimals of 38 digits, whole division). The first ``top`` phrases of a language are taken from salted parts of it first.

Defined results: null text is empty; null language is ``und``; repeated rows count as often as they occur, ties end in the order of the phrases' bytes; very long texts are
split like others, in one run; languages without a candidate have no rows, an empty table has none; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from itertools import count as numbers

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import dropped, only, written

#: Parts merged at a time, and ranges that a range is cut into.
FAN = 128
#: Text bytes of a run.
RUN = 12 << 20
#: Paths that a run offers as boundaries, and those of a range that are weighed at most (about).
OFFERED, WEIGHED = 256, 1 << 14
SALT = 64
#: Ranges whose boundaries (``FAN`` short paths each) are sent to all tasks; with more ranges they are joined.
SENT = 4_096
_END = np.zeros(1, np.uint32)
_BREAKS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b".........")
NODES = "lang string, m int, phrase string, suffix string, head string, a long, l1 long, l2 long, n long"


# ---- tries: of each language its words in order of their bytes, and its nodes in preorder: up to three word numbers from 1 (0: none), and a count


Trie = dict[str, tuple[list[bytes], np.ndarray, np.ndarray]]


def keys(path: np.ndarray, size: int) -> np.ndarray:
    """One number a node (rows of ``path``), in the order of the paths; ``size`` words are numbered."""
    bits = int(size + 1).bit_length()
    a, b, c = (path[i].astype(np.uint64) for i in range(3))
    if 3 * bits <= 64:
        return a << np.uint64(2 * bits) | b << np.uint64(bits) | c
    pair = np.unique(a << np.uint64(32) | b, return_inverse=True)[1].astype(np.uint64)
    return pair << np.uint64(32) | c


def packed(trie: Trie) -> bytes:
    head = json.dumps([[lang, len(words), len(counts)] for lang, (words, _, counts) in trie.items()]).encode()
    parts = [len(head).to_bytes(4, "little"), head]
    for words, path, counts in trie.values():
        text = b"\n".join(words)
        parts += [len(text).to_bytes(4, "little"), text, path.astype("<u4").tobytes(), counts.astype("<i8").tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpacked(blob: bytes) -> Trie:
    data = zstandard.ZstdDecompressor().decompress(blob)
    at = 4 + int.from_bytes(data[:4], "little")
    trie = {}
    for lang, n_words, n in json.loads(data[4:at]):
        size = int.from_bytes(data[at : at + 4], "little")
        words = data[at + 4 : at + 4 + size].split(b"\n") if n_words else []
        at += 4 + size
        path = np.frombuffer(data, "<u4", 3 * n, at).reshape(3, n)
        counts = np.frombuffer(data, "<i8", n, at + 12 * n)
        at += 20 * n
        trie[lang] = (words, path, counts)
    return trie


class Run:
    """Counts texts of any languages."""

    def __init__(self):
        self.langs: dict[str, tuple[dict[bytes, int], list[np.ndarray]]] = {}
        self.size = 0

    def add(self, lang: str, text: bytes) -> None:
        known, parts = self.langs.setdefault(lang, ({b".": 0}, [_END]))
        new = numbers(len(known)).__next__
        tokens = text.lower().translate(_BREAKS).replace(b".", b" . ").split()  # a dot stands in no word
        for t in set(tokens).difference(known):
            known[t] = new()
        parts += [np.fromiter(map(known.__getitem__, tokens), np.uint32, len(tokens)), _END]
        self.size += len(text)

    def trie(self) -> Trie:
        out = {}
        for lang in sorted(self.langs):
            known, parts = self.langs[lang]
            first = list(known)
            order = sorted(range(1, len(first)), key=first.__getitem__)
            rank = np.zeros(len(first), np.uint32)
            rank[np.array(order, np.int64)] = np.arange(1, len(first), dtype=np.uint32)
            ids = rank[np.concatenate([*parts, _END, _END])]
            a, b, c = ids[:-2], ids[1:-1], ids[2:]
            word, two = a > 0, (a > 0) & (b > 0)
            three, none = two & (c > 0), np.zeros(len(a), np.uint32)
            levels = [np.zeros((3, 1), np.uint32), np.stack([a, none, none])[:, word], np.stack([a, b, none])[:, two], np.stack([a, b, c])[:, three]]
            paths, counts = [levels[0]], [np.array([int(word.sum())])]
            for level in levels[1:]:
                k = keys(level, len(first))
                at = np.argsort(k)
                k = k[at]
                begin = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
                paths.append(level[:, at[begin]])
                counts.append(np.diff(np.append(begin, len(k))))
            out[lang] = _ordered([first[i] for i in order], np.concatenate(paths, axis=1), np.concatenate(counts))
        return out


def _ordered(words: list[bytes], path: np.ndarray, counts: np.ndarray):
    """Nodes in preorder, those of one path added up."""
    k = keys(path, len(words))
    at = np.argsort(k, kind="stable")
    k = k[at]
    begin = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    return words, path[:, at[begin]], np.add.reduceat(counts[at].astype(np.int64), begin)


def merged(tries: list[Trie]) -> Trie:
    """The k-way merge: equal paths add up."""
    out = {}
    for lang in sorted({x for t in tries for x in t}):
        parts = [t[lang] for t in tries if lang in t]
        words = sorted(set().union(*(p[0] for p in parts)))
        number = {w: i for i, w in enumerate(words, 1)}
        paths = []
        for own, path, _ in parts:
            to = np.array([0, *map(number.__getitem__, own)], np.uint32)
            paths.append(to[path])
        out[lang] = _ordered(words, np.concatenate(paths, axis=1), np.concatenate([p[2] for p in parts]))
    return out


# ---- prefix ranges: a boundary is a path, as a list of up to three words after the language


Bound = tuple[str, tuple[bytes, ...]]


def _place(section, words_of: tuple[bytes, ...]) -> int:
    """How many nodes of a language's section come before a path."""
    words, path, _ = section
    lo, hi = 0, path.shape[1]
    for depth, w in enumerate(words_of):
        i = bisect_left(words, w)
        level = path[depth, lo:hi]
        exact = i < len(words) and words[i] == w
        left = lo + int(np.searchsorted(level, i + 1))
        if not exact:
            return left
        hi = lo + int(np.searchsorted(level, i + 1, "right"))
        lo = left
        if lo == hi:
            return lo
    return lo


def cut(trie: Trie, lower: Bound | None, upper: Bound | None) -> Trie:
    """The nodes from ``lower`` to before ``upper``, and those above ``lower``."""
    out = {}
    for lang, section in trie.items():
        words, path, counts = section
        if (lower and lang < lower[0]) or (upper and lang > upper[0]):
            continue
        i = _place(section, lower[1]) if lower and lower[0] == lang else 0
        j = _place(section, upper[1]) if upper and upper[0] == lang else len(counts)
        above = []
        if lower and lower[0] == lang:
            for depth in range(len(lower[1])):
                at = _place(section, lower[1][:depth])
                if at < min(i, len(counts)) and _path(section, at) == lower[1][:depth]:
                    above.append(at)
        if j <= i and not above:
            continue
        take = np.concatenate([np.array(sorted(set(above)), np.int64), np.arange(i, max(i, j))])
        part = path[:, take]
        used = np.unique(part)
        used = used[used > 0]
        new = np.zeros(len(words) + 1, np.uint32)
        new[used] = np.arange(1, len(used) + 1, dtype=np.uint32)
        out[lang] = ([words[x - 1] for x in used.tolist()], new[part], counts[take])
    return out


def _path(section, at: int) -> tuple[bytes, ...]:
    words, path, _ = section
    return tuple(words[x - 1] for x in path[:, at].tolist() if x)


def _short(words_of: tuple[bytes, ...]) -> list[bytes]:
    """A path to cut at, not after the given one; it ends with the first word that is very long, cut off."""
    for i, w in enumerate(words_of):
        if len(w) > 64:
            return [*words_of[:i], w[:64]]
    return list(words_of)


def offered(trie: Trie, how_many: int = OFFERED) -> list[tuple[str, list[bytes]]]:
    """Evenly spaced paths."""
    total = sum(len(c) for _, _, c in trie.values())
    step, out, at = max(1, total // how_many), [], 0
    for lang, section in trie.items():
        n = len(section[2])
        out += [(lang, _short(_path(section, i))) for i in range((-at) % step, n, step)]
        at += n
    return out


def owned(trie: Trie, lower: Bound | None, least: int) -> dict[str, tuple]:
    """Nodes of the range that count at least ``least``, and the roots: of each language phrases, numbers of words, counts, counts of the first word and of the first two, and of the language."""
    out = {}
    for lang, section in trie.items():
        words, path, counts = section
        first = _place(section, lower[1]) if lower and lower[0] == lang else 0
        k = keys(path, len(words))
        depth = (path > 0).sum(axis=0)
        at = np.arange(first, len(counts))
        at = at[(counts[at] >= least) | (depth[at] == 0)]
        if not len(at):
            continue
        top = path[:, at].copy()
        top[1:] = 0
        both = path[:, at].copy()
        both[2] = 0
        if 3 * int(len(words) + 1).bit_length() <= 64:
            l1, l2 = (counts[np.searchsorted(k, keys(p, len(words)))] for p in (top, both))
        else:  # keys are ranks, and hold within one call only
            every = keys(np.concatenate([path, top, both], axis=1), len(words))
            n, m = len(counts), len(at)
            l1, l2 = (counts[np.searchsorted(every[:n], x)] for x in (every[n : n + m], every[n + m :]))
        assert depth[0] == 0, "the way up is whole"
        phrases = [[words[x - 1] for x in p if x] for p in path[:, at].T.tolist()]
        out[lang] = (phrases, depth[at].tolist(), counts[at].tolist(), l1.tolist(), l2.tolist(), int(counts[0]))
    return out


# ---- Spark


RUNS = "cell long, grp long, lower struct<lang: string, words: array<binary>>, offered array<struct<lang: string, words: array<binary>>>, n_bytes long, blob binary"
_NAMES = ["cell", "grp", "lower", "offered", "n_bytes", "blob"]
_PATH = pa.struct([("lang", pa.string()), ("words", pa.list_(pa.binary()))])


def _row(cell: int, grp: int, lower: Bound | None, trie: Trie) -> pa.RecordBatch:
    blob = packed(trie)
    as_path = lambda b: None if b is None else {"lang": b[0], "words": list(b[1])}
    values = [pa.array([cell], pa.int64()), pa.array([grp], pa.int64()), pa.array([as_path(lower)], _PATH), pa.array([[as_path(x) for x in offered(trie)]], pa.list_(_PATH)), pa.array([len(blob)], pa.int64()), pa.array([blob], pa.binary())]
    return pa.RecordBatch.from_arrays(values, _NAMES)


def _bound(x: dict | None) -> Bound | None:
    return None if x is None else (x["lang"], tuple(x["words"]))


def _count(run_bytes: int):
    def run(batches):
        part, seq, now = TaskContext.get().partitionId(), 0, Run()
        for b in batches:
            for lang, text in zip(b.column("lang"), b.column("text")):
                now.add(lang.as_py(), text.as_py())
                if now.size >= run_bytes:
                    yield _row(0, (part << 32) + seq, None, now.trie())
                    seq, now = seq + 1, Run()
        if now.langs:
            yield _row(0, (part << 32) + seq, None, now.trie())

    return run


def _boundaries(fan: int):
    def run(key, group):
        paths = sorted((p["lang"], tuple(p["words"])) for x in group.column("offered").to_pylist() for p in x)
        lower = _bound(group.column("lower")[0].as_py())
        ranges = min(fan, group.column("rows")[0].as_py())  # as large as a run, about
        step = len(paths) / ranges
        picked = sorted({paths[int(i * step)] for i in range(1, ranges)} if len(paths) else set())
        picked = [p for p in picked if lower is None or p > lower]
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int64()), "bounds": pa.array([[{"lang": p[0], "words": list(p[1])} for p in picked]], pa.list_(_PATH))})

    return run


def _cut(fan: int):
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                cell, grp, lower, bounds = (b.column(x)[i].as_py() for x in ("cell", "grp", "lower", "bounds"))
                trie = unpacked(b.column("blob")[i].as_py())
                edges = [_bound(lower), *map(_bound, bounds or [])]
                for j, low in enumerate(edges):
                    part = cut(trie, low, edges[j + 1] if j + 1 < len(edges) else None)
                    if part:
                        row = _row(cell * fan + j, grp, low, part)
                        yield row

    return run


def _merge(key, group):
    parts = [unpacked(x.as_py()) for x in group.column("blob")]
    lower = _bound(group.column("lower")[0].as_py())
    return pa.Table.from_batches([_row(key[0].as_py(), key[1].as_py(), lower, parts[0] if len(parts) == 1 else merged(parts))])


def _nodes(least: int):
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                trie, lower = unpacked(b.column("blob")[i].as_py()), _bound(b.column("lower")[i].as_py())
                for lang, (phrases, m, a, l1, l2, n) in owned(trie, lower, least).items():
                    text = lambda f: pa.array([b" ".join(f(p)) for p in phrases], pa.binary()).cast(pa.string())  # noqa: B023, E731
                    cols = [pa.array([lang] * len(m)), pa.array(m, pa.int32()), text(lambda p: p), text(lambda p: p[1:]), text(lambda p: p[:-1]), *[pa.array(x, pa.int64()) for x in (a, l1, l2)], pa.array([n] * len(m), pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in NODES.split(", ")])

    return run


def frequent(docs: DataFrame, least: int, run_bytes: int = RUN, fan: int = FAN) -> DataFrame:
    """Nodes (NODES) of one to three words that occur ``least`` times, and each language's root."""
    texts = only(docs, lang="lang", text="text").select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    now = written(texts.mapInArrow(_count(run_bytes), RUNS), "tries")
    width, cells = max(1, now.count()), 1
    while True:
        # the same rows whenever it is computed again
        chosen = F.pmod(F.xxhash64("cell", "grp"), F.lit(1 << 20)) * F.col("rows") * OFFERED <= WEIGHED << 20
        rows = now.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"))
        weighed = now.select("cell", "grp", "lower", "offered").join(rows, "cell").filter(chosen).select("cell", "lower", "offered", "rows")
        bounds = weighed.groupBy("cell").applyInArrow(_boundaries(fan), "cell long, bounds array<struct<lang: string, words: array<binary>>>")
        parts = now.drop("offered", "n_bytes").join(F.broadcast(bounds) if cells <= SENT else bounds, "cell", "left").mapInArrow(_cut(fan), RUNS)
        width, cells = max(1, -(-width // fan)), cells * fan
        grouped = parts.withColumn("grp", F.pmod(F.xxhash64("grp"), F.lit(width)))
        after = written(grouped.groupBy("cell", "grp").applyInArrow(_merge, RUNS), "tries")
        dropped(now)
        now = after
        if width == 1:
            break
    out = written(now.select("lower", "blob").mapInArrow(_nodes(least), NODES), "phrases")
    dropped(now)
    return out


def _way(k: int, left: str, right: str):
    """A phrase cut after its first ``k`` words, to be compared by score and ``k``; exact up to 10^14 occurrences."""
    wide = lambda c: f"CAST({c} AS DECIMAL(14,0))"
    score = F.expr(f"CAST(1000000 AS DECIMAL(7,0)) * ({wide('a')} * {wide('a')}) div ({wide(left)} * {wide(right)})")
    return F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))


def collocations(docs: DataFrame, least: int = 10, top: int = 2_000, share: int = 50, run_bytes: int = RUN, fan: int = FAN) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first ``top`` phrases of two or three words."""
    nodes = frequent(docs, least, run_bytes, fan).filter(F.col("m") > 0)
    one, two, three = (nodes.filter(F.col("m") == i) for i in (1, 2, 3))
    words = one.select("lang", F.col("phrase").alias("suffix"), F.col("a").alias("r1"))
    pairs = two.join(words, ["lang", "suffix"])  # a suffix link: the node of the last words
    links = pairs.select("lang", F.col("phrase").alias("suffix"), F.col("a").alias("r1"), F.col("r1").alias("r2"))
    triples = three.join(links, ["lang", "suffix"])
    longer = triples.select("lang", F.explode(F.array_distinct(F.array("head", "suffix"))).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    kept = pairs.join(longer, ["lang", "phrase"], "left").filter(F.col("longest").isNull() | (100 * F.col("longest") < share * F.col("a")))
    of_two = kept.select("lang", "phrase", "a", "n", _way(1, "l1", "r1").alias("cut"))
    of_three = triples.select("lang", "phrase", "a", "n", F.least(_way(1, "l1", "r1"), _way(2, "l2", "r2")).alias("cut"))
    scored = of_two.unionByName(of_three).select("lang", "phrase", "a", "n", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALT)))
    first = salted.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same in DuckDB, over documents.
SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: w[i : i + m - 1])) AS p FROM split, (SELECT unnest([1, 2, 3]) AS m) WHERE len(w) >= m),
f AS (SELECT lang, m, p, CAST(count(*) AS HUGEINT) AS a FROM grams GROUP BY lang, m, p),
total AS (SELECT lang, sum(a) AS n FROM f WHERE m = 1 GROUP BY lang),
candidates AS (SELECT lang, m, p, a FROM f WHERE m >= 2 AND a >= 10),
cuts AS (SELECT lang, m, p, a, unnest(range(1, m)) AS k FROM candidates),
scored AS (
  SELECT c.lang, c.m, c.p, c.a, c.k, x.a AS l, y.a AS r, (1000000 * c.a * c.a) // (x.a * y.a) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = c.p[1 : c.k] JOIN f y ON y.lang = c.lang AND y.p = c.p[c.k + 1 : c.m]),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
longer AS (
  SELECT lang, p, max(a) AS a FROM (SELECT lang, p[1:2] AS p, a FROM candidates WHERE m = 3 UNION ALL SELECT lang, p[2:3], a FROM candidates WHERE m = 3) GROUP BY lang, p),
kept AS (SELECT w.* FROM lowest w LEFT JOIN longer g ON g.lang = w.lang AND g.p = w.p WHERE g.a IS NULL OR 100 * g.a < 50 * w.a),
named AS (SELECT *, array_to_string(p, ' ') AS phrase FROM kept),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM named)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
