"""Collocations against a plain count of all phrases, with many small runs and rounds, and on odd rows."""

import random
import re
from collections import Counter

import pytest

from haltlens.llm import collocations


def plain(rows, least=10, top=2000, share=50):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in (1, 2, 3):
                for i in range(len(w) - m + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + m])] += 1
    out = set()
    for lang, c in f.items():
        found = []
        for p, a in c.items():
            if len(p) < 2 or a < least:
                continue
            if len(p) == 2 and any(len(q) == 3 and b >= least and 100 * b >= share * a and p in (q[:2], q[1:]) for q, b in c.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out |= {(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)}
    return out


def texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "é", "日本", "A", "b-c", "<d>", "\\", "Straße", "x'", "naïve", "İ", "\x1f", "'"]
    return [(rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ".", ", ", "\n", "\x0b"]) for _ in range(rng.randint(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize("run_bytes, fan", [(300, 3), (2_000, 4), (1 << 20, 64)])
def test_equals_plain_count(spark, run_bytes, fan):
    rows = texts(run_bytes, 250)
    rows += rows[:40]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = {tuple(r) for r in collocations.collocations(df, least=5, top=150, run_bytes=run_bytes, fan=fan).collect()}
    assert got == plain(rows, least=5, top=150) and len(got) > 100


def test_parts_of_a_range_keep_the_way_up():
    run = collocations.Run()
    for lang, text in texts(3, 200):
        run.add(lang or "und", text.encode())
    trie = run.trie()
    bounds = collocations.offered(trie, 40)
    assert len(bounds) > 20
    edges = [None, *sorted({(a, tuple(b)) for a, b in bounds}), None]
    seen = Counter()
    for low, high in zip(edges, edges[1:]):
        part = collocations.unpacked(collocations.packed(collocations.cut(trie, low, high)))
        for lang, (phrases, m, a, l1, l2, n) in collocations.owned(part, low, 0).items():
            words, path, counts = trie[lang]
            whole = {tuple(words[x - 1] for x in p if x): c for p, c in zip(path.T.tolist(), counts.tolist())}
            for p, *rest in zip(phrases, m, a, l1, l2):
                seen[lang, tuple(p)] += 1
                assert rest == [len(p), whole[tuple(p)], whole[tuple(p[:1])], whole[tuple(p[:2])]] and n == whole[()]
    assert set(seen.values()) == {1} and len(seen) == sum(len(c) for _, _, c in trie.values())


def test_many_words_need_no_wide_numbers():
    path = collocations.np.array([[1, 1, 2, 3_000_000], [5, 4, 0, 2_999_999], [0, 7, 0, 1]], "u4")
    k = collocations.keys(path, 3_000_000)
    assert sorted(range(4), key=lambda i: k[i]) == sorted(range(4), key=lambda i: tuple(path[:, i]))


def test_odd_rows(spark, odd, empty):
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert {tuple(r) for r in collocations.collocations(odd, run_bytes=5_000, fan=3).collect()} == plain(rows)
    assert collocations.collocations(empty).count() == 0
    long = spark.createDataFrame([("en", " ".join(["w" * 5_000, "v", "w" * 5_000 + "x"] * 30)), (None, None), ("en", "")], "lang string, text string")
    assert {tuple(r) for r in collocations.collocations(long, run_bytes=10, fan=2).collect()} == plain([tuple(r) for r in long.collect()])
