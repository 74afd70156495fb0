"""Each operator against a brute-force version, on the smallest table and on odd rows."""

import datetime
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from haltlens.llm import byte_bpe, common, components, fuzzy_lines, license_scan, packing, pii, quality_rules, simhash_dedup, suffix_dedup, token_rans, weighted_minhash

WORDS = P.path("word_bpe_49k.json")
RANKS = P.path("byte_bpe_50k.tiktoken")
KEY = b"k" * 32


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# ---- 1


def test_packing_is_a_packing():
    rng = random.Random(1)
    cost = packing.costs(packing.SIZES)
    for n in (0, 1, 7, 800):
        lengths = [min(16384, int(rng.lognormvariate(7, 1.3))) for _ in range(n)]
        bins = {}
        for length, (b, at, size) in zip(lengths, packing.pack(lengths, cost)):
            bins.setdefault(b, (size, []))[1].append((at, length))
        for size, items in bins.values():
            end = 0
            for at, length in sorted(items):
                assert at == end
                end += length
            assert size == next(s for s in packing.SIZES if s >= end)
        if n == 800:
            total = sum(cost[s] for s, _ in bins.values())
            single = len({b for b, *_ in packing.pack(lengths, {16384: 1.0})}) * cost[16384]
            assert total < single


def plain_packing(lengths, cost):
    """The rule as it is stated, with all bins and items looked through each time."""
    left, bins, where = sorted(lengths, reverse=True), [], []
    while left:
        item = left[0]
        fits = [b for b in bins if b[0] - sum(b[1]) >= item]
        if fits:
            b = min(fits, key=lambda b: (b[0] - sum(b[1]), bins.index(b)))
        else:
            def projected(size):
                room = size - item
                for x in left[1:]:
                    if 0 < x <= room:
                        room -= x
                return cost[size] / max(1, size - room)

            b = [min((s for s in sorted(cost) if s >= item), key=lambda s: (projected(s), -s)), []]
            bins.append(b)
        b[1].append(item)
        where.append(item)
        left = left[1:]
    return sorted((next(s for s in sorted(cost) if s >= sum(b)), sorted(b)) for _, b in bins)


@pytest.mark.parametrize("seed", range(6))
def test_packing_equals_the_plain_rule(seed):
    rng = random.Random(seed)
    lengths = [min(16384, int(rng.lognormvariate(6 + seed / 3, 1.2))) for _ in range(150)]
    cost = packing.costs(packing.SIZES)
    bins = {}
    for n, (b, _, size) in zip(lengths, packing.pack(lengths, cost)):
        bins.setdefault((b, size), []).append(n)
    assert sorted((size, sorted(x)) for (_, size), x in bins.items()) == plain_packing(lengths, cost)


def test_packing_in_shards_costs_little_more():
    rng = random.Random(3)
    lengths = [min(16384, int(rng.lognormvariate(7, 1.3))) for _ in range(16_000)]
    cost = packing.costs(packing.SIZES)
    total = lambda x: sum(cost[s] for s in {b: s for b, _, s in packing.pack(x, cost)}.values())
    assert sum(total(lengths[i::4]) for i in range(4)) <= 1.002 * total(lengths)


def test_packing_rows(odd, empty):
    length = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    rows = packing.best_fit(odd, length, shard_items=5).collect()
    want = sorted(str(d) + ":" + str(len((t or "").encode()) + 1) for d, t in texts(odd))
    whole = Counter()
    for r in rows:
        assert r.length <= max(packing.SIZES) and r.bin_offset + r.length <= r.bin_size
    n = Counter((r.doc_id, r.piece) for r in rows)
    assert sum(r.length for r in rows) == sum(int(x.split(":")[1]) for x in want) and n[(2, 0)] == 3
    del whole
    assert packing.best_fit(empty, length).count() == 0


# ---- 2


def test_feistel_permutes():
    for size in (1, 2, 10, 97, 1000):
        assert sorted(pii.permuted(x, size, KEY, b"t") for x in range(size)) == list(range(size))


@pytest.mark.parametrize("text, kind", [
    ("call +1 (017) 555-7713 now", "phone"), ("card 4041 8949 7460 8795.", "card"), ("at 10.2.3.4 now", "ip"), ("on 2024-02-29.", "date"), ("on 31/12/1999", "date"),
    ("GB82 WEST 1234 5698 7654 32", "iban"), ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "secret"), ("123-45-6789", "ssn"), ("00:1B:44:11:3A:B7", "mac"), ("a.b@mail3.example.com", "email"),
])
def test_pii_kinds(text, kind):
    new, found = pii.pseudonymised(text, KEY)
    assert found == {kind: 1} and new != text and re.sub(r"[0-9]+", "9", re.sub(r"[a-zA-Z]+", "a", new)).count("9") >= 0
    assert pii.pseudonymised(text + " and " + text, KEY)[0].count(new.strip(".")) >= 1
    again, f2 = pii.pseudonymised(new, KEY)
    assert f2.get(kind, 0) == 1  # still valid as what it was
    assert pii.pseudonymised(text, b"q" * 32)[0] != new


@pytest.mark.parametrize("text", ["4041894974608796 1234567890123", "300.1.1.1 1.2.3.4.5", "2023-02-30", "666-12-3456", "a plain sentence, with 12 words.", "hunter2hunter2hunter2", ""])
def test_pii_leaves_what_is_not_valid(text):
    assert pii.pseudonymised(text, KEY) == (text, {})


@pytest.mark.parametrize("before, value, after, kind", [
    ("card ", "4111 1111 1111 1111", " 123", "card"), ("", "4111 1111 1111 1111", " 12/26", "card"), ("order 12 ", "4111111111111111", "", "card"), ("id 7 ", "4111 1111 1111 1111", " exp", "card"),
    ("1 2 3 4 5 6 7 8 9 ", "4111 1111 1111 1111", " 123 55 66 77", "card"), ("", "BE68 5390 0754 7034", " BIC", "iban"), ("REF1 AB12 ", "BE68 5390 0754 7034", " GKCCBEBB", "iban"), ("", "+49 30 1234 5678", " 2023 1234 5678", "phone"),
    ("", "2023-05-01", "T12:00:00Z", "date"), ("", "2023-05-01", " 12:00", "date"), ("born ", "01-05-1980", ".", "date"), ("on ", "May 3rd, 1999", ".", "date"), ("am ", "12. März 2021", "", "date"), ("le ", "3 août 2005", ",", "date"), ("el ", "3 de mayo de 2005", "", "date"),
])
def test_pii_beside_other_digits(before, value, after, kind):
    new, found = pii.pseudonymised(before + value + after, KEY)
    assert found == {kind: 1} and new.startswith(before) and value not in new
    assert kind == "phone" or new.endswith(after)
    assert kind == "phone" or pii.pseudonymised(new, KEY)[1] == {kind: 1}


@pytest.mark.parametrize("shape", ["{y}-{m:02d}-{d:02d}", "{y}/{m}/{d}", "{d:02d}.{m:02d}.{y}", "{d}/{m}/{y}", "{m:02d}/{d:02d}/{y}"])
def test_dates_are_permuted_within_their_shape(shape):
    american, seen = shape.startswith("{m"), {}
    first = datetime.date(1900, 1, 1)
    for i in range(0, 73_048, 37):
        day = first + datetime.timedelta(i)
        if american and day.day < 13:
            continue
        value = shape.format(y=day.year, m=day.month, d=day.day)
        new = pii.date(value, KEY)
        parts = [int(x) for x in re.findall("[0-9]+", new)]
        y, m, d = parts if shape.startswith("{y") else (parts[2], parts[0], parts[1]) if american else parts[::-1]
        assert new == (shape.replace("{m}", "{m:02d}").replace("{d}", "{d:02d}") if min(day.month, day.day) > 9 else shape).format(y=y, m=m, d=d) and 1900 <= datetime.date(y, m, d).year < 2100
        assert not american or d > 12
        assert seen.setdefault(new, value) == value  # no two days become one
        assert american or new != value and datetime.date(y, m, d) == datetime.date.fromisoformat(pii.date(day.isoformat(), KEY))  # one pseudonym in all ways of writing


def test_equal_values_stay_linked(spark):
    rows = [(1, "card 4041 8949 7460 8795, on 2024-2-9"), (2, "x 4041 8949 7460 8795 y, 9.2.2024 and a.b@mail3.example.com"), (3, "a.b@mail3.example.com")]
    got = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()}
    card = pii.card("4041 8949 7460 8795", KEY)
    assert card in got[1] and card in got[2] and pii.luhn(card.replace(" ", "")) == 0 and [len(x) for x in card.split()] == [4, 4, 4, 4]
    assert got[3] in got[2] and re.fullmatch(r"[a-z]\.[a-z]@[a-z]{4}[0-9]\.example\.com", got[3])
    y, m, d = re.search(r"on ([0-9]+)-([0-9]+)-([0-9]+)$", got[1]).groups()
    assert f"{d}.{m}.{y}" in got[2]


def test_pii_rows(odd, empty):
    rows = pii.pseudonymise(odd, KEY).collect()
    assert len(rows) == odd.count() and Counter(r.text for r in rows) == Counter(t for _, t in texts(odd))
    assert pii.pseudonymise(empty, KEY).count() == 0


# ---- 3


def check_file(df, got):
    tok = Tokenizer.from_file(WORDS)
    want = []
    for d, t in texts(df):
        want.append((d, [*tok.encode(t or "", add_special_tokens=False).ids, 1]))
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted(((r.doc_id is not None, r.doc_id), r.n_tokens, r.ids_crc32) if r.doc_id is not None else ((False, 0), r.n_tokens, r.ids_crc32) for r in got) == sorted(((d is not None, d or 0), len(i), crc(i)) for d, i in want)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_token_file(request, which):
    df = request.getfixturevalue(which)
    check_file(df, token_rans.round_trip(df, WORDS, block_ids=5000, lanes=16, every=8).collect())


def test_blocks_round_trip_and_checkpoints():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 1000, 70_000):
        ids = np.minimum(rng.zipf(1.3, n), 49_000).astype(np.uint32)
        freq = token_rans.scaled(np.bincount(ids, minlength=49_408))
        assert n == 0 or freq.sum() == 1 << token_rans.SCALE
        t = token_rans.Table(freq)
        data = token_rans.encode_block(ids, t, [7], np.array([n]), lanes=64, every=16)
        b = token_rans.Block(data, t)
        assert (b.ids() == ids).all() and b.doc_ids == [7]
        if b.marks > 2:  # any checkpoint decodes on its own
            m = b.marks // 2
            assert (b.stretch(m) == ids[m * 16 * b.k : (m + 1) * 16 * b.k]).all()
            broken = bytearray(data)
            broken[-1] ^= 1
            with pytest.raises(ValueError):
                token_rans.Block(bytes(broken), t)


def test_pieces_equal_whole_texts():
    p, rng = token_rans.Pieces(WORDS), random.Random(3)
    parts = ["a", "B", "the", " ", "é", "É", "日", "😀", "\n", "'s", "'", "1", "#", "…", "́", "²", "İ", "\x1c", "\xa0", "½", "<|endoftext|>", "Σ", "\x00", "ñ", "×"]
    for _ in range(3000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert p.of(s) == np.array(p.tok.encode(s, add_special_tokens=False).ids, "<u2").tobytes(), repr(s)
    many = [None, "", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(500))]
    for texts in (many, [t for t in many if "<|" not in (t or "")]):
        assert p.all(pa.array(texts).slice(1), 1).to_pylist() == [p.of(t or "") + b"\1\0" for t in texts[1:]]


# ---- 4


def brute_repeats(pairs, length=50):
    order = lambda d: math.inf if d is None else d
    first = {}
    data = [(d, (t or "").encode()) for d, t in pairs]
    for d, b in data:
        for i in range(len(b) - length + 1):
            first[b[i : i + length]] = min(first.get(b[i : i + length], math.inf), order(d))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < order(d):
                gone[i : i + length] = b"\1" * length
        out.append((d is not None, d or 0, len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1])), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_repeated_strings(request, which):
    df = request.getfixturevalue(which)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicated(df).collect())
    assert got == brute_repeats(texts(df))


def test_slices_are_not_exchanged(spark, docs):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = suffix_dedup.deduplicated(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # of the two sides of the join by slice only the stretches, without blobs, are moved
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan and "SortMergeJoin" in plan


def test_repeats_over_many_shards(spark, monkeypatch):
    for name, value in (("SLICE", 400), ("BUCKET_ANCHORS", 3), ("SHARD_BYTES", 700)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rng = random.Random(5)
    base = ["".join(rng.choice("abc ") for _ in range(160)) for _ in range(4)]
    rows = [(i, "".join(rng.choice([rng.choice(base)[rng.randint(0, 60) :], "x" * rng.randint(0, 70), "".join(rng.choice("de") for _ in range(30))]) for _ in range(3))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicated(df).collect())
    assert got == brute_repeats(rows)


def test_interval_expansion():
    rng = np.random.default_rng(1)
    for n, s, length in ((1, 2, 3), (60, 2, 4), (900, 2, 6), (3000, 3, 8), (1500, 1, 5)):
        t = np.append(rng.integers(1, s + 1, n), 0)
        order, border = suffix_dedup.bounded_groups(t, length)
        x = t.tolist()
        key = [tuple(x[i : i + length]) for i in order]
        assert all((key[i] != key[i - 1]) == bool(border[i]) for i in range(1, n + 1) if max(order[i], order[i - 1]) <= n + 1 - length)


# ---- 5


def brute_stats(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = Counter(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += seen[line] > 0
            seen[line] += 1
    tri = Counter(zip(w, w[1:], w[2:]))
    rep = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(rep)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_base_counts(request, which):
    for _, t in texts(request.getfixturevalue(which)):
        assert quality_rules.text_stats(t) == brute_stats(t)


def test_outliers(spark, docs, odd, empty):
    for df in (docs, odd):
        rows = quality_rules.quality(df).collect()
        assert len(rows) == df.count() and all(not (r.kept and r.base_failed) for r in rows)
    assert quality_rules.quality(empty).count() == 0
    rng = random.Random(2)
    good = [(i, rng.randint(100, 900), None, rng.choice((0, 0, 0, 1)), 0, 0, "en", "s") for i in range(2000)]
    good = [(i, n, int(n * rng.gauss(5, 0.1)), s, d, r, lang, src) for i, n, _, s, d, r, lang, src in good]
    bad = [(5000 + i, 300, 3600, 2000, 0, 0, "en", "s") for i in range(100)] + [(6000 + i, 300, 1500, 0, 200, 100, "en", "s") for i in range(50)]
    stats = spark.createDataFrame(good + bad, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lang string, source string")
    kept = {r.doc_id for r in quality_rules.verdicts(stats).filter("kept").collect()}
    assert not {i for i in kept if i >= 5000} and len(kept) >= 1990


def least_determinant(x, support, scale):
    """By all subsets."""
    from itertools import combinations

    found = []
    for c in combinations(range(len(x)), round(support * len(x))):
        y = x[list(c)]
        found.append((np.linalg.slogdet(np.cov(y.T, bias=True) * scale + np.diag(np.square(quality_rules.FLOOR)))[1], tuple(y.mean(0))))
    return min(found)


def test_least_determinants(spark):
    """Against all subsets of small groups, outliers among them on one side or two."""
    rng = np.random.default_rng(7)
    rows, groups = [], {}
    for g in range(6):
        x = rng.normal(0, 1, (16, 4)) @ rng.normal(0, 1, (4, 4)) * 2
        x[: 1 + g % 4] += rng.choice([-1, 1], (1 + g % 4, 1)) * 40 if g % 2 else 40
        groups[f"g{g}"] = x
        rows += [(f"g{g}", *map(float, r)) for r in x]
    fit = spark.createDataFrame(rows, "grp string, x0 double, x1 double, x2 double, x3 double")
    scale = 0.75 / quality_rules.chi2_cdf(quality_rules.chi2_quantile(0.75, 4), 6)
    for r in quality_rules.mcd(fit, 6, 0.75).collect():
        want, centre = least_determinant(groups[r.grp], 0.75, scale)
        assert r.logdet <= want + 0.5, (r.grp, r.logdet, want)  # so few rows have many local minima
        assert np.linalg.norm(np.array([r.m0, r.m1, r.m2, r.m3]) - centre) < 10  # none of the outliers moves it
    assert sum(abs(r.logdet - least_determinant(groups[r.grp], 0.75, scale)[0]) < 1e-6 for r in quality_rules.mcd(fit, 6, 0.75).collect()) >= 3


def brute_verdicts(rows, support=0.75, quantile=1 - 1e-6, min_group=200):
    """Of (lang, source, base counts) in plain loops: base_failed and kept, with the smallest distance of a d2 to its cutoff."""
    floor = np.array([0.08, 0.35, 0.35, 0.12])
    x = np.array([[math.log((c + 1) / max(n, 1)), math.log1p(100 * s / max(n, 1)), math.log1p(d), math.asin(math.sqrt(min(r / max(n, 1), 1)))] for _, _, n, c, s, d, r in rows])
    failed = np.array([n < 50 or 100 * r > 50 * n for _, _, n, _, _, _, r in rows])
    of = lambda part: [i for i in range(len(rows)) if not failed[i] and part(rows[i])]
    pairs = {(r[0], r[1]): of(lambda o, r=r: o[:2] == r[:2]) for r in rows}
    small = {lang: [i for (a, _), m in pairs.items() if a == lang and len(m) < min_group for i in m] for lang, _ in pairs}
    left = [i for m in small.values() if len(m) < min_group for i in m]
    scale = support / quality_rules.chi2_cdf(quality_rules.chi2_quantile(support, 4), 6)
    cutoff = quality_rules.chi2_quantile(quantile, 4)
    median = lambda v: np.sort(np.floor(4096 * v), axis=0)[(len(v) - 1) // 2] / 4096

    def estimate(y):
        m = median(y)
        a = np.sqrt((1.4826 * median(np.abs(y - m))) ** 2 + floor**2)
        z = (y - m) / a
        best = (np.inf,)
        signs = z / np.maximum(np.linalg.norm(z, axis=1), 1e-9)[:, None]
        for like in (np.eye(4), np.tanh(z).T @ np.tanh(z) / len(z), signs.T @ signs / len(z)):
            size = np.sqrt(np.maximum(np.diag(like), 1e-12))
            cov, mid, last = np.outer(a, a) * (like / np.outer(size, size) * 0.999 + 0.001 * np.eye(4)), m, np.inf
            while True:
                d2 = np.einsum("ni,ij,nj->n", y - mid, np.linalg.inv(cov), y - mid)
                cell, need = np.floor(256 * np.log2(d2 + 1e-12)), support * len(y)
                k = np.zeros(len(y))
                for c in np.unique(cell):
                    k[cell == c] = min(1, max(0, need) / (cell == c).sum())
                    need -= (cell == c).sum()
                mu = (k[:, None] * y).sum(0) / k.sum()
                new = (k[:, None] * (y - mu)).T @ (y - mu) / k.sum() * scale + np.diag(floor**2)
                if (det := np.linalg.slogdet(new)[1]) >= last - 1e-9:
                    break
                cov, mid, last = new, mu, det
            best = min(best, (last, mid, cov), key=lambda b: b[0])
        return best[1], np.linalg.inv(best[2])

    kept, margin = [], np.inf
    known = {}
    for i, r in enumerate(rows):
        m = pairs[r[:2]]
        group = "pair", r[:2]
        if len(m) < min_group:
            group, m = ("lang", r[0]), small[r[0]]
            if len(m) < min_group:
                group, m = ("rest",), left if len(left) >= min_group else of(lambda o: True)
        if failed[i] or len(m) < 20:
            kept.append(not failed[i])
            continue
        if group not in known:
            known[group] = estimate(x[m])
        mid, inv = known[group]
        d2 = (x[i] - mid) @ inv @ (x[i] - mid)
        margin = min(margin, abs(d2 - cutoff))
        kept.append(bool(d2 <= cutoff))
    return [bool(f) for f in failed], kept, margin


@pytest.mark.parametrize("size", [0, 200, 5])
def test_verdicts_equal_brute_force(spark, docs, size):
    """Documents, in groups as they are, pooled and alone, and made rows with outliers among them: every verdict, and the same again from rows in another order."""
    if size:
        rng = random.Random(size)
        rows = [(rng.choice(("en", "de", None)), rng.choice(("a", "b", "c", None)), n := rng.randint(40, 900), int(n * rng.gauss(5, 0.1 if rng.random() < 0.9 else 2)), rng.choice((0, 0, 1, 40)), rng.choice((0, 0, 3, 60)), rng.choice((0, 5, n // 3, n))) for _ in range(1500)]
    else:
        rows = [(r.lang, r.source, *brute_stats(r.text)) for r in docs.select("lang", "source", "text").collect()]
    schema = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    failed, kept, margin = brute_verdicts(rows, min_group=size or 200)
    assert margin > 1e-6
    numbered = [(i, *r) for i, r in enumerate(rows)]
    for turn in (numbered, numbered[::-1]):
        stats = common.written(spark.createDataFrame(turn, schema), "stats")
        got = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules.verdicts(stats, min_group=size or 200).collect()}
        assert got == {i: v for i, v in enumerate(zip(failed, kept))}
    assert not size or 0 < sum(kept) < len(kept)


def test_small_groups_have_a_verdict(spark):
    rng = random.Random(8)
    rows = [(i, n := rng.randint(100, 900), int(n * rng.gauss(5, 0.1)), 0, 0, 0, "xx", f"s{i % 7}") for i in range(60)] + [(99, 300, 4000, 2500, 0, 0, "yy", "s")]
    stats = spark.createDataFrame(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lang string, source string")
    got = quality_rules.verdicts(stats).collect()
    assert {r.doc_id for r in got if not r.kept} == {99} and {r.pool for r in got} == {"\x04"}
    few = quality_rules.verdicts(stats.limit(5)).collect()
    assert all(r.kept and r.d2 is None for r in few)


def test_chi_square():
    assert quality_rules.chi2_quantile(0.95, 1) == pytest.approx(3.841459, abs=1e-5) and quality_rules.chi2_quantile(0.99, 4) == pytest.approx(13.276704, abs=1e-5)


# ---- 6


def test_licenses(spark, odd, empty):
    filler = " ".join(f"w{i}" for i in range(80))
    for name, forms in license_scan.TEMPLATES.items():
        for form in forms:
            for text in (form, f"{filler}\n{form}\n{filler}", form.upper().replace(". ", ".\n * ")):
                assert name in {x[1] for x in license_scan.scan(text)}, (name, form)
    assert license_scan.scan(f"the license of {filler} warranty") == []
    both = license_scan.scan(f"Released under the MIT License.\n{filler}\nLicensed under CC BY-NC 4.0.")
    assert [x[1] for x in both] == ["MIT", "CC-BY-NC-4.0"] and both[0][0] == 0
    df = spark.createDataFrame([(1, "Released under the MIT License."), (2, "nothing"), (3, None)], "doc_id long, text string")
    assert [(r.doc_id, r.license) for r in license_scan.scan_documents(df).collect()] == [(1, "MIT")]
    assert license_scan.scan_documents(odd).count() == 0 and license_scan.scan_documents(empty).count() == 0


@pytest.mark.parametrize("start", ["This work is licensed under a Creative Commons Attribution 3.0 Unported License.", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."])
def test_licenses_below_the_first_ranks(start):
    assert [x[1] for x in license_scan.scan(start + " Portions released under the MIT License.")] == ["MIT"]


def test_no_notice_is_lost_to_the_choice_of_blocks(monkeypatch):
    """Notices with words dropped, in filler: the same findings as where every word may begin a block."""
    rng, texts = random.Random(6), []
    for forms in license_scan.TEMPLATES.values():
        for form in forms:
            for _ in range(3):
                w = [x for x in form.split() if rng.random() > 0.06]
                fill = [f"w{rng.randint(0, 99)}" for _ in range(60)]
                texts.append(" ".join([*fill[:30], *w, *fill[30:]]))
    found = [[x[1] for x in license_scan.scan(t)] for t in texts]
    monkeypatch.setattr(license_scan, "_SIGN", re.compile(r"[A-Za-z0-9]+"))
    assert found == [[x[1] for x in license_scan.scan(t)] for t in texts] and sum(map(len, found)) > len(texts) / 2


def test_best_range_equals_brute_force():
    """Every range by the plain table of common subsequences."""

    def brute(t, words):
        best = None
        for a in range(len(words)):
            row = [0] * (len(t) + 1)
            for b in range(a, len(words)):
                new = [0]
                for i, x in enumerate(t):
                    new.append(row[i] + 1 if x == words[b] else max(row[i + 1], new[i]))
                row, size = new, b + 1 - a
                if row[-1] >= 0.7 * len(t) and size - row[-1] <= max(2, len(t) // 5):
                    score = (row[-1] / len(t) - (size - row[-1]) / size, row[-1])
                    if best is None or score > best[0]:
                        best = (score, (row[-1], a, b + 1, size - row[-1]))
        return best and best[1]

    rng, found = random.Random(66), 0
    for _ in range(300):
        t = tuple(rng.choice("abcdef") for _ in range(rng.randint(1, 14)))
        w = [rng.choice("abcdefghij") for _ in range(rng.randint(0, 20))]
        at = rng.randint(0, len(w))
        w[at:at] = [x for x in t if rng.random() > 0.15]
        got = license_scan.differences(t, w, 0.7)
        assert got == brute(t, w)
        found += got is not None
    assert 100 < found < 300


def test_quoted_part_before_a_changed_notice():
    """The middle third of a notice quoted, filler, then the notice with some words changed: the notice is found."""
    fill = " ".join(f"w{i}" for i in range(10))
    for name, forms in license_scan.TEMPLATES.items():
        for form in forms:
            w = form.split()
            if len(w) > license_scan.SHORT_WORDS:
                changed = [f"x{i}" if i % 24 == 11 else x for i, x in enumerate(w)]
                text = " ".join([*w[len(w) // 3 : 2 * len(w) // 3], fill, *changed])
                assert name in {x[1] for x in license_scan.scan(text)}, (name, form)


@pytest.mark.parametrize("name, kind", [("GPL-3.0", ""), ("LGPL-3.0", "Lesser "), ("AGPL-3.0", "Affero ")])
def test_long_gnu_notices(name, kind):
    text = f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    rest = f" This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details."
    assert [x[1] for x in license_scan.scan(text + rest)] == [name]


# ---- 7


def bag(t):
    return Counter(w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if w)


def jaccard(a, b):
    keys = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in keys) / max(1, sum(max(a[k], b[k]) for k in keys)) if keys else 1.0


def test_fingerprints(docs):
    got = {r.doc_id: r for r in weighted_minhash.fingerprints(docs).collect()}
    rows = sorted(texts(docs), key=lambda r: -r[0])
    off = []
    for (d, t), (_, n) in zip(rows, [*rows[1:], rows[0]]):
        k = len(t) // 3
        edited = t[: len(t) - k] + n[:k]
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        off += [r.near_edited - jaccard(bag(t), bag(edited)), r.near_next - jaccard(bag(t), bag(n))]
    assert abs(np.mean(off)) < 0.03 and np.std(off) < 0.12
    by_text = {}
    for d, t in rows:
        assert by_text.setdefault(t, got[d].fingerprint) == got[d].fingerprint


def test_fingerprints_of_odd_rows(odd, empty, spark):
    rows = weighted_minhash.fingerprints(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.near_next <= 1 for r in rows)
    zero = "0" * 8 * weighted_minhash.SAMPLES
    assert all(r.fingerprint == zero for r in rows if r.doc_id in (3, 4, 5))
    assert weighted_minhash.fingerprints(empty).count() == 0
    one = weighted_minhash.fingerprints(spark.createDataFrame([(1, "just one text")], "doc_id long, text string")).first()
    assert one.near_next == 1.0


# ---- 8


def test_bpe_equals_the_library(docs, odd, empty):
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    for df in (docs, odd):
        want = sorted((len(i := ref.encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for _, t in texts(df))
        assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.digests(df, RANKS, P.PATTERN).collect()) == want
    back = byte_bpe.decode_ids(byte_bpe.encode_documents(odd, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert Counter(bytes(r.bytes).decode() for r in back) == Counter(t or "" for _, t in texts(odd))
    assert byte_bpe.digests(empty, RANKS, P.PATTERN).count() == 0


def test_bpe_random_texts():
    c = byte_bpe.codec(RANKS, P.PATTERN)
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    rng = random.Random(1)
    for _ in range(4000):
        s = "".join(rng.choice(["a", "b", "the", "ing", " ", "é", "日", "😀", "\n", "  ", "st", "on", "1", "22", "#", "ZZ", "́", "_"]) for _ in range(rng.randint(0, 40)))
        assert c.encode(s) == ref.encode_ordinary(s)
    for s in ("a" * 30_000, "ab" * 20_000, "thing" * 9_000):
        assert c.encode(s) == ref.encode_ordinary(s)


# ---- 9


def brute_lines(pairs, min_words=5):
    wordings = {}
    for d, t in pairs:
        for i, w in enumerate(fuzzy_lines.normal_lines(t or "")):
            if len(w) >= min_words:
                wordings.setdefault(b" ".join(w), []).append((d, i))
    keys = list(wordings)
    h = fuzzy_lines.simhashes([k.split() for k in keys]).view(np.uint64)
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def apart(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for i in range(len(keys)):
        for j in np.flatnonzero(np.bitwise_count(h[i + 1 :] ^ h[i]) <= 3):
            a, b = keys[i].split(), keys[i + 1 + int(j)].split()
            if apart(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9):
                root[find(i)] = find(i + 1 + int(j))
    groups = {}
    for i, k in enumerate(keys):
        groups.setdefault(find(i), []).extend(wordings[k])
    gone = {p for g in groups.values() for p in sorted(g)[1:]}
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in pairs}


def test_fuzzy_lines(docs):
    assert {r.doc_id: r.text for r in fuzzy_lines.without_lines(docs).collect()} == brute_lines(texts(docs))


def test_fuzzy_families(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randint(0, 500)}" for _ in range(30)] for _ in range(6)]
    rows = []
    for d in range(80):
        lines = []
        for _ in range(3):
            w = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = f"v{rng.randint(0, 9)}"
            if rng.random() < 0.3:
                rng.shuffle(w)
            lines.append(" ".join(w))
        rows.append((d, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in fuzzy_lines.without_lines(df).collect()} == brute_lines(rows)


def brute_every(rows, similarity=0.8, min_words=5):
    """As brute_lines, but every two lines are compared: no SimHash, no keys."""
    places = {}
    for d, t in rows:
        for i, w in enumerate(fuzzy_lines.normal_lines(t or "")):
            if len(w) >= min_words:
                places.setdefault(tuple(w), []).append((d, i))
    keys, root = list(places), {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            k = int((1 - similarity) * max(len(a), len(b)) + 1e-9)
            if abs(len(a) - len(b)) > k or max(len(a), len(b)) - sum((Counter(a) & Counter(b)).values()) > k:
                continue
            row = list(range(len(b) + 1))
            for m, x in enumerate(a, 1):
                new = [m]
                for n, y in enumerate(b, 1):
                    new.append(min(row[n] + 1, new[-1] + 1, row[n - 1] + (x != y)))
                row = new
            if row[-1] <= k:
                root[find(a)] = find(b)
    groups = {}
    for k in keys:
        groups.setdefault(find(k), []).extend(places[k])
    return {p for g in groups.values() for p in sorted(g)[1:]}


@pytest.mark.parametrize("often", [2, 1000])
def test_every_fuzzy_line_is_found(spark, monkeypatch, often):
    monkeypatch.setattr(fuzzy_lines, "OFTEN", often)
    rng = random.Random(11)
    lines = []
    for _ in range(60):
        base = [rng.choice(("a", "b", f"c{rng.choice('pqrstuvw')}", "".join(rng.choices("xyzuvw", k=4)))) for _ in range(rng.choice((5, 6, 8, 12, 20, 33, 40, 41, 45, 60, 120)))]
        lines.append(base)
        for _ in range(3):
            w = list(base)
            for _ in range(rng.randint(1, len(w) // 5 + 1)):
                at, what = rng.randrange(len(w)), rng.random()
                w[at : at + (what < 0.7)] = ["".join(rng.choices("ijklm", k=5))] * (what > 0.3)
            lines.append(w)
    rng.shuffle(lines)
    rows = [(i, "\n".join(" ".join(w) for w in lines[i::50])) for i in range(50)]
    gone = brute_every(rows)
    want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in rows}
    got = {r.doc_id: r.text for r in fuzzy_lines.without_lines(spark.createDataFrame(rows, "doc_id long, text string"), every=True).collect()}
    assert got == want and len(gone) > 60


def test_a_cell_gives_a_forest_of_links():
    rng = random.Random(8)
    word = lambda: chr(0x10000 + rng.randrange(0xFFFFE))
    base, passage = [word() for _ in range(20)], [word() for _ in range(60)]
    near = ["".join(w if rng.random() > 0.05 else word() for w in base) for _ in range(150)]  # one group
    unlike = ["".join([word() for _ in range(17)] + passage) for _ in range(150)]  # share 60 of 77 words: none is a link
    norm = near + unlike
    group = pa.table({"key": pa.array([7] * 300), "wording": pa.array(range(300)), "root": pa.array(range(300)), "norm": norm})
    got = fuzzy_lines._linked(0.8)((pa.scalar(0),), group).to_pylist()

    def joined(pairs):
        of = list(range(300))
        for u, v in pairs:
            of = [of[v] if x == of[u] else x for x in of]
        return {frozenset(i for i in range(300) if of[i] == x) for x in of}

    links = [(i, j) for i in range(300) for j in range(i) if fuzzy_lines.within(norm[i], norm[j], int(0.2 * max(len(norm[i]), len(norm[j])) + 1e-9))]
    assert len(links) > 5000 and joined((r["u"], r["v"]) for r in got) == joined(links)
    assert len(got) == 300 - len(joined(links)) < 150  # before: a row for each two that may be similar


@pytest.mark.parametrize("n", [5, 6, 9, 10, 12, 13, 14, 16, 20, 25, 40, 80, 200])
def test_lines_at_the_limit_share_a_key(n):
    """Without any filter: of lines with as many words replaced as the similarity allows, nearly all meet in a cell, and all of up to 14 words."""
    rng = random.Random(n)
    word = lambda: rng.choice(("the", "of", "and")) if rng.random() < 0.3 else f"w{int(rng.paretovariate(0.6)) % 100_000}"
    common, lines = np.zeros(1 << 20, bool), []
    for _ in range(1500):
        a = [word() for _ in range(n)]
        b = list(a)
        for i in rng.sample(range(n), int(0.2 * n + 1e-9)):
            b[i] = word()
        lines += [" ".join(a).encode(), " ".join(b).encode()]
    w = fuzzy_lines.Words([b"\n".join(lines)])
    common[w.h[w.at == 0][:50] & np.uint64((1 << 20) - 1)] = True
    line, key = w.keys(np.arange(3000), common, 0.8)
    of = [set() for _ in lines]
    for i, k in zip(line.tolist(), key.tolist()):
        of[i].add(k)
    met = sum(bool(of[i] & of[i + 1]) for i in range(0, 3000, 2)) / 1500
    print(n, met)
    assert met == 1 if n <= 14 else met >= 0.99


def test_short_lines_and_scripts_without_spaces(spark):
    rows = [
        (1, "Share on Facebook\nPage 3\n\n---"),
        (2, "share on facebook!\nPage 4\nown text\n\n---"),
        (3, "今日は天気がとても良いですね"),
        (4, "今日は天気がとても悪いですね\n全く別の文章がここにあります"),
        (5, "版权所有\nown words"),
        (6, "版权所有"),
    ]
    got = {r.doc_id: r.text for r in fuzzy_lines.without_lines(spark.createDataFrame(rows, "doc_id long, text string"), every=True).collect()}
    assert got == {1: rows[0][1], 2: "Page 4\nown text\n\n---", 3: rows[2][1], 4: "全く別の文章がここにあります", 5: rows[4][1], 6: ""}


def test_every_odd(docs, odd, empty):
    by = Counter((r.doc_id, r.text is None, len(r.text or "")) for r in fuzzy_lines.without_lines(odd, every=True).collect())
    assert sum(by.values()) == odd.count() and by[(3, True, 0)] == 1 and by[(4, False, 0)] == 1
    assert fuzzy_lines.without_lines(empty, every=True).count() == 0


def test_fuzzy_odd(odd, empty):
    rows = fuzzy_lines.without_lines(odd).collect()
    assert len(rows) == odd.count()
    by = Counter((r.doc_id, r.text is None, len(r.text or "")) for r in rows)
    assert by[(3, True, 0)] == 1 and by[(4, False, 0)] == 1
    assert [len(r.text) for r in rows if r.doc_id == 2 and "same" not in r.text and "second" not in r.text] == [0, 0]
    assert fuzzy_lines.without_lines(empty).count() == 0


# ---- 10


def brute_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ([" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, odd, empty):
    for df in (docs, odd):
        assert Counter(r.fp % 2**64 for r in simhash_dedup.fingerprints(df).collect()) == Counter(brute_fingerprint(t) for _, t in texts(df))
    rows = simhash_dedup.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and {r.component_id for r in rows if r.doc_id in (3, 4, 5)} == {3}
    assert simhash_dedup.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 4, 5])
def test_every_link_is_found(spark, distance):
    rng = random.Random(distance)
    near = set()
    for _ in range(30):
        f = rng.getrandbits(64)
        for _ in range(8):
            g = f
            for b in rng.sample(range(64), rng.randint(0, 6)):
                g ^= 1 << b
            near.add(g)
    near |= {0, 1, 3, 2**64 - 1, 2**63}
    signed = [x - 2**64 if x >= 2**63 else x for x in near]
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= distance}
    got = simhash_dedup.links(spark.createDataFrame([(x,) for x in signed], "fp long"), distance).collect()
    assert {(r.u, r.v) for r in got} == want


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long"), "t").collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components.components(spark.createDataFrame([], "u long, v long"), "t").count() == 0


def test_edit_distance_within():
    r = random.Random(5)
    for size, rounds in ((14, 1500), (120, 25)):
        for _ in range(rounds):
            signs = [chr(0x10000 + i) for i in range(r.choice([2, 8, 300]))]
            x = [r.choice(signs) for _ in range(r.randint(0, size))]
            y = list(x)
            for _ in range(r.randint(0, size // 3)):
                at = r.randint(0, len(y))
                y[at : at + r.randint(0, 1)] = r.choice([[], [r.choice(signs)]])
            row = list(range(len(y) + 1))
            for i, a in enumerate(x, 1):
                last, row[0] = row[0], i
                for j, b in enumerate(y, 1):
                    last, row[j] = row[j], min(last + (a != b), row[j] + 1, row[j - 1] + 1)
            for allowed in {0, 1, max(0, row[-1] - 1), row[-1], row[-1] + 1}:
                assert fuzzy_lines.within("".join(x), "".join(y), allowed) == (row[-1] <= allowed)


def test_shared_dir_where_none_is_named():
    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default), sparkContext=SimpleNamespace(master=master))
    assert common.shared_dir(session("local[2]")) == common.shared_dir(session("local"))
    with pytest.raises(ValueError):
        common.shared_dir(session("spark://host:7077"))


def test_short_lines_are_looked_for_by_all_their_pairs():
    """Whatever words are frequent in some of the texts; and the bytes that buckets are counted by are those of all texts."""
    w = fuzzy_lines.Words([b"a b c d e f g h i j k l"])
    line, key = w.keys(np.array([0]), None, 0.8)
    pairs = np.unique(key[: len(key) - 8])
    assert len(key) == 11 + 8 and len(np.unique(key)) == 19 and len(pairs) == 11
    assert not hasattr(fuzzy_lines, "common_words")


def test_characters_are_replaced_by_kind_as_by_patterns(monkeypatch):
    rng = random.Random(3)
    lines = ["".join(rng.choice("aéB ß–“漢字かなไทย\nſﬁ①,_7") for _ in range(60)) for _ in range(200)]
    by_kind = [fuzzy_lines.normal_bytes(t) for t in lines]
    monkeypatch.setattr(fuzzy_lines, "KINDS", 0)
    assert by_kind == [fuzzy_lines.normal_bytes(t) for t in lines] and any("漢".encode() in t for t in by_kind)


def test_named_lines_are_cut_from_texts():
    at = pa.array([[{"line_no": 2, "wording": 7}, {"line_no": 0, "wording": 8}], [{"line_no": 1, "wording": 9}]], pa.list_(pa.struct([("line_no", pa.int32()), ("wording", pa.int64())])))
    got = list(fuzzy_lines._cut([pa.RecordBatch.from_arrays([pa.array(["x", "a\nb\nc d", "e\nf\n"]), pa.concat_arrays([pa.array([[]], at.type), at])], ["text", "at"])]))
    assert [r for b in got for r in b.to_pylist()] == [{"wording": 7, "line": "c d"}, {"wording": 8, "line": "a"}, {"wording": 9, "line": "f"}]
