"""Main text of pages: made pages with known texts, the suffix array against a plain search, and odd rows."""

import random

import pytest

from haltlens.llm import main_text

DATA = "/root/testdata/sf0.001"


def text(html):
    return main_text.assembled(main_text.blocks(html), None)[0]


def test_markup():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>no</article>";</script></head><body class="has-sidebar">
    <header><h1>Site name</h1></header><nav><ul><li><a href="/a">Menu</a><li>More</ul></nav><div id="cookie-notice">We use cookies</div>
    <form action="/"><div class="content wrapper"><main><article class="post comments-open"><header><h1>A &amp;  B&nbsp;&lt;c&gt;</h1></header><p>One <b>t</b>wo<br>three<p title="a>b">four&eacute;
    <ul><li>five<li>six</ul><div class="ad-box">Buy</div><aside>side</aside><script>x()</script><figure><img alt="no"><figcaption>seven</figcaption></figure><!-- <p>gone</p> -->
    <table><tr><td>8<td>9</table><div class="share">Share</div><section id="comments"><article class="comment"><p>I agree</p></article></section><p hidden>no</p></article></main></div></form>
    <footer>&copy; us</footer><div class="newsletter">Subscribe</div></body>"""
    assert text(page) == "A & B <c> One two three fouré five six seven 8 9"
    assert text("<body><div>just <i>a</i> text</div><ul class=menu><li>x</ul><p>&#65;&am &amp<!-- cut off <p>not</p>") == "just a text A&am &"
    assert text("<main><p>in main</p></main><p>out</p>") == "in main" and text("<nav>open<article><p>told</article>") == "told"
    assert text(None) == text("") == text("<script>never <p>ends") == "" and text("5 < 6 and <3") == "5 < 6 and <3"
    assert text("<article><h1>t</h1><p><b>a b.<br><p>c</p></article><footer>f") == "t a b. c"


def page(body, article=False):
    return f"<html><head><title>t</title></head><body>{'<article>' if article else ''}{body}{'</article>' if article else ''}</body></html>"


def test_repeated_runs_go_and_unique_runs_stay(spark):
    words = lambda seed, n: " ".join(f"w{random.Random(seed * 1000 + i).randint(0, 10**6)}" for i in range(n))
    around, after = words(1, 12), words(2, 25)
    rows = []
    for i in range(6):
        rows.append((i, f"https://a.example/{i}", page(f"<div>{around}</div><div>{words(100 + i, 40)}</div><div>by author {i} {after}</div>")))
    rows.append((6, "https://b.example/", page(f"<div>{around}</div><div>{words(200, 40)}</div><div>{after}</div>")))  # alone on its host
    quoted = words(3, 60)
    rows += [(10 + i, "https://a.example/q", page(f"<p>{words(300 + i, 9)}</p><p>{quoted}</p>", article=True)) for i in range(3)]
    rows += [(20, "http://c.example/1", page(f"<div>{quoted}</div>")), (21, "http://c.example/2", page(f"<div>{quoted}</div>")), (22, "http://c.example/3", page(f"<div>{quoted} edited</div>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in main_text.main_texts(df).collect()}
    for i in range(6):
        assert got[i].text == f"{words(100 + i, 40)} by author {i}" and got[i].n_taken == 37
    assert got[6].text == f"{around} {words(200, 40)} {after}" and got[6].n_repeated == 0
    assert all(got[10 + i].text == f"{words(300 + i, 9)} {quoted}" for i in range(3))
    assert got[20].text == got[21].text == quoted
    assert all(r.n_chars == len(r.text) for r in got.values())


@pytest.mark.parametrize("chunk, shard", [(10**9, 10**9), (10**9, 20), (3, 20)])
def test_covered_equals_plain_search(spark, monkeypatch, chunk, shard):
    monkeypatch.setattr(main_text, "CHUNK", chunk)
    monkeypatch.setattr(main_text, "SHARD", shard)
    rng = random.Random(5)
    pool = [[rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randint(3, 30))] for _ in range(12)]
    streams = {}
    for i in range(80):
        tokens = sum((rng.choice(pool) if rng.random() < 0.6 else [f"u{rng.randint(0, 500)}" for _ in range(6)] for _ in range(rng.randint(1, 6))), [])
        streams[rng.choice(["h1", "h1", "h2", ""]), main_text._key(tokens)] = tokens
    df = spark.createDataFrame([(h, bytearray(k), main_text.SEP.join(t)) for (h, k), t in streams.items()], "host string, skey binary, tokens string")
    got = {(r.host, bytes(r.skey)): set(r.windows) for r in main_text.covered(df)[0].collect()}
    where = {}
    for (h, k), t in streams.items():
        for i in range(len(t) - 7):
            where.setdefault((h, tuple(t[i : i + 8])), set()).add(k)
    want = {}
    for (h, k), t in streams.items():
        if hit := {i for i in range(len(t) - 7) if len(where[h, tuple(t[i : i + 8])]) > 1}:
            want[h, k] = hit
    assert got == want and sum(map(len, want.values())) > 500


def test_whole_tables_and_odd_rows(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r.page_id: r for r in main_text.main_texts(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        body = r.html.split("<article>")[1].split("</article>")[0]
        for tag in ("<h1>", "</h1>", "<p>", "</p>", "<br>"):
            body = body.replace(tag, " ")
        assert got[r.page_id].text == " ".join(main_text._html.unescape(body.replace("<b>", "")).split())
    odd = [(1, None, None, "x"), (1, None, None, "x"), (None, "no url", "", "x"), (2, "http://h/", "<p>" + "long <b>text " * 60_000, "x"), (None, None, "<p>\x00 \x1f é́ 日本</p>", None), (3, "http://H:80/", "<article></article>", "x")]
    df = spark.createDataFrame(odd, "page_id long, url string, html string, host string")
    rows = main_text.main_texts(df).collect()
    assert sorted(r.n_chars for r in rows) == [0, 0, 0, 0, len("\x00 é́ 日本"), len("long text " * 60_000) - 1]
    assert main_text.main_texts(df.limit(0)).count() == 0
