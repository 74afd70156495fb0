"""Main text of web pages: host suffix arrays tell the runs that pages of a host repeat, markup tells the rest.

A page is read into blocks of three kinds: *framed* ones, which the markup says are no article (menus, asides, footers, forms, elements that are named or
labelled as adverts, notices, comments and the like), those of the article (``article``, else ``main``), and *open* ones, of which it says neither: all text of a page without
``article`` and ``main``, and a header inside an article. Framed and open blocks, each after a token for its element, are the page's token stream.

The streams of a host are searched for strings of ``length`` tokens that stand in two different streams. Windows are dealt by their anchor (the least
hash of their GRAM-token parts), windows in a row with one anchor being one piece; equal pieces of a host are merged before they move on. A shard
concatenates its pieces, sorts all suffixes as deep as ``length`` by doubling, and takes neighbours that agree so far: those of two streams of one
host are boilerplate. An anchor around which a host has more than ``CHUNK`` different pieces deals its windows by their own hashes instead. Each stream then gets back which of its
tokens are covered. Open blocks lose what is covered and keep their unique runs; framed blocks go, covered or not; article blocks stay, since pages may quote and copy
each other. Copies of a stream count as one, and a page that would lose all its open text to boilerplate (an edited copy of another page) keeps it.

Texts cross one shuffle, compressed, to meet what is covered of their streams; streams are distinct by then, and joins are plain equi-joins that adaptive execution splits.

Defined results: null html is empty, and has the empty text; a null or odd url has the host of its own kind (none); repeated rows stay rows and are alike; tags that are never closed end with what
contains them, a comment or script that never ends takes the rest of the page; very long pages are read whole, a few at a time; an empty table stays empty; other columns, whatever their
names, are ignored. Character references are decoded as HTML 5 says.
"""

from __future__ import annotations

import hashlib
import html as _html
import json
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, sliced, written

LENGTH, GRAM = 8, 4
#: Different pieces of one anchor of one host that meet in a shard; and pieces a shard, about.
CHUNK, SHARD = 20_000, 40_000

#: Names of HTML elements.
BLOCKS = frozenset("address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
UNSEEN = frozenset("head script style textarea title iframe noembed noframes xmp noscript template svg math select datalist button object canvas audio video map".split())
FRAMES = frozenset("nav aside footer form menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: What authors call such elements in ``class`` and ``id``.
AROUND = frozenset("ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos promotion promotions teaser teasers comment comments commentlist disqus responses replies reply respond related recommended recommendations sidebar footer".split())
NAMED = AROUND | frozenset("menu menus nav navbar navigation breadcrumb breadcrumbs masthead topbar header banner banners cookie cookies consent gdpr notice notices disclaimer newsletter subscribe subscription signup login popup modal overlay share sharing social widget widgets toolbar pagination pager skip paywall".split())
DISCUSSION = frozenset("comment comments commentlist disqus responses replies reply respond".split())
#: What an ``article`` that is a comment is called; others tell whether one may comment.
POST = frozenset(("comment", "reply"))
#: An element that begins inside one of these ends it.
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}

_MARKUP = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HOST = re.compile(r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@\s]*@)?([^/?#:\s]+)")
FRAMED, OPEN, ARTICLE = 0, 1, 2


class Element:
    """An open element; what it inherits is kept with it, so that no step looks through all open elements."""

    __slots__ = ("tag", "mark", "own_frame", "unseen", "article", "main", "names", "above", "in_article", "in_talk", "in_unseen", "block", "_framed")

    def __init__(self, tag: str, attributes: str, above: "Element | None", at: int):
        found = {}
        if attributes.strip(" /\n\t\r"):
            for k, a, b, c in _ATTRIBUTE.findall(attributes):
                found.setdefault(k.lower(), a or b or c)
        label = f"{found.get('class', '')} {found.get('id', '')}"
        self.tag, self.mark, self.above = tag, tag + (f".{found['class']}" if found.get("class") else ""), above
        self.names = frozenset(x.lower() for x in _NAME.findall(label)) if label != " " else frozenset()
        role = found.get("role", "").lower()
        self.in_article = above is not None and (above.in_article or above.article)
        self.in_talk = above is not None and (above.in_talk or (above.own_frame and bool(above.names & DISCUSSION)))
        talk = self.in_talk or bool(self.names & (POST if tag == "article" else DISCUSSION))
        self.article = (tag == "article" or role == "article") and not talk
        self.main = tag == "main" or role == "main"
        hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        self.unseen = tag in UNSEEN or hidden
        self.in_unseen = self.unseen or (above is not None and above.in_unseen)
        self.block = at if tag in BLOCKS else above.block if above else -1  # place of the nearest block among the open elements
        named = bool(self.names & NAMED) and tag not in ("html", "body", "main") and (self.in_article or not self.article) and not (tag == "header" and self.in_article)
        self.own_frame = tag in FRAMES or role in ROLES or (tag == "header" and not self.in_article) or (tag == "article" and talk) or named
        self._framed: bool | None = None

    def framed(self) -> bool:
        """Whether it or one that contains it is no article; asked for at the end only."""
        chain, e = [], self
        while e is not None and e._framed is None:
            chain.append(e)
            e = e.above
        state = e is not None and e._framed
        for x in reversed(chain):
            state = x._framed = state or x.own_frame
        return state


def blocks(html: str | None) -> list[tuple[int, str, str]]:
    """Kind, element and text of each block with text, in page order."""
    stack: list[Element] = []
    opened: Counter = Counter()
    found: list[tuple[Element | None, str, float]] = []
    text: list[str] = []
    linked = [0, 0]

    def flush():
        if text:
            joined = " ".join("".join(text).split())
            if joined and not (stack and stack[-1].in_unseen):
                found.append((stack[-1] if stack else None, joined, linked[0] / max(1, linked[1])))
            text.clear()
        linked[:] = [0, 0]

    def say(s: str):
        if s:
            text.append(_html.unescape(s) if "&" in s else s)
            linked[1] += len(s)
            if opened["a"]:
                linked[0] += len(s)

    def shut(size: int):
        while len(stack) > size:
            opened[stack.pop().tag] -= 1

    at, html = 0, html or ""
    while True:
        m = _MARKUP.search(html, at)
        if not m:
            say(html[at:])
            break
        say(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:  # an end tag
            if opened[tag]:
                if tag in BLOCKS or tag in UNSEEN:
                    flush()
                size = len(stack) - 1
                while stack[size].tag != tag:
                    size -= 1
                shut(size)
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in BLOCKS or tag in UNSEEN:
            flush()
        if tag in VOID:
            continue
        if tag in BLOCKS and stack and stack[-1].block >= 0 and stack[stack[-1].block].tag == "p":  # no block stands in a paragraph
            shut(stack[-1].block)
        if tag in ENDS and any(opened[x] for x in ENDS[tag][0]):
            which, border = ENDS[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag in border:
                    break
                if stack[i].tag in which:
                    shut(i)
                    break
        new = Element(tag, m[3], stack[-1] if stack else None, len(stack))
        if (new.article or new.main) and not new.own_frame and not new.in_article:
            first = next((i for i, e in enumerate(stack) if e.tag in ("nav", "header", "menu")), None)  # never closed
            if first is not None:
                shut(first)
                new = Element(tag, m[3], stack[-1] if stack else None, len(stack))
            for e in stack:  # what holds the article is not around it
                if e.tag == "form" or (e.tag not in FRAMES and not e.names & AROUND):
                    e.own_frame = False
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag in BLOCKS or tag in UNSEEN or tag == "a" or new.own_frame or new.unseen or new.article or new.main:
            stack.append(new)  # others, open or closed, change nothing
            opened[tag] += 1
    flush()
    articles = any((e.in_article or e.article) and not e.framed() for e, _, _ in found if e)
    in_main: dict[int, bool] = {}

    def within_main(e: Element | None) -> bool:
        chain = []
        while e is not None and id(e) not in in_main:
            chain.append(e)
            e = e.above
        state = e is not None and in_main[id(e)]
        for x in reversed(chain):
            state = in_main[id(x)] = state or x.main
        return state

    mains = not articles and any(within_main(e) and not e.framed() for e, _, _ in found if e)
    out = []
    for e, joined, links in found:
        inside = e is not None and (e.in_article or e.article if articles else within_main(e) if mains else False)
        if (e is not None and e.framed()) or ((articles or mains) and not inside) or (not inside and links > 0.5):
            kind = FRAMED
        elif inside:
            kind = OPEN if _in_header(e) else ARTICLE
        else:
            kind = OPEN
        out.append((kind, e.mark if e else "", joined))
    return out


def _in_header(e: Element | None) -> bool:
    """Whether a block stands in a header (of its article); a header is not deep."""
    for _ in range(16):
        if e is None or e.article or e.main:
            return False
        if e.tag == "header":
            return True
        e = e.above
    return False


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


SEP = "\x1f"  # white space, so that no token has it


def stream(found: list[tuple[int, str, str]]) -> list[str]:
    """Tokens of the blocks that may be boilerplate."""
    out: list[str] = []
    for kind, mark, text in found:
        if kind != ARTICLE:
            out.append("\x02" + "_".join(mark.split()))
            out += text.split()
    return out


def _key(tokens: list[str]) -> bytes:
    return hashlib.blake2b(SEP.join(tokens).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _streams(batches):
    for b in sliced(batches, 64):
        seen = {}
        for url, html in zip(b.column("url").to_pylist(), b.column("html").to_pylist()):
            tokens = stream(blocks(html))
            if len(tokens) >= LENGTH:
                seen[host_of(url), _key(tokens)] = SEP.join(tokens)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen]), pa.array([k[1] for k in seen], pa.binary()), pa.array(list(seen.values()))], ["host", "skey", "tokens"])


def _blobs(keep: tuple[str, ...]):
    def run(batches):
        for b in sliced(batches, 64):
            hosts, skeys, blobs = [], [], []
            for url, html in zip(b.column("url").to_pylist(), b.column("html").to_pylist()):
                found = blocks(html)
                hosts.append(host_of(url))
                skeys.append(_key(stream(found)))
                blobs.append(zstandard.ZstdCompressor(level=3).compress(json.dumps(found, ensure_ascii=False).encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(hosts), pa.array(skeys, pa.binary()), pa.array(blobs, pa.binary())], [*keep, "host", "skey", "blob"])

    return run


# ---- pieces


def _hash(tokens: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for t in tokens], np.uint64)


def pieces(tokens: list[str], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """Windows in a row with one anchor: first token, number of tokens, anchor."""
    if len(tokens) < length:
        return []
    h, odd = _hash(tokens), np.uint64(0x9E3779B97F4A7C15)
    gram = min(GRAM, length)
    g = np.zeros(len(h) - gram + 1, np.uint64)
    for i in range(gram):
        g = (g ^ (g >> np.uint64(29))) * odd + h[i : i + len(g)]
    g ^= g >> np.uint64(31)
    least = np.lib.stride_tricks.sliding_window_view(g, length - gram + 1).min(axis=1)
    first = np.append(0, np.flatnonzero(least[1:] != least[:-1]) + 1)
    n = np.diff(np.append(first, len(least)))
    return [(int(a), int(k) + length - 1, int(x)) for a, k, x in zip(first, n, least[first].view(np.int64))]


def _pieces(length: int):
    def run(batches):
        for b in sliced(batches, 256):
            rows = []
            for host, skey, joined in zip(b.column("host").to_pylist(), b.column("skey").to_pylist(), b.column("tokens").to_pylist()):
                tokens = joined.split(SEP)
                rows += [(host, skey, a, x, SEP.join(tokens[a : a + n])) for a, n, x in pieces(tokens, length)]
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["host", "skey", "at", "anchor", "piece"])

    return run


def repeated(texts: list[list[str]], hosts: list[str], low: list[bytes], high: list[bytes], length: int = LENGTH) -> list[list[int]]:
    """Of each piece the windows that stand in two streams of its host, by a suffix array over all pieces, sorted as deep as ``length``."""
    number: dict[str, int] = {}
    flat = np.array([i for t in texts for i in (*(number.setdefault(x, len(number) + 1) for x in t), 0)], np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    rank, have = flat, 1
    while have < length:  # doubling; the last step overlaps
        step = min(have, length - have)
        nxt = np.zeros(len(flat), np.int64)
        nxt[:-step] = rank[step:]
        rank = np.unique(rank * (int(rank.max()) + 2) + nxt, return_inverse=True)[1].astype(np.int64)
        have += step
    span = sizes - length + 1
    of = np.repeat(np.arange(len(texts)), span)
    at = np.arange(len(of)) - np.repeat(np.cumsum(span) - span, span)
    hosts_no = np.unique(np.array(hosts, object), return_inverse=True)[1]
    group = rank[begin[of] + at] * (int(hosts_no.max()) + 1) + hosts_no[of]
    order = np.argsort(group, kind="stable")
    ids: dict[bytes, int] = {}
    lo, hi = (np.array([ids.setdefault(x, len(ids)) for x in col], np.int64) for col in (low, high))
    starts = np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1]))
    least = np.minimum.reduceat(np.minimum(lo, hi)[of[order]], starts)
    most = np.maximum.reduceat(np.maximum(lo, hi)[of[order]], starts)
    hit = np.zeros(len(of), bool)
    hit[order] = np.repeat(least != most, np.diff(np.append(starts, len(order))))
    out: list[list[int]] = [[] for _ in texts]
    for i, a in zip(of[hit].tolist(), at[hit].tolist()):
        out[i].append(a)
    return out


def _shard(length: int):
    def run(key, group):
        texts = [x.split(SEP) for x in group.column("piece").to_pylist()]
        hits = repeated(texts, group.column("host").to_pylist(), group.column("low").to_pylist(), group.column("high").to_pylist(), length)
        keep = pa.array([i for i, x in enumerate(hits) if x], pa.int64())
        return pa.table({"host": group.column("host").take(keep), "piece": group.column("piece").take(keep), "hits": pa.array([x for x in hits if x], pa.list_(pa.int64()))})

    return run


def covered(streams: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """host, skey and windows (first tokens of windows that another stream of the host has), of streams that have any; and the written table it reads."""
    cut = written(streams.dropDuplicates(["host", "skey"]).mapInArrow(_pieces(length), "host string, skey binary, at long, anchor long, piece string"), "pieces")
    different = cut.groupBy("host", "anchor", "piece").agg(F.min("skey").alias("low"), F.max("skey").alias("high"))
    hot = cut.groupBy("host", "anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CHUNK).select("host", "anchor")
    shards = max(1, -(-cut.count() // SHARD))
    few = different.join(hot, ["host", "anchor"], "left_anti").withColumn("shard", F.pmod(F.xxhash64("host", "anchor"), F.lit(shards)))
    kind = "host string, piece string, hits array<bigint>"
    found = few.groupBy("shard").applyInArrow(_shard(length), kind)
    tokens = F.split("piece", SEP)
    many = different.join(hot, ["host", "anchor"], "left_semi").select("host", "piece", "low", "high", tokens.alias("tokens"))
    many = many.select("host", "piece", "low", "high", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("tokens") - length + 1), lambda i: F.array_join(F.slice("tokens", i, F.lit(length)), SEP))).alias("at", "window"))
    twice = many.groupBy("host", "window").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low <> high").select("host", "window")
    of_many = many.join(twice, ["host", "window"]).groupBy("host", "piece").agg(F.collect_set(F.col("at").cast("long")).alias("hits"))
    every = found.unionByName(of_many).groupBy("host", "piece").agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"))
    back = cut.select("host", "skey", "at", "piece").join(every, ["host", "piece"])
    each = back.select("host", "skey", F.transform("hits", lambda x: x + F.col("at")).alias("windows"))
    return each.groupBy("host", "skey").agg(F.flatten(F.collect_list("windows")).alias("windows")), cut


def assembled(found: list, windows: list[int] | None, length: int = LENGTH) -> tuple[str, int, int]:
    """The text of a page's blocks, its tokens that are covered, and the tokens of its open blocks that were taken out."""
    sizes = [1 + len(t.split()) for k, _, t in found if k != ARTICLE]
    mask = np.zeros(sum(sizes) + length, bool)
    for w in windows or ():
        mask[w : w + length] = True
    n_covered, at, parts, taken, rest = int(mask.sum()), 0, [], 0, 0
    for kind, _, text in found:
        if kind == ARTICLE:
            parts.append((text, text))
            continue
        words = text.split()
        own = mask[at + 1 : at + 1 + len(words)]
        at += 1 + len(words)
        if kind == OPEN:
            unique = [w for w, c in zip(words, own) if not c]
            taken += len(words) - len(unique)
            rest += len(unique)
            parts.append((" ".join(unique), text))
    whole = not rest and not any(k == ARTICLE for k, _, _ in found)
    chosen = [b if whole else a for a, b in parts]
    return " ".join(x for x in chosen if x), n_covered, 0 if whole else taken


def _texts(keep: tuple[str, ...], length: int):
    def run(batches):
        for b in sliced(batches, 64):
            rows = []
            for blob, windows in zip(b.column("blob").to_pylist(), b.column("windows").to_pylist()):
                rows.append(assembled(json.loads(zstandard.ZstdDecompressor().decompress(blob).decode("utf-8", "surrogatepass")), windows, length))
            texts, n, taken = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array(taken, pa.int64())], [*keep, "text", "n_chars", "n_repeated", "n_taken"])

    return run


def main_texts(pages: DataFrame, length: int = LENGTH) -> DataFrame:
    """page_id, url, text and n_chars of every page; n_repeated: tokens outside the article that other pages of the host repeat; n_taken: those taken out of open blocks."""
    rows = only(pages, page_id="page_id", url="url", html="html")
    kind = dict(rows.dtypes)["page_id"]
    windows, _ = covered(rows.select("url", "html").mapInArrow(_streams, "host string, skey binary, tokens string"), length)
    keep = ("page_id", "url")
    read = rows.mapInArrow(_blobs(keep), f"page_id {kind}, url string, host string, skey binary, blob binary")
    return read.join(windows, ["host", "skey"], "left").select(*keep, "blob", "windows").mapInArrow(_texts(keep, length), f"page_id {kind}, url string, text string, n_chars long, n_repeated long, n_taken long")
