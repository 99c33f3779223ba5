"""Divergence of sources, main text of pages and collocations on small fixtures, against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("cohortlab.llm")
from cohortlab.llm import collocations, divergence, sitetext

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, rank string"


def corpus(seed=3, n=220):
    """Rows of documents over few words: nulls in every column, repeats, empty and long texts, clashing extra columns."""
    draw = random.Random(seed)
    words = [f"w{c}" for c in "abcdefghij"] + ["Été", "été", "日本", "x2y", "The", "the", "o'clock", "a-b"]
    rows = []
    for i in range(n):
        lang = draw.choice(["en", "en", "en", "de", None, ""])
        source = draw.choice([f"s{k}" for k in range(40)] + [None, ""])
        size = draw.choice([0, 1, 2, 3, 8, 30])
        text = "".join(draw.choice(words) + draw.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "! "]) for _ in range(size))
        rows.append((i, draw.choice([text, text, text, None, "", " .,;"]), lang, source, i, 0.5, "r"))
    rows += rows[:20]
    rows.append((None, "the The the été " * 5000, "en", "s1", 1, 0.5, "r"))
    rows.append((7, "ab " * 3, "xx", "only", None, None, None))
    return rows


# divergence


def diverging(rows, min_docs, best):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        found = term.findall((text or "").translate(table))
        docs[lang or ""].update(set(found))
        counts[lang or "", source or ""].update(found)
        groups.add((lang or "", source or ""))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        v = len(kept)
        own = sorted(g for g in groups if g[0] == lang)

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * v) for t in kept}

        p = {g: shares(counts[g]) for g in own}
        everything = Counter()
        for g in own:
            everything.update(counts[g])
        q = shares(everything)
        for g in own:
            pairs = sorted((-sum(abs(p[g][t] - p[o][t]) for t in kept), o[1].encode()) for o in own if o != g)
            out |= {(lang, g[1], "pair", o.decode(), -d, i + 1) for i, (d, o) in enumerate(pairs)}
            terms = sorted((q[t] - p[g][t], t.encode()) for t in kept if counts[g][t] > 0 and p[g][t] > q[t])
            out |= {(lang, g[1], "term", t.decode(), -d, i + 1) for i, (d, t) in enumerate(terms[:best])}
    return out


@pytest.mark.parametrize("rows_a_leaf, columns", [(32, 2048), (4, 3)])
def test_divergence_by_force(spark, monkeypatch, rows_a_leaf, columns):
    """Small leaves give a tree of several levels with empty quadrants."""
    monkeypatch.setattr(divergence, "ROWS", rows_a_leaf)
    rows = corpus()
    df = spark.createDataFrame(rows, DOCS)
    found = [tuple(r) for r in divergence.divergence(df, min_docs=5, best_terms=4, columns=columns).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(found) == len(set(found))
    assert set(found) == diverging(rows, 5, 4)


def test_divergence_without_terms_or_rows(spark):
    assert divergence.divergence(spark.createDataFrame([], DOCS)).count() == 0
    few = spark.createDataFrame([(1, None, None, "a", 0, None, None), (2, "x", None, None, 0, None, None), (3, "x y", "en", "b", 0, None, None)], DOCS)
    found = {tuple(r) for r in divergence.divergence(few).collect()}
    assert found == {("", "a", "pair", "", 0, 1), ("", "", "pair", "a", 0, 1)}


def test_shares_are_exact_beyond_64_bits(spark):
    c, n, v = 9 * 10**15, 10**16 + 3, 7
    found = spark.sql(f"SELECT {divergence.SHARE.format(c=f'{c}L', n=f'{n}L', v=f'{v}L')} AS p").first()[0]
    assert found == 1 + 10**9 * (c + 5) // (n + 5 * v)


# collocations


def collocated(rows, longest=3, threshold=10, best=2000, share=50):
    counts, words = defaultdict(Counter), Counter()
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(table)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(ws)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) >= 2 and a >= threshold}
        scored = []
        for p, a in candidates.items():
            inside = [q for q in candidates if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * candidates[q] >= share * a for q in inside):
                continue
            cuts = [(10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (score, a, p, x, y) in enumerate(sorted(scored)[:best]):
            out.append((lang, i + 1, p.decode(), -a, x, y, words[lang], -score))
    return sorted(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("options", [{}, {"range_phrases": 200, "slice_bytes": 500}, {"threshold": 3, "best": 5, "share": 90}, {"longest": 4, "threshold": 4}])
def test_collocations_by_force(spark, options):
    rows = corpus(seed=5, n=400)
    df = spark.createDataFrame(rows, DOCS)
    found = sorted(tuple(r) for r in collocations.collocations(df, **options).select(*COLUMNS).collect())
    assert found == collocated(rows, **{k: v for k, v in options.items() if k in ("longest", "threshold", "best", "share")})


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0
    blank = spark.createDataFrame([(1, None, "en", "a", 0, None, None), (2, " .\t", None, None, 0, None, None)], DOCS)
    assert collocations.collocations(blank).count() == 0


def test_products_beyond_64_bits(spark):
    """Scores of counts near 10^13 stay exact."""
    a, x, y = 3 * 10**12, 5 * 10**12, 4 * 10**12
    df = spark.createDataFrame([(a, x, y)], "a bigint, l bigint, r bigint")
    found = df.select(F.expr(collocations.SCORE).alias("s")).first()[0]
    assert found == 10**6 * a * a // (x * y)


def test_summaries_keep_every_frequent_key():
    """Any order and grouping of merges: no key with ``threshold`` occurrences is lost, and counters bound the true counts."""
    draw = np.random.default_rng(1)
    for trial in range(20):
        keys = draw.zipf(1.3, 4000).astype(np.uint32) % np.uint32(900)
        threshold = int(draw.integers(5, 60))
        capacity = len(keys) // threshold + 1
        merged = collocations.Summary(capacity)
        for part in np.array_split(keys, int(draw.integers(1, 30))):
            own = collocations.Summary(capacity)
            for block in np.array_split(part, 3):
                own.merge(*np.unique(block, return_counts=True))
            merged.merge(own.keys, own.counts, own.taken)
        assert len(merged.keys) <= capacity and merged.taken < threshold
        true, counts = np.unique(keys, return_counts=True)
        assert set(true[counts >= threshold]) <= set(merged.possible(threshold).tolist())
        own = dict(zip(true.tolist(), counts.tolist(), strict=True))
        assert all(c <= own[k] <= c + merged.taken for k, c in zip(merged.keys.tolist(), merged.counts.tolist(), strict=True))


def test_long_texts_are_cut_at_pieces_only():
    text = b"aa bb. " * 50 + b"c" * 400 + b" dd"
    parts = list(collocations.short_parts(text, 100))
    assert b"".join(parts) == text and all(p[-1:] in b".," for p in parts[:-1])
    assert list(collocations.short_parts(b"", 10)) == [b""]


# main text


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><article>no</article>";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a href="/{n}">Menu {n}</a></li></ul></nav><div class="cookie-notice">We use <b>cookies</b></div>
<article><h1>Title&nbsp;{n}</h1><p>First &amp; foremost<br>second   line <a href="x">link</a>.<p>Unclosed <i>tags &lt;ok&gt;
<div class="ad">Buy {n}</div><ul><li>one<li>two</ul><div hidden>secret</div><aside>side</aside><p>1 < 2 &copy;</p>
<form><input value="a>b"><button>Send</button></form></article>
<section id="comments"><article><p>Nice post {n}, really a very long comment that goes on and on and on and on</p></article></section>
<div class="sidebar-right">More</div><footer>&copy; site</footer></body></html>"""
TEXT = "Title {n}\nFirst & foremost second line link.\nUnclosed tags <ok>\none\ntwo\n1 < 2 ©"


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("plain &amp text &am", "plain & text &am"), ("<p>a<b>b</b>c</p> <p>d\n e</p>", "abc\nd e"), ("<article></article><p>x", ""),
        ("<main><h1>A</h1><p>b</p></main><p>c</p>", "A\nb"), ('<div id="content">x<div class="no-sidebar">y</div></div>z', "x\ny"), ('<p title="a>b">c</p><!-- <p>d</p> -->e<scr', "c\ne"),
        ("<form><article>in a form<form>no</form></article></form>", "in a form"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
        ("<script>unclosed <article>x</article>", ""), ('<main><div class="widget"><article>all of it</article></div></main>', "all of it"), ("<P>UP</P><BR>", "UP"),
        ("<article>a<article>b</article><footer>c</footer></article><article>d</article>", "a\nb\nd"), ("<dl><dt>a<dd>b</dl>", "a\nb"),
    ],
)
def test_main_text(page, text):
    assert sitetext.main_text(page) == text


def test_markup_of_any_depth_and_length():
    assert sitetext.main_text("<div><b>" * 5000 + "x" + "</b></div>" * 5000) == "x"
    assert sitetext.main_text("<p>" + "word " * 200_000) == ("word " * 200_000).strip()
    assert sitetext.main_text('<a "' * 20_000 + "x") == sitetext.main_text('<a "' * 20_000 + "x")


PAGES = "page_id bigint, url string, html string, text string, templates string, _x int"


def test_templates_of_a_site(spark):
    """Pages without a named article: what recurs on pages of the host goes, what recurs on another host or in copies stays."""
    rows = []
    for n in range(12):
        rows.append((n, f"http://Site.example/{n}", f"<div>Welcome to us</div><p>Own text {n}</p><div><p>Legal <b>note</b></p></div>", "old", "t", 1))
        rows.append((100 + n, f"http://other{n}.example/", f"<div>Welcome to us</div><p>Own text {n}</p>", None, None, None))
        rows.append((200 + n, "http://copies.example/", "<div>Only copies</div><p>of one page</p>", None, None, None))
        rows.append((300 + n, f"http://named.example/{n}", f"<article><p>A quoted passage</p><ul><li><a href=x>Share</a></ul><p>{n}</p></article>", None, None, None))
        rows.append((400 + n, f"http://full.example/{n}", PAGE.format(n=n), None, None, None))
    rows += [(None, None, None, None, None, None), (1, "no host", "", None, None, None), (0, "http://Site.example/0", rows[0][2], "old", "t", 1)]
    out = sitetext.extracted(spark.createDataFrame(rows, PAGES))
    assert out.columns == ["page_id", "url", "html", "templates", "_x", "text", "n_chars"]
    found = out.collect()
    assert len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in found)
    text = defaultdict(set)
    for r in found:
        text[r["page_id"]].add(r["text"])
    for n in range(12):
        assert text[n] == {f"Own text {n}"} | ({""} if n == 1 else set())
        assert text[100 + n] == {f"Welcome to us\nOwn text {n}"}
        assert text[200 + n] == {"Only copies\nof one page"}
        assert text[300 + n] == {f"A quoted passage\n{n}"}
        assert text[400 + n] == {TEXT.format(n=n)}
    assert text[None] == {""}


def test_templates_need_a_share_of_the_host(spark):
    pages = spark.createDataFrame([(n, f"http://h.example/{n}", f"<p>{n}</p><div>{'rare' if n < 3 else f'd{n}'}</div>", None, None, None) for n in range(40)], PAGES)
    assert {r["text"] for r in sitetext.extracted(pages).filter("page_id < 3").collect()} == {f"{n}\nrare" for n in range(3)}
    assert {r["text"] for r in sitetext.extracted(pages, share=0.05).filter("page_id < 3").collect()} == {f"{n}" for n in range(3)}


def test_salted_joins_give_the_same_rows(spark, monkeypatch):
    """Without a broadcast every operator returns the same rows."""
    from cohortlab.llm import store

    rows = corpus(seed=8, n=150)
    df = spark.createDataFrame(rows, DOCS)
    pages = spark.createDataFrame([(n, f"http://site.example/{n}", f"<div>Welcome</div><p>Own {n}</p>", None, None, None) for n in range(12)], PAGES)
    monkeypatch.setattr(store, "measured", lambda side, *wide, **options: side)
    for module in (collocations, divergence):
        monkeypatch.setattr(module, "measured", lambda side, *wide, **options: side)
    monkeypatch.setattr(divergence, "ROWS", 4)
    found = sorted(tuple(r) for r in collocations.collocations(df, threshold=4).select(*COLUMNS).collect())
    assert found == collocated(rows, threshold=4)
    assert {tuple(r) for r in divergence.divergence(df, min_docs=5, columns=3).collect()} == diverging(rows, 5, 50)
    assert {r["text"] for r in sitetext.extracted(pages).select(F.col("text")).collect()} == {f"Own {n}" for n in range(12)}
