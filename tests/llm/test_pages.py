"""Wrappers and main texts on pages of many makes; fill-in-middle over chunks; collocations where the filter is full."""

import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from incognita.llm import collocations as co
from incognita.llm import fill_in_middle as fim
from incognita.llm import page_text, session, wrappers
from incognita.llm.wrappers import Node

from . import brute


def digest(text):
    return zlib.crc32(text.encode())


def wrapper(*pages):
    node = wrappers.of_page(pages[0], digest)
    for page in pages[1:]:
        node = wrappers.merged(node, wrappers.of_page(page, digest))
    return node


def text_of(page, *others):
    return page_text.main_text(page, page_text.Rules(page_text.decide(wrapper(page, *others))))


def test_repeats_options_and_slots():
    got = wrapper("<div><h2>A</h2><p>x</p><p>y</p></div>", "<div><p>z</p><ul><li>1<li>2</ul></div>")
    assert got.told() == "(div(h2(#)? p(#)+ ul(li(#)+)?))"


def test_groups_that_repeat_together():
    got = wrapper("<dl>" + "<dt>a<dd>b" * 3 + "</dl>", "<dl><dt>c<dd>d</dl>")
    assert got.told() == "(dl((dt(#) dd(#))+))"


def test_template_and_data():
    slots = wrapper(*(f"<div><p>Welcome</p><h1>{x}</h1></div>" for x in "abc")).kids[0].kids
    assert [(s.key, s.kids[0].same is None) for s in slots] == [("p", False), ("h1", True)]


def test_wrappers_do_not_depend_on_who_is_first():
    pages = ["<div><p>1</p></div>", "<div><h2>2</h2><p>3</p><p>4</p></div>", "<div><p>5</p><hr></div>"]
    assert len({wrapper(*order).told() for order in (pages, pages[::-1], pages[1:] + pages[:1])}) == 1


def test_wrappers_are_bounded():
    rng = random.Random(7)
    pages = ["".join(f"<div class='c{rng.choice('abcdefghij')}{rng.choice('klmnopqrst')}{rng.choice('uvwxyz')}'><p>{i}</p></div>" for i in range(300)) + "<div>" * 3000 + f"deep {k}" for k in range(6)]
    got = wrappers.bounded(wrapper(*pages))
    assert len(wrappers.write(got)) < 200_000 and wrappers.read(wrappers.write(got)).told() == got.told()
    assert "deep" in text_of(pages[0], *pages[1:])


ARTICLE = "<h1>Title &amp; more</h1><p>First <b>bold</b>, <a href='/x'>link</a>&nbsp;end.</p><p>Line one<br>line&#32;two &lt;b&gt;</p><ul><li>one<li>two</ul>"
TOLD = "Title & more\n\nFirst bold, link end.\n\nLine one line two <b>\n\none\n\ntwo"
AROUND = (
    "<!DOCTYPE html><html><head><title>Not me</title><style>p{}</style><script>var t='</p><p>no';</script></head><body class='has-sidebar'>",
    "<header><h1>The Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><!-- <p>no</p> --><div class='cookie-notice'>We use cookies</div>",
    "<aside>Side</aside><div id='sidebar'>More</div><form><label>Mail</label><input value='<p>'></form><section class='comments'><article class='comment'>Nice!</article></section><footer>&copy; us</footer>",
)


@pytest.mark.parametrize("opening, closing", [("<article>", "</article>"), ("<main>", "</main>"), ("<div class='content with-sidebar'><article>", "</article></div>"), ("<main><article>", "</article></main>")])
def test_articles(opening, closing):
    page = AROUND[0] + "<div class='page-header'>" + AROUND[1] + "</div>" + opening + ARTICLE + "<div class='ad'>Buy</div><div class=share-buttons>Tell</div>" + closing + AROUND[2] + "</body></html>"
    assert text_of(page) == TOLD


def test_an_article_within_a_part_named_otherwise():
    page = f"<body><div class='widget'><article>{ARTICLE}</article></div><div class='widget'>Hot news</div></body>"
    assert text_of(page) == TOLD


def test_pages_without_article_elements():
    """The part with most of the text that differs; what all pages have in one place, and lists of links, are no text of it."""
    body = lambda i: f"<p>Story {i} tells of {'water ' * (i + 9)}and wind.</p><p>It goes on {'and on ' * i}to its end {i}.</p>"
    page = lambda i: f"<body><div id=top>Our site</div><div id=c{i}><h2>Head {i}</h2>{body(i)}<div>All rights stay with us for ever and ever.</div><ul><li><a href=a>More {i}</a><li><a href=b>Other {i * 7}</a></ul></div><p>Bye</p></body>"
    pages = [page(i) for i in range(4)]
    got = text_of(pages[2], *pages)
    assert got.split("\n\n")[0] == "Head 2" and len(got.split("\n\n")) == 3 and "rights" not in got and "Other" not in got


def test_one_page_of_a_kind():
    assert text_of("<body><nav>Menu</nav><p>Alone</p> here</body>") == "Alone\n\nhere"


def test_cut_and_broken_pages():
    whole = AROUND[0] + AROUND[1] + "<article>" + ARTICLE + "</article>" + AROUND[2]
    assert text_of(whole[: whole.index("Line one") + 8]) == "Title & more\n\nFirst bold, link end.\n\nLine one"
    assert [text_of(p) for p in ("", "<", "a < b && c", "<p", "<p class='x", "&amp;amp; &am", "<article></b></div>x</article>")] == ["", "<", "a < b && c", "", "", "&amp; &am", "x"]
    assert text_of("<article>" + "<div>" * 50_000 + "deep" + "</div>" * 50_000 + "</article>") == "deep"


def test_time_grows_with_length():
    import time

    pages = ["<article>" + "<p>x<b>y</p>" * n + "</b></i>" * n + "<a '" * 50 + "</article>" for n in (20_000, 80_000)]
    seconds = []
    for page in pages:
        began = time.time()
        text_of(page)
        seconds.append(time.time() - began)
    assert seconds[1] < 12 * max(seconds[0], 0.5)


def test_rounds_of_merging(spark, monkeypatch):
    """One host on many tasks: partial wrappers are merged in rounds to the same expression."""
    monkeypatch.setattr(page_text, "FAN", 2)
    rows = [(i, "http://one.example.com/x" if i % 3 else None, f"<article><h1>{i}</h1>" + f"<p>{i}</p>" * (i % 4) + "</article>", "x") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(9)
    session.prepare(spark)
    found = {r.host: r for r in page_text.infer_wrappers(pages, session.Tables(spark, "test")).collect()}
    assert {h: r.pages for h, r in found.items()} == {"one.example.com": 40, "": 20}
    assert wrappers.read(found["one.example.com"].wrapper).told() == "(article(h1(#) p(#)*))"
    got = {r.page_id: r.text for r in page_text.main_texts(pages).collect()}
    assert got == {i: "\n\n".join([str(i)] * (i % 4 + 1)) for i in range(60)}


def test_rules_of_small_hosts_are_joined(spark, monkeypatch):
    monkeypatch.setattr(page_text, "LARGE", 3)
    rows = [(i, f"http://h{i % 7}/" if i > 50 else "http://big/", f"<article>{i}</article>") for i in range(80)]
    got = page_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.text) for r in got) == [(i, str(i)) for i in range(80)]


def test_decisions_are_small():
    node = Node.unpacked(json.loads(wrappers.write(wrapper(AROUND[0] + AROUND[1] + ARTICLE + AROUND[2]))))
    assert len(json.dumps(page_text.decide(node))) < 400


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 64, 1 << 18])
@pytest.mark.parametrize("unit", ["line", "word", "character"])
def test_chunks_do_not_matter(chunk, unit):
    rng = random.Random(chunk)
    texts = ["".join(rng.choice("a\n é😀") for _ in range(rng.randrange(40))) for _ in range(60)] + ["", "\n", "\n\n", "é"]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    chunks = fim.Chunks(np.frombuffer(b"".join(raw), np.uint8), offsets, unit, chunk)
    for i, text in enumerate(texts):
        if unit == "line":
            ends = [k for k in range(1, len(text)) if text[k - 1] == "\n"]
        elif unit == "word":
            ends = [k for k in range(1, len(text)) if text[k - 1] in "\n " and text[k] not in "\n "]
        else:
            ends = list(range(1, len(text)))
        ends += [len(text)] if text else []
        assert chunks.units[i] == len(ends)
        for rank, end in enumerate([0, *ends]):
            assert chunks.place(i, rank) == (offsets[i] + len(text[:end].encode()), end)


def test_middles_of_long_texts_and_other_markers(spark):
    docs = spark.createDataFrame([(1, "é line\n" * 2_000_000), (2, "<P> here"), (3, "|s| there\n" * 9), (4, "plain words here")], "doc_id long, text string")
    marks = ("|p|"[0] + "p>", "[s>", "{m>")
    told = fim.fill_in_middle(docs, markers=marks).join(docs, "doc_id").select("doc_id", "n", "form", (fim.restored(F.col("output"), F.col("form"), marks) == F.col("text")).alias("same")).collect()
    assert {r.doc_id: r.n for r in told} == {1: 2_000_000, 2: 1, 3: 9, 4: 1} and all(r.same and r.form != "plain" for r in told)
    assert {r.form for r in fim.fill_in_middle(docs, rate=0).collect()} == {"plain"}
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs, markers=("<P>", "<S<", "<M>"))


DOCS = [("en" if i % 5 else None, f"New  York city, New York\tstate; the new york CITY of {'big apple ' * (i % 3)}!\nnew york city ends\x0bnew york, {w} x {w} y") for i, w in enumerate("ab" * 30)]


@pytest.mark.parametrize("max_n", [2, 3, 5])
def test_phrases_of_any_length(spark, max_n):
    rows = co.collocations(spark.createDataFrame(DOCS, "lang string, text string"), max_n=max_n).collect()
    assert sorted(map(tuple, rows)) == sorted(brute.phrases(DOCS, max_n))


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(co, "_filter_of", lambda hashes: np.full(co.FILTER_BITS >> 6, ~np.uint64(0)))
    monkeypatch.setattr(co, "HELD", 10)
    rows = co.collocations(spark.createDataFrame(DOCS, "lang string, text string"), top=5).collect()
    assert sorted(map(tuple, rows)) == sorted(brute.phrases(DOCS, top=5))


def test_scores_beyond_64_bits(spark):
    big = 10**13
    got = spark.range(1).select(co.score(F.lit(big - 1), F.lit(big), F.lit(big + 7))).first()[0]
    assert got == 1_000_000 * (big - 1) ** 2 // (big * (big + 7))


def test_filter_bits(spark):
    hashes = np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 5000)
    bits = co._filter_of(spark.createDataFrame(pa.table({"hash": hashes[:2500]})))
    passed = set(co._passes(bits, hashes.view(np.uint64)).tolist())
    assert passed >= set(range(2500)) and len(passed) < 2510
