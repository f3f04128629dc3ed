import random
import re
import time
import tracemalloc
from html import unescape

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright.functions import entities, html, text
from pagewright.operators import extract, links


def values(spark, texts, column):
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, html string").repartition(4)
    return [r["v"] for r in frame.select("id", column.alias("v")).orderBy("id").collect()]


PAGES = [
    ("<p>a</p><p>b</p>", "a\n\nb", []),
    ("a<br>b<br/>c", "a\nb\n\nc", []),
    ("a<b>b</b> c", "a b c", []),
    ("1 < 2 &amp; 3", "1 < 2 & 3", []),
    ("x<script>var t = '</p>';</script>y<style>p{}</style>z", "x y z", []),
    ("a<template><p>in</p><template>deep</template>in</template>b", "a b", []),
    ("a</template>b<template/>c", "a b c", []),
    ('<p title="<b>">x<!-- <p>no</p> -->y</p>', "x y", []),
    ("<a href='/x'>1</a><a name=n>2</a><a href=>3</a><a href=\"y?a=1&amp;b=2\" title='a>b'>4</a>", "1 2 3 4", ["/x", "y?a=1&b=2"]),
    ("<ul><li>i<li>j</ul>&#65;&nbsp;&am", "i\n\nj\n\nA \u00a0&am".replace(" \u00a0", "\u00a0"), []),
]


def test_text_and_links_of_small_pages(spark):
    got = values(spark, [p for p, *_ in PAGES], extract.html_to_text("html"))
    hrefs = values(spark, [p for p, *_ in PAGES], entities.unescape_each(html.link_targets("html")))
    squeezed = [re.sub("\n+", "\n", re.sub("[ \xa0]+", " ", t)) for t in got]
    assert squeezed == [re.sub("\n+", "\n", re.sub("[ \xa0]+", " ", t)) for _, t, _ in PAGES]
    assert hrefs == [links for *_, links in PAGES]


def test_text_of_random_pages_keeps_what_is_text(spark):
    """Words outside of tags, scripts and templates appear once each and in order; no markup is left."""
    rng, pages, words = random.Random(11), [], []
    closed = ["<p>", "</p>", "<div class='x'>", "</div>", "<br/>", "\n", "<!-- c -->", "<script>var a = '<p>no';</script>", "<style>no{}</style>", "<template>no<p>no</p></template>", "<a href=z id=q>", "</a>", "<article>", "<td>"]
    for _ in range(400):
        kept = [f"w{i}" for i in range(rng.randint(0, 12))]
        pages.append("".join(rng.choice(closed) + w + rng.choice(closed) for w in kept))
        words.append(kept)
    for page, kept, got in zip(pages, words, values(spark, pages, extract.html_to_text("html")), strict=True):
        assert got.split() == kept, page
    again = values(spark, values(spark, pages, extract.html_to_text("html")), text.normalize_text(F.col("html")))
    assert again == values(spark, pages, extract.html_to_text("html"))


def test_a_page_costs_what_its_size_is(spark):
    """Four times the links cost about four times as much: each doubling at most 2.3 times."""

    def seconds(links_of_page):
        page = "<html><nav><a href=/n>n</a></nav><main>" + "".join(f'<a href="/p{i}">t{i}</a>' for i in range(links_of_page)) + "</main>"
        frame = spark.createDataFrame([(page,)], "html string").select(F.size(html.segments("html")).alias("n"))
        begun = time.perf_counter()
        assert frame.first()["n"] > 2 * links_of_page
        return time.perf_counter() - begun

    seconds(1000)
    small, large = min(seconds(20_000) for _ in range(2)), min(seconds(80_000) for _ in range(2))
    assert large < 2.3 * 2.3 * max(small, 0.5) and large < 12


def test_an_unclosed_heading_ends_at_the_next_block(spark):
    pages = ["<h1>Head<p>rest", "<h1>Two<br>lines</h1><p>x", "<title>T</title><h1>Head"]
    found = values(spark, pages, html.metadata(F.col("html"))["title"])
    assert [re.sub(" +", " ", t) for t in found] == ["Head", "Two lines", "T"]


def test_extreme_pages(spark):
    pages = ["<a " + "b=c " * 20000 + ">x", "<p" + " " * 60000 + ">y", "x" * 100000, "<b>" * 20000 + "z", None, "", "x<script>never closed"]
    got = values(spark, pages, extract.html_to_text("html"))
    assert got == ["x", "y", "x" * 100000, "z", "", "", "x"]
    sizes = values(spark, pages, F.size(html.segments("html")))
    assert sizes[0] == 1 and sizes[3] >= 1


def test_extract_links_resolves_sorts_and_drops(spark):
    page = '<a href="b">1</a><a href="/a#x">2</a><a href="mailto:q">3</a><a href="b">4</a><link href="/no"><a href="//o.example/">5</a>'
    frame = spark.createDataFrame([("https://h.example/d/e", page)], "fetched_url string, html string")
    got = links.with_links(frame).first()["links"]
    assert got == ["https://h.example/a", "https://h.example/d/b", "https://o.example/"]


def test_normalize_and_lines(spark):
    raw = [" a \t b\r\n\r\n\r\n c \r d\u2003", "\xa0x\xa0", None, "a\x0bb\x85c\u2028d\x1ce", " \n \n"]
    assert values(spark, raw, text.normalize_text(F.col("html"))) == [
        "a b\n\nc\nd", "x", "", "a\x0bb\x85c\u2028d\x1ce", "",
    ]
    lines = values(spark, raw, text.stripped_lines(F.coalesce("html", F.lit(""))))
    assert lines == [[s.strip() for s in (r or "").splitlines() if s.strip()] for r in raw]


def test_repetition_penalty(spark):
    """Nothing below four lines or above 85 % distinct ones; else the repeated share of the length, 1200 at most."""
    ten = "\n".join(["same line"] * 5 + [f"line {i}" for i in range(5)])
    cases = [
        ("x\nx\nx", 0), ("a\nb\nc\nd", 0), ("a\na\nb\nb", 3), ("a\n" * 50, 98), (ten, int((1 - 6 / 10) * len(ten))),
        ("\n".join(["y" * 999] * 4), 900), (" \n\n ", 0), ("p\n\np\n\nq\n\nq", 5),
    ]
    assert values(spark, [t for t, _ in cases], text.repetition_penalty(F.col("html"))) == [n for _, n in cases]


def test_decoding_holds_few_texts_at_a_time(monkeypatch):
    """Texts of 36 MB in one batch never take 16 MB as Python strings; runs of any size decode alike."""
    batch = pa.array(["word &amp; more of it " * 200] * 8000 + [None, "x"])
    decode = entities._decoder(False).func
    tracemalloc.start()
    got = decode(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16e6 and got[0].as_py() == "word & more of it " * 200 and got[-2:].to_pylist() == [None, "x"]
    monkeypatch.setattr(entities, "SLICE_BYTES", 50)
    rng = random.Random(3)
    for _ in range(100):
        texts = [rng.choice([None, "", "plain", "&amp;", "&lt;é&#128512;&notit;" * rng.randint(1, 9)]) for _ in range(rng.randint(0, 30))]
        wanted = [t if t is None else unescape(t) for t in texts]
        assert entities._decoder(False).func(pa.array(["&"] + texts, pa.string())[1:]).to_pylist() == wanted
        lists = pa.array([texts, None, [], texts[:5]], pa.list_(pa.string()))
        assert entities._decoder(True).func(lists).to_pylist() == [wanted, None, [], wanted[:5]]


def test_names(spark):
    urls = [" HTTPS://Ex.com/a_b/?q=1 ", "http://https://x", "///", "https://e.com/" + "a" * 70 + "/" + "b" * 40]
    assert values(spark, urls, text.slugify(F.col("html"))) == [
        "ex-com-a-b-q-1", "x", "page", ("e-com-" + "a" * 70 + "-" + "b" * 3)[:80].rstrip("-"),
    ]
    assert values(spark, ["e.com"], text.site_filename(F.col("html"), F.lit("2026-02-25T00:01:02Z"), "Markdown")) == [
        "site_e-com_20260225T000102Z.md"
    ]
    with pytest.raises(ValueError):
        text.file_extension("pdf")
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", values(spark, ["x"], text.utc_now_iso())[0])


def test_token_depth_never_negative(spark):
    pages = ["</script>a<template>b<template>c</template>d</template>e", "<template>x</style>y"]
    frame = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    rows = extract.html_tokens(frame, "id").where("kind = 'text'").orderBy("id", "pos").collect()
    assert [(r["text"], r["skip_depth"]) for r in rows] == [("a", 0), ("b", 1), ("c", 2), ("d", 1), ("e", 0), ("x", 1), ("y", 0)]
