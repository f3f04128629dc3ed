import fnmatch
from urllib.parse import parse_qsl, urlsplit

import pytest
from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.functions import urls


def evaluate(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


CANONICAL_CASES = [
    ("hTTp://Sea.Example//x///y/?k=v&c=&B=2#top", "http://sea.example/x/y?B=2&c=&k=v"),
    ("tel:+123", ""),
    ("javascript:x", ""),
    ("example.com/a", ""),
    ("", ""),
    (None, ""),
    ("http://u:p@H.example:80/", "http://h.example/"),
    ("https://h.example:80/", "https://h.example:80/"),
    ("http://h.example:99999/", ""),
    ("http://h.example:x/", ""),
    ("http://[bad", ""),
    ("http://[::1]:8080/a", "http://[::1]:8080/a"),
    ("//h.example/a;x=1", "https://h.example/a"),
    ("https://h.example/../a/./b/", "https://h.example/a/b"),
    ("https://h.example/?b&a=%zz&a=1+2", "https://h.example/?a=%25zz&a=1+2&b="),
    ("https://exa_mple.example/x", "https://exa_mple.example/x"),
    ("https://hü.example/ü?q=ü", "https://hü.example/ü?q=%C3%BC"),
    ("https://h.example/?q=*~", "https://h.example/?q=%2A~"),
    ("ftp://h/", "ftp://h/"),
    ("http://h:0/", "http://h/"),
    ("http://h℀x/", ""),
]


def test_canonical_literal_cases(spark):
    got = evaluate(spark, [(u,) for u, _ in CANONICAL_CASES], "url string", urls.canonicalize_url(F.col("url")))
    assert [g for (g,) in got] == [want for _, want in CANONICAL_CASES]


# Reference resolution examples of RFC 3986, section 5.4, and what is left of them in canonical form.
RFC_BASE = "http://a/b/c/d;p?q"
RFC_CASES = [
    ("g", "http://a/b/c/g"), ("./g", "http://a/b/c/g"), ("g/", "http://a/b/c/g"), ("/g", "http://a/g"), ("//g", "http://g/"),
    ("g?y", "http://a/b/c/g?y="), ("g#s", "http://a/b/c/g"), ("..", "http://a/b"), ("../g", "http://a/b/g"),
    ("../..", "http://a/"), ("../../g", "http://a/g"), ("../../../g", "http://a/g"), ("/./g", "http://a/g"), ("g.", "http://a/b/c/g."),
    ("..g", "http://a/b/c/..g"), ("./../g", "http://a/b/g"), ("g/./h", "http://a/b/c/g/h"), ("g/../h", "http://a/b/c/h"),
]


def test_resolution_examples_of_the_standard(spark):
    got = evaluate(spark, RFC_CASES, "url string, want string", urls.resolve_url(F.col("url"), F.lit(RFC_BASE)), F.col("want"))
    assert [g for g, _ in got] == [w for _, w in got]


ALPHABET = st.sampled_from(list("ab./:?#&=;%+@ Z~*ü_-0189[]\t") + ["//", "..", "http:", "https://", "%41", "h.example"])
URL = st.lists(ALPHABET, max_size=12).map("".join) | st.lists(ALPHABET, max_size=10).map(
    lambda p: "http://h.example/" + "".join(p)
)


@settings(max_examples=6, deadline=None, phases=[Phase.explicit, Phase.generate])
@given(st.lists(URL, min_size=150, max_size=150))
def test_canonical_form_has_its_properties(spark, raw):
    again = urls.canonicalize_url(urls.canonicalize_url(F.col("url")))
    columns = [F.col("url"), urls.canonicalize_url(F.col("url")), again]
    for url, found, twice in evaluate(spark, [(u,) for u in raw], "url string", *columns):
        # Parameters of a last path segment are cut once, and what stands before them may have some again.
        assert twice == found or ";" in url, url
        if found:
            parts = urlsplit(found)
            assert parts.scheme and parts.hostname and not parts.fragment, url
            assert parts.netloc == parts.netloc.lower() and "@" not in parts.netloc, url
            assert "//" not in parts.path and not {".", ".."} & set(parts.path.split("/")), url
            assert parts.path == "/" or not parts.path.endswith("/"), url
            pairs = parse_qsl(parts.query, keep_blank_values=True)
            assert pairs == sorted(pairs), url


@pytest.mark.parametrize(
    "url, binary",
    [("https://h/a.TAR.GZ", True), ("https://h/.pdf", False), ("https://h/d.pdf/x", False), ("https://h/x.pdf?y", True), ("https://h/pdf", False)],
)
def test_binary(spark, url, binary):
    assert one(spark, urls.is_binary_url(F.lit(url))) is binary


@pytest.mark.parametrize(
    "url,want",
    [("https://h/x?k1=1&k2=2&k3=3&k4=", True), ("https://h/x?k1=1&k2=2&k3=3", False), ("https://h/x", False), ("https://h/?k=" + "v" * 79, True), ("https://h/?k=" + "v" * 78, False)],
)
def test_query_heavy(spark, url, want):
    assert one(spark, urls.is_query_heavy(F.lit(url))) is want


def test_skip_reason(spark):
    def reason(url, **options):
        return one(spark, urls.skip_reason(F.lit(url), **options))

    assert reason("https://port.test/charts/north.zip") == "binary-extension"
    assert reason("https://port.test/tides/may", allow_patterns=["*/tides/*"]) is None
    assert reason("https://port.test/news/may", allow_patterns=["*/tides/*"]) == "allow-pattern-miss"
    assert reason("https://port.test/crew/x", deny_patterns=["https://port.test/crew/?"]) == "deny-pattern"
    assert reason("https://port.test/crew/x.zip", deny_patterns=["*"]) == "binary-extension"
    assert reason("https://port.test/?p=1&q=2&r=3&s=4") == "query-heavy"
    assert reason("https://port.test/?p=1&q=2&r=3&s=4", query_filter=False) is None


GLOBS = ["*", "https://h/[ab]?", "https://h/[!a-c]*", "*[", "*[]x]*", "*[a[b]*", "a^b$", "*.html", "*[!]]", "[^a]*", "*\\*", "*[&&]*"]


@pytest.mark.parametrize("pattern", GLOBS)
def test_glob_equals_standard_library(spark, pattern):
    texts = ["https://h/ax", "https://h/dx", "https://h/", "x[", "a]", "a^b$", "q.html", "q.HTML", "^x", "ab\\c", "https://h/a\nb", "&"]
    got = evaluate(
        spark,
        [(t,) for t in texts],
        "url string",
        urls.glob_match(F.col("url"), [pattern]),
        urls.glob_match(F.col("url"), F.array(F.lit(pattern))),
    )
    assert got == [(fnmatch.fnmatchcase(t, pattern),) * 2 for t in texts]


def test_host_and_key(spark):
    rows = [("http://a.b:8080/x?y",), ("https://a.b/x",), ("https://[::1]/",)]
    got = evaluate(spark, rows, "url string", urls.url_host(F.col("url")), urls.host_key(F.col("url")), urls.path_and_query(F.col("url")))
    assert got == [
        ("a.b", "http://a.b:8080", "/x?y"),
        ("a.b", "https://a.b:", "/x"),
        ("[::1]", "https://[::1]:", "/"),
    ]
