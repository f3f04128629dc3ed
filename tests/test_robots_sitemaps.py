import random
import urllib.robotparser

from pagewright.operators import robots as operators
from pagewright.sources import robots, sitemaps
from pagewright.storage import materialize

NAMESPACE = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
LINES = [
    "", "", "User-agent: *", "User-Agent: pagewright", "user-agent: other", "user-agent: Page # x", "Disallow: /a", "Disallow: /",
    "Allow: /a/b", "Disallow:", "Allow:", "crawl-delay: 3", "Disallow: *", "Disallow: /%7Eu?q=1", "Sitemap: x", "  ", "Disallow: /a%2Fc",
    "nonsense", "Allow: /a?x",
]
PATHS = ["/", "/a", "/a/b", "/~u?q=1", "/a/c", "/b", "/a?x=1", "/%41"]


def test_robots_equals_standard_library(spark):
    rng = random.Random(3)
    bodies = [rng.choice(["\n", "\r\n"]).join(rng.choice(LINES) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    files = [(f"https://h{i}.e:", 200, body) for i, body in enumerate(bodies)]
    files += [("https://no.e:", 403, ""), ("https://gone.e:", 404, "User-agent: *\nDisallow: /")]
    hosts = [f"https://h{i}.e" for i in range(300)] + ["https://no.e", "https://gone.e", "https://silent.e"]
    documents = spark.createDataFrame(files, "host_key string, status int, body string")
    urls = spark.createDataFrame([(h + p,) for h in hosts for p in PATHS], "url string")
    by_host = operators.robots_by_host(documents, robots.read_robots(documents), "pagewright/1.0")
    got = {r["url"]: r["allowed"] for r in operators.with_robots_verdict(urls, by_host).collect()}
    assert len(got) == len(hosts) * len(PATHS)
    indexed = operators.with_indexed_verdict(urls, documents, robots.read_robots(documents), "pagewright/1.0")
    assert {r["url"]: r["allowed"] for r in indexed.collect()} == got
    for host, body in zip(hosts, bodies):
        parser = urllib.robotparser.RobotFileParser()
        parser.parse(body.splitlines())
        for path in PATHS:
            assert got[host + path] == parser.can_fetch("pagewright/1.0", host + path), (body, path)
    assert not got["https://no.e/a"] and got["https://gone.e/a"] and got["https://silent.e/a"]


def test_a_file_with_very_many_rules(spark):
    lines = [f"{'Allow' if i % 3 else 'Disallow'}: /{'x' * (i % 7)}{i}" for i in range(100_000)]
    documents = spark.createDataFrame([("https://h.e:", 200, "User-agent: *\n" + "\n".join(lines))], "host_key string, status int, body string")
    urls = [f"https://h.e/{'x' * (i % 7)}{i}/page" for i in range(0, 100_000, 3331)] + ["https://h.e/", "https://o.e/0"]
    rules = robots.read_robots(documents)
    got = {r["url"]: r["allowed"] for r in operators.with_indexed_verdict(spark.createDataFrame([(u,) for u in urls], "url string"), documents, rules, "any").collect()}
    parsed = [(x.split(": ")[1], x[0] == "A") for x in lines]
    want = {u: next((allow for path, allow in parsed if u[11:].startswith(path)), True) if u.startswith("https://h.e") else True for u in urls}
    assert got == want and not all(got.values())


def xml(urls, children):
    if urls:
        return f"<urlset {NAMESPACE}>" + "".join(f"<url><loc> {u}\n</loc></url>" for u in urls) + "</urlset>"
    return f"<sitemapindex {NAMESPACE}>" + "".join(f"<sitemap><loc>{c}</loc></sitemap>" for c in children) + "</sitemapindex>"


EXPANDED = {
    # A leaf is itself; children of children are opened, those of their children are page URLs.
    "leaf": (["p1", "p2"], [], {"p1", "p2"}),
    "index": ([], ["leaf", "other", "leaf"], {"p1", "p2", "p3"}),
    "other": (["p3", "p1"], [], {"p3", "p1"}),
    "two": ([], ["index", "other"], {"p1", "p2", "p3"}),
    "three": ([], ["two"], {"leaf", "other", "p3", "p1"}),
    # Missing and broken children give nothing.
    "holes": ([], ["nowhere", "leaf", "broken"], {"p1", "p2"}),
    # A URL that is the location of the same child or an earlier one is dropped, that of a later one is not.
    "own": (["own", "leaf", "later"], [], {"own", "leaf", "later"}),
    "names": ([], ["leaf", "own", "later"], {"p1", "p2", "later", "p4"}),
    "later": (["p4"], [], {"p4"}),
    "loop": ([], ["loop"], {"loop"}),
}


def test_index_expansion(spark):
    at = lambda x: f"https://m/{x}"
    bodies = [(at(n), xml([at(u) for u in urls], [at(c) for c in children])) for n, (urls, children, _) in EXPANDED.items()]
    documents = spark.createDataFrame([*bodies, (at("broken"), "<urlset><url>")], "location string, body string")
    roots = spark.createDataFrame([(n, at(n)) for n in EXPANDED], "site_id string, location string")
    got = {}
    for row in sitemaps.expand_sitemap_index(roots, documents).collect():
        got.setdefault(row["site_id"], set()).add(row["url"].removeprefix("https://m/"))
    assert {n: got.get(n, set()) for n in EXPANDED if n != "loop"} == {n: want for n, (*_, want) in EXPANDED.items() if n != "loop"}


def test_a_child_of_many_indexes_is_opened_once(spark, monkeypatch):
    """1,000 indexes name the same child: no stored table has a row, or the child's URLs, for each way that leads there."""
    at = lambda x: f"https://m/{x}"
    indexes, pages = [at(f"index{i}") for i in range(1000)], [at(f"page{i}") for i in range(50)]
    bodies = [(at("root"), xml([], indexes)), (at("child"), xml([*pages, at("child"), at("twin"), indexes[3]], []))]
    bodies += [(name, xml([], [at("child"), at("twin")] if i % 2 else [at("twin"), at("child")])) for i, name in enumerate(indexes)]
    documents = spark.createDataFrame(bodies, "location string, body string")
    roots = spark.createDataFrame([("s", at("root")), ("s", at("root"))], "site_id string, location string")
    parsed, sizes = sitemaps.parse_for_expansion(documents), []

    def counted(frame):
        kept = materialize(frame)
        sizes.append(kept.count())
        return kept

    monkeypatch.setattr(sitemaps, "materialize", counted)
    got = {r["url"] for r in sitemaps.expand_parsed(roots, parsed).collect()}
    # The twin passes through odd indexes, where it comes after the child; the fourth index only through earlier ones.
    assert got == {*pages, at("twin"), indexes[3]}
    assert max(sizes) == 3000 and sizes[1:4] == [1, 1000, 2]


def test_documents(spark):
    bodies = [
        ("list", "https://port.test/1\n \n# remark\n https://port.test/2 \n"),
        ("set", f'\ufeff<?xml version="1.0" encoding="UTF-8"?>\n<urlset {NAMESPACE}>\n<url><loc>https://e/</loc></url><url><loc>https://e/d&amp;x</loc></url></urlset>'),
        ("prefixed", '<s:urlset xmlns:s="http://www.sitemaps.org/schemas/sitemap/0.9"><s:url><s:loc>https://e/p</s:loc></s:url></s:urlset>'),
        ("broken", "<urlset><url>"),
        ("typed", f'<?xml version="1.0"?><!-- <!ENTITY is named here --><!DOCTYPE urlset><urlset {NAMESPACE}><url><loc>https://e/t</loc></url></urlset>'),
        ("entity", '<!DOCTYPE x [<!ENTITY a "b">]><urlset><url><loc>&a;</loc></url></urlset>'),
        ("page", "<html><body>not found</body></html>"),
    ]
    frame = spark.createDataFrame(bodies, "location string, body string")
    parsed = {r["location"]: r for r in sitemaps.parse_documents(frame).collect()}
    assert parsed["list"]["urls"] == ["https://port.test/1", "https://port.test/2"]
    assert parsed["typed"]["urls"] == ["https://e/t"]
    assert parsed["set"]["urls"] == ["https://e/", "https://e/d&x"]
    assert parsed["prefixed"]["urls"] == ["https://e/p"]
    assert [n for n, r in parsed.items() if r["unreadable"]] == ["broken", "entity"]
    assert not parsed["page"]["urls"] and not parsed["broken"]["urls"]
    seeds = sitemaps.read_seed_lines(frame.where("location = 'list'")).orderBy("pos").collect()
    assert [r["url"] for r in seeds] == ["https://port.test/1", "# remark", "https://port.test/2"]
    skips = {tuple(r) for r in sitemaps.unreadable_sitemaps(frame).collect()}
    assert skips == {("broken", "sitemap-unreadable"), ("entity", "sitemap-unreadable")}


def test_scan_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("https://e/1\nhttps://e/2\n", encoding="utf-8")
    rows = sitemaps.read_url_list(sitemaps.scan_documents(spark, str(tmp_path))).orderBy("pos").collect()
    assert [r["url"] for r in rows] == ["https://e/1", "https://e/2"]
    literal = sitemaps.seed_literals(spark, "s", "https://e/", ["x"]).orderBy("seq").collect()
    assert [tuple(r) for r in literal] == [("s", 0, "https://e/"), ("s", 1, "x")]
