import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagewright.operators import crawl, seeds
from pagewright.schemas import CrawlParams


def random_world(rng, size):
    urls = [f"https://h{rng.randint(0, 1)}.e/{rng.choice('abcx')}{i}{rng.choice(['', '', '', '.pdf'])}" for i in range(size)]
    pages = {u: (rng.choice([200, 200, 200, 200, 404]), rng.choice(["text/HTML", "text/html", "text/html", "image/png"])) for u in urls if rng.random() < 0.9}
    graph = {u: {rng.choice(urls) for _ in range(rng.randint(0, 5))} for u in urls}
    return urls, pages, graph


LEVELS = """
WITH RECURSIVE reached(site_id, url, depth) USING KEY (site_id, url) AS (
    SELECT site_id, start_url, 0 FROM starts
    UNION
    SELECT r.site_id, g.dst, min(r.depth) + 1 FROM reached r JOIN judged j ON j.url = r.url AND j.site_id = r.site_id AND j.reason IS NULL
    JOIN graph g ON g.src = r.url LEFT JOIN recurring.reached k ON k.site_id = r.site_id AND k.url = g.dst
    WHERE k.url IS NULL GROUP BY r.site_id, g.dst
) SELECT r.site_id, r.url, r.depth, j.reason FROM reached r JOIN judged j USING (site_id, url)
"""


@pytest.mark.parametrize("seed, external", [(1, False), (2, True)])
def test_crawl_without_budget_equals_level_sets(spark, seed, external):
    rng = random.Random(seed)
    urls, pages, graph = random_world(rng, 45)
    starts = {f"s{i}": rng.choice(urls) for i in range(5)}
    pairs = [(s, d) for s, ds in graph.items() for d in ds]
    judged = []
    for site, start in starts.items():
        for url in urls:
            status, kind = pages.get(url, (None, ""))
            reasons = {
                "external-host": not external and url[:12] != start[:12],
                "binary-extension": url.endswith(".pdf"),
                "robots-disallow": url.startswith("https://h1.e/x"),
                "fetch-failed": status != 200,
                "non-html": "html" not in kind.lower(),
            }
            judged.append((site, url, next((r for r, holds in reasons.items() if holds), None)))
    tables = duckdb.connect()
    tables.register("starts", pd.DataFrame(list(starts.items()), columns=["site_id", "start_url"]))
    tables.register("graph", pd.DataFrame(pairs, columns=["src", "dst"]))
    tables.register("judged", pd.DataFrame(judged, columns=["site_id", "url", "reason"]))
    want = set(tables.execute(LEVELS).fetchall())
    edges = spark.createDataFrame(pairs, "src string, dst string")
    index = spark.createDataFrame([(u, *p) for u, p in pages.items()], "url string, status int, content_type string")
    robots = spark.createDataFrame(
        [("https://h1.e:", 200, [(1, False, "/x")])],
        "host_key string, robots_status int, robots_rules array<struct<rule_no:int,allow:boolean,path:string>>",
    )
    sites = spark.createDataFrame([*starts.items(), ("bad", "mailto:x")], "site_id string, start_url string")
    params = CrawlParams(max_pages=None, override_hard_cap=True, include_external=external)
    found, skipped = crawl.bfs_discover(sites, edges, index, params, robots)
    got = {(r["site_id"], r["url"], r["depth"], None) for r in found.collect()}
    got |= {(r["site_id"], r["url"], r["depth"], r["reason"]) for r in skipped.collect()}
    assert got - {("bad", "mailto:x", 0, "invalid-start-url")} == want and len(got) == len(want) + 1


def test_crawl_order_and_budget(spark):
    """Pages count in the order of their parents, then by URL; what comes after the last page is not judged."""
    graph = {"": ["b", "a", "z.pdf"], "a": ["d", "b", ""], "b": ["c", "e.pdf"], "d": ["f"], "c": ["g"]}
    at = lambda x: f"https://h.e/{x}"
    edges = spark.createDataFrame([(at(s), at(d)) for s, ds in graph.items() for d in ds], "src string, dst string")
    index = spark.createDataFrame([(at(x), 200, "text/html") for x in ("", *"abcdfg")], "url string, status int, content_type string")
    sites = spark.createDataFrame([("s", at(""))], "site_id string, start_url string")
    for limit, names, skips in [
        (1, ["/"], []), (3, ["/", "a", "b"], []), (4, ["/", "a", "b", "d"], ["z.pdf"]),
        (9, ["/", "a", "b", "d", "c", "f", "g"], ["e.pdf", "z.pdf"]),
    ]:
        found, skipped = crawl.bfs_discover(sites, edges, index, CrawlParams(max_pages=limit))
        rows = found.orderBy("ord").collect()
        assert [r["url"].removeprefix("https://h.e/") or "/" for r in rows] == names and [r["ord"] for r in rows] == list(range(1, len(names) + 1))
        assert sorted(r["url"].removeprefix("https://h.e/") for r in skipped.collect()) == skips


def test_budget_with_one_hot_site(spark):
    rows = spark.range(30000).select(
        F.when(F.col("id") % 3 < 2, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("site_id"),
        F.format_string("https://h/%08d", (F.col("id") * 7919) % 30000).alias("url"),
        F.lit(0).alias("depth"),
    )
    got = seeds.page_budget(rows.repartition(16), 5).collect()
    local = {}
    for r in rows.collect():
        local.setdefault(r["site_id"], []).append(r["url"])
    want = {(s, u) for s, us in local.items() for u in sorted(us)[:5]}
    assert {(r["site_id"], r["url"]) for r in got} == want


def test_budget_does_not_depend_on_partitioning(spark):
    rows = [("s", f"https://h/{c}", 0) for c in "zyxw"]
    frame = spark.createDataFrame(rows, "site_id string, url string, depth int")
    for parts in (1, 3, 7):
        got = seeds.page_budget(frame.repartition(parts), 2).orderBy("url").collect()
        assert [r["url"] for r in got] == ["https://h/w", "https://h/x"]


def test_merge_keeps_existing_depth(spark):
    entries = spark.createDataFrame([("s", "https://h/a", 2)], "site_id string, url string, depth int")
    extra = spark.createDataFrame([("s", "https://h/a"), ("s", "https://h/b"), ("s", "https://h/b")], "site_id string, url string")
    got = {tuple(r) for r in seeds.merge_seeds(entries, extra).collect()}
    assert got == {("s", "https://h/a", 2), ("s", "https://h/b", 0)}


def test_precedence_and_sites_left(spark):
    schema = "site_id string, url string, depth int"
    given = spark.createDataFrame([("a", "u1", 0)], schema)
    probed = spark.createDataFrame([("a", "u2", 0), ("b", "u3", 0)], schema)
    walked = spark.createDataFrame([("a", "u4", 1), ("b", "u5", 1), ("c", "u6", 1)], schema)
    got = {(r["site_id"], r["url"]) for r in seeds.discovery_precedence(given, probed, walked).collect()}
    assert got == {("a", "u1"), ("b", "u3"), ("c", "u6")}
    sites = spark.createDataFrame([("a",), ("b",), ("c",)], "site_id string")
    assert [r["site_id"] for r in seeds.sites_without(sites, given.unionByName(probed)).collect()] == ["c"]


def test_sitemap_entries_and_seed_reasons(spark):
    sites = spark.createDataFrame([("s", "https://h.e/")], "site_id string, start_url string")
    found = spark.createDataFrame([("s", u) for u in ["/a", "https://h.e/a#x", "https://o.e/", "mailto:x", "/f.pdf"]], "site_id string, raw_url string")
    kept, skips = seeds.sitemap_entries(found, sites, CrawlParams())
    assert {r["url"] for r in kept.collect()} == {"https://h.e/a", "https://h.e/f.pdf"}
    assert [tuple(r) for r in skips.collect()] == [("s", "https://o.e/", "external-host")]
    judged = seeds.canonical_seeds(found, sites)
    reasons = judged.select("raw_url", seeds.seed_reason(F.col("url"), F.col("start_host"), CrawlParams()).alias("r")).collect()
    assert {r["raw_url"]: r["r"] for r in reasons} == {
        "/a": None, "https://h.e/a#x": None, "https://o.e/": "external-host", "mailto:x": "invalid-url", "/f.pdf": "binary-extension",
    }


def test_params():
    for bad in ({"max_pages": 0}, {"concurrency": 0}, {"max_pages": 501}):
        with pytest.raises(ValueError):
            CrawlParams(**bad)
    assert CrawlParams(max_pages=501, override_hard_cap=True).max_pages == 501
