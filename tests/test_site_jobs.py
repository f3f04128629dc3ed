"""Schedules, options per site, deep crawls, cache ages, stored pages, streams that stop, dumps in parts."""

import datetime
import fnmatch
import glob
import os
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pagewright.operators import crawl, extract, options, pacing, prefix, robots, seeds, sites
from pagewright.plans import jobs
from pagewright.schemas import CrawlParams
from pagewright.sources import fetched as fetched_source
from pagewright.sources.robots import read_robots
from pagewright.storage import checkpoint_dir, shared_path
from pagewright.streaming import ingest

# --- running sums and schedules ----------------------------------------------------------------------


def test_running_total_of_a_large_group(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.6 else rng.choice([None, "a", "b"]), f"k{rng.randint(0, 300)}", i, rng.randint(0, 9)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "g string, k string, i int, n int")
    got = prefix.running_total(frame, ["g"], ["k", "i"], F.col("n"), "total").collect()
    sums, want = {}, {}
    for g, _, i, n in sorted(rows, key=lambda r: (r[1], r[2])):
        want[i] = sums.get(g, 0)
        sums[g] = want[i] + n
    assert {r["i"]: r["total"] for r in got} == want and len(got) == len(rows)
    whole = prefix.running_total(frame, [], ["i"], F.col("n"), "total").collect()
    assert {r["i"]: r["total"] for r in whole} == {i: sum(r[3] for r in rows[:i]) for i in range(len(rows))}
    assert prefix.running_total(frame.where("false"), ["g"], ["k"], F.col("n"), "total").count() == 0


def test_delays_of_robots_files(spark):
    files = [
        ("http://a:", "User-agent: *\nCrawl-delay: 9\n\nUser-agent: ours\nCrawl-delay: 2\nCrawl-delay: x\nCrawl-delay: 3\nRequest-rate: 1/10"),
        ("http://b:", "User-agent: *\nCrawl-delay: 0.5\nRequest-rate: 4/2 "),
        ("http://c:", "User-agent: other\nCrawl-delay: 50"),
        ("http://d:", "User-agent: *\nDisallow: /x\nRequest-rate: 0/5\nCrawl-delay: 7"),
    ]
    rules = read_robots(spark.createDataFrame(files, "host_key string, body string"))
    delays = pacing.robots_delays(rules, "Ours/2.0")
    assert {r["host_key"]: (r["crawl_delay"], r["request_gap"]) for r in delays.collect()} == {
        "http://a:": (3.0, 10.0), "http://b:": (None, 0.5), "http://d:": (7.0, None),
    }
    urls = [("s", f"http://{h}/{i:04d}") for h, n in (("a", 40), ("b", 500), ("c", 3), ("d", 2)) for i in range(n)]
    paced = pacing.crawl_schedule(spark.createDataFrame(urls, "site_id string, url string"), delays, F.lit(1.0)).collect()
    step = {"a": 10.0, "b": 1.0, "c": 1.0, "d": 7.0}
    assert {r["url"]: (r["delay"], r["earliest"]) for r in paced} == {u: (step[u[7]], int(u[9:]) * step[u[7]]) for _, u in urls}


# --- options -----------------------------------------------------------------------------------------


def test_options_fall_back_to_the_run(spark):
    rows = [("a", 3, None, None, ["*x*"]), ("b", None, True, [], None), ("c", 100_000, None, None, None), ("d", 0, None, None, None)]
    table = spark.createDataFrame(rows, "site_id string, max_pages int, include_external boolean, allow_patterns array<string>, deny_patterns array<string>")
    made = {r["site_id"]: r["options"] for r in options.site_options(table, CrawlParams(max_pages=7, deny_patterns=("*y",))).collect()}
    assert [made[s]["max_pages"] for s in "abcd"] == [3, 7, 500, 7]
    assert (made["a"]["deny_patterns"], made["b"]["deny_patterns"], made["b"]["include_external"]) == (["*x*"], ["*y"], True)
    assert all(o["query_filter"] and o["probe_sitemap"] and not o["allow_patterns"] for o in made.values())
    open_run = options.site_options(table, CrawlParams(max_pages=None, override_hard_cap=True))
    assert {r["site_id"]: r["options"]["max_pages"] for r in open_run.collect()} == {"a": 3, "b": 2**31 - 1, "c": 100_000, "d": 2**31 - 1}


def test_reasons_follow_the_patterns_of_the_site(spark):
    urls = ["http://h/a/en/1.html", "http://h/b?x=1", "http://h/[c]", "http://h/file.pdf", "http://h/q?a&b&c&d&e", "http://o/a"]
    sites_of = {"s": ([], ["*/[a-b]*"], False), "t": (["*/en/*", "*[[]c]"], [], True), "u": (["http://?/*"], ["*?x=1"], True)}
    rows = [(s, u, allow, deny, heavy) for s, (allow, deny, heavy) in sites_of.items() for u in urls]
    frame = spark.createDataFrame(rows, "site_id string, url string, allow_patterns array<string>, deny_patterns array<string>, query_filter boolean")
    given = options.site_options(frame.drop("url").distinct(), CrawlParams())
    judged = frame.select("site_id", "url").join(given, "site_id").select("site_id", "url", F.coalesce(options.external_reason(F.col("url"), F.lit("h")), options.url_reason(F.col("url"))).alias("reason"))

    def want(site, url):
        allow, deny, heavy = sites_of[site]
        hit = lambda patterns: any(fnmatch.fnmatchcase(url, p) for p in patterns)
        return (
            "external-host" if "//o/" in url else "binary-extension" if url.endswith(".pdf") else "query-heavy" if heavy and "&" in url
            else "deny-pattern" if hit(deny) else "allow-pattern-miss" if allow and not hit(allow) else None
        )

    assert {(r["site_id"], r["url"]): r["reason"] for r in judged.collect()} == {(s, u): want(s, u) for s in sites_of for u in urls}


def test_every_site_has_its_own_budget(spark):
    entries = spark.createDataFrame([(s, f"u{i:03d}", 0) for s in "abc" for i in range(100)], "site_id string, url string, depth int")
    given = options.site_options(spark.createDataFrame([("a", 1), ("b", 60), ("c", None)], "site_id string, max_pages int"), CrawlParams(max_pages=5))
    kept = seeds.page_budget(entries, 5, given).collect()
    assert {s: sorted(r["url"] for r in kept if r["site_id"] == s)[-1] for s in "abc"} == {"a": "u000", "b": "u059", "c": "u004"}
    assert len(kept) == 66


# --- crawl -------------------------------------------------------------------------------------------


def graph(spark, n):
    pages = spark.createDataFrame([(f"http://h/{i:03d}", 404 if i % 7 == 6 else 200, "text/html") for i in range(n)], "url string, status int, content_type string")
    links = [(i, j) for i in range(n) for j in (i + 1, i + 2, max(0, i - 1)) if j < n]
    edges = spark.createDataFrame([(f"http://h/{i:03d}", f"http://h/{j:03d}") for i, j in links], "src string, dst string")
    return pages, edges


@pytest.mark.parametrize("limit", [None, 25])
def test_deep_crawl_keeps_few_runs(spark, monkeypatch, limit):
    monkeypatch.setattr(crawl, "FAN", 3)
    pages, edges = graph(spark, 60)
    start = spark.createDataFrame([("s", "http://h/000")], "site_id string, start_url string")
    params = CrawlParams(max_pages=limit, override_hard_cap=True, respect_robots=False)
    before = set(glob.glob(f"{checkpoint_dir(spark)}/pagewright/*"))
    found, skips = crawl.bfs_discover(start, edges, pages, params)
    got, away = {r["url"]: r["depth"] for r in found.collect()}, {r["url"]: r["reason"] for r in skips.collect()}
    depth, order, queue, bad = {0: 0}, [], [0], set()
    while queue and (limit is None or len(order) < limit):
        i = queue.pop(0)
        if i % 7 == 6:
            bad.add(i)
            continue
        order.append(i)
        for j in sorted({i + 1, i + 2, max(0, i - 1)} - {i}):
            if j < 60 and j not in depth:
                depth[j] = depth[i] + 1
                queue.append(j)
    assert got == {f"http://h/{i:03d}": depth[i] for i in order}
    assert away == {f"http://h/{i:03d}": "fetch-failed" for i in bad}
    # About 30 levels are 2 runs of 9 levels and more, and 2 of each smaller size at most; their parts are gone.
    scans = found._jdf.queryExecution().optimizedPlan().toString().count("Relation")
    left = set(glob.glob(f"{checkpoint_dir(spark)}/pagewright/*")) - before
    assert scans <= 14 and sum(bool(glob.glob(f"{x}/*.parquet")) for x in left) <= 24


def test_sites_that_differ_crawl_like_alone(spark):
    pages, edges = graph(spark, 30)
    rows = [("a", "http://h/000", 4, None, True), ("b", "http://h/010", None, ["*/01[3-9]"], True), ("c", "http://h/021", 500, ["*5"], False), ("d", "nothing", 1, None, True)]
    kinds = "site_id string, start_url string, max_pages int, deny_patterns array<string>, respect_robots boolean"
    files = spark.createDataFrame([("http://h:", 200, "User-agent: *\nDisallow: /02")], "host_key string, status int, body string")
    rules = robots.robots_by_host(files, read_robots(files), "x")
    together, skips = crawl.bfs_discover(spark.createDataFrame(rows, kinds), edges, pages, CrawlParams(max_pages=6), rules)
    got = {(r["site_id"], r["url"], r["depth"], r["ord"]) for r in together.collect()}
    away = {(r["site_id"], r["url"], r["reason"]) for r in skips.collect()}
    want, want_away = set(), set()
    for site, start, pages_of, deny, heed in rows:
        params = CrawlParams(max_pages=pages_of or 6, deny_patterns=tuple(deny or ()), respect_robots=heed)
        alone = spark.createDataFrame([(site, start)], "site_id string, start_url string")
        found, skipped = crawl.bfs_discover(alone, edges, pages, params, rules)
        want |= {(r["site_id"], r["url"], r["depth"], r["ord"]) for r in found.collect()}
        want_away |= {(r["site_id"], r["url"], r["reason"]) for r in skipped.collect()}
    assert (got, away) == (want, want_away) and len(got) > 12


def test_site_job_of_three_kinds(spark):
    page = "<html><body><article><p>{}</p><a href='/next'>n</a></article></body></html>"
    fetched = fetched_source.from_pages(
        spark.createDataFrame([(i, f"http://{h}/{p}", page.format(p * 30)) for i, (h, p) in enumerate([(h, p) for h in "gpwx" for p in ("", "next", "other")])], "page_id long, url string, html string")
    )
    start = spark.createDataFrame([(h, f"http://{h}/", h != "x", 2 if h == "g" else None) for h in "gpwx"], "site_id string, start_url string, probe_sitemap boolean, max_pages int")
    given = spark.createDataFrame([("g", "maps://g")], "site_id string, location string")
    listing = lambda h: f"<urlset><url><loc>http://{h}/other</loc></url><url><loc>http://{h}/missing</loc></url><url><loc>http://else/</loc></url></urlset>"
    documents = spark.createDataFrame([("maps://g", listing("g")), *[(f"http://{h}/sitemap.xml", listing(h)) for h in "gpx"]], "location string, body string")
    run = jobs.site_job(start, given, documents, fetched, CrawlParams(), "page_id")
    assert {(r["site_id"], r["url"], r["depth"]) for r in run.sitemap.collect()} == {
        # The start URL sorts first, so the budget of two leaves out the last of three.
        ("g", "http://g/", 0), ("g", "http://g/missing", 0),
        ("p", "http://p/", 0), ("p", "http://p/missing", 0), ("p", "http://p/other", 0),
        ("w", "http://w/", 0), ("w", "http://w/next", 1), ("x", "http://x/", 0), ("x", "http://x/next", 1),
    }
    assert sorted((r["site_id"], r["url"], r["reason"]) for r in run.skipped.collect()) == [
        ("g", "http://else/", "external-host"), ("g", "http://g/missing", "fetch-error: not fetched"),
        ("p", "http://else/", "external-host"), ("p", "http://p/missing", "fetch-error: not fetched"),
    ]
    assert run.pages.count() == 7


# --- caches and stored pages ---------------------------------------------------------------------------


def test_cache_answers_by_age(spark):
    t = lambda minute: datetime.datetime(2026, 1, 1, 10, minute)
    cached = [("a", t(5), 1), ("a", t(30), 2), ("a", t(50), 3), ("b", t(9), 4), ("c", t(10), 5), ("d", t(41), 6), ("e", t(40), 7), ("e", t(40), 8), (None, t(1), 9)]
    frame = spark.createDataFrame(cached, "url string, fetched_at timestamp, row int")
    wanted = spark.createDataFrame([(x, i) for i, x in enumerate("abcdef")] + [(None, 9)], "url string, asked int")
    got = fetched_source.cache_state(wanted, frame, F.lit(t(40)), 1800).collect()
    assert {r["url"]: (r["state"], r["row"]) for r in got} == {
        "a": ("hit", 2), "b": ("expired", 4), "c": ("hit", 5), "d": ("miss", None), "e": ("hit", 8), "f": ("miss", None), None: ("miss", None),
    }


def test_lookups_read_one_row_group(spark):
    rows = [(i, f"http://h{i % 7}.example/{i}", "x" * 300 + str(i)) for i in range(4000)]
    path = shared_path(spark)
    fetched_source.write_page_table(fetched_source.from_pages(spark.createDataFrame(rows, "page_id long, url string, html string")), path, 60_000)
    found = fetched_source.page_lookup(spark.read.parquet(path), "HTTP://h3.example/x/../10")
    assert [r["page_id"] for r in found.collect()] == [10]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(canonical_url), EqualTo(canonical_url,http://h3.example/10)]" in plan
    groups, holding = 0, 0
    for name in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        column = next(i for i in range(meta.num_columns) if meta.schema.column(i).name == "canonical_url")
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(column).statistics
            groups, holding = groups + 1, holding + (stats.min <= "http://h3.example/10" <= stats.max)
    assert groups >= 8 and holding == 1


# --- streams -----------------------------------------------------------------------------------------

STREAMED = "url string, fetched_url string, status int, content_type string, html string, fetched_at timestamp"


def arrivals(*rows):
    page = "<html><body><p>{}</p></body></html>"
    return [(u, u, 200, "text/html", page.format(text), datetime.datetime(2026, 1, 1, 12, minute)) for u, minute, text in rows]


def test_a_stopped_stream_leaves_every_page_once(spark, monkeypatch):
    folder = shared_path(spark)
    source, out, state = f"{folder}/in", f"{folder}/out", f"{folder}/state"
    put = lambda rows: spark.createDataFrame(rows, STREAMED).coalesce(1).write.mode("append").parquet(source)
    read = lambda: spark.readStream.schema(STREAMED).option("maxFilesPerTrigger", 1).parquet(source)
    newest = lambda: {r["canonical_url"]: r["text"] for r in ingest.current_pages(spark, out, "fetched_at").collect()}
    put(arrivals(("http://h/a", 1, "first a"), ("http://H/a", 5, "second a"), ("http://h/b", 2, "first b")))
    whole = ingest.write_batch

    def stops(*arguments):
        whole(*arguments)
        raise RuntimeError("stopped behind the write")

    monkeypatch.setattr(ingest, "write_batch", stops)
    with pytest.raises(Exception, match="stopped behind the write"):
        ingest.store_pages(read(), out, state, "fetched_at").awaitTermination()
    monkeypatch.setattr(ingest, "write_batch", whole)
    ingest.store_pages(read(), out, state, "fetched_at").awaitTermination()
    assert newest() == {"http://h/a": "second a", "http://h/b": "first b"}
    assert ingest.current_pages(spark, out, "fetched_at").count() == 2
    # A newer copy replaces, a late one does not, an equal time is won by the later batch.
    put(arrivals(("http://h/b", 30, "newer b"), ("http://h/a", 3, "late a"), ("http://h/c", 9, "c")))
    ingest.store_pages(read(), out, state, "fetched_at").awaitTermination()
    put(arrivals(("http://h/c", 9, "c again"), ("mailto:x", 9, "none")))
    ingest.store_pages(read(), out, state, "fetched_at").awaitTermination()
    assert newest() == {"http://h/a": "second a", "http://h/b": "newer b", "http://h/c": "c again"}
    assert sorted(os.listdir(out)) == ["batch=0", "batch=1", "batch=2"]


# --- strategies and dumps ------------------------------------------------------------------------------


def test_strategies_as_rows_equal_strategies_as_columns(spark):
    html = [
        (1, "<article><table><tr><td>T</td></tr></table><p>x <a href='/l'>L</a></p><div class='comments'>C</div></article><nav>n</nav>"),
        (2, "<div>a<table><tr><td>b</td></tr></table></div><footer>f</footer>"), (3, None), (4, ""),
    ]
    parts = extract.with_page_parts(spark.createDataFrame(html, "page_id int, html string"))
    every = [extract.Strategy(f"{r}{t}{a}{c}", r, t, a, c) for r in (False, True) for t in (False, True) for a in (False, True) for c in (False, True)]
    table = spark.createDataFrame([(i, *s) for i, s in enumerate(every)], "ord int, name string, recall boolean, tables boolean, links boolean, comments boolean")
    made = parts.select(
        extract.texts_of_strategies(F.col("segments"), extract.strategy_array(table)).alias("rows"),
        *[extract.strategy_text("segments", s).alias(s.name) for s in every],
    )
    for row in made.collect():
        assert [(r["strategy"], r["text"]) for r in row["rows"]] == [(s.name, row[s.name]) for s in every]


@pytest.mark.parametrize("part_bytes", [1, 700, 1 << 20])
def test_dump_parts_hold_every_dump(spark, part_bytes):
    names = [("a", "http://a/", "z"), ("b", "http://b/", "z"), ("b2", "http://b/", "z"), ("c", "http://c/", "z")]
    site = spark.createDataFrame(names, "site_id string, start_url string, finished_at string")
    rows = [(s, 0, "", f"head {s}") for s in "abc"] + [("b2", 0, "", "only")]
    rows += [("b", 1, f"{i:04d}", f"zeile ü {i}" + "\nmehr" * (i % 3)) for i in range(300)] + [("c", 2, "x", "y" * 900)]
    chunks = spark.createDataFrame(rows, "site_id string, section int, position string, chunk string").repartition(6)
    path = shared_path(spark)
    sites.write_dump_parts(chunks, site, path, "md", part_bytes)
    pieces = sorted((r["dump"], r["part"], r["content"]) for r in sites.read_dump_parts(spark, path).collect())
    got = {}
    for dump, _, content in pieces:
        got[dump] = got.get(dump, "") + content
    named = {r["site_id"]: r["dump"] for r in sites.dump_names(site, "md").collect()}
    whole = {named[r["site_id"]]: r["content"] for r in sites.assemble(chunks).collect()}
    assert got == whole and len(set(named.values())) == 4
    size = sum(len(x.encode()) for x in whole.values())
    files = glob.glob(f"{path}/parts/*/*.txt")
    assert len(files) <= min(len(rows), size // part_bytes + 1)
    assert all(os.path.getsize(f) < part_bytes + 1000 for f in files)
