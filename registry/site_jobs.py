"""Queries of the jobs that need more than one operator, over sites whose options differ."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from pagewright.operators import extract, pacing, robots, sites
from pagewright.plans import jobs
from pagewright.schemas import CrawlParams
from pagewright.sources import fetched as fetched_source
from pagewright.sources import robots as robots_source
from pagewright.storage import delete_at_exit, shared_path
from registry import sql as S
from registry import tables as T
from registry.catalog import IS_BINARY_SQL, IS_HEAVY_SQL, ORACLES, RUN, STRATEGY_SQL, _rich_text, _skips, query, run, stamp

# --- pace ------------------------------------------------------------------------------------------


def paced_robots(spark, sf):
    """The robots files with delays in the groups that speak to us and in one that does not."""
    body = F.replace(F.col("body"), F.lit("Pagewright # us\n"), F.lit("Pagewright # us\nCrawl-delay: 3\nRequest-rate: 2/9\n"))
    body = F.replace(body, F.lit("User-agent: *\nAllow"), F.lit("User-agent: *\nCrawl-delay: 7\nCrawl-delay: 2\nAllow"))
    body = F.replace(body, F.lit("otherbot\n"), F.lit("otherbot\nCrawl-delay: 60\n"))
    return T.robots_files(spark, sf).withColumn("body", body)


@query(
    "crawl_delay",
    f"""WITH {S.ENTRIES}, paced AS (
      SELECT *, CASE WHEN site_id LIKE 'www.%' THEN 2.0 WHEN site_id LIKE 'm.%' THEN 4.5 ELSE 1.5 END::DOUBLE AS delay FROM entries
    ) SELECT site_id, url, depth, delay, coalesce(sum(delay) OVER (PARTITION BY regexp_extract(url, '^[a-z]+://[^/]+') ORDER BY url
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)::DOUBLE AS earliest FROM paced""",
)
def crawl_delay(spark, sf):
    rules = robots_source.read_robots(paced_robots(spark, sf))
    return pacing.crawl_schedule(T.entries(spark, sf), pacing.robots_delays(rules, "pagewright"), F.lit(1.5))


@query("robots_index", f"WITH {S.ENTRIES} SELECT site_id, url, {S.ALLOWED} AS allowed FROM entries")
def robots_index(spark, sf):
    files = T.robots_files(spark, sf)
    entries = T.entries(spark, sf).select("site_id", "url")
    return robots.with_indexed_verdict(entries, files, robots_source.read_robots(files), "Pagewright/1.0")


# --- skips -----------------------------------------------------------------------------------------


@query(
    "skip_reason_rollup",
    f"""SELECT site_id, reason, grouping(site_id, reason)::INT AS level, count(*) AS n FROM ({ORACLES['bfs_skips']})
    GROUP BY GROUPING SETS ((site_id, reason), (site_id), (reason), ())""",
)
def skip_reason_rollup(spark, sf):
    return sites.skip_reason_rollup(_skips(spark, sf))


# --- the site job ----------------------------------------------------------------------------------

JOB = CrawlParams(max_pages=9, deny_patterns=("*/es/*",))


@functools.lru_cache(maxsize=None)
def differing_sites(spark, sf):
    """Sites whose budget, host rule, patterns, probe and regard for robots files depend on their name; NULL: as the run has it."""
    host = F.col("site_id")
    www, mobile, blog = host.startswith("www."), host.startswith("m."), host.startswith("blog.")
    none = F.array().cast("array<string>")
    return T.sites(spark, sf).select(
        "site_id",
        "start_url",
        F.when(www, F.lit(4)).when(mobile, F.lit(2)).alias("max_pages"),
        F.when(mobile, F.lit(True)).alias("include_external"),
        F.when(blog, F.lit(False)).alias("respect_robots"),
        F.when(mobile, F.array(F.lit("*/fr/*"), F.lit("*/[de][a-m]/*"), F.lit("https://other.*"))).when(blog, none).alias("allow_patterns"),
        F.when(blog, F.array(F.lit("*[!a-m]"), F.lit("*/?"))).alias("deny_patterns"),
        (~host.endswith(".net")).alias("probe_sitemap"),
    )


def job_sitemaps(spark, sf):
    """(site_id, location) given for hosts with www, and all documents: of pages, and for probes of the hosts with m and blog."""
    a = T.addresses(spark, sf)
    given = a.where(F.col("site_id").startswith("www.")).select("site_id", T.sitemap_location(F.col("page_id")).alias("location"))
    probed = T.sites(spark, sf).where(F.col("site_id").startswith("m.") | F.col("site_id").startswith("blog."))
    root = F.regexp_extract("start_url", "^([a-z]+://[^/]+)", 1)
    start = F.replace(F.col("start_url"), F.lit("&"), F.lit("&amp;"))
    foreign = F.lit("</loc></url><url><loc>https://other.example/a</loc></url></urlset>")
    body = F.when(F.col("site_id").startswith("m."), F.concat(F.lit("<urlset><url><loc>"), start, foreign)).otherwise(F.lit("<urlset><url>"))
    probes = probed.select(F.concat(root, F.lit("/sitemap.xml")).alias("location"), body.alias("body"))
    # Indexes would list documents of other sites, so only plain sitemaps are given here.
    plain = T.sitemap_documents(spark, sf).where(~F.col("body").contains("<sitemapindex"))
    return given, plain.unionByName(probes)


def job(spark, sf):
    files = T.robots_files(spark, sf)
    by_host = robots.robots_by_host(files, robots_source.read_robots(files), "pagewright")
    given, documents = job_sitemaps(spark, sf)
    return jobs.site_job(
        differing_sites(spark, sf), given, documents, T.outcomes(spark, sf), JOB, "page_id", robots=by_host, extracted_at=stamp(), lazy_pages=True
    )


ALLOWED_HERE = f"(site_id LIKE 'blog.%' OR {S.ALLOWED})"
SITE_REASON = f"""CASE WHEN site_id NOT LIKE 'm.%' AND {S.host('url')} <> site_id THEN 'external-host'
  WHEN {IS_BINARY_SQL} THEN 'binary-extension' WHEN {IS_HEAVY_SQL} THEN 'query-heavy'
  WHEN site_id LIKE 'blog.%' THEN CASE WHEN regexp_matches(url, '[^a-m]$') OR regexp_matches(url, '/.$') THEN 'deny-pattern' END
  WHEN url LIKE '%/es/%' THEN 'deny-pattern'
  WHEN site_id LIKE 'm.%' AND NOT (url LIKE '%/fr/%' OR regexp_matches(url, '/[de][a-m]/') OR url LIKE 'https://other.%') THEN 'allow-pattern-miss' END"""

SITE_JOB = f"""WITH RECURSIVE {S.LINKS}, sites AS (
  SELECT site_id, arg_min(canon, page_id) AS start_url FROM base GROUP BY site_id
), idx AS (SELECT canon AS url, min(page_id) AS page_id FROM base GROUP BY canon),
budgets AS (SELECT site_id, start_url, CASE WHEN site_id LIKE 'www.%' THEN 4 WHEN site_id LIKE 'm.%' THEN 2 ELSE 9 END AS budget FROM sites),
listed AS (
  SELECT DISTINCT site_id, canon AS url FROM base WHERE site_id LIKE 'www.%' AND page_id % 2 = 0
  UNION SELECT DISTINCT b.site_id, link FROM base b JOIN links USING (page_id) WHERE b.site_id LIKE 'www.%' AND page_id % 2 = 0
  UNION SELECT site_id, unnest([start_url, 'https://other.example/a']) FROM sites WHERE site_id LIKE 'm.%' AND site_id NOT LIKE '%.net'
), walked AS (SELECT site_id, start_url, 0 AS depth FROM sites WHERE site_id NOT IN (SELECT site_id FROM listed)),
verdicts AS (
  SELECT site_id, url, coalesce({SITE_REASON}, CASE WHEN NOT {ALLOWED_HERE} THEN 'robots-disallow'
    WHEN page_id IS NULL OR page_id % 11 = 0 THEN 'fetch-failed' WHEN page_id % 13 = 0 THEN 'non-html' END) AS reason
  FROM (SELECT DISTINCT w.site_id, u.url FROM walked w JOIN (
          SELECT {S.host('canon')} AS h, link AS url FROM links UNION SELECT site_id, start_url FROM sites) u ON u.h = w.site_id)
    LEFT JOIN idx USING (url)
), reached(site_id, url, depth, reason) USING KEY (site_id, url) AS (
  SELECT w.site_id, w.start_url AS url, 0 AS depth, v.reason FROM walked w JOIN verdicts v ON v.site_id = w.site_id AND v.url = w.start_url
  UNION
  SELECT r.site_id, l.link, min(r.depth) + 1, any_value(v.reason) FROM reached r JOIN links l ON l.canon = r.url
    JOIN verdicts v ON v.site_id = r.site_id AND v.url = l.link
    LEFT JOIN recurring.reached k ON k.site_id = r.site_id AND k.url = l.link
  WHERE r.reason IS NULL AND k.url IS NULL GROUP BY r.site_id, l.link
), entries AS (
  SELECT site_id, url, 0 AS depth FROM listed UNION ALL SELECT site_id, url, depth FROM reached WHERE reason IS NULL
), first AS (
  SELECT e.*, budget FROM entries e JOIN budgets USING (site_id) QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY url) <= budget
), starts AS (SELECT site_id, url, budget, {SITE_REASON} AS reason FROM (SELECT site_id, start_url AS url, budget FROM budgets)),
merged AS (
  SELECT * FROM first UNION ALL
  SELECT site_id, url, 0, budget FROM starts WHERE reason IS NULL AND (site_id, url) NOT IN (SELECT (site_id, url) FROM first)
), visit AS (
  SELECT *, CASE WHEN {S.host('url')} = 'other.example' THEN true ELSE {ALLOWED_HERE} END AS allowed FROM merged
  QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY url) <= budget
), located AS (SELECT v.*, page_id FROM visit v LEFT JOIN idx USING (url)),
told AS (
  SELECT site_id, url, depth, NULL AS reason FROM visit WHERE allowed
  UNION ALL SELECT site_id, url, NULL, reason FROM reached WHERE reason IS NOT NULL
  UNION ALL SELECT site_id, url, NULL, reason FROM starts WHERE reason IS NOT NULL
  UNION ALL SELECT site_id, url, NULL, CASE WHEN NOT allowed THEN 'robots-disallow' WHEN page_id IS NULL THEN 'fetch-error: not fetched'
      WHEN page_id % 11 = 0 THEN 'fetch-error: status 404' ELSE 'non-html-content-type: application/pdf' END
    FROM located WHERE NOT allowed OR page_id IS NULL OR page_id % 11 = 0 OR page_id % 13 = 0
) SELECT site_id, url, depth::INT AS depth, reason, count(*) AS n FROM told GROUP BY ALL"""


@query("site_job", SITE_JOB)
def site_job(spark, sf):
    """Entries to visit with their depth, and every skip with its reason, of sites of all three kinds of discovery."""
    result = job(spark, sf)
    entries = result.sitemap.select("site_id", "url", "depth", F.lit(None).cast("string").alias("reason"))
    skips = result.skipped.select("site_id", "url", F.lit(None).cast("int").alias("depth"), "reason")
    return entries.unionByName(skips).groupBy("site_id", "url", "depth", "reason").agg(F.count("*").alias("n"))


# --- stored pages ----------------------------------------------------------------------------------


@query("stored_page_lookup", ORACLES["page_lookup"])
def stored_page_lookup(spark, sf):
    """Write the page table for lookups and look up one page in it."""
    path = shared_path(spark)
    fetched_source.write_page_table(T.fetched(spark, sf), path)
    delete_at_exit(spark, path)
    wanted = T.fetched(spark, sf).agg(F.max_by("url", "page_id").alias("u")).first()["u"]
    found = fetched_source.page_lookup(spark.read.parquet(path), wanted)
    return found.select("page_id", "canonical_url", F.length("html").alias("html_chars"))


START = 1767225600  # 2026-01-01, UTC


@query(
    "cache_ttl",
    # Minutes of the day: every page was fetched once, every third page twice. Asked at minute 60, for 40 minutes.
    f"""WITH {S.BASE}, cached AS (
      SELECT canon AS url, page_id, page_id % 100 AS minute FROM base UNION ALL SELECT canon, page_id, page_id * 7 % 100 FROM base WHERE page_id % 3 = 0
    ), newest AS (
      SELECT * FROM cached WHERE minute <= 60 QUALIFY row_number() OVER (PARTITION BY url ORDER BY minute DESC, page_id DESC) = 1
    ) SELECT url, CASE WHEN n.url IS NULL THEN 'miss' WHEN minute < 20 THEN 'expired' ELSE 'hit' END AS state, minute, n.page_id
    FROM (SELECT DISTINCT canon AS url FROM base) w LEFT JOIN newest n USING (url)""",
)
def cache_ttl(spark, sf):
    light = T.addresses(spark, sf).select(F.col("canon").alias("url"), "page_id")
    minutes = F.when(F.col("page_id") % 3 == 0, F.array(F.col("page_id") % 100, F.col("page_id") * 7 % 100)).otherwise(F.array(F.col("page_id") % 100))
    cached = light.withColumn("minute", F.explode(minutes))
    cached = cached.select("url", F.timestamp_seconds(F.lit(START) + F.col("minute") * 60).alias("fetched_at"), "page_id")
    state = fetched_source.cache_state(light.select("url").distinct(), cached, F.timestamp_seconds(F.lit(START + 3600)), 2400)
    minute = ((F.unix_timestamp("fetched_at") - START) / 60).cast("long").alias("minute")
    return state.select("url", "state", minute, "page_id")


# --- strategies and dumps --------------------------------------------------------------------------


def strategy_table(spark):
    """The six strategies and a seventh as rows."""
    rows = [(i, *s) for i, s in enumerate((*extract.STRATEGIES, extract.Strategy("tables_and_links", tables=True, links=True)))]
    return spark.createDataFrame(rows, "ord int, name string, recall boolean, tables boolean, links boolean, comments boolean")


@query(
    "strategy_rows",
    f"{STRATEGY_SQL} UNION ALL SELECT page_id, 'tables_and_links' AS strategy, {_rich_text('art', tables=True, with_links=True)} AS text FROM cut",
)
def strategy_rows(spark, sf):
    parts = extract.with_page_parts(T.rich_pages(spark, sf).select("page_id", "html"))
    each = extract.texts_of_strategies(F.col("segments"), extract.strategy_array(strategy_table(spark)))
    return parts.select("page_id", F.inline(each))


@query("write_dump_parts", ORACLES["write_dump"])
def write_dump_parts(spark, sf):
    """Write the Markdown dumps of all sites into parts of bounded size and read back the size of each dump."""
    result = run(spark, sf)
    chunks = sites.site_chunks("md", result.sites, result.sitemap, result.pages, result.skipped, RUN)
    path = shared_path(spark)
    sites.write_dump_parts(chunks, result.sites, path, "md", part_bytes=100_000)
    delete_at_exit(spark, path)
    pieces = sites.read_dump_parts(spark, path)
    lines = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))
    return pieces.groupBy("dump").agg(F.sum(lines).cast("long").alias("lines"), F.sum(F.length("content")).alias("chars"))
