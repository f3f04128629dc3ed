"""Every operator as a query over the given tables, with the SQL that gives the same rows."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import fixed, text, urls
from pagewright.operators import api, crawl, extract, links, render, robots, seeds, sites
from pagewright.plans import jobs
from pagewright.schemas import CrawlParams
from pagewright.storage import delete_at_exit, shared_path
from pagewright.sources import fetched as fetched_source
from pagewright.sources import robots as robots_source
from pagewright.sources import sitemaps
from registry import sql as S
from registry import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PATTERNS_DENY = ["*.example.net/[!e]?/*", "*casino*"]
PATTERNS_ALLOW = ["http*://*.example.???/*", "*/en/*.html"]
BUDGET = 3
MIN_CHARS = fixed.MIN_TEXT_CHARS


def query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def stamp() -> F.Column:
    return F.lit(T.STAMP)


def joined(items, separator: str = ",") -> F.Column:
    return F.array_join(items, separator)


# --- sources ---------------------------------------------------------------------------------------


@query(
    "scan_fetched",
    "SELECT page_id, url AS requested_url, url AS fetched_url, 200 AS status, 'text/html' AS content_type, "
    "length(html) AS html_chars FROM pages",
)
def scan_fetched(spark, sf):
    """The adapter writes fetched rows, the scan reads them with the columns of its own schema and the row key."""
    path = f"{shared_path(spark)}/fetched"
    T.fetched(spark, sf).write.parquet(path)
    delete_at_exit(spark, path)
    return fetched_source.scan_fetched(spark, path, others="page_id long").select(
        "page_id",
        F.col("url").alias("requested_url"),
        "fetched_url",
        "status",
        "content_type",
        F.length("html").alias("html_chars"),
    )


@query(
    "page_lookup",
    f"WITH {S.BASE} SELECT page_id, canon AS canonical_url, length(html) AS html_chars FROM base "
    f"WHERE canon = (SELECT arg_max(canon, page_id) FROM base)",
)
def page_lookup(spark, sf):
    pages = T.fetched(spark, sf)
    wanted = pages.agg(F.max_by("url", "page_id").alias("u")).first()["u"]
    found = fetched_source.page_lookup(pages, wanted)
    return found.select("page_id", "canonical_url", F.length("html").alias("html_chars"))


LIST_ITEMS = f"""WITH {S.LINKS}, items AS (
  SELECT page_id, url AS item, 0 AS part, '' AS ord FROM pages
  UNION ALL SELECT page_id, link, 1, link FROM links
  UNION ALL SELECT page_id, '#x', 2, link FROM links
)"""


@query(
    "read_url_list",
    f"""{LIST_ITEMS} SELECT 'https://maps.example/' || page_id || '.xml' AS location,
    (row_number() OVER (PARTITION BY page_id ORDER BY part, ord) - 1)::INT AS pos, item AS url
    FROM items WHERE part < 2""",
)
def read_url_list(spark, sf):
    return sitemaps.read_url_list(T.list_documents(spark, sf))


@query(
    "read_seed_lines",
    f"""{LIST_ITEMS} SELECT 'https://maps.example/' || page_id || '.xml' AS location, item AS url, count(*) AS n
    FROM (SELECT page_id, item FROM items WHERE part < 2
          UNION ALL SELECT page_id, '# list' FROM pages
          UNION ALL SELECT page_id, '#x' FROM (
            SELECT page_id, row_number() OVER (PARTITION BY page_id) AS n FROM links) WHERE n > 1)
    GROUP BY ALL""",
)
def read_seed_lines(spark, sf):
    lines = sitemaps.read_seed_lines(T.list_documents(spark, sf))
    return lines.groupBy("location", "url").agg(F.count(F.lit(1)).alias("n"))


@query(
    "seed_literals",
    f"""WITH {S.SITES} SELECT site_id, 0 AS seq, start_url AS raw_url FROM sites
    UNION ALL SELECT site_id, (page_id + 1)::INT, url FROM base""",
)
def seed_literals(spark, sf):
    flags = T.addresses(spark, sf).select("site_id", F.col("page_id").alias("seq"), "url")
    return sitemaps.seed_rows(T.sites(spark, sf), flags)


SITEMAP_URLS = f"""WITH {S.LINKS}, listed AS (
  SELECT page_id, canon AS url, 0 AS part FROM base WHERE page_id % 2 = 0
  UNION ALL SELECT page_id, link, 1 FROM links WHERE page_id % 2 = 0
)"""
INDEX_URLS = """SELECT page_id, 2 * page_id + 1 AS child, 0 AS pos FROM pages WHERE page_id % 2 = 1
  UNION ALL SELECT page_id, 2 * page_id + 2, 1 FROM pages WHERE page_id % 2 = 1
  UNION ALL SELECT page_id, page_id, 2 FROM pages WHERE page_id % 2 = 1
  UNION ALL SELECT page_id, -page_id, 3 FROM pages WHERE page_id % 2 = 1"""
LOCATION = "'https://maps.example/' || page_id || '.xml'"


@query(
    "read_sitemap_xml",
    f"""{SITEMAP_URLS} SELECT {LOCATION} AS location,
    (row_number() OVER (PARTITION BY page_id ORDER BY part, url) - 1)::INT AS pos, url FROM listed""",
)
def read_sitemap_xml(spark, sf):
    return sitemaps.read_sitemap_xml(T.sitemap_documents(spark, sf))


@query(
    "read_sitemap_index",
    f"""{SITEMAP_URLS} SELECT {LOCATION} AS location,
    (row_number() OVER (PARTITION BY page_id ORDER BY part, url) - 1)::INT AS pos, url FROM listed
    UNION ALL SELECT {LOCATION}, pos, 'https://maps.example/' || child || '.xml' FROM ({INDEX_URLS})""",
)
def read_sitemap_index(spark, sf):
    return sitemaps.read_sitemap_index(T.sitemap_documents(spark, sf))


@query(
    "expand_sitemap_index",
    # Roots are the sitemaps of each host's first page. Even documents list URLs, odd ones list
    # children; below two levels of indexes a child location counts as a URL, unless the index that
    # called it had listed that location at the same or an earlier place.
    f"""{SITEMAP_URLS}, idx AS ({INDEX_URLS}), roots AS (
      SELECT site_id, min(page_id) AS page_id FROM base GROUP BY site_id
    ), c1 AS (
      SELECT site_id, r.page_id AS r0, i.child AS c, i.pos AS p1 FROM roots r JOIN idx i USING (page_id)
    ), c2 AS (
      SELECT site_id, r0, p1, c1.c AS r1, i.child AS c, i.pos AS p2 FROM c1 JOIN idx i ON i.page_id = c1.c
    ), last AS (
      SELECT c2.site_id, 'https://maps.example/' || i.child || '.xml' AS url, r0, p1, r1, p2, i.child
      FROM c2 JOIN idx i ON i.page_id = c2.c
    )
    SELECT site_id, url FROM roots JOIN listed USING (page_id)
    UNION SELECT site_id, url FROM c1 JOIN listed ON listed.page_id = c1.c
    UNION SELECT site_id, url FROM c2 JOIN listed ON listed.page_id = c2.c
    UNION SELECT site_id, url FROM last
      WHERE NOT EXISTS (SELECT 1 FROM idx WHERE idx.page_id = last.r1 AND idx.child = last.child AND idx.pos <= last.p2)
        AND NOT EXISTS (SELECT 1 FROM idx WHERE idx.page_id = last.r0 AND idx.child = last.child AND idx.pos <= last.p1)""",
)
def expand_sitemap_index(spark, sf):
    documents = T.sitemap_documents(spark, sf)
    first = T.addresses(spark, sf).groupBy("site_id").agg(F.min("page_id").alias("page_id"))
    roots = first.select("site_id", T.sitemap_location(F.col("page_id")).alias("location"))
    return sitemaps.expand_sitemap_index(roots, documents)


@query(
    "sitemap_dispatch",
    f"""WITH {S.LINKS}, n AS (SELECT page_id, count(*) AS n FROM links GROUP BY page_id)
    SELECT {LOCATION} AS location, true AS is_xml,
      (CASE WHEN page_id % 2 = 0 THEN 1 + coalesce(n, 0) ELSE 0 END)::INT AS urls,
      (CASE WHEN page_id % 2 = 1 THEN 4 ELSE 0 END)::INT AS children, false AS unreadable
    FROM base LEFT JOIN n USING (page_id)
    UNION ALL
    SELECT {LOCATION} || '.txt', false, (1 + coalesce(n, 0))::INT, 0, false FROM base LEFT JOIN n USING (page_id)
    UNION ALL SELECT {LOCATION} || '.html', true, 0, 0, true FROM base""",
)
def sitemap_dispatch(spark, sf):
    lists = T.list_documents(spark, sf).withColumn("location", F.concat("location", F.lit(".txt")))
    cut = T.pages(spark, sf).select(
        F.concat(T.sitemap_location(F.col("page_id")), F.lit(".html")).alias("location"),
        F.col("html").alias("body"),
    )
    documents = T.sitemap_documents(spark, sf).unionByName(lists).unionByName(cut)
    kinds = documents.select("location", sitemaps.is_xml(F.col("body")).alias("is_xml"), "body")
    return sitemaps.parse_documents(kinds).select(
        "location", "is_xml", F.size("urls").alias("urls"), F.size("children").alias("children"), "unreadable"
    )


@query(
    "read_robots",
    f"""WITH {S.BASE}, keys AS (
      SELECT DISTINCT site_id, regexp_extract(canon, '^([a-z]+://[^/]+)', 1) || ':' AS host_key FROM base)
    SELECT host_key, 1 AS group_no, 1 AS rule_no, '*' AS agents, 'disallow' AS field, '/' AS path FROM keys WHERE site_id LIKE 'm.%'
    UNION ALL SELECT host_key, 2, 4, 'pagewright', 'disallow', '/en/' FROM keys WHERE site_id LIKE 'm.%'
    UNION ALL SELECT host_key, 2, 5, 'pagewright', 'allow', '/' FROM keys WHERE site_id LIKE 'm.%'
    UNION ALL SELECT host_key, 1, 1, 'otherbot', 'disallow', '/' FROM keys WHERE site_id LIKE 'www.%'
    UNION ALL SELECT host_key, 2, 4, '*', 'allow', '/fr/' FROM keys WHERE site_id LIKE 'www.%'
    UNION ALL SELECT host_key, 2, 5, '*', 'disallow', '/fr/' FROM keys WHERE site_id LIKE 'www.%'
    UNION ALL SELECT host_key, 2, 6, '*', 'disallow', '/de/' FROM keys WHERE site_id LIKE 'www.%'""",
)
def read_robots(spark, sf):
    rules = robots_source.read_robots(T.robots_files(spark, sf))
    return rules.withColumn("agents", joined("agents"))


@query(
    "read_api_payload",
    """SELECT 'api-' || p_partkey AS subdomain, CASE WHEN p_size % 2 = 0 THEN p_name END AS name,
      'https://api.example/' || p_partkey AS production, p_brand AS first_group, 1 AS groups
    FROM part WHERE p_partkey % 5 <> 4""",
)
def read_api_payload(spark, sf):
    payload = api.read_api_payloads(T.api_documents(spark, sf))
    return payload.select(
        "subdomain",
        "payload.name",
        F.col("payload.urls")["production"].alias("production"),
        F.col("payload.resourceGroups")[0]["name"].alias("first_group"),
        F.size("payload.resourceGroups").alias("groups"),
    )


# --- URL functions ---------------------------------------------------------------------------------


@query(
    "canonicalize_url",
    f"""WITH {S.BASE} SELECT url, canon AS canonical_url FROM base
    UNION ALL SELECT upper(regexp_extract(url, '^([a-z]+://[^/]+)', 1)) || ':' ||
        CASE WHEN url LIKE 'https%' THEN '443' ELSE '80' END || '//a/./b/../' ||
        regexp_extract(url, '^[a-z]+://[^/]+/(.*)', 1), {S.canon("regexp_replace(url, '^([a-z]+://[^/]+)/', '\\1/a/')")} FROM pages
    UNION ALL SELECT regexp_extract(url, '^[a-z]+://(.*)', 1), '' FROM pages""",
)
def canonicalize_url(spark, sf):
    light = T.pages(spark, sf).select("url")
    port = F.when(F.col("url").startswith("https"), F.lit(":443")).otherwise(F.lit(":80"))
    place = F.upper(F.regexp_extract("url", "^([a-z]+://[^/]+)", 1))
    rest = F.regexp_extract("url", "^[a-z]+://[^/]+/(.*)", 1)
    noisy = light.select(F.concat(place, port, F.lit("//a/./b/../"), rest).alias("url"))
    bare = light.select(F.regexp_extract("url", "^[a-z]+://(.*)", 1).alias("url"))
    variants = light.unionByName(noisy).unionByName(bare)
    return variants.select("url", urls.canonicalize_url("url").alias("canonical_url"))


@query("resolve_url", f"WITH {S.HREFS} SELECT page_id, href, {S.ROOT} || href AS resolved FROM hrefs")
def resolve_url(spark, sf):
    return T.hrefs(spark, sf).select(
        "page_id", "href", urls.resolve_url("href", "url").alias("resolved")
    )


@query("url_host", f"SELECT url, {S.host('url')} AS host FROM pages")
def url_host(spark, sf):
    return T.pages(spark, sf).select("url", urls.url_host("url").alias("host"))


# URLs with an extension of each kind: page URLs, links, and files named after the part types.
SHAPED_URLS = f"""WITH {S.LINKS}, shaped AS (
  SELECT url FROM pages
  UNION ALL SELECT link FROM links
  UNION ALL SELECT regexp_extract(url, '^([^?#]*)', 1) || '.PdF?x=1.zip' FROM pages
  UNION ALL SELECT regexp_extract(url, '^([a-z]+://[^/]+)', 1) || '/.gz' FROM pages
  UNION ALL SELECT regexp_extract(url, '^([^?#]*)', 1) || '?a=1&b=2&&c=3&d=' || page_id FROM pages
  UNION ALL SELECT url || 'long?q=' || repeat('x', (60 + page_id % 40)::INT) FROM pages
)"""


@functools.lru_cache(maxsize=None)
def shaped_urls(spark, sf):
    pages = T.pages(spark, sf).select("page_id", "url")
    head = F.regexp_extract("url", "^([^?#]*)", 1)
    root = F.regexp_extract("url", "^([a-z]+://[^/]+)", 1)
    real = T.hrefs(spark, sf).select(urls.resolve_url("href", "url").alias("url"), "page_id").distinct()
    made = pages.select(
        F.explode(
            F.array(
                "url",
                F.concat(head, F.lit(".PdF?x=1.zip")),
                F.concat(root, F.lit("/.gz")),
                F.concat(head, F.lit("?a=1&b=2&&c=3&d="), F.col("page_id").cast("string")),
                F.concat(F.col("url"), F.lit("long?q="), F.repeat(F.lit("x"), (60 + F.col("page_id") % 40).cast("int"))),
            )
        ).alias("url")
    )
    return real.select("url").unionByName(made)


IS_BINARY_SQL = "regexp_matches(url, '(?i)^[^?#]*/[^/?#]*[^/?#.][^/?#]*\\.(pdf|gz|zip|jpg|png)([?#]|$)')"
IS_HEAVY_SQL = (
    "(len(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda q: q <> '')) > 3 "
    "OR length(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)) > 80)"
)


@query("is_binary_url", f"{SHAPED_URLS} SELECT url, {IS_BINARY_SQL} AS is_binary FROM shaped")
def is_binary_url(spark, sf):
    return shaped_urls(spark, sf).select("url", urls.is_binary_url(F.col("url")).alias("is_binary"))


@query("is_query_heavy", f"{SHAPED_URLS} SELECT url, {IS_HEAVY_SQL} AS is_heavy FROM shaped")
def is_query_heavy(spark, sf):
    return shaped_urls(spark, sf).select("url", urls.is_query_heavy(F.col("url")).alias("is_heavy"))


DENY_SQL = "(regexp_matches(url, '^.*\\.example\\.net/[^e]./.*$') OR url LIKE '%casino%')"
ALLOW_SQL = "(regexp_matches(url, '^http.*://.*\\.example\\..../.*$') OR regexp_matches(url, '^.*/en/.*\\.html$'))"


@query("glob_match", f"{SHAPED_URLS} SELECT url, {DENY_SQL} AS denied, {ALLOW_SQL} AS allowed FROM shaped")
def glob_match(spark, sf):
    return shaped_urls(spark, sf).select(
        "url",
        urls.glob_match(F.col("url"), PATTERNS_DENY).alias("denied"),
        urls.glob_match(F.col("url"), PATTERNS_ALLOW).alias("allowed"),
    )


@query(
    "skip_reason",
    f"""{SHAPED_URLS} SELECT url, CASE WHEN {IS_BINARY_SQL} THEN 'binary-extension' WHEN {IS_HEAVY_SQL} THEN 'query-heavy'
    WHEN {DENY_SQL} THEN 'deny-pattern' WHEN NOT {ALLOW_SQL} THEN 'allow-pattern-miss' END AS reason FROM shaped""",
)
def skip_reason(spark, sf):
    reason = urls.skip_reason("url", True, PATTERNS_ALLOW, PATTERNS_DENY)
    return shaped_urls(spark, sf).select("url", reason.alias("reason"))


SLUG_SQL = (
    "rtrim(left(trim(regexp_replace(regexp_replace(lower(url), 'https?://', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-'), 80), '-')"
)


@query("slugify", f"{SHAPED_URLS} SELECT url, {SLUG_SQL} AS slug FROM shaped")
def slugify(spark, sf):
    return shaped_urls(spark, sf).select("url", text.slugify(F.col("url")).alias("slug"))


@query(
    "dump_filename",
    f"""SELECT url, {SLUG_SQL} || '.md' AS page_file,
    'site_' || replace({S.host('url')}, '.', '-') || '_20260101T000000Z.xml' AS site_file FROM pages""",
)
def dump_filename(spark, sf):
    site = text.site_filename(urls.url_host("url"), stamp(), "xml")
    return T.pages(spark, sf).select(
        "url", text.page_filename(F.col("url"), "markdown").alias("page_file"), site.alias("site_file")
    )


@query(
    "utc_now_iso",
    "SELECT page_id, strftime(TIMESTAMP '2024-02-28 23:59:58' + to_seconds(page_id * 61), '%Y-%m-%dT%H:%M:%SZ') AS extracted_at, "
    "true AS now_is_between FROM pages",
)
def utc_now_iso(spark, sf):
    """The format on times that depend on the page, and whether the time of the run lies between two clocks."""
    before = spark.range(1).select(F.current_timestamp().alias("t")).first()["t"]
    start = F.unix_timestamp(F.lit("2024-02-28 23:59:58"))
    given = F.timestamp_seconds(start + F.col("page_id") * 61)
    now = F.to_timestamp(text.utc_now_iso(), "yyyy-MM-dd'T'HH:mm:ssX")
    between = (F.lit(before) - F.expr("INTERVAL 1 SECOND") <= now) & (now <= F.current_timestamp())
    return T.pages(spark, sf).select("page_id", text.utc_iso(given).alias("extracted_at"), between.alias("now_is_between"))


# --- filters ---------------------------------------------------------------------------------------

# Seeds of every page: its own URL, a foreign one, a binary one, a mail address and a new page.
SEEDS_SQL = f"""WITH {S.SITES}, seeds AS (
  SELECT site_id, regexp_replace(url, '^http', 'HTTP') AS raw_url, canon AS url FROM base
  UNION ALL SELECT site_id, 'https://other.example/' || page_id, 'https://other.example/' || page_id FROM base
  UNION ALL SELECT b.site_id, '/files/' || page_id || '.PDF', regexp_extract(start_url, '^([a-z]+://[^/]+)', 1) || '/files/' || page_id || '.PDF'
    FROM base b JOIN sites s USING (site_id)
  UNION ALL SELECT site_id, 'mailto:p' || page_id, '' FROM base
  UNION ALL SELECT b.site_id, '/new/./' || page_id || '//?z=1&a=2',
    regexp_extract(start_url, '^([a-z]+://[^/]+)', 1) || '/new/' || page_id || '?a=2&z=1' FROM base b JOIN sites s USING (site_id)
), judged AS (
  SELECT *, CASE WHEN url = '' THEN 'invalid-url' WHEN {S.host('url')} <> site_id THEN 'external-host'
    WHEN url LIKE '%.PDF' THEN 'binary-extension' END AS reason FROM seeds
)"""


@functools.lru_cache(maxsize=None)
def judged_seeds(spark, sf):
    frame = seeds.canonical_seeds(T.seed_rows(spark, sf), T.sites(spark, sf))
    return frame.withColumn("reason", seeds.seed_reason(F.col("url"), F.col("start_host"), CrawlParams()))


@query("filter_invalid_url", f"{SEEDS_SQL} SELECT site_id, raw_url, url FROM judged WHERE url <> ''")
def filter_invalid_url(spark, sf):
    return judged_seeds(spark, sf).where("url <> ''").select("site_id", "raw_url", "url")


@query(
    "filter_external_host",
    f"{SEEDS_SQL} SELECT site_id, url, CASE WHEN {S.host('url')} <> site_id THEN 'external-host' END AS reason FROM judged WHERE url <> ''",
)
def filter_external_host(spark, sf):
    frame = seeds.canonical_seeds(T.seed_rows(spark, sf), T.sites(spark, sf)).where("url <> ''")
    return frame.select(
        "site_id", "url", seeds.external_reason(F.col("url"), F.col("start_host"), CrawlParams()).alias("reason")
    )


@query(
    "filter_non_html",
    "SELECT page_id, url, CASE WHEN page_id % 11 = 0 THEN 'fetch-error: status 404' WHEN page_id % 13 = 0 THEN 'non-html-content-type: application/pdf' END AS reason "
    "FROM pages",
)
def filter_non_html(spark, sf):
    judged = T.outcomes(spark, sf)
    return judged.select("page_id", "url", jobs.extraction_reason().alias("reason"))


@query(
    "filter_fetch_failed",
    "SELECT page_id, url, page_id % 11 = 0 AS failed, "
    "CASE WHEN page_id % 11 = 0 THEN 'fetch-error: status 404' END AS reason FROM pages",
)
def filter_fetch_failed(spark, sf):
    failed = fetched_source.fetch_failed(F.col("status"), F.col("html").isNotNull())
    reason = F.when(failed, jobs.extraction_reason())
    return T.outcomes(spark, sf).select("page_id", "url", failed.alias("failed"), reason.alias("reason"))


@query(
    "split_result",
    """SELECT CASE WHEN page_id % 11 = 0 THEN 'fetch-error: status 404'
      WHEN page_id % 13 = 0 THEN 'non-html-content-type: application/pdf' ELSE 'page' END AS route, url
    FROM pages""",
)
def split_result(spark, sf):
    judged = T.outcomes(spark, sf).withColumn("reason", jobs.extraction_reason()).withColumn("site_id", F.lit(""))
    kept, skips = seeds.split_by_reason(judged)
    return kept.select(F.lit("page").alias("route"), "url").unionByName(
        skips.select(F.col("reason").alias("route"), "url")
    )


# --- link graph ------------------------------------------------------------------------------------


@query(
    "extract_links",
    f"""WITH {S.LINKS} SELECT page_id, coalesce(string_agg(link, ' ' ORDER BY link), '') AS links, count(link) AS n
    FROM base LEFT JOIN links USING (page_id) GROUP BY page_id""",
)
def extract_links(spark, sf):
    linked = links.with_links(T.fetched(spark, sf))
    return linked.select("page_id", joined("links", " ").alias("links"), F.size("links").cast("bigint").alias("n"))


@query("link_edges", f"WITH {S.LINKS} SELECT canon AS src, link AS dst FROM links")
def link_edges(spark, sf):
    linked = fetched_source.with_canonical_url(links.with_links(T.fetched(spark, sf)))
    return links.link_edges(linked, "canonical_url")


# The recursion ends by itself: a row is a page at its first depth, and USING KEY keeps one row per page.
REACHED = f"""WITH RECURSIVE {S.EDGES}, reached(site_id, url, depth) USING KEY (site_id, url) AS (
  SELECT site_id, start_url AS url, 0 AS depth FROM sites
  UNION
  SELECT r.site_id, e.dst, min(r.depth) + 1 FROM reached r JOIN edges e ON e.src = r.url
  LEFT JOIN recurring.reached k ON k.site_id = r.site_id AND k.url = e.dst
  WHERE k.url IS NULL GROUP BY r.site_id, e.dst
)"""

OPEN = CrawlParams(max_pages=None, override_hard_cap=True, include_external=True, respect_robots=False)


@query(
    "bfs_discover",
    f"""{REACHED} SELECT site_id, url, min(depth)::INT AS depth FROM reached
    WHERE url IN (SELECT canon FROM base) GROUP BY site_id, url""",
)
def bfs_discover(spark, sf):
    found, _ = crawl.bfs_discover(T.sites(spark, sf), T.edges(spark, sf), T.page_index(spark, sf), OPEN)
    return found.select("site_id", "url", "depth")


CLOSED = CrawlParams(max_pages=None, override_hard_cap=True, respect_robots=True)
VERDICT = f"""CASE WHEN {S.host('url')} <> site_id THEN 'external-host'
  WHEN {IS_BINARY_SQL} THEN 'binary-extension'
  WHEN NOT ({S.ALLOWED}) THEN 'robots-disallow'
  WHEN page_id IS NULL OR page_id % 11 = 0 THEN 'fetch-failed'
  WHEN page_id % 13 = 0 THEN 'non-html' END"""


@query(
    "bfs_skips",
    f"""WITH RECURSIVE {S.EDGES}, idx AS (SELECT canon AS url, min(page_id) AS page_id FROM base GROUP BY canon),
    verdicts AS (
      SELECT site_id, url, {VERDICT} AS reason FROM
        (SELECT s.site_id, u.url, idx.page_id FROM sites s CROSS JOIN (SELECT DISTINCT dst AS url FROM edges UNION SELECT start_url FROM sites) u
         LEFT JOIN idx ON idx.url = u.url
         WHERE {S.host('u.url')} = s.site_id OR u.url IN (SELECT url FROM idx))
    ), reached AS (
      SELECT s.site_id, start_url AS url, v.reason FROM sites s JOIN verdicts v ON v.site_id = s.site_id AND v.url = s.start_url
      UNION
      SELECT r.site_id, e.dst, v.reason FROM reached r JOIN edges e ON e.src = r.url
        JOIN verdicts v ON v.site_id = r.site_id AND v.url = e.dst
      WHERE r.reason IS NULL
    ) SELECT site_id, url, reason FROM reached WHERE reason IS NOT NULL""",
)
def bfs_skips(spark, sf):
    return _skips(spark, sf).select("site_id", "url", "reason")


@query("skip_reason_counts", f"SELECT site_id, reason, count(*) AS n FROM ({ORACLES['bfs_skips']}) GROUP BY ALL")
def skip_reason_counts(spark, sf):
    return sites.skip_reason_counts(_skips(spark, sf))


@query(
    "cache_resume",
    # Newer rows have higher numbers; every seventh page was written in an earlier dump.
    f"""WITH {S.BASE}, newest AS (SELECT canon, max(page_id) AS page_id FROM base GROUP BY canon)
    SELECT page_id, canon AS url FROM newest
    WHERE canon NOT IN (SELECT canon FROM base WHERE page_id % 7 = 0)""",
)
def cache_resume(spark, sf):
    pages = fetched_source.with_canonical_url(T.fetched(spark, sf)).drop("html", "url")
    pages = pages.withColumnRenamed("canonical_url", "url").where("url <> ''")
    written = pages.where("page_id % 7 = 0").select("url")
    return fetched_source.still_to_write(pages, written, "page_id").select("page_id", "url")


def _skips(spark, sf):
    files = T.robots_files(spark, sf)
    by_host = robots.robots_by_host(files, robots_source.read_robots(files), "pagewright")
    _, skips = crawl.bfs_discover(
        T.sites(spark, sf), T.edges(spark, sf), T.page_index(spark, sf, failing=True), CLOSED, by_host
    )
    return skips


FEW = 5


@query(
    "bfs_budget",
    # The queue order is the order of (depth, URLs on the way to the page). Every level before a page's own has a page ahead
    # of it in the queue, so the first n pages of any graph are at most n - 1 links deep; deeper ways are not needed.
    f"""WITH RECURSIVE {S.EDGES}, ways AS (
      SELECT site_id, start_url AS url, 0 AS depth, [start_url] AS way FROM sites
      UNION ALL
      SELECT w.site_id, e.dst, w.depth + 1, list_append(w.way, e.dst) FROM ways w JOIN edges e ON e.src = w.url
      WHERE w.depth < {FEW - 1} AND e.dst IN (SELECT canon FROM base) AND NOT list_contains(w.way, e.dst)
    ), firsts AS (
      SELECT site_id, url, depth, way FROM ways
      QUALIFY row_number() OVER (PARTITION BY site_id, url ORDER BY depth, way) = 1
    ), ranked AS (
      SELECT site_id, url, depth::INT AS depth, (row_number() OVER (PARTITION BY site_id ORDER BY depth, way))::INT AS ord FROM firsts
    ) SELECT * FROM ranked WHERE ord <= {FEW}""",
)
def bfs_budget(spark, sf):
    params = CrawlParams(max_pages=FEW, include_external=True, respect_robots=False)
    found, _ = crawl.bfs_discover(T.sites(spark, sf), T.edges(spark, sf), T.page_index(spark, sf), params)
    return found


# Sitemap entries of the hosts that have a page in French, link discovery for the others.
FRENCH = "SELECT site_id FROM base WHERE canon LIKE '%/fr/%'"


def french_entries(spark, sf):
    return T.entries(spark, sf).where(F.col("url").contains("/fr/"))


@query(
    "discovery_precedence",
    f"""WITH {S.ENTRIES}, probed AS (SELECT site_id, url, depth FROM entries WHERE url LIKE '%/fr/%')
    SELECT * FROM probed UNION ALL SELECT * FROM entries WHERE site_id NOT IN (SELECT site_id FROM probed)""",
)
def discovery_precedence(spark, sf):
    given = T.entries(spark, sf).where(F.col("url").contains("/no-such-language/"))
    return seeds.discovery_precedence(given, french_entries(spark, sf), T.entries(spark, sf))


@query(
    "merge_seeds",
    f"""{SEEDS_SQL}, entries AS (SELECT site_id, canon AS url, (min(page_id) % 3 + 1)::INT AS depth FROM base GROUP BY site_id, canon),
    french AS (SELECT * FROM entries WHERE url LIKE '%/fr/%')
    SELECT * FROM french
    UNION ALL SELECT DISTINCT site_id, url, 0 FROM judged WHERE reason IS NULL AND (site_id, url) NOT IN (SELECT (site_id, url) FROM french)""",
)
def merge_seeds(spark, sf):
    wanted, _ = seeds.split_by_reason(judged_seeds(spark, sf))
    return seeds.merge_seeds(french_entries(spark, sf), wanted)


# --- joins -----------------------------------------------------------------------------------------


@functools.lru_cache(maxsize=None)
def robots_verdicts(spark, sf, entries):
    files = T.robots_files(spark, sf)
    by_host = robots.robots_by_host(files, robots_source.read_robots(files), "Pagewright/1.0")
    return robots.with_robots_verdict(entries, by_host)


@query("robots_filter", f"WITH {S.ENTRIES} SELECT site_id, url, {S.ALLOWED} AS allowed FROM entries")
def robots_filter(spark, sf):
    return robots_verdicts(spark, sf, T.entries(spark, sf).drop("depth"))


VISIT_SQL = f"""{SEEDS_SQL}, idx AS (SELECT canon AS url, min(page_id) AS page_id FROM base GROUP BY canon),
visit AS (SELECT DISTINCT site_id, url FROM judged WHERE reason IS NULL)"""


@query(
    "fetch_join",
    f"""{VISIT_SQL} SELECT site_id, url, page_id, CASE WHEN page_id IS NULL THEN 'fetch-failed'
      WHEN page_id % 11 = 0 THEN 'fetch-failed' END AS reason FROM visit LEFT JOIN idx USING (url)""",
)
def fetch_join(spark, sf):
    wanted, _ = seeds.split_by_reason(judged_seeds(spark, sf))
    located = jobs.fetch_join(wanted.select("site_id", "url").distinct(), T.page_index(spark, sf, failing=True))
    failed = fetched_source.fetch_failed(F.col("status"), F.lit(True))
    return located.select("site_id", "url", "page_id", F.when(failed, F.lit(fixed.FETCH_FAILED)).alias("reason"))


@query(
    "frontier_anti_join",
    f"""WITH {S.EDGES} SELECT DISTINCT b.site_id, e.dst AS url FROM edges e JOIN base b ON b.canon = e.src
    WHERE (b.site_id, e.dst) NOT IN (SELECT (site_id, canon) FROM base)""",
)
def frontier_anti_join(spark, sf):
    known = T.entries(spark, sf).select("site_id", "url")
    edges = T.edges(spark, sf).join(known.withColumnRenamed("url", "src"), "src")
    children = edges.select("site_id", F.col("dst").alias("url")).distinct()
    return crawl.frontier_anti_join(children, known)


@query(
    "depth_lookup",
    f"""WITH {S.ENTRIES}, final AS (SELECT site_id, url FROM entries WHERE {S.ALLOWED})
    SELECT site_id, url, depth FROM final JOIN entries USING (site_id, url)""",
)
def depth_lookup(spark, sf):
    final = robots_verdicts(spark, sf, T.entries(spark, sf).drop("depth")).where("allowed").drop("allowed")
    return final.join(T.entries(spark, sf), ["site_id", "url"])


@query(
    "meta_backfill",
    f"WITH {S.docs()} SELECT page_id, title, subtitle, author, language FROM docs",
)
def meta_backfill(spark, sf):
    return docs(spark, sf).select("page_id", "title", "subtitle", "author", "language")


# --- text and extraction ---------------------------------------------------------------------------


@functools.lru_cache(maxsize=None)
def docs(spark, sf, **options):
    return extract.build_page_docs(T.described(T.fetched(spark, sf)), extracted_at=stamp(), **options)


def attempts_text(attempts) -> F.Column:
    return joined(
        F.transform(
            attempts,
            lambda a: F.concat_ws(":", a["strategy"], a["text_len"].cast("string"), a["success"].cast("string")),
        )
    )


@query("normalize_text", f"SELECT doc_id, {S.normalize('text')} AS text FROM documents")
def normalize_text(spark, sf):
    return T.documents(spark, sf).select("doc_id", text.normalize_text(F.col("text")).alias("text"))


TOKENS_SQL = f"""WITH p AS (
  SELECT page_id, replace(html, '<article>', {list(T.TEMPLATES)}[page_id % 4 + 1] || '<article>') AS html FROM pages
), t AS (
  SELECT page_id, regexp_extract_all(html, '(?is)<!--.*?-->|<!doctype[^>]*>|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|</?[a-z][^>]*>|[^<]+|<') AS tokens
  FROM p
), e AS (SELECT page_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS pos FROM t),
k AS (
  SELECT page_id, pos::INT AS pos, token,
    CASE WHEN regexp_matches(token, '^</[a-zA-Z]') THEN 'close' WHEN regexp_matches(token, '(?i)^<(script|style)') THEN 'raw'
         WHEN regexp_matches(token, '^<[a-zA-Z]') THEN 'open' ELSE 'text' END AS kind,
    lower(regexp_extract(token, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS name
  FROM e
), s AS (
  SELECT *, sum(CASE WHEN name NOT IN ('script', 'style', 'template') THEN 0 WHEN kind = 'open' THEN 1 WHEN kind = 'close' THEN -1 ELSE 0 END)
    OVER (PARTITION BY page_id ORDER BY pos) AS level FROM k
), d AS (SELECT *, least(0, min(level) OVER (PARTITION BY page_id ORDER BY pos)) AS lowest FROM s)
SELECT page_id, pos, kind, name, CASE WHEN regexp_matches(token, '^</?[a-zA-Z]') THEN '' ELSE token END AS text,
  (level - lowest)::INT AS skip_depth
FROM d WHERE NOT regexp_matches(token, '^<!')"""


@query("html_tokens", TOKENS_SQL)
def html_tokens(spark, sf):
    return extract.html_tokens(T.templated_pages(spark, sf), "page_id")


@query("html_to_text", f"SELECT page_id, {S.text_of('html')} AS text FROM pages")
def html_to_text(spark, sf):
    return T.pages(spark, sf).select("page_id", extract.html_to_text("html").alias("text"))


_RICH = r"""rich AS (
  SELECT page_id, replace(html, '<article>', '<article><table><tr><td>T' || page_id || '</td></tr></table><div class="post comments"><div>C' || page_id ||
    '</div>more</div><p>see <a href="/l' || page_id || '&amp;x">L</a></p>') AS html FROM pages
), cut AS (SELECT page_id, regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1) AS art,
  regexp_replace(html, '(?is)<title>[^<]*</title>|<nav>.*?</nav>|<footer>.*?(?:</footer>|$)', ' ' || chr(10) || ' ', 'g') AS rest FROM rich)"""
_TABLE = r"'<table>.*?</table>'"
_COMMENT = r"'<div class=\"post comments\"><div>[^<]*</div>more</div>'"
_LINKED = r"regexp_replace({}, '<a href=\"([^\"]*)\">([^<]*)</a>', '\2 (\1) ', 'g')"


def _rich_text(html_sql: str, tables: bool = False, comments: bool = False, with_links: bool = False) -> str:
    if not tables:
        html_sql = f"regexp_replace({html_sql}, {_TABLE}, ' ' || chr(10) || ' ')"
    if not comments:
        html_sql = f"regexp_replace({html_sql}, {_COMMENT}, ' ' || chr(10) || ' ')"
    return S.text_of(_LINKED.format(html_sql) if with_links else html_sql)


RICH_TEXTS = [
    ("default", _rich_text("art")),
    ("favor_recall", _rich_text("rest")),
    ("include_tables", _rich_text("art", tables=True)),
    ("include_links", _rich_text("art", with_links=True)),
    ("include_comments", _rich_text("art", comments=True)),
    ("relaxed_combo", _rich_text("rest", True, True, True)),
]
STRATEGY_SQL = f"WITH {_RICH} " + " UNION ALL ".join(
    f"SELECT page_id, '{name}' AS strategy, {expression} AS text FROM cut" for name, expression in RICH_TEXTS
)


@query("strategy_texts", STRATEGY_SQL)
def strategy_texts(spark, sf):
    parts = extract.with_page_parts(T.rich_pages(spark, sf).select("page_id", "html"))
    each = F.array(
        *[
            F.struct(F.lit(s.name).alias("strategy"), extract.strategy_text("segments", s).alias("text"))
            for s in extract.STRATEGIES
        ]
    )
    return parts.select("page_id", F.inline(each))


@query(
    "strategy_cross",
    f"""WITH {_RICH}, listed AS (SELECT page_id, 'T' || page_id AS t, 'C' || page_id AS c FROM cut)
    SELECT page_id, strategy, tables, comments, links FROM listed CROSS JOIN (VALUES
      ('default', false, false, false), ('favor_recall', false, false, false), ('include_tables', true, false, false),
      ('include_links', false, false, true), ('include_comments', false, true, false), ('relaxed_combo', true, true, true)
    ) s(strategy, tables, comments, links)""",
)
def strategy_cross(spark, sf):
    # The strategies are a fixed list of columns, so no cross join is needed: each page row yields one
    # row per strategy, with what the strategy's flags let through.
    number = F.col("page_id").cast("string")
    return strategy_texts(spark, sf).select(
        "page_id",
        "strategy",
        F.regexp_like("text", F.concat(F.lit("(?m)^T"), number, F.lit("$"))).alias("tables"),
        F.regexp_like("text", F.concat(F.lit("(?m)^C"), number, F.lit("$"))).alias("comments"),
        F.col("text").contains(F.concat(F.lit("(/l"), number, F.lit("&x)"))).alias("links"),
    )


@functools.lru_cache(maxsize=None)
def tried(spark, sf, min_chars=MIN_CHARS):
    return extract.page_candidates(T.described(T.fetched(spark, sf)), min_chars)


def exploded(frame):
    return frame.select("page_id", F.posexplode("tried").alias("turn", "candidate"))


@query(
    "strategy_ladder",
    f"WITH {S.candidates(900)} SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY turn) - 1)::INT AS turn, "
    "strategy, text FROM tried",
)
def strategy_ladder(spark, sf):
    return exploded(tried(spark, sf, 900)).select("page_id", "turn", "candidate.strategy", "candidate.text")


@query("bare_metadata", f"WITH {S.texts()} SELECT page_id, title, subtitle, author, date_published, lang AS language, t_recall AS text FROM texts")
def bare_metadata(spark, sf):
    candidate = F.get(F.filter("tried", lambda c: c["strategy"] == fixed.METADATA_CANDIDATE), F.lit(0))
    fields = ("title", "subtitle", "author", "date_published", "language", "text")
    return tried(spark, sf).select("page_id", *[candidate[name].alias(name) for name in fields])


@query("attempt_log", f"WITH {S.docs(900)} SELECT page_id, attempts FROM docs")
def attempt_log(spark, sf):
    return tried(spark, sf, 900).select("page_id", attempts_text(extract.attempt_log("tried")).alias("attempts"))


@query(
    "repetition_penalty",
    f"""SELECT 'd' || doc_id AS id, {S.penalty('text')} AS penalty FROM documents
    UNION ALL SELECT 'p' || page_id, {S.penalty('text')} FROM (SELECT page_id, {S.text_of('html')} AS text FROM pages)""",
)
def repetition_penalty(spark, sf):
    documents = T.documents(spark, sf).select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    pages = html_to_text(spark, sf).select(F.concat(F.lit("p"), "page_id").alias("id"), "text")
    return documents.unionByName(pages).select("id", text.repetition_penalty(F.col("text")).alias("penalty"))


@query("candidate_score", f"WITH {S.candidates(900)} SELECT page_id, strategy, score::INT AS score FROM scored")
def candidate_score(spark, sf):
    c = F.col("candidate")
    return exploded(tried(spark, sf, 900)).select(
        "page_id", c["strategy"].alias("strategy"), text.candidate_score(c["text"], c["title"]).alias("score")
    )


@query("best_candidate", f"WITH {S.candidates(900)} SELECT page_id, strategy, text FROM best")
def best_candidate(spark, sf):
    best = tried(spark, sf, 900).select("page_id", extract.best_candidate("tried").alias("best"))
    return best.where("best is not null").select("page_id", "best.strategy", "best.text")


@query("short_text_warning", f"WITH {S.docs(900)} SELECT page_id, warnings FROM docs")
def short_text_warning(spark, sf):
    return docs(spark, sf, min_text_chars=900).select("page_id", joined("warnings").alias("warnings"))


WIDGET_KEY = "CASE WHEN page_id % 3 < 2 THEN 'api-' || page_id END"


@query("find_api_subdomain", f"SELECT page_id, {WIDGET_KEY} AS subdomain FROM pages")
def find_api_subdomain(spark, sf):
    return T.widget_pages(spark, sf).select("page_id", api.find_api_subdomain("html").alias("subdomain"))


API_SQL = """api AS (
  SELECT 'api-' || p_partkey AS subdomain, title,
    title || chr(10) || 'production: https://api.example/' || p_partkey || chr(10) || 'Part' || chr(10) || chr(10) || 'No. ' || p_partkey || chr(10)
    || chr(10) || '# ' || p_brand || chr(10) || 'Brand & more' || chr(10)
    || chr(10) || '## ' || p_name || chr(10) || '/parts/' || p_partkey || chr(10)
    || chr(10) || '### ' || p_type || chr(10) || 'GET /parts/' || p_partkey || '?size={s}' || chr(10) || 'Size ' || p_size || chr(10)
    || 'Request example:' || chr(10) || 's' || p_partkey || chr(10) || 'Response example:' || chr(10) || '{"price": ' || p_size || '}' AS text
  FROM (SELECT *, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'api-' || p_partkey END AS title FROM part)
  WHERE p_partkey % 5 <> 4
)"""


@functools.lru_cache(maxsize=None)
def known_apis(spark, sf):
    return api.api_candidates(api.read_api_payloads(T.api_documents(spark, sf)))


def embedded_apis(spark, sf):
    documents = api.embedded_documents(T.api_documents(spark, sf), T.widget_pages(spark, sf))
    return api.api_candidates(api.read_api_payloads(documents))


@query("api_payload_text", f"WITH {API_SQL} SELECT subdomain, title AS api_title, text AS api_text FROM api")
def api_payload_text(spark, sf):
    return known_apis(spark, sf)


@query(
    "api_payload_join",
    f"""WITH {S.candidates(900)}, {API_SQL}, w AS (SELECT *, {WIDGET_KEY} AS subdomain FROM pages)
    SELECT w.page_id, w.subdomain, a.title AS api_title FROM w JOIN api a USING (subdomain)
    LEFT JOIN best b ON b.page_id = w.page_id WHERE coalesce(length(b.text), 0) < 900""",
)
def api_payload_join(spark, sf):
    pages = T.widget_pages(spark, sf).withColumn("subdomain", api.find_api_subdomain("html"))
    best = extract.page_candidates(pages.where(F.col("subdomain").isNotNull()), 900).withColumn("best", extract.best_candidate("tried"))
    short = best.where(api.needs_api(F.col("best"), 900))
    return short.select("page_id", "subdomain").join(embedded_apis(spark, sf).drop("api_text"), "subdomain")


@query(
    "api_fallback",
    f"""WITH {S.candidates(900)}, {API_SQL}, w AS (SELECT *, {WIDGET_KEY} AS subdomain FROM pages),
    more AS (
      SELECT w.page_id, 7 AS turn, 'apiary_embed_json' AS strategy, a.text, a.title
      FROM w JOIN api a USING (subdomain) LEFT JOIN best b ON b.page_id = w.page_id WHERE coalesce(length(b.text), 0) < 900
    ), everything AS (
      SELECT page_id, turn, strategy, text, length(text) + CASE WHEN title IS NOT NULL THEN 200 ELSE 0 END - {S.penalty('text')} AS score FROM tried
      UNION ALL SELECT page_id, turn, strategy, text, length(text) + 200 - {S.penalty('text')} FROM more
    ), chosen AS (
      SELECT * FROM everything WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, turn) = 1
    ) SELECT e.page_id, {S.ATTEMPTS} AS attempts, any_value(c.text) AS best_text
    FROM (SELECT * FROM everything) e LEFT JOIN (SELECT page_id, text FROM chosen) c USING (page_id) GROUP BY e.page_id""".replace(
        "strategy || ':' || length(text) || ':' || (text <> '')", "e.strategy || ':' || length(e.text) || ':' || (e.text <> '')"
    ),
)
def api_fallback(spark, sf):
    frame = extract.build_page_docs(T.widget_pages(spark, sf), 900, embedded_apis(spark, sf), stamp())
    return frame.select("page_id", attempts_text(F.col("extraction_attempts")).alias("attempts"), F.col("text").alias("best_text"))


@query("text_length", f"WITH {S.docs()} SELECT page_id, length(text) AS text_length FROM docs")
def text_length(spark, sf):
    return docs(spark, sf).select("page_id", F.length("text").cast("bigint").alias("text_length"))


DOC_COLUMNS = f"url, url AS fetched_url, '{T.STAMP}' AS extracted_at, title, subtitle, author, date_published, language, text"


@query(
    "build_page_doc",
    f"WITH {S.docs()} SELECT page_id, {DOC_COLUMNS}, attempts AS extraction_attempts, warnings FROM docs",
)
def build_page_doc(spark, sf):
    return (
        docs(spark, sf)
        .withColumn("extraction_attempts", attempts_text(F.col("extraction_attempts")))
        .withColumn("warnings", joined("warnings"))
    )


# --- the site run ----------------------------------------------------------------------------------

RUN = CrawlParams(max_pages=BUDGET, deny_patterns=("*/es/*",))

RUN_SQL = f"""{S.ENTRIES}, idx AS (SELECT canon AS url, min(page_id) AS page_id FROM base GROUP BY canon),
budgeted AS (
  SELECT site_id, url, depth FROM entries QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY url) <= {BUDGET}
), merged AS (
  SELECT * FROM budgeted
  UNION ALL SELECT site_id, start_url, 0 FROM sites WHERE start_url NOT LIKE '%/es/%' AND (site_id, start_url) NOT IN (SELECT (site_id, url) FROM budgeted)
), visit AS (
  SELECT *, {S.ALLOWED} AS allowed FROM merged QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY url) <= {BUDGET}
), sitemap AS (SELECT site_id, url, depth FROM visit WHERE allowed),
located AS (SELECT s.site_id, s.url, idx.page_id FROM sitemap s JOIN idx USING (url)),
skipped AS (
  SELECT site_id, start_url AS url, 'deny-pattern' AS reason FROM sites WHERE start_url LIKE '%/es/%'
  UNION ALL SELECT site_id, url, 'robots-disallow' FROM visit WHERE NOT allowed
  UNION ALL SELECT site_id, url, 'fetch-error: status 404' FROM located WHERE page_id % 11 = 0
  UNION ALL SELECT site_id, url, 'non-html-content-type: application/pdf' FROM located WHERE page_id % 11 <> 0 AND page_id % 13 = 0
), visited AS (SELECT * FROM located WHERE page_id % 11 <> 0 AND page_id % 13 <> 0),
counts AS (
  SELECT s.site_id, s.start_url, (SELECT count(*) FROM sitemap m WHERE m.site_id = s.site_id) AS discovered_urls_count,
    (SELECT count(*) FROM visited v WHERE v.site_id = s.site_id) AS visited_urls_count FROM sites s
), {S.docs()}, shown AS (
  SELECT v.site_id, v.url, d.url AS fetched_url, d.title, d.subtitle, d.author, d.date_published, d.language, d.text, d.attempts, d.warnings, d.page_id
  FROM visited v JOIN docs d USING (page_id)
)"""


def run(spark, sf, lazy_pages: bool = False) -> jobs.SiteRun:
    files = T.robots_files(spark, sf)
    by_host = robots.robots_by_host(files, robots_source.read_robots(files), "pagewright")
    nothing = T.sites(spark, sf).select("site_id", F.col("start_url").alias("raw_url")).where(F.lit(False))
    return jobs.site_run(
        T.sites(spark, sf),
        T.entries(spark, sf),
        nothing,
        T.described(T.outcomes(spark, sf)),
        RUN,
        "page_id",
        robots=by_host,
        extracted_at=stamp(),
        lazy_pages=lazy_pages,
    )


@query(
    "site_counts",
    f"WITH {RUN_SQL} SELECT site_id, start_url, discovered_urls_count, visited_urls_count FROM counts",
)
def site_counts(spark, sf):
    return run(spark, sf, lazy_pages=True).sites.select("site_id", "start_url", "discovered_urls_count", "visited_urls_count")


@query(
    "site_collect",
    f"""WITH {RUN_SQL}, m AS (SELECT site_id, string_agg(depth || ' ' || url, ',' ORDER BY url) AS sitemap FROM sitemap GROUP BY site_id),
    g AS (SELECT site_id, string_agg(url || ' ' || length(text), ',' ORDER BY url) AS pages FROM shown GROUP BY site_id)
    SELECT site_id, sitemap, coalesce(pages, '') AS pages FROM m LEFT JOIN g USING (site_id)""",
)
def site_collect(spark, sf):
    result = run(spark, sf)
    nested = sites.collect_site(result.sitemap, result.pages, RUN)
    return nested.select(
        "site_id",
        joined(F.transform("sitemap", lambda e: F.concat(e["depth"].cast("string"), F.lit(" "), e["url"]))).alias("sitemap"),
        F.coalesce(
            joined(F.transform("pages", lambda p: F.concat(p["url"], F.lit(" "), F.length(p["text"]).cast("string")))), F.lit("")
        ).alias("pages"),
    )


@query("seen_distinct", f"WITH {S.BASE} SELECT DISTINCT site_id, canon AS url FROM base")
def seen_distinct(spark, sf):
    light = T.pages(spark, sf).select("url")
    root = F.regexp_extract("url", "^([a-z]+://[^/]+)", 1)
    upper = F.concat(F.upper(root), F.substring("url", F.length(root) + 1, F.length("url")))
    fragment = F.when(F.col("url").contains("#"), F.col("url")).otherwise(F.concat("url", F.lit("#x")))
    variants = light.select(F.explode(F.array("url", upper, fragment)).alias("raw"))
    canon = variants.select(urls.canonicalize_url("raw").alias("url"))
    return canon.select(urls.url_host("url").alias("site_id"), "url").distinct()


@query(
    "page_budget",
    f"""WITH {S.ENTRIES} SELECT site_id, url, depth FROM entries
    QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY url) <= {BUDGET}""",
)
def page_budget(spark, sf):
    return seeds.page_budget(T.entries(spark, sf), BUDGET)


@query(
    "sort_by_url",
    f"WITH {RUN_SQL} SELECT site_id, string_agg(url, ' ' ORDER BY url) AS urls FROM sitemap GROUP BY site_id",
)
def sort_by_url(spark, sf):
    result = run(spark, sf, lazy_pages=True)
    nested = sites.collect_site(result.sitemap, result.pages, RUN)
    return nested.select("site_id", joined("sitemap.url", " ").alias("urls"))


@query(
    "union_sources",
    f"""{SEEDS_SQL} SELECT DISTINCT site_id, url FROM (
      SELECT site_id, start_url AS url FROM sites UNION ALL SELECT site_id, url FROM judged WHERE url <> ''
      UNION ALL SELECT site_id, canon FROM base)""",
)
def union_sources(spark, sf):
    starts = T.sites(spark, sf).select("site_id", F.lit(0).alias("depth"), F.col("start_url").alias("url"))
    flags = judged_seeds(spark, sf).where("url <> ''").select("site_id", F.lit(0).alias("depth"), "url")
    return seeds.merge_seeds(T.entries(spark, sf), starts.unionByName(flags)).select("site_id", "url")


@query(
    "union_skips",
    f"""WITH {RUN_SQL} SELECT site_id, url, reason, count(*) AS n FROM (
      SELECT * FROM skipped UNION ALL SELECT * FROM skipped) GROUP BY ALL""",
)
def union_skips(spark, sf):
    skipped = run(spark, sf, lazy_pages=True).skipped
    both = skipped.unionByName(skipped)
    return both.groupBy("site_id", "url", "reason").agg(F.count(F.lit(1)).alias("n"))


# --- rendering -------------------------------------------------------------------------------------

V = render.DEFAULT_STYLE.version
NL = "chr(10)"
ATTEMPT_LINES = "'  - strategy=' || regexp_replace(regexp_replace(replace(attempts, ',', chr(10) || '  - strategy='), ':(\\d+):', '; text_len=\\1; success=', 'g'), '$', '')"


def _md_block(url: str, fetched: str) -> str:
    return (
        f"'--- PAGEWRIGHT_PAGE ---' || {NL} || 'URL: ' || {url} || {NL} || 'Fetched-URL: ' || {fetched} || {NL} || 'Title: ' || coalesce(title, '') "
        f"|| {NL} || 'Subtitle: ' || coalesce(subtitle, '') || {NL} || 'Language: ' || coalesce(language, '') || {NL} || 'Published: ' || coalesce(date_published, '') || {NL} || 'Extracted-At: {T.STAMP}' || {NL} "
        f"|| 'Text-Length: ' || length(text) || {NL} || 'Attempts:' || {NL} || {ATTEMPT_LINES} || {NL} || 'Warnings:' || {NL} "
        f"|| CASE WHEN warnings = '' THEN '-' ELSE '  - ' || warnings END || {NL} || '--- PAGEWRIGHT_TEXT ---' || {NL} || text || {NL} || '--- END_PAGEWRIGHT_PAGE ---'"
    )


def _json_page(url: str, fetched: str) -> str:
    attempts = (
        "'[' || array_to_string(list_transform(string_split(attempts, ','), lambda a: '{\"strategy\":\"' || split_part(a, ':', 1) || "
        "'\",\"success\":' || split_part(a, ':', 3) || ',\"text_len\":' || split_part(a, ':', 2) || '}'), ',') || ']'"
    )

    def value(expression: str) -> str:
        return f"coalesce(to_json({expression})::VARCHAR, 'null')"

    return (
        f"'{{\"author\":' || {value('author')} || ',\"date_published\":' || {value('date_published')} || ',\"extracted_at\":\"{T.STAMP}\",\"extraction_attempts\":' || {attempts} || "
        f"',\"fetched_url\":' || {value(fetched)} || ',\"language\":' || {value('language')} || ',\"subtitle\":' || {value('subtitle')} || ',\"text\":' || {value('text')} || "
        f"',\"title\":' || {value('title')} || ',\"url\":' || {value(url)} || ',\"warnings\":' || CASE WHEN warnings = '' THEN '[]' ELSE '[' || {value('warnings')} || ']' END || '}}'"
    )


def _xml(name: str, value: str) -> str:
    escaped = f"replace(replace(replace(coalesce({value}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    return f"CASE WHEN coalesce({value}, '') = '' THEN '<{name} />' ELSE '<{name}>' || {escaped} || '</{name}>' END"


def _xml_page(url: str, fetched: str) -> str:
    attempts = (
        "'<extraction_attempts>' || array_to_string(list_transform(string_split(attempts, ','), lambda a: '<attempt><strategy>' || split_part(a, ':', 1) || "
        "'</strategy><text_len>' || split_part(a, ':', 2) || '</text_len><success>' || split_part(a, ':', 3) || '</success></attempt>'), '') || '</extraction_attempts>'"
    )
    warnings = f"CASE WHEN warnings = '' THEN '<warnings />' ELSE '<warnings>' || {_xml('warning', 'warnings')} || '</warnings>' END"
    return (
        f"'<page>' || {_xml('url', url)} || {_xml('fetched_url', fetched)} || '<extracted_at>{T.STAMP}</extracted_at>' || {_xml('title', 'title')} "
        f"|| {_xml('subtitle', 'subtitle')} || {_xml('author', 'author')} || {_xml('date_published', 'date_published')} || {_xml('language', 'language')} || {_xml('text', 'text')} || {attempts} || {warnings} || '</page>'"
    )


@query(
    "render_page_md",
    f"""WITH {S.docs()} SELECT page_id, '# pagewright page dump' || {NL} || 'Source URL: ' || url || {NL} || 'Extracted at: {T.STAMP}' || {NL} || {NL}
    || {_md_block('url', 'url')} || {NL} AS content FROM docs""",
)
def render_page_md(spark, sf):
    return rendered(spark, sf, "md")


@query(
    "render_page_json",
    f"""WITH {S.docs()} SELECT page_id, '{{"pages":[' || {_json_page('url', 'url')} || '],"run":{{"extracted_at":"{T.STAMP}","mode":"page","source_url":"' || url
    || '"}},"tool":{{"name":"pagewright","version":"{V}"}}}}' || {NL} AS content FROM docs""",
)
def render_page_json(spark, sf):
    return rendered(spark, sf, "json")


@query(
    "render_page_xml",
    f"""WITH {S.docs()} SELECT page_id, '<pagewrightDump><tool><name>pagewright</name><version>{V}</version></tool><run><mode>page</mode>' || {_xml('source_url', 'url')}
    || '<extracted_at>{T.STAMP}</extracted_at></run><pages>' || {_xml_page('url', 'url')} || '</pages></pagewrightDump>' || {NL} AS content FROM docs""",
)
def render_page_xml(spark, sf):
    return rendered(spark, sf, "xml")


def rendered(spark, sf, fmt):
    frame = docs(spark, sf)
    return frame.select("page_id", render.render_page(sites.page_struct(frame), fmt).alias("content"))


def site_dump(spark, sf, fmt):
    result = run(spark, sf)
    chunks = sites.site_chunks(fmt, result.sites, result.sitemap, result.pages, result.skipped, RUN)
    return sites.assemble(chunks)


@query(
    "render_site_md",
    f"""WITH {RUN_SQL}, m AS (SELECT site_id, string_agg('- [depth=' || depth || '] ' || url || {NL}, '' ORDER BY url) AS listed FROM sitemap GROUP BY site_id),
    g AS (SELECT site_id, string_agg({NL} || {_md_block('url', 'fetched_url')} || {NL}, '' ORDER BY url) AS blocks FROM shown GROUP BY site_id)
    SELECT site_id, '# pagewright site dump' || {NL} || 'Start URL: ' || start_url || {NL} || 'Extracted at: {T.STAMP}' || {NL} || 'Params:' || {NL}
      || '  max_pages: {BUDGET}' || {NL} || '  delay: 1.0' || {NL} || '  jitter: 0.3' || {NL} || '  concurrency: 2' || {NL} || '  respect_robots: true' || {NL}
      || '  include_external: false' || {NL} || '  query_filter: true' || {NL} || '## Sitemap' || {NL}
      || coalesce(listed, '- (empty)' || {NL}) || coalesce(blocks, '') AS content
    FROM sites LEFT JOIN m USING (site_id) LEFT JOIN g USING (site_id)""",
)
def render_site_md(spark, sf):
    return site_dump(spark, sf, "md")


PARAMS_JSON = f'{{"allow_patterns":[],"concurrency":2,"delay":1.0,"deny_patterns":["*/es/*"],"include_external":false,"jitter":0.3,"max_pages":{BUDGET},"query_filter":true,"respect_robots":true}}'


@query(
    "render_site_json",
    f"""WITH {RUN_SQL}, m AS (SELECT site_id, string_agg('{{"depth":' || depth || ',"url":"' || url || '"}}', {NL} || ',' ORDER BY url) AS listed FROM sitemap GROUP BY site_id),
    k AS (SELECT site_id, string_agg('{{"reason":"' || reason || '","url":"' || url || '"}}', {NL} || ',' ORDER BY url || chr(9) || reason) AS skips FROM skipped GROUP BY site_id),
    g AS (SELECT site_id, string_agg({_json_page('url', 'fetched_url')}, {NL} || ',' ORDER BY url) AS blocks FROM shown GROUP BY site_id)
    SELECT site_id, '{{"pages":[' || {NL} || coalesce(blocks || {NL}, '') || '],"run":{{"crawl_params":{PARAMS_JSON},"discovered_urls_count":' || discovered_urls_count
      || ',"finished_at":"{T.STAMP}","mode":"site","sitemap":[' || {NL} || coalesce(listed || {NL}, '') || '],"skipped_urls":[' || {NL} || coalesce(skips || {NL}, '')
      || '],"start_url":"' || start_url || '","started_at":"{T.STAMP}","visited_urls_count":' || visited_urls_count
      || '}},"tool":{{"name":"pagewright","version":"{V}"}}}}' || {NL} AS content
    FROM counts LEFT JOIN m USING (site_id) LEFT JOIN g USING (site_id) LEFT JOIN k USING (site_id)""",
)
def render_site_json(spark, sf):
    return site_dump(spark, sf, "json")


PARAMS_XML = f"<max_pages>{BUDGET}</max_pages><delay>1.0</delay><jitter>0.3</jitter><concurrency>2</concurrency><respect_robots>true</respect_robots><include_external>false</include_external><query_filter>true</query_filter><allow_patterns>[]</allow_patterns><deny_patterns>[''*/es/*'']</deny_patterns>"


@query(
    "render_site_xml",
    f"""WITH {RUN_SQL}, m AS (SELECT site_id, string_agg('<entry>' || {_xml('url', 'url')} || '<depth>' || depth || '</depth></entry>' || {NL}, '' ORDER BY url) AS listed FROM sitemap GROUP BY site_id),
    k AS (SELECT site_id, string_agg('<skipped>' || {_xml('url', 'url')} || '<reason>' || reason || '</reason></skipped>' || {NL}, '' ORDER BY url || chr(9) || reason) AS skips FROM skipped GROUP BY site_id),
    g AS (SELECT site_id, string_agg({_xml_page('url', 'fetched_url')} || {NL}, '' ORDER BY url) AS blocks FROM shown GROUP BY site_id)
    SELECT site_id, '<pagewrightDump><tool><name>pagewright</name><version>{V}</version></tool><run><mode>site</mode>' || {_xml('start_url', 'start_url')}
      || '<started_at>{T.STAMP}</started_at><finished_at>{T.STAMP}</finished_at><crawl_params>{PARAMS_XML}</crawl_params><discovered_urls_count>' || discovered_urls_count
      || '</discovered_urls_count><visited_urls_count>' || visited_urls_count || '</visited_urls_count><skipped_urls>' || {NL} || coalesce(skips, '')
      || '</skipped_urls><sitemap>' || {NL} || coalesce(listed, '') || '</sitemap></run><pages>' || {NL} || coalesce(blocks, '') || '</pages></pagewrightDump>' || {NL} AS content
    FROM counts LEFT JOIN m USING (site_id) LEFT JOIN g USING (site_id) LEFT JOIN k USING (site_id)""",
)
def render_site_xml(spark, sf):
    return site_dump(spark, sf, "xml")


@query(
    "write_dump",
    f"""SELECT 'site_' || trim(regexp_replace(lower({S.host('start_url')}), '[^a-z0-9]+', '-', 'g'), '-') || '_' || replace(replace('{T.STAMP}', '-', ''), ':', '') || '.md' AS dump,
      length(content) - length(replace(content, chr(10), '')) AS lines, length(content) AS chars
    FROM ({ORACLES['render_site_md']}) JOIN (WITH {S.SITES} SELECT site_id, start_url FROM sites) USING (site_id)""",
)
def write_dump(spark, sf):
    """Write the Markdown dumps of all sites and read back the size of each."""
    result = run(spark, sf)
    chunks = sites.site_chunks("md", result.sites, result.sitemap, result.pages, result.skipped, RUN)
    path = shared_path(spark)
    sites.write_dump(chunks, result.sites, path, "md")
    delete_at_exit(spark, path)
    lines = spark.read.text(path)
    return lines.groupBy("dump").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("value") + 1).alias("chars"))
