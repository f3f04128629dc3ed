"""Inputs of the registered queries: the given tables and what Spark derives from them.

All derivations are projections, equi-joins or pre-aggregated groups; none collects a site. They are
only plans, so each is built once per session.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.urls import canonicalize_url, host_key, url_host
from pagewright.operators.links import link_edges, with_links
from pagewright.sources.fetched import from_pages, one_per_url, with_canonical_url

STAMP = "2026-01-01T00:00:00Z"


@functools.lru_cache(maxsize=None)
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.lru_cache(maxsize=None)
def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


@functools.lru_cache(maxsize=None)
def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@functools.lru_cache(maxsize=None)
def fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_pages(pages(spark, sf_dir))


@functools.lru_cache(maxsize=None)
def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched pages of which some failed and some are no HTML."""
    return fetched(spark, sf_dir).withColumns(
        {
            "status": F.when(F.col("page_id") % 11 == 0, F.lit(404)).otherwise(F.lit(200)),
            "content_type": F.when(F.col("page_id") % 13 == 0, F.lit("application/pdf")).otherwise(
                F.lit("Text/HTML; charset=utf-8")
            ),
        }
    )


@functools.lru_cache(maxsize=None)
def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, canon, site_id) without HTML."""
    light = pages(spark, sf_dir).select("page_id", "url")
    canon = light.withColumn("canon", canonicalize_url("url"))
    return canon.withColumn("site_id", url_host("canon"))


@functools.lru_cache(maxsize=None)
def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site_id, start_url): every host, starting at its first page."""
    return addresses(spark, sf_dir).groupBy("site_id").agg(F.min_by("canon", "page_id").alias("start_url"))


@functools.lru_cache(maxsize=None)
def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site_id, url, depth): the distinct URLs of every host."""
    return (
        addresses(spark, sf_dir)
        .groupBy("site_id", F.col("canon").alias("url"))
        .agg((F.min("page_id") % 3 + 1).cast("int").alias("depth"))
    )


@functools.lru_cache(maxsize=None)
def hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, href): the link targets of all pages as written."""
    from pagewright.functions import entities, html

    values = entities.unescape_each(html.link_targets("html"))
    listed = pages(spark, sf_dir).select("page_id", "url", values.alias("values"))
    return listed.select("page_id", "url", F.explode("values").alias("href"))


@functools.lru_cache(maxsize=None)
def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real links of the pages, and page i to 2i+1, 2i+2 and its neighbour (odd up, even down)."""
    linked = with_canonical_url(with_links(fetched(spark, sf_dir)))
    real = link_edges(linked, "canonical_url")
    page = addresses(spark, sf_dir).select("page_id", F.col("canon").alias("src"))
    i = F.col("page_id")
    neighbour = F.when(i % 2 == 1, i + 1).otherwise(i - 1)
    targets = page.select("src", F.explode(F.array(2 * i + 1, 2 * i + 2, neighbour)).alias("target"))
    other = addresses(spark, sf_dir).select(F.col("page_id").alias("target"), F.col("canon").alias("dst"))
    return real.unionByName(targets.join(other, "target").select("src", "dst"))


@functools.lru_cache(maxsize=None)
def page_index(spark: SparkSession, sf_dir: str, failing: bool = False) -> DataFrame:
    source = outcomes if failing else fetched
    return one_per_url(source(spark, sf_dir).drop("html"), "page_id")


@functools.lru_cache(maxsize=None)
def robots_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(host_key, status, body): a robots file for every host, of a kind that its name decides."""
    keys = addresses(spark, sf_dir).select("site_id", host_key("canon").alias("host_key")).distinct()
    mobile = "User-agent: *\nDisallow: /\n\nUser-agent: Pagewright # us\nDisallow: /en/\nAllow: /\n"
    www = "User-agent: otherbot\nDisallow: /\n\nUser-agent: *\nAllow: /fr/\nDisallow: /%66r/\nDisallow: /de/\n\nDisallow: /en/\n"
    host = F.col("site_id")
    files = keys.select(
        "host_key",
        F.when(host.startswith("blog."), F.lit(403))
        .when(host.startswith("m.") | host.startswith("www."), F.lit(200))
        .otherwise(F.lit(404))
        .alias("status"),
        F.when(host.startswith("m."), F.lit(mobile)).when(host.startswith("www."), F.lit(www)).otherwise("").alias("body"),
    )
    unreadable = (F.col("status") == 404) & F.col("host_key").startswith("http:")
    return files.where(~unreadable)


@functools.lru_cache(maxsize=None)
def seed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site_id, raw_url): per page a plain, an upper-case, a foreign, a binary and a broken seed."""
    a = addresses(spark, sf_dir)
    foreign = F.concat(F.lit("https://other.example/"), F.col("page_id").cast("string"))
    seeds = F.array(
        F.regexp_replace("url", "^http", "HTTP"),
        foreign,
        F.concat(F.lit("/files/"), F.col("page_id").cast("string"), F.lit(".PDF")),
        F.concat(F.lit("mailto:p"), F.col("page_id").cast("string")),
        F.concat(F.lit("/new/./"), F.col("page_id").cast("string"), F.lit("//?z=1&a=2")),
    )
    return a.select("site_id", "page_id", F.posexplode(seeds).alias("seq", "raw_url"))


def sitemap_location(page_id) -> F.Column:
    return F.concat(F.lit("https://maps.example/"), page_id.cast("string"), F.lit(".xml"))


def _xml_loc(url) -> F.Column:
    return F.concat(F.lit("<loc> "), F.replace(url, F.lit("&"), F.lit("&amp;")), F.lit("\n</loc>"))


@functools.lru_cache(maxsize=None)
def sitemap_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(location, body) per page: even ids a urlset, odd ids an index of four children.

    The urlset lists the page and its links. The children of index i are documents 2i+1, 2i+2, i
    itself (a cycle) and one that does not exist.
    """
    linked = with_canonical_url(with_links(fetched(spark, sf_dir)))
    i = F.col("page_id")
    urls = F.concat(F.array("canonical_url"), F.col("links"))
    children = F.array(
        sitemap_location(2 * i + 1), sitemap_location(2 * i + 2), sitemap_location(i), sitemap_location(-i)
    )

    def listed(items, name: str):
        return F.array_join(
            F.transform(items, lambda u: F.concat(F.lit(f"<{name}>"), _xml_loc(u), F.lit(f"</{name}>"))), ""
        )

    namespace = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    urlset = F.concat(F.lit(f"<urlset {namespace}>"), listed(urls, "url"), F.lit("</urlset>"))
    index = F.concat(F.lit(f"<sitemapindex {namespace}>"), listed(children, "sitemap"), F.lit("</sitemapindex>"))
    body = F.concat(F.lit('\ufeff<?xml version="1.0" encoding="UTF-8"?>\n'), F.when(i % 2 == 0, urlset).otherwise(index))
    return linked.select(sitemap_location(i).alias("location"), body.alias("body"))


@functools.lru_cache(maxsize=None)
def list_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(location, body) per page: a text list of the page and its links with comments and blanks."""
    linked = with_links(fetched(spark, sf_dir))
    body = F.concat(
        F.lit("# list\r\n\n  "), F.col("url"), F.lit(" \t\r\n"), F.array_join("links", "\n#x\n"), F.lit("\n \n")
    )
    return linked.select(sitemap_location(F.col("page_id")).alias("location"), body.alias("body"))


@functools.lru_cache(maxsize=None)
def api_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subdomain, body): one API description per part; every fifth is no JSON object.

    A part takes a few bytes in its file and its description some hundred operations, so the rows of one file,
    which Spark cuts by bytes, are dealt out to the number of tasks that shuffles have in this session.
    """
    p = table(spark, sf_dir, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    key = F.col("p_partkey")
    action = F.struct(
        F.col("p_type").alias("name"),
        F.lit("GET").alias("method"),
        F.lit("?size={s}").alias("uriTemplate"),
        text("<p>Size<b>", F.col("p_size"), "</b></p><script>x</script>").alias("description"),
        F.array(
            F.struct(
                F.array(F.struct(F.lit(" ").alias("body"), text("s", key).alias("schema"))).alias("requests"),
                F.array(F.struct(text('{"price": ', F.col("p_size"), "}").alias("body"))).alias("responses"),
            )
        ).alias("examples"),
    )
    resource = F.struct(
        F.col("p_name").alias("name"),
        text("/parts/", key).alias("uriTemplate"),
        F.lit("<template>hidden</template>").alias("description"),
        F.array(action).alias("actions"),
    )
    group = F.struct(
        F.col("p_brand").alias("name"), F.lit("<i>Brand &amp; more</i>").alias("description"), F.array(resource).alias("resources")
    )
    payload = F.struct(
        F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("name"),
        text("api-", key).alias("subdomain"),
        F.struct(text("https://api.example/", key).alias("production"), F.lit("").alias("none")).alias("urls"),
        text("<h2>Part</h2><p>No. ", key, "</p>").alias("description"),
        F.array(group).alias("resourceGroups"),
    )
    body = F.when(key % 5 == 4, F.concat(F.lit("["), F.to_json(payload), F.lit("]"))).otherwise(F.to_json(payload))
    return p.select(text("api-", key).alias("subdomain"), body.alias("body"))


@functools.lru_cache(maxsize=None)
def widget_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched pages with an embedded API description, in one of three spellings."""
    i = F.col("page_id")
    key = F.concat(F.lit("api-"), i.cast("string"))
    as_json = F.concat(F.lit('{"preferences": {"a": "}"}, "subdomain": "'), key, F.lit('", "element": "#x"}'))
    as_script = F.concat(F.lit("{element: '#x', 'subdomain' : '"), key, F.lit("', p: {q: 1}}"))
    broken = F.concat(F.lit('{"subdomain": "'), key, F.lit('"'))
    config = F.when(i % 3 == 0, as_json).when(i % 3 == 1, as_script).otherwise(broken)
    widget = F.concat(F.lit("<script>var e = new Apiary.Embed("), config, F.lit(");</script>"))
    return fetched(spark, sf_dir).withColumn("html", F.concat(widget, "html"))


@functools.lru_cache(maxsize=None)
def rich_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched pages whose article starts with a table, a comment box and a link."""
    number = F.col("page_id").cast("string")
    insert = F.concat(
        F.lit("<article><table><tr><td>T"),
        number,
        F.lit('</td></tr></table><div class="post comments"><div>C'),
        number,
        F.lit('</div>more</div><p>see <a href="/l'),
        number,
        F.lit('&amp;x">L</a></p><meta name="description" content="About '),
        number,
        F.lit('"><time datetime="2025-10-01">'),
    )
    return fetched(spark, sf_dir).withColumn("html", F.replace(F.col("html"), F.lit("<article>"), insert))


def described(frame: DataFrame) -> DataFrame:
    """The pages with a description, author and date in their head: in one of two or three places, blank, or missing."""
    i, number = F.col("page_id"), F.col("page_id").cast("string")

    def meta(kind: str, key: str, *content) -> F.Column:
        parts = [F.lit(x) if isinstance(x, str) else x for x in content]
        return F.concat(F.lit(f'<meta {kind}="{key}" content="'), *parts, F.lit('">'))

    description = (
        F.when(i % 3 == 0, meta("name", "description", "About ", number, " &amp; more"))
        .when(i % 3 == 1, meta("property", "og:description", "Shared ", number))
        .otherwise(meta("name", "description", " "))
    )
    author = (
        F.when(i % 4 == 0, meta("name", "author", "A. ", number))
        .when(i % 4 == 1, meta("property", "article:author", "&Eacute;va ", number))
        .otherwise(F.lit(""))
    )
    date = (
        F.when(i % 5 == 0, meta("property", "article:published_time", "2025-01-02T03:04:05Z"))
        .when(i % 5 == 1, meta("name", "date", "2025-02-03"))
        .when(i % 5 == 2, F.lit('<time datetime="2025-03-04"></time>'))
        .otherwise(F.lit(""))
    )
    head = F.concat(description, author, date, F.lit("</head>"))
    return frame.withColumn("html", F.replace(F.col("html"), F.lit("</head>"), head))


#: By page_id modulo 4: nested templates, closing tags without an opening one, a template that is never closed, nothing.
TEMPLATES = (
    "<template><b>x</b><template>y</template>z</template>",
    "</template>s<template>q</template></style>r",
    "<template><template>u</template>",
    "",
)


@functools.lru_cache(maxsize=None)
def templated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with template elements before their article."""
    before = F.element_at(F.array(*map(F.lit, TEMPLATES)), (F.col("page_id") % 4 + 1).cast("int"))
    article = F.lit("<article>")
    return pages(spark, sf_dir).withColumn("html", F.replace(F.col("html"), article, F.concat(before, article)))
