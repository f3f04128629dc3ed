"""Seed lists and sitemap documents as tables."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright import schemas
from pagewright.functions import fixed
from pagewright.functions.text import strip, stripped_lines
from pagewright.storage import materialize


def scan_documents(spark: SparkSession, path: str) -> DataFrame:
    """(location, body) of whole text files."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("location"), F.col("value").alias("body")
    )


def listed_urls(body: Column, comments: bool = True) -> Column:
    """Array of the URLs in a text list; with ``comments``, lines starting with '#' are dropped."""
    lines = stripped_lines(body)
    return F.filter(lines, lambda line: ~line.startswith("#")) if comments else lines


def read_url_list(documents: DataFrame, comments: bool = True) -> DataFrame:
    """(location, pos, url) of text lists, in file order."""
    return documents.select("location", F.posexplode(listed_urls(F.col("body"), comments)).alias("pos", "url"))


def read_seed_lines(documents: DataFrame) -> DataFrame:
    """(location, pos, url) of seed files: like URL lists, but '#' lines are kept."""
    return read_url_list(documents, comments=False)


def seed_rows(sites: DataFrame, flags: DataFrame) -> DataFrame:
    """(site_id, seq, raw_url) of many sites: the start URL is number 0, given URLs (site_id, seq from 0, url)
    follow from 1."""
    starts = sites.select("site_id", F.lit(0).alias("seq"), F.col("start_url").alias("raw_url"))
    given = flags.select("site_id", (F.col("seq") + 1).cast("int").alias("seq"), F.col("url").alias("raw_url"))
    return starts.unionByName(given)


def seed_literals(spark: SparkSession, site_id: str, start_url: str, urls: Sequence[str] = ()) -> DataFrame:
    """(site_id, seq, url): the start URL, then the given ones."""
    rows = [(site_id, seq, url) for seq, url in enumerate([start_url, *urls])]
    return spark.createDataFrame(rows, "site_id string, seq int, url string")


def _without_bom(body: Column) -> Column:
    return F.ltrim(body, F.lit("\ufeff"))


def is_xml(body: Column) -> Column:
    return strip(_without_bom(body)).startswith("<")


#: A document type with an entity declaration, before the root element; comments and instructions may precede.
DECLARES_ENTITIES = r"(?s)\A\s*+(?:<\?.*?\?>\s*+|<!--.*?-->\s*+)*+<!DOCTYPE[^>\[]*+\[[^\]]*?<!ENTITY"


def parse_documents(documents: DataFrame) -> DataFrame:
    """Documents with ``urls``, ``children`` and ``unreadable`` instead of their body.

    Other columns are kept. XML gives page URLs and child sitemaps, anything else is a text list.
    Malformed XML, and XML that declares entities of its own, gives nothing and is unreadable.
    """
    text = _without_bom(F.col("body"))
    safe = F.when(is_xml(F.col("body")) & ~text.rlike(DECLARES_ENTITIES), strip(text))
    options = {"ignoreNamespace": "true", "columnNameOfCorruptRecord": "broken", "mode": "PERMISSIVE"}
    parsed = documents.withColumn("xml", F.from_xml(safe, schemas.SITEMAP_XML, options))
    nothing = F.array().cast("array<string>")

    def locations(field: str) -> Column:
        found = F.filter(f"xml.{field}.loc", lambda loc: loc.isNotNull() & (loc != ""))
        return F.coalesce(F.transform(found, strip), nothing)

    xml = is_xml(F.col("body"))
    return parsed.select(
        *[c for c in documents.columns if c != "body"],
        F.when(xml, locations("url")).otherwise(listed_urls(text)).alias("urls"),
        F.when(xml, locations("sitemap")).otherwise(nothing).alias("children"),
        (xml & (safe.isNull() | F.col("xml.broken").isNotNull() | F.col("xml").isNull())).alias("unreadable"),
    )


def read_sitemap_xml(documents: DataFrame) -> DataFrame:
    """(location, pos, url) of the page URLs of XML sitemaps."""
    return parse_documents(documents.where(is_xml(F.col("body")))).select(
        "location", F.posexplode("urls").alias("pos", "url")
    )


def read_sitemap_index(documents: DataFrame) -> DataFrame:
    """(location, pos, url): page URLs, or the child sitemaps where there are none."""
    listed = F.when(F.size("urls") > 0, F.col("urls")).otherwise(F.col("children"))
    return parse_documents(documents).select("location", F.posexplode(listed).alias("pos", "url"))


def unreadable_sitemaps(documents: DataFrame) -> DataFrame:
    return parse_documents(documents).where("unreadable").select(
        F.col("location").alias("url"), F.lit(fixed.SITEMAP_UNREADABLE).alias("reason")
    )


def expand_sitemap_index(
    roots: DataFrame, documents: DataFrame, max_depth: int = fixed.SITEMAP_INDEX_DEPTH
) -> DataFrame:
    """(site_id, url) of all page URLs below the root sitemaps (site_id, location)."""
    return expand_parsed(roots, parse_for_expansion(documents), max_depth)


def parse_for_expansion(documents: DataFrame) -> DataFrame:
    """Sitemap documents (location, body) parsed and written once, for any number of expansions."""
    return materialize(parse_documents(documents).select("location", "urls", "children"))


def expand_parsed(roots: DataFrame, parsed: DataFrame, max_depth: int = fixed.SITEMAP_INDEX_DEPTH) -> DataFrame:
    """``expand_sitemap_index`` over documents from ``parse_for_expansion``.

    Children that are missing from the documents or unreadable give nothing. At the last level an index's child locations
    count as page URLs. Within one index, a URL equal to the location of the same or an earlier child is dropped.

    Going down, only (site_id, location) is kept, once a level however many indexes lead there; an index's children
    are a table of their own. URLs that no opened index names as a child belong to every site that reaches their
    document. Only the others go up again, level by level, through the indexes that let them pass.
    """
    leaf = F.size("urls") > 0
    children = parsed.where(~leaf).select(F.col("location").alias("parent"), F.posexplode("children").alias("pos", "child"))
    edges = materialize(children.where("child IS NOT NULL").groupBy("parent", "child").agg(F.min("pos").alias("pos")))
    reached = [materialize(roots.select("site_id", "location").distinct())]
    for _ in range(max_depth):
        below = reached[-1].join(edges, F.col("location") == F.col("parent"))
        reached.append(materialize(below.select("site_id", F.col("child").alias("location")).distinct()))

    listed = F.col("urls")
    last = F.when(leaf, F.col("urls")).otherwise(F.col("children"))
    pages = [
        sites.join(parsed.select("location", (last if level == max_depth else listed).alias("listed")), "location").select(
            "site_id", "location", F.explode("listed").alias("url")
        )
        for level, sites in enumerate(reached)
    ]
    # What the last level lists is not opened, so its indexes drop nothing.
    opened = _together([reached[0].where(F.lit(max_depth > 0)), *reached[1:-1]]).select(F.col("location").alias("parent"))
    edges = materialize(edges.join(opened.distinct(), "parent", "left_semi"))
    named = edges.select(F.col("child").alias("url")).distinct()
    free = _together(pages).select("site_id", "url").join(named, "url", "left_anti").select("site_id", "url")
    seen = edges.select("parent", F.col("child").alias("url"), F.col("pos").alias("seen_at"))
    passing = pages[max_depth].join(named, "url", "left_semi").select("site_id", "location", "url")
    for level in range(max_depth - 1, -1, -1):
        calls = reached[level].select("site_id", F.col("location").alias("parent")).join(edges, "parent")
        called = passing.distinct().join(calls.withColumnRenamed("child", "location"), ["site_id", "location"])
        earlier = called.join(seen, ["parent", "url"], "left").where("seen_at IS NULL OR seen_at > pos")
        own = pages[level].join(named, "url", "left_semi").select("site_id", "location", "url")
        passing = own.unionByName(earlier.select("site_id", F.col("parent").alias("location"), "url"))
    return free.unionByName(passing.select("site_id", "url")).distinct()


def _together(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)
