"""Links of pages and the site link graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import entities, html
from pagewright.functions.binding import by_name, let
from pagewright.functions.urls import base_of, resolve_from


@by_name(2)
def extract_links(hrefs: Column, base: Column) -> Column:
    """Sorted distinct canonical URLs of decoded href values on the page ``base``."""
    links = let(base_of(base), lambda b: F.transform(hrefs, lambda href: resolve_from(href, b)))
    return F.array_sort(F.array_distinct(F.filter(links, lambda link: link != "")))


def with_links(fetched: DataFrame) -> DataFrame:
    """Fetched rows with ``links`` instead of their HTML; a projection, no shuffle."""
    hrefs = fetched.withColumn("hrefs", entities.unescape_each(html.link_targets("html")))
    kept = [c for c in fetched.columns if c != "html"]
    return hrefs.select(*kept, extract_links("hrefs", "fetched_url").alias("links"))


def link_edges(linked: DataFrame, source: str = "url") -> DataFrame:
    """(src, dst), one row per link; links are distinct within a page already."""
    return linked.select(F.col(source).alias("src"), F.explode("links").alias("dst"))
