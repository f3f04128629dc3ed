"""Deciding which URLs of a site to visit: filters, sources in order of preference, budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import fixed
from pagewright.functions.urls import canonicalize_url, skip_reason, url_host
from pagewright.operators import options as own
from pagewright.schemas import CrawlParams

SALTS = 32


def canonical_sites(sites: DataFrame) -> DataFrame:
    """(site_id, start_url) with canonical start URLs; sites whose start URL is invalid are left out."""
    return sites.select("site_id", canonicalize_url("start_url").alias("start_url")).where("start_url <> ''")


def canonical_seeds(seeds: DataFrame, sites: DataFrame) -> DataFrame:
    """Seeds (site_id, raw_url, ...) with ``url`` (canonical, seen from the site's start) and
    ``start_host``. ``sites`` is (site_id, start_url)."""
    start = sites.select("site_id", "start_url", url_host("start_url").alias("start_host"))
    joined = seeds.join(start, "site_id")
    return joined.withColumn("url", canonicalize_url("raw_url", "start_url")).drop("start_url")


def external_reason(url: Column, start_host: Column, params: CrawlParams) -> Column:
    reason = F.lit(None).cast("string")
    if params.include_external:
        return reason
    return F.when(url_host(url) != start_host, F.lit(fixed.EXTERNAL))


def url_reason(url: Column | str, params: CrawlParams) -> Column:
    return skip_reason(url, params.query_filter, params.allow_patterns, params.deny_patterns)


def seed_reason(url: Column, start_host: Column, params: CrawlParams) -> Column:
    """Why an explicit seed is left out, or NULL."""
    return F.coalesce(
        F.when(url == "", F.lit(fixed.BAD_URL)),
        external_reason(url, start_host, params),
        url_reason(url, params),
    )


def own_seed_reason(url: Column, start_host: Column) -> Column:
    """Like ``seed_reason``, under the site's own column ``options``."""
    return F.coalesce(F.when(url == "", F.lit(fixed.BAD_URL)), own.external_reason(url, start_host), own.url_reason(url))


def split_by_reason(frame: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without and with a ``reason``; skips are (site_id, url, reason)."""
    kept = frame.where(F.col("reason").isNull()).drop("reason")
    return kept, frame.where(F.col("reason").isNotNull()).select("site_id", "url", "reason")


def sitemap_entries(
    found: DataFrame, sites: DataFrame, params: CrawlParams, options: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Entries (site_id, url, depth 0) and skips from sitemap URLs (site_id, raw_url).

    URLs without a canonical form are dropped silently. Only the host is checked, not the skip rules. ``options`` are those
    of the sites, from ``site_options``.
    """
    canonical = canonical_seeds(found, sites).where("url <> ''")
    if options is None:
        reason = external_reason(F.col("url"), F.col("start_host"), params)
    else:
        canonical, reason = canonical.join(options, "site_id"), own.external_reason(F.col("url"), F.col("start_host"))
    judged = canonical.withColumn("reason", reason)
    kept, skips = split_by_reason(judged)
    return kept.select("site_id", "url").distinct().withColumn("depth", F.lit(0)), skips


def discovery_precedence(*sources: DataFrame) -> DataFrame:
    """Per site, all entries of the first source that has any; sources are (site_id, url, depth)."""
    ranked = None
    for rank, source in enumerate(sources):
        part = source.select("site_id", "url", "depth", F.lit(rank).alias("rank"))
        ranked = part if ranked is None else ranked.unionByName(part)
    best = ranked.groupBy("site_id").agg(F.min("rank").alias("rank"))
    return ranked.join(best, ["site_id", "rank"]).select("site_id", "url", "depth")


def sites_without(sites: DataFrame, entries: DataFrame) -> DataFrame:
    """Sites left for link discovery: those without any usable entry."""
    return sites.join(entries.select("site_id").distinct(), "site_id", "left_anti")


def merge_seeds(entries: DataFrame, seeds: DataFrame) -> DataFrame:
    """Entries plus seeds (site_id, url); an existing entry keeps its depth, a new one gets 0."""
    both = entries.select("site_id", "url", F.lit(0).alias("rank"), "depth").unionByName(
        seeds.select("site_id", "url", F.lit(1).alias("rank"), F.lit(0).alias("depth"))
    )
    first = F.min(F.struct("rank", "depth")).alias("first")
    return both.groupBy("site_id", "url").agg(first).select("site_id", "url", "first.depth")


def first_per_site(frame: DataFrame, limit: int | Column, *order: Column | str) -> DataFrame:
    """The first ``limit`` rows of every site, with their rank ``rn``; a column gives each site its own limit.

    A first round keeps the best rows of 32 random slices of each site, so even a site with a third of
    all rows sends at most 32 x limit rows to the one task that ranks it.
    """
    slices = Window.partitionBy("site_id", "slice").orderBy(*order)
    whole = Window.partitionBy("site_id").orderBy(*order)
    sliced = frame.withColumn("slice", F.pmod(F.xxhash64("url"), F.lit(SALTS)))
    thinned = sliced.withColumn("rn", F.row_number().over(slices)).where(F.col("rn") <= limit)
    ranked = thinned.drop("slice", "rn").withColumn("rn", F.row_number().over(whole))
    return ranked.where(F.col("rn") <= limit)


def page_budget(entries: DataFrame, max_pages: int | None, options: DataFrame | None = None) -> DataFrame:
    """The first ``max_pages`` URLs of every site in URL order; all without a budget. With ``options`` each site has its own."""
    if options is not None:
        limited = entries.join(options.select("site_id", F.col("options.max_pages").alias("budget")), "site_id")
        return first_per_site(limited, F.col("budget"), "url").drop("rn", "budget")
    if max_pages is None:
        return entries
    return first_per_site(entries, max_pages, "url").drop("rn")
