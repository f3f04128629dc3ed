"""The two whole jobs: documents of single pages, and dumps of sites."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import fixed
from pagewright.functions.text import utc_now_iso
from pagewright.operators import crawl, extract, seeds
from pagewright.operators import options as own
from pagewright.operators.links import link_edges, with_links
from pagewright.operators.robots import with_robots_verdict
from pagewright.operators.sites import site_counts
from pagewright.schemas import CrawlParams
from pagewright.sources import sitemaps
from pagewright.sources.fetched import fetch_failed, is_html, one_per_url, with_canonical_url
from pagewright.storage import materialize


class SiteRun(NamedTuple):
    sites: DataFrame
    sitemap: DataFrame
    pages: DataFrame
    skipped: DataFrame


def page_docs(
    fetched: DataFrame,
    min_text_chars: int = fixed.MIN_TEXT_CHARS,
    api_candidates: DataFrame | None = None,
    extracted_at: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Documents of the usable fetched rows, and (url, reason) of the others."""
    judged = fetched.withColumn("reason", extraction_reason())
    usable = judged.where("reason is null").drop("reason")
    docs = extract.build_page_docs(usable, min_text_chars, api_candidates, extracted_at)
    return docs, judged.where("reason is not null").select("url", "reason")


def _fetch_error() -> Column:
    status = F.concat(F.lit("status "), F.col("status").cast("string"))
    return F.concat(F.lit("fetch-error: "), F.coalesce(status, F.lit("not fetched")))


def _not_html() -> Column:
    return F.concat(F.lit("non-html-content-type: "), F.coalesce("content_type", F.lit("")))


def extraction_reason() -> Column:
    """Why a fetched row gives no document, or NULL."""
    failed = fetch_failed(F.col("status"), F.col("html").isNotNull())
    return F.when(failed, _fetch_error()).when(~is_html(F.col("content_type")), _not_html())


def discover(
    sites: DataFrame,
    fetched: DataFrame,
    params: CrawlParams,
    order: str,
    robots: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Link discovery from the fetched pages themselves: (discovered, skipped)."""
    answered = fetched.where(extraction_reason().isNull())
    linked = with_canonical_url(with_links(answered)).where("canonical_url <> ''")
    index = one_per_url(fetched.drop("html"), order)
    edges = link_edges(linked.join(index.select(order), order, "left_semi"), "canonical_url")
    return crawl.bfs_discover(sites, edges, index, params, robots)


def site_run(
    sites: DataFrame,
    entries: DataFrame,
    explicit: DataFrame,
    fetched: DataFrame,
    params: CrawlParams,
    order: str,
    robots: DataFrame | None = None,
    discovery_skips: DataFrame | None = None,
    api_candidates: DataFrame | None = None,
    min_text_chars: int = fixed.MIN_TEXT_CHARS,
    extracted_at: Column | None = None,
    lazy_pages: bool = False,
) -> SiteRun:
    """Everything after discovery: merge seeds, budget, robots, extraction, counts.

    ``sites`` is (site_id, start_url), ``entries`` (site_id, url, depth) from a sitemap or from link
    discovery, ``explicit`` (site_id, raw_url) further seeds, ``fetched`` the page table with a unique
    ``order`` column. Only URLs move until the pages to visit are known; then the page texts are
    joined by that column. Start URLs are canonicalized first; a site without a valid one is only a skip.
    With ``lazy_pages`` the texts are extracted when they are asked for. Option columns of ``sites`` (see
    ``operators.options``) hold for their site alone.
    """
    stamp = extracted_at if extracted_at is not None else _now(sites)
    options = materialize(own.site_options(sites, params)) if own.has_options(sites) else None
    given, sites = sites, seeds.canonical_sites(sites)
    starts = sites.select("site_id", F.col("start_url").alias("raw_url"))
    asked = seeds.canonical_seeds(starts.unionByName(explicit.select("site_id", "raw_url")), sites)
    if options is None:
        judged = asked.withColumn("reason", seeds.seed_reason(F.col("url"), F.col("start_host"), params))
    else:
        reason = seeds.own_seed_reason(F.col("url"), F.col("start_host"))
        judged = asked.join(options, "site_id").withColumn("reason", reason)
    judged = judged.withColumn("url", F.when(F.col("url") == "", F.col("raw_url")).otherwise(F.col("url")))
    judged = materialize(judged.select("site_id", "url", "reason"))
    wanted, seed_skips = seeds.split_by_reason(judged)
    budgeted = seeds.page_budget(entries, params.max_pages, options)
    visit = seeds.page_budget(seeds.merge_seeds(budgeted, wanted), params.max_pages, options)
    if robots is not None and options is not None:
        heeded = with_robots_verdict(visit, robots).join(options, "site_id")
        visit = heeded.withColumn("allowed", F.col("allowed") | ~F.col("options.respect_robots")).drop("options")
    elif params.respect_robots and robots is not None:
        visit = with_robots_verdict(visit, robots)
    else:
        visit = visit.withColumn("allowed", F.lit(True))
    located = fetch_join(visit, one_per_url(fetched.drop("html"), order))
    failed = fetch_failed(F.col("status"), F.lit(True))
    reason = (
        F.when(~F.col("allowed"), F.lit(fixed.ROBOTS))
        .when(failed, _fetch_error())
        .when(~is_html(F.col("content_type")), _not_html())
    )
    located = materialize(
        located.select("site_id", "url", "depth", "allowed", order, reason.alias("reason"))
    )
    # Only pages that are visited are extracted: the ids of the others do not pass the semi-join.
    usable = located.where("reason is null").select("site_id", "url", order)
    visited = fetched.join(materialize(usable.select(order).distinct()), order, "left_semi")
    texts = extract.build_page_docs(visited, min_text_chars, api_candidates, stamp).drop("url")
    pages = usable.join(texts, order).drop(order)
    if not lazy_pages:
        pages = materialize(pages)
    finished = stamp if extracted_at is not None else _now(sites)
    skipped = seed_skips.unionByName(located.where("reason is not null").select("site_id", "url", "reason"))
    if discovery_skips is not None:
        skipped = discovery_skips.select("site_id", "url", "reason").unionByName(skipped)
    sitemap = located.where("allowed").select("site_id", "url", "depth")
    bad = given.join(sites, "site_id", "left_anti")
    bad = bad.select("site_id", F.col("start_url").alias("url"), F.lit(fixed.BAD_START).alias("reason"))
    skipped = skipped.unionByName(bad)
    timed = sites.select("site_id", "start_url", stamp.alias("started_at"), finished.alias("finished_at"))
    return SiteRun(materialize(site_counts(timed, sitemap, usable)), sitemap, pages, skipped)


def site_job(
    sites: DataFrame,
    given: DataFrame,
    documents: DataFrame,
    fetched: DataFrame,
    params: CrawlParams,
    order: str,
    robots: DataFrame | None = None,
    explicit: DataFrame | None = None,
    **options,
) -> SiteRun:
    """The whole site run: given sitemaps, else a probe, else a walk over the links; then ``site_run``.

    ``given`` is (site_id, location) of sitemaps that were asked for, ``documents`` (location, body) of all sitemap documents that
    were fetched, the other tables are those of ``site_run``. A site without a given sitemap is probed at ``/sitemap.xml`` of its start
    URL, unless its option ``probe_sitemap`` is false. Only sites for which this leaves no usable URL are walked. Skips of every
    step are reported.
    """
    starts = materialize(seeds.canonical_sites(sites))
    own_options = materialize(own.site_options(sites, params))
    parsed = sitemaps.parse_for_expansion(documents)
    root = F.regexp_extract("start_url", r"^([^:]+://[^/]+)", 1)
    probed = starts.join(own_options.where("options.probe_sitemap").select("site_id"), "site_id")
    probed = probed.join(given.select("site_id").distinct(), "site_id", "left_anti")
    probes = probed.select("site_id", F.concat(root, F.lit("/sitemap.xml")).alias("location"))
    roots = materialize(given.select("site_id", "location").unionByName(probes))
    found = sitemaps.expand_parsed(roots, parsed).withColumnRenamed("url", "raw_url")
    listed, skips = seeds.sitemap_entries(materialize(found), starts, params, own_options)
    listed = materialize(listed)
    walked_sites = sites.join(seeds.sites_without(starts.select("site_id"), listed), "site_id", "left_semi")
    walked, walk_skips = discover(walked_sites, fetched, params, order, robots)
    entries = materialize(listed.unionByName(walked.select("site_id", "url", "depth")))
    skips = skips.unionByName(walk_skips.select("site_id", "url", "reason"))
    nothing = starts.select("site_id", F.col("start_url").alias("raw_url")).where(F.lit(False))
    return site_run(
        sites, entries, explicit if explicit is not None else nothing, fetched, params, order, robots=robots, discovery_skips=skips, **options
    )


def _now(frame: DataFrame) -> Column:
    """The time of this call as a literal, so that later steps do not move it."""
    return F.lit(frame.sparkSession.range(1).select(utc_now_iso().alias("now")).first()["now"])


def fetch_join(visit: DataFrame, index: DataFrame) -> DataFrame:
    """URLs to visit with the page that answers them; unknown URLs keep NULLs."""
    return visit.join(index, "url", "left")
