"""Breadth-first discovery over the link graph of already fetched pages, for all sites at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import fixed
from pagewright.functions.urls import canonicalize_url, url_host
from pagewright.operators.robots import with_robots_verdict
from pagewright.operators import options as own
from pagewright.operators.seeds import external_reason, first_per_site, url_reason
from pagewright.schemas import CrawlParams
from pagewright.sources.fetched import fetch_failed, is_html
from pagewright.storage import delete_now, forget, materialize, materialize_by


#: So many runs of judged URLs are merged into one larger run.
FAN = 8


def _verdict(params: CrawlParams, per_site: bool) -> Column:
    """First reason not to count a frontier row as discovered, or NULL."""
    if per_site:
        reasons = [own.external_reason(F.col("url"), F.col("start_host")), own.url_reason(F.col("url"))]
        obeyed = F.col("options.respect_robots")
    else:
        reasons = [external_reason(F.col("url"), F.col("start_host"), params), url_reason("url", params)]
        obeyed = F.lit(True)
    return F.coalesce(
        *reasons,
        F.when(obeyed & ~F.col("allowed"), F.lit(fixed.ROBOTS)),
        F.when(fetch_failed(F.col("status"), F.lit(True)), F.lit(fixed.FETCH_FAILED)),
        F.when(~is_html(F.col("content_type")), F.lit(fixed.NON_HTML)),
    )


def _judge(
    frontier: DataFrame, pages: DataFrame, robots: DataFrame | None, options: DataFrame | None, verdict: Column
) -> DataFrame:
    """Frontier rows with their ``reason``, and the ``budget`` of their site where sites have their own."""
    outcome = frontier.join(pages, "url", "left")
    if robots is not None:
        outcome = with_robots_verdict(outcome, robots)
    else:
        outcome = outcome.withColumn("allowed", F.lit(True))
    columns = ["site_id", "url", "parent_ord", "done", "start_host", verdict.alias("reason")]
    if options is not None:
        outcome = outcome.join(options, "site_id")
        columns.append(F.col("options.max_pages").alias("budget"))
    return outcome.select(*columns)


class JudgedLog:
    """All URLs judged so far, as few runs: FAN runs of one size are merged into one of the next.

    Level n of a crawl finds at most FAN - 1 runs of each size, so plans stay small on deep graphs, and each row is
    written once per size. Merged runs are bucketed by (site_id, url): the anti-join of a frontier does not shuffle them. Files of
    merged runs are deleted when the next run is there.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.levels: list[tuple[DataFrame, DataFrame, list[DataFrame]]] = []  # judged, result, what was written
        self.runs: list[list[tuple[DataFrame, str]]] = []  # by size: bucketed results
        self.tables: list[str] = []

    def add(self, judged: DataFrame, result: DataFrame, written: list[DataFrame]) -> None:
        self.levels.append((judged, result, written))
        if len(self.levels) <= FAN:  # the newest level is still needed by itself
            return
        full, self.levels = self.levels[:FAN], self.levels[FAN:]
        self._merge([result for _, result, _ in full], 0)
        delete_now(self.spark, *[frame for _, _, written in full for frame in written])

    def _merge(self, parts: list[DataFrame], size: int) -> None:
        run = materialize_by(_union(parts), "site_id", "url")
        self.tables.append(run[1])
        if len(self.runs) == size:
            self.runs.append([])
        self.runs[size].append(run)
        if len(self.runs[size]) == FAN:
            old, self.runs[size] = self.runs[size], []
            self._merge([frame for frame, _ in old], size + 1)
            delete_now(self.spark, *[frame for frame, _ in old])

    def new(self, children: DataFrame) -> DataFrame:
        """Children (site_id, url, ...) that were not judged yet."""
        for run in self.runs:
            for frame, _ in run:
                children = frontier_anti_join(children, frame.select("site_id", "url"))
        return frontier_anti_join(children, _union([judged.select("site_id", "url") for judged, _, _ in self.levels]))

    def result(self) -> DataFrame:
        return _union([frame for run in self.runs for frame, _ in run] + [result for _, result, _ in self.levels])


def bfs_discover(
    sites: DataFrame,
    edges: DataFrame,
    pages: DataFrame,
    params: CrawlParams,
    robots: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Discovered (site_id, url, depth, ord) and skipped (site_id, url, reason, depth).

    With a budget, ``ord`` is the place in the site's queue. Without one all reachable pages are found and
    ``ord`` is NULL, as nothing depends on the order within a level.

    ``sites`` is (site_id, start_url) and, if sites differ, option columns; ``edges`` (src, dst) with canonical URLs, ``pages`` one
    row (url, status, content_type) per canonical URL, ``robots`` the result of ``robots_by_host``.

    Pages are visited in the order of a first-in-first-out queue, which is the order of (depth, rank
    of the parent, URL). One round per level: join the frontier with the edges, keep the earliest
    parent of each new URL, judge it, and rank the pages of each site up to its budget. Every round is
    written to the shared checkpoint folder; ``JudgedLog`` holds what the rounds have seen.
    """
    options = materialize(own.site_options(sites, params)) if own.has_options(sites) else None
    start = canonicalize_url("start_url")
    begun = sites.select("site_id", "start_url", start.alias("url"))
    bad_starts = begun.where("url = ''").select(
        "site_id", F.col("start_url").alias("url"), F.lit(fixed.BAD_START).alias("reason"), F.lit(0).alias("depth")
    )
    frontier = begun.where("url <> ''").select(
        "site_id",
        "url",
        F.lit(0).alias("parent_ord"),
        F.lit(0).alias("done"),
        url_host("url").alias("start_host"),
    )
    edges, edges_name = materialize_by(edges.where("src <> dst").select("src", "dst"), "src")
    pages, pages_name = materialize_by(pages.select("url", "status", "content_type"), "url")
    heed = robots is not None and (params.respect_robots or options is not None)
    rules = materialize(robots) if heed else None
    verdict = _verdict(params, options is not None)
    limit = params.max_pages if options is None else F.col("budget")
    log, depth = JudgedLog(sites.sparkSession), 0
    while True:
        judged = materialize(_judge(frontier, pages, rules, options, verdict))
        accepted = _accepted(judged.where("reason is null"), limit, depth)
        found = accepted.select("site_id", "url", "depth", "ord", F.lit(None).cast("string").alias("reason"))
        away = _popped_skips(judged, accepted, limit, depth)
        log.add(judged, found.unionByName(away), [judged] if limit is None else [judged, accepted])
        if accepted.isEmpty():
            break
        depth += 1
        frontier = log.new(_children(accepted, edges, limit))
    forget(sites.sparkSession, edges_name, pages_name)
    whole = log.result()
    earliest = F.min(F.struct("depth", "reason")).alias("earliest")
    skips = whole.where("reason is not null").select("site_id", "url", "reason", "depth").unionByName(bad_starts)
    skips = skips.groupBy("site_id", "url").agg(earliest)
    return (
        whole.where("reason is null").select("site_id", "url", "depth", "ord"),
        skips.select("site_id", "url", "earliest.reason", "earliest.depth"),
    )


def _accepted(passed: DataFrame, limit: int | Column | None, depth: int) -> DataFrame:
    """Pages of this level that are within the budget of their site."""
    level, place = F.lit(depth).alias("depth"), (F.col("rn") + F.col("done")).alias("ord")
    if limit is None:
        return passed.select("site_id", "url", level, F.lit(None).cast("int").alias("ord"), "parent_ord", "start_host")
    ranked = first_per_site(passed, limit, "parent_ord", "url").where(F.col("rn") + F.col("done") <= limit)
    budget = ["budget"] if "budget" in passed.columns else []
    return materialize(ranked.select("site_id", "url", level, place, "parent_ord", "start_host", *budget))


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def _popped_skips(judged: DataFrame, accepted: DataFrame, limit: int | Column | None, depth: int) -> DataFrame:
    """Judged-away URLs that come before the page with which a site's budget ran out."""
    columns = ["site_id", "url", F.lit(depth).alias("depth"), F.lit(None).cast("int").alias("ord"), "reason"]
    away = judged.where("reason is not null")
    if limit is None:
        return away.select(*columns)
    last = accepted.where(F.col("ord") == limit).select(
        "site_id", F.struct("parent_ord", "url").alias("last_position")
    )
    before = F.col("last_position").isNull() | (F.struct("parent_ord", "url") < F.col("last_position"))
    return away.join(last, "site_id", "left").where(before).select(*columns)


def _children(accepted: DataFrame, edges: DataFrame, limit: int | Column | None) -> DataFrame:
    """URLs behind the pages of this level, for sites that have budget left."""
    if limit is None:
        parents = accepted.select("site_id", F.col("url").alias("src"), F.lit(0).alias("parent_ord"), F.lit(0).alias("done"), "start_host")
    else:
        budget = [F.first("budget").alias("budget")] if "budget" in accepted.columns else []
        progress = accepted.groupBy("site_id").agg(F.max("ord").alias("done"), *budget).where(F.col("done") < limit)
        parents = accepted.drop("budget").join(progress, "site_id").select(
            "site_id", F.col("url").alias("src"), F.col("ord").alias("parent_ord"), "done", "start_host"
        )
    children = parents.join(edges, "src").groupBy("site_id", F.col("dst").alias("url"))
    return children.agg(
        F.min("parent_ord").alias("parent_ord"),
        F.first("done").alias("done"),
        F.first("start_host").alias("start_host"),
    )


def frontier_anti_join(children: DataFrame, seen: DataFrame) -> DataFrame:
    """Children (site_id, url, ...) that were not seen yet."""
    return children.join(seen, ["site_id", "url"], "left_anti")
