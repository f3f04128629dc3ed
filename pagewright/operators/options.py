"""Options that differ from site to site: columns of the site table, with the run's parameters where one is missing or NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import fixed
from pagewright.functions.urls import glob_match, is_binary_url, is_query_heavy, url_host
from pagewright.schemas import CrawlParams

#: Columns a site table may have. ``max_pages`` is cut to the hard limit unless the run overrides it.
KINDS = {
    "max_pages": "int",
    "include_external": "boolean",
    "query_filter": "boolean",
    "respect_robots": "boolean",
    "probe_sitemap": "boolean",
    "delay": "double",
    "allow_patterns": "array<string>",
    "deny_patterns": "array<string>",
}


def has_options(sites: DataFrame) -> bool:
    return any(name in sites.columns for name in KINDS)


def site_options(sites: DataFrame, params: CrawlParams) -> DataFrame:
    """(site_id, options) with a complete struct per site.

    A ``max_pages`` that is not positive counts as missing.
    """
    defaults = {
        "max_pages": F.lit(params.max_pages if params.max_pages is not None else 2**31 - 1),
        "include_external": F.lit(params.include_external),
        "query_filter": F.lit(params.query_filter),
        "respect_robots": F.lit(params.respect_robots),
        "probe_sitemap": F.lit(True),
        "delay": F.lit(params.delay),
        "allow_patterns": F.array(*map(F.lit, params.allow_patterns)),
        "deny_patterns": F.array(*map(F.lit, params.deny_patterns)),
    }
    fields = []
    for name, kind in KINDS.items():
        own = F.col(name).cast(kind) if name in sites.columns else F.lit(None).cast(kind)
        if name == "max_pages":
            cap = 2**31 - 1 if params.override_hard_cap else fixed.HARD_MAX_PAGES
            own = F.when(own > 0, F.least(own, F.lit(cap)))
        fields.append(F.coalesce(own, defaults[name].cast(kind)).alias(name))
    return sites.select("site_id", F.struct(*fields).alias("options"))


def external_reason(url: Column, start_host: Column) -> Column:
    """Needs the column ``options``."""
    return F.when(~F.col("options.include_external") & (url_host(url) != start_host), F.lit(fixed.EXTERNAL))


def url_reason(url: Column) -> Column:
    """First reason to leave the URL out under the site's own ``options``, or NULL."""
    allow, deny = F.col("options.allow_patterns"), F.col("options.deny_patterns")
    return (
        F.when(is_binary_url(url), F.lit(fixed.BINARY))
        .when(F.col("options.query_filter") & is_query_heavy(url), F.lit(fixed.QUERY_HEAVY))
        .when(glob_match(url, deny), F.lit(fixed.DENIED))
        .when((F.size(allow) > 0) & ~glob_match(url, allow), F.lit(fixed.NOT_ALLOWED))
    )
