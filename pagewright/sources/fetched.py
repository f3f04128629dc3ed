"""Fetched-page tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright import schemas
from pagewright.functions.urls import canonicalize_url


def scan_fetched(spark: SparkSession, path: str, fmt: str = "parquet", others: str = "") -> DataFrame:
    """Fetched rows (url, fetched_url, status, content_type, html) from Parquet, ORC or JSON files.

    ``others`` is the schema of columns that the files have besides, such as a row key; they come first.
    """
    return spark.read.format(fmt).schema(f"{others}, {schemas.FETCHED}" if others else schemas.FETCHED).load(path)


def from_pages(pages: DataFrame) -> DataFrame:
    """Fetched rows from a plain table of (url, html): every page answered with HTML."""
    others = [c for c in pages.columns if c not in ("url", "html")]
    return pages.select(
        *others,
        "url",
        F.col("url").alias("fetched_url"),
        F.lit(200).alias("status"),
        F.lit("text/html").alias("content_type"),
        "html",
    )


def with_canonical_url(frame: DataFrame, url: str = "url") -> DataFrame:
    """Add ``canonical_url``. Write it once into the stored table: lookups then prune by it."""
    return frame.withColumn("canonical_url", canonicalize_url(url))


def one_per_url(fetched: DataFrame, order: str) -> DataFrame:
    """Light page index: one row per canonical URL, the copy with the lowest ``order`` wins.

    The aggregate combines copies before the shuffle, so a URL with very many copies stays cheap, and
    no HTML takes part.
    """
    light = with_canonical_url(fetched).where("canonical_url <> ''")
    first = F.min(F.struct(order, "fetched_url", "status", "content_type")).alias("first")
    return light.groupBy("canonical_url").agg(first).select(
        F.col("canonical_url").alias("url"), f"first.{order}", "first.fetched_url", "first.status", "first.content_type"
    )


def still_to_write(fetched: DataFrame, written: DataFrame, order: str) -> DataFrame:
    """The newest row of each ``url`` that an earlier dump (url) does not have.

    Give rows without their HTML and join that by ``order`` afterwards: the aggregate combines the copies of
    a URL before they are shuffled, and texts stay where they are.
    """
    others = [c for c in fetched.columns if c not in ("url", order)]
    newest = fetched.groupBy("url").agg(F.max(F.struct(order, *others)).alias("newest"))
    left = newest.join(written.select("url").distinct(), "url", "left_anti")
    return left.select("url", *[F.col("newest")[c].alias(c) for c in (order, *others)])


def cache_state(wanted: DataFrame, cached: DataFrame, at: Column, max_age: int, time: str = "fetched_at") -> DataFrame:
    """Wanted (url, ...) with what a cache holds for it at the time ``at``: ``state`` and the fields of the row it would serve.

    The cache's row of a URL is its newest one not after ``at``; one older than ``max_age`` seconds is ``expired``, else it is
    a ``hit``. Without one the URL is a ``miss``. Give the cache without its HTML. Copies of a URL combine before the shuffle.
    """
    others = [c for c in cached.columns if c not in ("url", time)]
    known = cached.where(F.col(time) <= at).groupBy("url").agg(F.max(F.struct(time, *others)).alias("newest"))
    joined = wanted.join(known, "url", "left")
    oldest = at - F.make_dt_interval(secs=F.lit(max_age))
    state = F.when(F.col("newest").isNull(), "miss").when(F.col(f"newest.{time}") < oldest, "expired").otherwise("hit")
    return joined.select(*[F.col(f"`{c}`") for c in wanted.columns], state.alias("state"), F.col(f"newest.{time}").alias(time), *[F.col(f"newest.{c}") for c in others])


def write_page_table(fetched: DataFrame, path: str, row_group_bytes: int = 32 << 20) -> None:
    """Store a page table for lookups: with its canonical URLs, sorted by them, with Bloom filters for them.

    Sorted files have narrow ranges of URLs, so a lookup opens few of them; within a range the filters rule out nearly all
    other row groups before their HTML is read.
    """
    stored = with_canonical_url(fetched)
    sorted_rows = stored.repartitionByRange("canonical_url").sortWithinPartitions("canonical_url")
    writer = sorted_rows.write.option("parquet.bloom.filter.enabled#canonical_url", "true")
    writer.option("parquet.block.size", row_group_bytes).parquet(path)


def page_lookup(fetched: DataFrame, url: str) -> DataFrame:
    """Rows of one page. Raises if the argument is no URL.

    Only a table that has its ``canonical_url`` stored, see ``write_page_table``, is read in part.
    """
    spark = fetched.sparkSession
    wanted = spark.range(1).select(canonicalize_url(F.lit(url)).alias("u")).first()["u"]
    if not wanted:
        raise ValueError("URL is invalid or missing hostname.")
    if "canonical_url" not in fetched.columns:
        fetched = with_canonical_url(fetched)
    return fetched.where(F.col("canonical_url") == wanted)


def fetch_failed(status: Column, html_present: Column) -> Column:
    """No answer, an HTTP error, or no body."""
    return status.isNull() | (status >= 400) | ~html_present


def is_html(content_type: Column) -> Column:
    return F.lower(F.coalesce(content_type, F.lit(""))).contains("html")
