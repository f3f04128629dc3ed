"""The page documents of a stream of fetched pages.

Extraction is a projection, so the batch plan runs unchanged on a streaming DataFrame. Repeats of a page are
dropped by canonical URL within a watermark, which also bounds the state: rows later than that are dropped.

``store_pages`` keeps every page's newest version instead, however late its copies come. Each batch writes its documents into a folder
named by its number, which a repeated batch replaces, so a run that stops between the write and the commit leaves
nothing twice. ``current_pages`` reads the newest version of each page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagewright.functions import fixed
from pagewright.plans.jobs import page_docs
from pagewright.sources.fetched import with_canonical_url


def stream_page_docs(fetched: DataFrame, min_text_chars: int = fixed.MIN_TEXT_CHARS) -> DataFrame:
    """Streaming page documents of the usable rows of a fetched-page stream."""
    docs, _ = page_docs(fetched, min_text_chars)
    return docs


def without_repeats(fetched: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each canonical URL within ``delay`` of the event time column ``time``."""
    known = with_canonical_url(fetched.withWatermark(time, delay)).where("canonical_url <> ''")
    return known.dropDuplicatesWithinWatermark(["canonical_url"]).drop("canonical_url")


def write_page_docs(docs: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append the documents to a Parquet table, exactly once."""
    writer = docs.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def write_batch(batch: DataFrame, number: int, path: str, time: str, min_text_chars: int = fixed.MIN_TEXT_CHARS) -> None:
    """The documents of the newest copy of each page in one batch, into the batch's own folder.

    Of copies with the same time the one with the greater body counts, so a repeated batch gives the same rows.
    """
    known = with_canonical_url(batch).where("canonical_url <> ''")
    others = [c for c in known.columns if c not in ("canonical_url", time)]
    newest = known.groupBy("canonical_url").agg(F.max(F.struct(time, *others)).alias("newest"))
    docs, _ = page_docs(newest.select("canonical_url", "newest.*"), min_text_chars)
    docs.write.mode("overwrite").parquet(f"{path}/batch={number}")


def store_pages(
    fetched: DataFrame, path: str, checkpoint: str, time: str, min_text_chars: int = fixed.MIN_TEXT_CHARS, **trigger
) -> StreamingQuery:
    """Write the documents of a stream of fetched pages (with an event time column ``time``), batch by batch."""

    def write(batch: DataFrame, number: int) -> None:
        write_batch(batch, number, path, time, min_text_chars)

    writer = fetched.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def current_pages(spark: SparkSession, path: str, time: str) -> DataFrame:
    """The newest document of each page; of equal times the one of the later batch.

    Only URLs, times and batch numbers are aggregated; texts are joined to what is left.
    """
    docs = spark.read.option("basePath", path).parquet(path)
    last = docs.groupBy("canonical_url").agg(F.max(F.struct(time, "batch")).alias("last"))
    last = last.select("canonical_url", f"last.{time}", "last.batch")
    return docs.join(last, ["canonical_url", time, "batch"], "left_semi").drop("batch")
