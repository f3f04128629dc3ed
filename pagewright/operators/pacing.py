"""When to fetch which URL: delays of hosts, and a schedule that keeps them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.urls import host_key
from pagewright.operators.prefix import running_total
from pagewright.operators.robots import speaking_to

WHOLE = r"^\s*[0-9]{1,9}\s*$"
RATE = r"^\s*([0-9]{1,9})/([0-9]{1,9})\s*$"


def robots_delays(rules: DataFrame, agent: str) -> DataFrame:
    """(host_key, crawl_delay, request_gap) in seconds, from the group of each robots file that speaks to ``agent``.

    Of repeated lines the last one counts; a crawl delay that is no whole number, and a rate that is not requests/seconds, do not. The
    gap is what a rate leaves between two requests.
    """
    value = F.col("path")
    delay = F.when((F.col("field") == "crawl-delay") & value.rlike(WHOLE), F.trim(value).cast("double"))
    requests, seconds = (F.regexp_extract(value, RATE, i).cast("double") for i in (1, 2))
    rate = (F.col("field") == "request-rate") & value.rlike(RATE)
    gap = F.when(rate & (requests > 0), seconds / requests)
    last = [
        F.max(F.when(c.isNotNull(), F.struct("rule_no", c.alias("value")))).alias(name)
        for name, c in (("crawl_delay", delay), ("request_gap", gap))
    ]
    groups = speaking_to(rules, agent).groupBy("host_key", "priority", "group_no").agg(*last)
    chosen = groups.groupBy("host_key").agg(
        F.min(F.struct("priority", "group_no", "crawl_delay.value", F.col("request_gap.value").alias("gap"))).alias("own")
    )
    return chosen.select("host_key", F.col("own.value").alias("crawl_delay"), F.col("own.gap").alias("request_gap"))


def crawl_schedule(urls: DataFrame, delays: DataFrame, delay: Column) -> DataFrame:
    """Add ``delay`` and ``earliest``, seconds from the start of the run, to a table with a canonical ``url``.

    The delay of a host is the largest of the parameter and what its robots file asks for. A host's URLs are fetched in URL
    order, each one delay behind the one before; hosts do not wait for each other.
    """
    keyed = urls.withColumn("host_key", host_key("url")).join(delays, "host_key", "left")
    own = F.greatest(delay.cast("double"), F.col("crawl_delay"), F.col("request_gap"))
    paced = keyed.withColumn("delay", own).drop("crawl_delay", "request_gap")
    others = [c for c in urls.columns if c != "url"]
    return running_total(paced, ["host_key"], ["url", *others], F.col("delay"), "earliest").drop("host_key")
