"""Which URLs a site's robots file lets our agent read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.binding import let
from pagewright.functions.urls import host_key, path_and_query


def speaking_to(rules: DataFrame, agent: str) -> DataFrame:
    """Rules of groups that name ``agent`` (``priority`` 0) or all agents (1)."""
    name = agent.split("/")[0].lower()
    for_all = F.array_contains("agents", "*")
    for_us = ~for_all & F.exists("agents", lambda a: F.lit(name).contains(a))
    priority = F.when(for_us, F.lit(0)).when(for_all, F.lit(1))
    return rules.withColumn("priority", priority).where(F.col("priority").isNotNull())


def rules_for_agent(rules: DataFrame, agent: str) -> DataFrame:
    """(host_key, rules): the one group of each robots file that speaks to ``agent``, as an array.

    The first group naming the agent wins; else the first '*' group. One row holds the rules of one
    robots file, so its size is that of the file.
    """
    matching = speaking_to(rules, agent)
    rule = F.struct(
        "rule_no",
        ((F.col("field") == "allow") | (F.col("path") == "")).alias("allow"),
        "path",
    )
    is_path_rule = F.col("field").isin("allow", "disallow")
    by_group = matching.groupBy("host_key", "priority", "group_no").agg(
        F.array_sort(F.collect_list(F.when(is_path_rule, rule))).alias("rules")
    )
    return by_group.groupBy("host_key").agg(
        F.min_by("rules", F.struct("priority", "group_no")).alias("rules")
    )


def _verdict(rules: Column, url: Column) -> Column:
    def first_match(path: Column) -> Column:
        path = F.when(path == "", F.lit("/")).otherwise(path)
        matching = F.filter(rules, lambda r: path.startswith(r["path"]))
        return F.get(matching, F.lit(0))["allow"]

    return F.coalesce(let(path_and_query(url), first_match), F.lit(True))


def with_robots_verdict(urls: DataFrame, robots: DataFrame) -> DataFrame:
    """Add ``allowed`` to a table with a canonical ``url``.

    ``robots`` is (host_key, status, rules table columns) prepared by ``robots_by_host``. A host
    without a row could not be read, and is allowed.
    """
    keyed = urls.withColumn("host_key", host_key("url"))
    joined = keyed.join(robots, "host_key", "left")
    allowed = (
        F.when(F.col("robots_status").isin(401, 403), F.lit(False))
        .when((F.col("robots_status") >= 400) & (F.col("robots_status") < 500), F.lit(True))
        .otherwise(_verdict(F.col("robots_rules"), F.col("url")))
    )
    return joined.withColumn("allowed", allowed).drop("host_key", "robots_status", "robots_rules")


def robots_by_host(documents: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """(host_key, robots_status, robots_rules), one row per robots file (host_key, status, body)."""
    ours = rules_for_agent(rules, agent).withColumnRenamed("rules", "robots_rules")
    status = documents.groupBy("host_key").agg(F.min("status").alias("robots_status"))
    return status.join(ours, "host_key", "left")


def rule_index(rules: DataFrame, agent: str) -> tuple[DataFrame, DataFrame]:
    """The path rules that hold for ``agent`` as (host_key, prefix, rule_no, allow), the first of equal prefixes, and the lengths of prefixes
    that occur as (host_key, lengths)."""
    spoken = speaking_to(rules, agent)
    group = spoken.groupBy("host_key").agg(F.min(F.struct("priority", "group_no")).alias("own"))
    group = group.select("host_key", "own.priority", "own.group_no")
    paths = spoken.join(group, ["host_key", "priority", "group_no"]).where(F.col("field").isin("allow", "disallow"))
    allow = (F.col("field") == "allow") | (F.col("path") == "")
    first = F.min(F.struct("rule_no", allow.alias("allow"))).alias("first")
    index = paths.groupBy("host_key", F.col("path").alias("prefix")).agg(first).select("host_key", "prefix", "first.rule_no", "first.allow")
    lengths = index.groupBy("host_key").agg(F.array_sort(F.collect_set(F.length("prefix"))).alias("lengths"))
    return index, lengths


def with_indexed_verdict(urls: DataFrame, documents: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """Like ``with_robots_verdict``, for robots files of any number of rules.

    A URL does not look at every rule of its host: it is cut to the lengths of prefixes that occur, and the pieces meet the rules by
    equality. The rule with the lowest number decides. A host with a third of all URLs is split, as each side of the joins has
    one row per key on the right.
    """
    index, lengths = rule_index(rules, agent)
    path = path_and_query(F.col("url"))
    keyed = urls.select("url").distinct().withColumn("host_key", host_key("url"))
    cut = keyed.join(lengths, "host_key").withColumn("path", F.when(path == "", F.lit("/")).otherwise(path))
    pieces = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substr("path", F.lit(1), n))
    met = cut.select("url", "host_key", F.explode(pieces).alias("prefix")).join(index, ["host_key", "prefix"])
    verdicts = met.groupBy("url").agg(F.min(F.struct("rule_no", "allow")).alias("first")).select("url", F.col("first.allow").alias("ruled"))
    status = documents.groupBy("host_key").agg(F.min("status").alias("robots_status"))
    joined = urls.withColumn("host_key", host_key("url")).join(status, "host_key", "left").join(verdicts, "url", "left")
    allowed = (
        F.when(F.col("robots_status").isin(401, 403), F.lit(False))
        .when((F.col("robots_status") >= 400) & (F.col("robots_status") < 500), F.lit(True))
        .otherwise(F.coalesce("ruled", F.lit(True)))
    )
    return joined.withColumn("allowed", allowed).select(*[F.col(f"`{c}`") for c in urls.columns], "allowed")
