"""Robots files as a table of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.binding import running
from pagewright.functions.text import split_lines, strip
from pagewright.functions.urls import lenient_unquote

_RULES = ("allow", "disallow", "crawl-delay", "request-rate")
_STATE = "struct<group_no:int,open:boolean,after_agent:boolean,agents:array<string>>"


def read_robots(documents: DataFrame) -> DataFrame:
    """(host_key, group_no, rule_no, agents, field, path) of robots files (host_key, body).

    A group starts at the first user-agent line after rules, after an empty line or at the top. Rules
    behind an empty line without a new user-agent line belong to no group. A projection: the lines of a file are walked in its
    own row, with the group that is open as the state.
    """
    body = F.replace("body", F.lit("\r\n"), F.lit("\n"))

    def event(line: Column, number: Column) -> Column:
        content = strip(F.substring_index(line, "#", 1))
        field = F.when(content.contains(":"), F.lower(strip(F.substring_index(content, ":", 1)))).otherwise("")
        value = lenient_unquote(strip(F.regexp_replace(content, "(?s)^[^:]*:?", "")), False)
        return F.struct(
            number.alias("line_no"), field.alias("field"), value.alias("value"), (line == "").alias("blank")
        )

    events = F.filter(
        F.transform(split_lines(body), event),
        lambda e: e["blank"] | (e["field"] == "user-agent") | e["field"].isin(*_RULES),
    )

    def step(state: Column, e: Column) -> Column:
        agent = e["field"] == "user-agent"
        opens, name = agent & ~state["after_agent"], F.lower(e["value"])
        return F.struct(
            (state["group_no"] + opens.cast("int")).alias("group_no"),
            F.when(agent, F.lit(True)).when(e["blank"], F.lit(False)).otherwise(state["open"]).alias("open"),
            agent.alias("after_agent"),
            F.when(opens, F.array(name)).when(agent, F.array_append(state["agents"], name)).otherwise(state["agents"]).alias("agents"),
        )

    none = F.array().cast("array<string>")
    begin = F.struct(F.lit(0).alias("group_no"), F.lit(False).alias("open"), F.lit(False).alias("after_agent"), none.alias("agents"))
    states = running(F.col("events"), begin, step, lambda s: s, _STATE)
    walked = documents.select("host_key", events.alias("events")).select("host_key", F.arrays_zip("events", states.alias("states")).alias("zipped"))
    rules = walked.select("host_key", F.explode("zipped").alias("z")).where(F.col("z.states.open") & F.col("z.events.field").isin(*_RULES))
    return rules.select(
        "host_key",
        F.col("z.states.group_no").alias("group_no"),
        F.col("z.events.line_no").alias("rule_no"),
        F.col("z.states.agents").alias("agents"),
        F.col("z.events.field").alias("field"),
        F.col("z.events.value").alias("path"),
    )
