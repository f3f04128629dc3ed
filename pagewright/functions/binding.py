"""Helpers for composing large column expressions."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``; works inside lambdas as well."""
    return F.transform(F.array(value), body)[0]


def running(
    items: Column,
    start: Column,
    step: Callable[[Column, Column], Column],
    value: Callable[[Column], Column],
    kind: str,
    block: int = 128,
) -> Column:
    """Array of ``value(state)`` behind each item, where ``step(state, item)`` moves the state on.

    An aggregate that appends to a list copies the list each time, which is quadratic. Here a list never
    gets longer than ``block``: blocks of items are walked one after the other, and only the finished lists
    are kept, so the cost of n items is about n * block / 2 + (n / block) ** 2 / 2 copies.
    """

    def extended(lists: Column, state: Column, more: Column) -> Column:
        return F.struct(state.alias("state"), F.array_append(lists, more).alias("values"))

    def walk(state: Column, part: Column) -> Column:
        none = F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("values"))
        return F.aggregate(
            part,
            none,
            lambda now, item: let(step(now["state"], item), lambda s: extended(now["values"], s, value(s))),
            lambda end: end,
        )

    def by_blocks(whole: Column) -> Column:
        blocks = F.array_repeat(F.lit(0), F.ceil(F.size(whole) / block).cast("int"))
        parts = F.transform(blocks, lambda _, i: F.slice(whole, i * block + 1, block))
        none = F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("values"))
        walked = F.aggregate(
            parts,
            none,
            lambda now, part: let(
                walk(now["state"], part), lambda w: extended(now["values"], w["state"], w["values"])
            ),
            lambda end: end["values"],
        )
        return F.when(F.size(whole) > 0, F.flatten(walked)).otherwise(F.array().cast(f"array<{kind}>"))

    return let(items, by_blocks)


def after(text: Column, prefix_length: Column | int) -> Column:
    """The part of ``text`` behind its first ``prefix_length`` characters."""
    length = prefix_length if isinstance(prefix_length, Column) else F.lit(prefix_length)
    return F.substr(text, length + F.lit(1))


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def by_name(columns: int):
    """Let a column function take column names for its first ``columns`` arguments.

    A large expression over names is the same object every time, so it is built once per session.
    """

    def wrap(function):
        built: dict = {}

        @functools.wraps(function)
        def call(*args, **options):
            lead = [F.col(a) if isinstance(a, str) else a for a in args[:columns]]
            if any(isinstance(a, Column) for a in args[:columns]):
                return function(*lead, *args[columns:], **options)
            rest = [tuple(a) if isinstance(a, list) else a for a in args[columns:]]
            key = (SparkSession.getActiveSession(), args[:columns], tuple(rest), tuple(sorted(options.items())))
            if key not in built:
                built[key] = function(*lead, *args[columns:], **options)
            return built[key]

        return call

    return wrap
