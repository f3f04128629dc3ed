"""The model of the PPM scores in one process: a trie as sorted arrays, for small texts."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.ppm import ORDER, SYMBOLS, _threshold
from pagewright.storage import materialize


@dataclass
class Trie:
    """For each order k: its (k + 1)-grams in ascending order, with counts."""

    grams: list[np.ndarray]
    counts: list[np.ndarray]

    def prepare(self) -> Trie:
        """Sums of contexts: totals, distinct bytes, and the logarithm of an escape, also after exclusion."""
        self.contexts, self.totals, self.distinct, self.place = [], [], [], []
        for grams, counts in zip(self.grams, self.counts, strict=True):
            contexts, begin = np.unique(grams >> np.uint64(8), return_index=True)
            self.contexts.append(contexts)
            self.totals.append(np.add.reduceat(counts, begin) if len(begin) else np.zeros(0))
            self.distinct.append(np.diff(np.append(begin, len(grams))))
            self.place.append(np.searchsorted(contexts, grams >> np.uint64(8)))
        # What is left of the next shorter context once a context's own bytes are excluded.
        self.left_total, self.left_distinct, self.parent = [None], [None], [None]
        for k in range(1, len(self.grams)):
            shorter = self.grams[k] & np.uint64((1 << (8 * k)) - 1)
            same = self.counts[k - 1][_find(self.grams[k - 1], shorter)[0]]
            used = np.bincount(self.place[k], weights=same, minlength=len(self.contexts[k]))
            parent = _find(self.contexts[k - 1], self.contexts[k] & np.uint64((1 << (8 * (k - 1))) - 1))[0]
            self.parent.append(parent)
            self.left_total.append(self.totals[k - 1][parent] - used)
            self.left_distinct.append(self.distinct[k - 1][parent] - self.distinct[k])
        return self

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probability of the last byte of each (ORDER + 1)-gram after those before."""
        result = np.zeros(len(grams))
        todo = np.arange(len(grams))  # grams whose byte has not been coded yet
        child = np.full(len(grams), -1)  # the longer context that escaped, if any
        for k in range(len(self.grams) - 1, -1, -1):
            part = grams[todo] & np.uint64((1 << (8 * (k + 1))) - 1)
            context, seen = _find(self.contexts[k], part >> np.uint64(8))
            above = child[todo]
            if k + 1 < len(self.grams) and len(self.contexts[k + 1]):
                safe = np.maximum(above, 0)
                total = np.where(above < 0, _at(self.totals[k], context), self.left_total[k + 1][safe])
                distinct = np.where(above < 0, _at(self.distinct[k], context), self.left_distinct[k + 1][safe])
            else:
                total, distinct = _at(self.totals[k], context), _at(self.distinct[k], context)
            place, hit = _find(self.grams[k], part)
            hit &= seen
            room = np.maximum(total, 1)
            result[todo[hit]] += np.log10((_at(self.counts[k], place)[hit] - 0.5) / room[hit])
            # A context with nothing left to code escapes for sure.
            miss = seen & ~hit
            escape = np.where(distinct > 0, 0.5 * distinct / room, 1.0)
            result[todo[miss]] += np.log10(escape[miss])
            child[todo] = np.where(seen, context, -1)
            todo = todo[~hit]
        unseen = SYMBOLS - (self.distinct[0][0] if len(self.distinct[0]) else 0)
        result[todo] -= math.log10(max(1, unseen))
        return result


def _find(sorted_values: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of values in a sorted array, and whether they are there."""
    if not len(sorted_values):
        return np.zeros(len(values), dtype=np.int64), np.zeros(len(values), dtype=bool)
    places = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return places, sorted_values[places] == values


def _at(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    return values[places] if len(values) else np.zeros(len(places))


def train(grams: DataFrame, most: int = 1_000_000) -> Trie:
    """The trie of the counted grams (key, n): all of them, or the ``most`` frequent of each order.

    Longer grams have smaller counts, so the least count of an order is never below that of shorter grams, and
    with a gram all its ends are in the trie.
    """
    orders, least = [], 1
    for k in range(ORDER + 1):
        ending = F.col("key").bitwiseAND((1 << (8 * (k + 1))) - 1).alias("key")
        part = grams.groupBy(ending).agg(F.sum("n").alias("n")) if k < ORDER else grams
        part = materialize(part)
        least = max(least, _threshold(part, most))
        rows = part.where(F.col("n") >= least).toArrow()
        keys, counts = rows["key"].to_numpy().view(np.uint64), rows["n"].to_numpy()
        order = np.argsort(keys)
        orders.append((keys[order], counts[order]))
    return Trie([x[0] for x in orders], [x[1] for x in orders])
