"""Character references. The one Python function in the library: Spark has no such built-in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: So much text at most is held as Python strings at a time, besides the Arrow batch itself.
SLICE_BYTES = 1 << 22


def _decoder(as_list: bool):
    """Arrow function over strings or lists of strings.

    Defined inside a function so that it is shipped by value: executors need no copy of this package.
    Declared non-deterministic only to keep the optimizer from pushing later filters below it, which
    would run the extraction once for the filter and once more for the result.

    Texts become Python strings some megabytes at a time, however large a batch is, and what Arrow has freed goes
    back to the system: a worker is reused, and so would otherwise keep the most that any batch ever took.
    """
    at_once = SLICE_BYTES

    def slices(values):
        """(first, number) of runs of values that have ``at_once`` bytes at most, or one value."""
        import bisect

        import pyarrow.compute as pc

        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(values), 0).cast("int64")).to_numpy()
        first = 0
        while first < len(values):
            before = ends[first - 1] if first else 0
            last = max(bisect.bisect_right(ends, before + at_once, first), first + 1)
            yield first, last - first
            first = last

    def decode(values):
        import html

        import pyarrow as pa
        import pyarrow.compute as pc

        pa.default_memory_pool().release_unused()
        marked = pc.fill_null(pc.match_substring(values, "&"), False)
        if not pc.any(marked).as_py():
            return values
        parts = []
        for run in slices(values):
            some, mask = values.slice(*run), marked.slice(*run)
            decoded = pa.array((html.unescape(text.as_py()) for text in some.filter(mask)), values.type)
            parts.append(pc.replace_with_mask(some, mask, decoded))
        return pa.concat_arrays(parts)

    def decode_text(texts):
        return decode(texts)

    def decode_lists(lists):
        import pyarrow as pa
        import pyarrow.compute as pc

        lengths = pc.fill_null(pc.list_value_length(lists), 0)
        ends = pc.cumulative_sum(lengths).cast(pa.int32())
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
        return pa.ListArray.from_arrays(offsets, decode(lists.flatten()), mask=pc.is_null(lists))

    if as_list:
        return F.arrow_udf(decode_lists, T.ArrayType(T.StringType())).asNondeterministic()
    return F.arrow_udf(decode_text, T.StringType()).asNondeterministic()


def unescape(text: Column) -> Column:
    """Decode character references; texts without an ampersand pass through untouched."""
    return _decoder(False)(text)


def unescape_each(texts: Column) -> Column:
    """The same for every element of an array of texts."""
    return _decoder(True)(texts)
