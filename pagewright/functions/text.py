"""Text columns: normalisation, line statistics, file names and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions import fixed
from pagewright.functions.binding import let

# All characters the Python string type calls white space, from its own definition.
WHITESPACE = "".join(char for char in map(chr, range(0x3001)) if char.isspace())
# Characters besides the newline that end a line.
LINE_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def strip(text: Column) -> Column:
    """Remove Unicode white space on both sides."""
    return F.btrim(text, F.lit(WHITESPACE))


def has_text(text: Column) -> Column:
    """Whether anything but white space is in the text; looks no further than the first such character."""
    return F.ltrim(text, F.lit(WHITESPACE)) != ""


def normalize_text(text: Column) -> Column:
    """Single spaces, no spaces around newlines, at most one empty line in a row; NULL gives ''."""
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    text = F.replace(F.replace(text, F.lit("\r"), F.lit("\n")), F.lit("\t"), F.lit(" "))
    # Plain replacements search bytes; only runs of spaces and newlines need a pattern.
    text = F.regexp_replace(text, " {2,}", " ")
    text = F.replace(F.replace(text, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))
    return strip(F.regexp_replace(text, "\n{3,}", "\n\n"))


def split_lines(text: Column) -> Column:
    """Array of lines. "\\r\\n" gives an empty line more, so use it where blank lines do not count."""
    for char in LINE_BREAKS:
        text = F.replace(text, F.lit(char), F.lit("\n"))
    return F.split(text, "\n")


def stripped_lines(text: Column) -> Column:
    """Array of the non-blank lines, stripped."""
    return F.filter(F.transform(split_lines(text), strip), lambda line: line != "")


def repetition_penalty(text: Column) -> Column:
    """How many characters to take off the score of a text that repeats its lines."""

    def penalty(total: Column, ratio: Column) -> Column:
        weight = F.least(F.length(text), F.lit(fixed.PENALTY_MAX_CHARS))
        return (
            F.when(total < fixed.PENALTY_MIN_LINES, F.lit(0))
            .when(ratio > F.lit(fixed.PENALTY_RATIO), F.lit(0))
            .otherwise(((F.lit(1.0) - ratio) * weight).cast("int"))
        )

    return let(
        stripped_lines(text),
        lambda lines: let(
            F.size(F.array_distinct(lines)).cast("double") / F.greatest(F.size(lines), F.lit(1)),
            lambda ratio: penalty(F.size(lines), ratio),
        ),
    )


def candidate_score(text: Column, title: Column) -> Column:
    """Length of the text, plus a bonus for an own title, minus the repetition penalty."""
    bonus = F.when(F.coalesce(title, F.lit("")) != "", F.lit(fixed.TITLE_BONUS)).otherwise(F.lit(0))
    return F.length(text) + bonus - repetition_penalty(text)


def slugify(value: Column, max_len: int = 80, fallback: str = "page") -> Column:
    """File-safe name of a URL or any other text."""
    slug = F.regexp_replace(F.lower(strip(value)), "https?://", "")
    slug = F.btrim(F.regexp_replace(slug, "[^a-z0-9]+", "-"), F.lit("-"))
    slug = F.when(slug == "", F.lit(fallback)).otherwise(slug)
    return F.rtrim(F.left(slug, F.lit(max_len)), F.lit("-"))


def file_extension(fmt: str) -> str:
    fmt = fmt.lower()
    if fmt not in ("md", "markdown", "json", "xml"):
        raise ValueError(f"unknown dump format {fmt!r}")
    return "md" if fmt == "markdown" else fmt


def page_filename(url: Column, fmt: str) -> Column:
    return F.concat(slugify(url), F.lit("." + file_extension(fmt)))


def site_filename(host: Column, finished_at: Column, fmt: str) -> Column:
    name = F.when(F.coalesce(host, F.lit("")) == "", F.lit("site")).otherwise(host)
    stamp = F.translate(finished_at, ":-", "")
    return F.concat(
        F.lit("site_"), slugify(name), F.lit("_"), stamp, F.lit("." + file_extension(fmt))
    )


def utc_iso(time: Column) -> Column:
    """A timestamp in UTC, to the second."""
    return F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def utc_now_iso() -> Column:
    """Time of the run in UTC, to the second, the same in every row of a query."""
    return utc_iso(F.current_timestamp())
