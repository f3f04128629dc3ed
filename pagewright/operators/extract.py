"""Page extraction: candidate texts per strategy, scores, best candidate, page document.

The whole chain is a projection over the page table. Nothing is shuffled, exploded or collected; a
page's candidates live in arrays of its own row.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import entities, fixed, html
from pagewright.functions.binding import blank_to_null, by_name, let, running
from pagewright.functions.text import candidate_score, normalize_text, utc_now_iso

META_FIELDS = ("title", "subtitle", "author", "date_published", "language")


class Strategy(NamedTuple):
    """What a strategy lets through; add your own to the list given to the operators."""

    name: str
    recall: bool = False
    tables: bool = False
    links: bool = False
    comments: bool = False


STRATEGIES = (
    Strategy("default"),
    Strategy("favor_recall", recall=True),
    Strategy("include_tables", tables=True),
    Strategy("include_links", links=True),
    Strategy("include_comments", comments=True),
    Strategy("relaxed_combo", recall=True, tables=True, links=True, comments=True),
)
RECALL = Strategy("recall", recall=True)


@by_name(1)
def html_to_text(markup: Column) -> Column:
    """Plain text of a piece of HTML."""
    return normalize_text(entities.unescape(html.encoded_text(markup)))


def with_page_parts(pages: DataFrame) -> DataFrame:
    """Add ``segments`` and ``meta`` (both decoded) to a table with an ``html`` column; drop html."""
    marked = pages.withColumn("markup", html.page_markup("html")).drop("html")
    cut = marked.select(
        *[c for c in marked.columns if c != "markup"],
        html.segments("markup").alias("encoded"),
        html.metadata("markup").alias("encoded_meta"),
    )
    decoded = cut.select(
        *[c for c in cut.columns if not c.startswith("encoded")],
        F.col("encoded.place").alias("place"),
        entities.unescape_each(F.col("encoded.text")).alias("text_parts"),
        entities.unescape_each(F.col("encoded.link")).alias("link_parts"),
        *[entities.unescape(F.col(f"encoded_meta.{name}")).alias(f"meta_{name}") for name in META_FIELDS],
    )
    parts = ("place", "text_parts", "link_parts", *[f"meta_{name}" for name in META_FIELDS])
    return decoded.select(
        *[c for c in decoded.columns if c not in parts],
        F.transform(
            F.arrays_zip("place", "text_parts", "link_parts"),
            lambda z: F.struct(
                z["place"].alias("place"), z["text_parts"].alias("text"), z["link_parts"].alias("link")
            ),
        ).alias("segments"),
        F.struct(*[F.col(f"meta_{name}").alias(name) for name in META_FIELDS]).alias("meta"),
    )


def _has(segment: Column, bit: int) -> Column:
    return segment["place"].bitwiseAND(F.lit(bit)) != 0


def strategy_array(strategies: DataFrame) -> Column:
    """A table of strategies (ord, name, recall, tables, links, comments) as one array of structs.

    The table is a handful of options; its rows come to the driver and become part of the plan, so pages meet them without a join.
    """
    rows = strategies.orderBy("ord").select(*[F.col(n) for n in Strategy._fields]).collect()
    one = lambda row: F.struct(*[F.lit(row[n]).alias(n) for n in Strategy._fields])
    return F.array(*map(one, rows))


def texts_of_strategies(segments: Column, strategies: Column) -> Column:
    """Array of (strategy, text), one for each struct in the array ``strategies``.

    The expression is the same size however many strategies there are.
    """
    has_main = F.exists(segments, lambda s: _has(s, html.IN_MAIN) & ~_has(s, html.HIDDEN))

    def text(strategy: Column, has_main: Column) -> Column:
        def wanted(segment: Column) -> Column:
            inside = F.when(has_main, _has(segment, html.IN_MAIN)).otherwise(~_has(segment, html.IN_BOILERPLATE))
            scope = F.when(strategy["recall"], ~_has(segment, html.IN_NAV_FOOTER)).otherwise(inside)
            tables = strategy["tables"] | ~_has(segment, html.IN_TABLE)
            comments = strategy["comments"] | ~_has(segment, html.IN_COMMENTS)
            return scope & tables & comments & ~_has(segment, html.HIDDEN)

        def shown(segment: Column) -> Column:
            target = F.concat(segment["text"], F.lit(" ("), segment["link"], F.lit(") "))
            return F.when(strategy["links"] & (segment["link"] != ""), target).otherwise(segment["text"])

        return normalize_text(F.array_join(F.transform(F.filter(segments, wanted), shown), " "))

    def every(has_main: Column) -> Column:
        return F.transform(
            strategies, lambda s: F.struct(s["name"].alias("strategy"), text(s, has_main).alias("text"))
        )

    return let(F.coalesce(has_main, F.lit(False)), every)


@by_name(1)
def strategy_text(segments: Column, strategy: Strategy) -> Column:
    """Text of the segments a strategy lets through."""

    def build(has_main: Column) -> Column:
        def wanted(segment: Column) -> Column:
            scope = F.when(has_main, _has(segment, html.IN_MAIN)).otherwise(
                ~_has(segment, html.IN_BOILERPLATE)
            )
            keep = ~_has(segment, html.IN_NAV_FOOTER) if strategy.recall else scope
            keep = keep & ~_has(segment, html.HIDDEN)
            if not strategy.tables:
                keep = keep & ~_has(segment, html.IN_TABLE)
            if not strategy.comments:
                keep = keep & ~_has(segment, html.IN_COMMENTS)
            return keep

        def shown(segment: Column) -> Column:
            if not strategy.links:
                return segment["text"]
            target = F.concat(segment["text"], F.lit(" ("), segment["link"], F.lit(") "))
            return F.when(segment["link"] != "", target).otherwise(segment["text"])

        return F.array_join(F.transform(F.filter(segments, wanted), shown), " ")

    has_main = F.exists(segments, lambda s: _has(s, html.IN_MAIN) & ~_has(s, html.HIDDEN))
    return normalize_text(let(F.coalesce(has_main, F.lit(False)), build))


def _candidate(strategy: str, text: Column, meta: Column | None = None) -> Column:
    nothing = F.lit(None).cast("string")
    return F.struct(
        F.lit(strategy).alias("strategy"),
        text.alias("text"),
        *[(meta[name] if meta is not None else nothing).alias(name) for name in META_FIELDS],
    )


def with_candidates(
    parts: DataFrame,
    min_text_chars: int = fixed.MIN_TEXT_CHARS,
    strategies: tuple[Strategy, ...] = STRATEGIES,
) -> DataFrame:
    """Add ``tried``, the candidates in the order of the attempts, empty ones included.

    The first strategy always runs; the others only where its text is short (a lazy branch, so long
    pages never evaluate them). The metadata candidate always runs, on the recall text.
    """
    first, *others = strategies
    base = parts.withColumn("first_text", strategy_text("segments", first)).withColumn(
        "recall_text", strategy_text("segments", RECALL)
    )

    def text_of(strategy: Strategy) -> Column:
        if strategy._replace(name=RECALL.name) == RECALL:
            return F.col("recall_text")
        return strategy_text("segments", strategy)

    opening = F.array(_candidate(first.name, F.col("first_text")))
    ladder = F.array(
        _candidate(first.name, F.col("first_text")), *[_candidate(s.name, text_of(s)) for s in others]
    )
    meta = F.col("meta")
    from_meta = _candidate(fixed.METADATA_CANDIDATE, F.col("recall_text"), meta)
    found_any = F.col("recall_text") != ""
    for name in META_FIELDS:
        found_any = found_any | meta[name].isNotNull()
    tried = F.concat(
        F.when(F.length("first_text") >= min_text_chars, opening).otherwise(ladder),
        F.when(found_any, F.array(from_meta)).otherwise(F.filter(F.array(from_meta), lambda c: F.lit(False))),
    )
    return base.withColumn("tried", tried).drop("segments", "first_text", "recall_text")


@by_name(1)
def best_candidate(candidates: Column) -> Column:
    """Candidate with the highest score, the earliest one on ties; NULL if none has a text."""
    ranked = F.transform(
        candidates,
        lambda c, i: F.struct(
            candidate_score(c["text"], c["title"]).alias("score"), (-i).alias("turn"), c.alias("candidate")
        ),
    )
    return F.array_max(F.filter(ranked, lambda r: r["candidate"]["text"] != ""))["candidate"]


@by_name(1)
def attempt_log(candidates: Column) -> Column:
    return F.transform(
        candidates,
        lambda c: F.struct(
            c["strategy"].alias("strategy"),
            F.length(c["text"]).alias("text_len"),
            (c["text"] != "").alias("success"),
        ),
    )


def short_text_warnings(text: Column, min_text_chars: int) -> Column:
    """Warnings for a missing (NULL) or short text."""
    message = F.concat(
        F.lit("Extracted text length ("),
        F.length(text).cast("string"),
        F.lit(f") is below threshold ({min_text_chars})."),
    )
    return (
        F.when(text.isNull(), F.array(F.lit(fixed.NO_TEXT_WARNING)))
        .when(F.length(text) < min_text_chars, F.array(message))
        .otherwise(F.array().cast("array<string>"))
    )


def backfilled(best: Column, meta: Column, field: str) -> Column:
    """A field of the best candidate, or the page's metadata where the candidate has none.

    Pages without any candidate keep their fields empty.
    """
    value = F.coalesce(blank_to_null(best[field]), blank_to_null(meta[field]), best[field])
    return F.when(best.isNotNull(), value)


def page_candidates(
    fetched: DataFrame,
    min_text_chars: int = fixed.MIN_TEXT_CHARS,
    strategies: tuple[Strategy, ...] = STRATEGIES,
) -> DataFrame:
    """Fetched rows with ``tried`` and ``meta`` instead of their HTML."""
    return with_candidates(with_page_parts(fetched), min_text_chars, strategies)


def build_page_docs(
    fetched: DataFrame,
    min_text_chars: int = fixed.MIN_TEXT_CHARS,
    api_candidates: DataFrame | None = None,
    extracted_at: Column | None = None,
    strategies: tuple[Strategy, ...] = STRATEGIES,
) -> DataFrame:
    """One page document per fetched row, with any further columns of the input kept.

    ``api_candidates(subdomain, api_title, api_text)`` turns on the API fallback for pages whose best
    text stays short; see ``operators.api``.
    """
    from pagewright.operators import api

    extra = [c for c in fetched.columns if c not in ("url", "fetched_url", "status", "content_type", "html")]

    def judged(pages: DataFrame) -> DataFrame:
        """Only the best candidate and the attempt log go on, not the texts that were tried."""
        frame = page_candidates(pages, min_text_chars, strategies)
        return frame.withColumns({"best": best_candidate("tried"), "attempts": attempt_log("tried")}).drop("tried")

    if api_candidates is None:
        frame = judged(fetched)
    else:
        # Pages without an embedded description never meet the join.
        subdomain = api.find_api_subdomain("html")
        embedding = judged(fetched.where(subdomain.isNotNull()).withColumn("subdomain", subdomain))
        plain = judged(fetched.where(subdomain.isNull()))
        frame = plain.unionByName(api.with_api_fallback(embedding, api_candidates, min_text_chars))
    best, meta = F.col("best"), F.col("meta")
    stamp = extracted_at if extracted_at is not None else utc_now_iso()
    return frame.select(
        *[F.col(c) for c in extra],
        F.col("url"),
        F.col("fetched_url"),
        stamp.alias("extracted_at"),
        *[backfilled(best, meta, name).alias(name) for name in META_FIELDS],
        F.coalesce(best["text"], F.lit("")).alias("text"),
        F.col("attempts").alias("extraction_attempts"),
        short_text_warnings(best["text"], min_text_chars).alias("warnings"),
    )


def html_tokens(pages: DataFrame, key: str) -> DataFrame:
    """Event stream of each page: (key, pos, kind, name, text, skip_depth), kind open/close/empty/raw/text.

    ``skip_depth`` counts the script, style and template elements around an event. It is a running
    sum over the page's own events that never falls below 0 on a stray closing tag.
    """
    pattern = rf"(?is){html.NOT_TEXT}|{html.ANY_TAG}|[^<]++|<"
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(pattern), F.lit(0))

    def event(token: Column) -> Column:
        named = token.rlike("(?i)^</?[a-z]")
        raw = token.rlike(r"(?i)^<(?:script|style)[\s/>]") & token.rlike(r"(?is)(?<!/)>")
        kind = (
            F.when(token.rlike(r"^<[!?]"), F.lit(None))
            .when(token.rlike("(?i)^</[a-z]"), F.lit("close"))
            .when(html.is_empty_tag(token), F.lit("empty"))
            .when(raw, F.lit("raw"))
            .when(token.rlike("(?i)^<[a-z]"), F.lit("open"))
            .otherwise(F.lit("text"))
        )
        return F.struct(
            kind.alias("kind"),
            F.when(named, html.tag_name(token)).otherwise(F.lit("")).alias("name"),
            F.when(named, F.lit("")).otherwise(token).alias("text"),
        )

    def step(depth: Column, item: Column) -> Column:
        counted = item["name"].isin(*fixed.SKIP_TAGS)
        return (
            F.when(counted & (item["kind"] == "open"), depth + 1)
            .when(counted & (item["kind"] == "close"), F.greatest(depth - 1, F.lit(0)))
            .otherwise(depth)
        )

    def with_depths(items: Column) -> Column:
        depths = running(items, F.lit(0), step, lambda depth: depth, "int")
        return F.zip_with(items, depths, lambda item, depth: item.withField("skip_depth", depth))

    events = pages.select(key, F.posexplode(let(F.transform(found, event), with_depths)))
    return events.where("col.kind is not null").select(key, "pos", "col.kind", "col.name", "col.text", "col.skip_depth")
