"""Page and site dumps as Markdown, JSON and XML text.

A page dump is one string column. A site dump is a table of chunks (site_id, section, position, chunk):
the file is the chunks in that order, one per line block. Sites of any size stay distributed that way;
``sites.assemble`` turns the small ones into single strings, ``sites.write_dump`` writes all of them.
"""

from __future__ import annotations

import html as _html
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright import __version__
from pagewright.schemas import CrawlParams


class Style(NamedTuple):
    """Names that appear in a dump."""

    tool: str = "pagewright"
    version: str = __version__
    marker: str = "PAGEWRIGHT"

    @property
    def root(self) -> str:
        return f"{self.tool}Dump"


TEXT_FIELDS = (
    "url",
    "fetched_url",
    "extracted_at",
    "title",
    "subtitle",
    "author",
    "date_published",
    "language",
    "text",
)
# Fields of a page in JSON, sorted.
JSON_FIELDS = (
    "author",
    "date_published",
    "extracted_at",
    "extraction_attempts",
    "fetched_url",
    "language",
    "subtitle",
    "text",
    "title",
    "url",
    "warnings",
)
DEFAULT_STYLE = Style()


def _shown(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def _listed(items: Column) -> Column:
    return F.when(F.size(items) == 0, F.lit("-")).otherwise(F.array_join(items, "\n"))


def _field(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), _shown(value))


def page_markdown(page: Column, style: Style = DEFAULT_STYLE, top_header: bool = True) -> Column:
    """Delimited block of one page document (a struct)."""
    attempts = F.transform(
        page["extraction_attempts"],
        lambda a: F.concat(
            F.lit("  - strategy="),
            a["strategy"],
            F.lit("; text_len="),
            a["text_len"].cast("string"),
            F.lit("; success="),
            a["success"].cast("string"),
        ),
    )
    warnings = F.transform(page["warnings"], lambda w: F.concat(F.lit("  - "), w))
    header = (
        [
            F.lit(f"# {style.tool} page dump"),
            _field("Source URL", page["url"]),
            _field("Extracted at", page["extracted_at"]),
            F.lit(""),
        ]
        if top_header
        else []
    )
    return F.concat_ws(
        "\n",
        *header,
        F.lit(f"--- {style.marker}_PAGE ---"),
        _field("URL", page["url"]),
        _field("Fetched-URL", page["fetched_url"]),
        _field("Title", page["title"]),
        _field("Subtitle", page["subtitle"]),
        _field("Language", page["language"]),
        _field("Published", page["date_published"]),
        _field("Extracted-At", page["extracted_at"]),
        _field("Text-Length", F.length(page["text"])),
        F.lit("Attempts:"),
        _listed(attempts),
        F.lit("Warnings:"),
        _listed(warnings),
        F.lit(f"--- {style.marker}_TEXT ---"),
        page["text"],
        F.lit(f"--- END_{style.marker}_PAGE ---\n"),
    )


def _json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def _json_string(value: Column) -> Column:
    """A JSON string or null."""
    return F.regexp_replace(_json(F.struct(value.alias("v"))), r"(?s)^\{\"v\":|\}\z", "")


def page_json_object(page: Column) -> Column:
    ordered = [page[name].alias(name) for name in JSON_FIELDS if name != "extraction_attempts"]
    attempts = F.transform(
        page["extraction_attempts"],
        lambda a: F.struct(
            a["strategy"].alias("strategy"), a["success"].alias("success"), a["text_len"].alias("text_len")
        ),
    ).alias("extraction_attempts")
    ordered.insert(JSON_FIELDS.index("extraction_attempts"), attempts)
    return _json(F.struct(*ordered))


def _tool_json(style: Style) -> str:
    return f'{{"name":"{style.tool}","version":"{style.version}"}}'


def page_json(page: Column, style: Style = DEFAULT_STYLE) -> Column:
    run = F.struct(
        page["extracted_at"].alias("extracted_at"), F.lit("page").alias("mode"), page["url"].alias("source_url")
    )
    return F.concat(
        F.lit('{"pages":['),
        page_json_object(page),
        F.lit('],"run":'),
        _json(run),
        F.lit(f',"tool":{_tool_json(style)}}}\n'),
    )


def xml_escape(text: Column) -> Column:
    escaped = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(escaped, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def xml_element(name: str, value: Column) -> Column:
    """An element with text, or an empty element for NULL and ''."""
    text = _shown(value)
    filled = F.concat(F.lit(f"<{name}>"), xml_escape(text), F.lit(f"</{name}>"))
    return F.when(text == "", F.lit(f"<{name} />")).otherwise(filled)


def _xml_group(name: str, items: Column) -> Column:
    filled = F.concat(F.lit(f"<{name}>"), F.array_join(items, ""), F.lit(f"</{name}>"))
    return F.when(F.size(items) == 0, F.lit(f"<{name} />")).otherwise(filled)


def page_xml_element(page: Column) -> Column:
    attempts = F.transform(
        page["extraction_attempts"],
        lambda a: F.concat(
            F.lit("<attempt>"),
            *[xml_element(name, a[name]) for name in ("strategy", "text_len", "success")],
            F.lit("</attempt>"),
        ),
    )
    warnings = F.transform(page["warnings"], lambda w: xml_element("warning", w))
    return F.concat(
        F.lit("<page>"),
        *[xml_element(name, page[name]) for name in TEXT_FIELDS],
        _xml_group("extraction_attempts", attempts),
        _xml_group("warnings", warnings),
        F.lit("</page>"),
    )


def _xml_literal(name: str, value: str) -> str:
    text = _html.escape(value, quote=False)
    return f"<{name}>{text}</{name}>" if text else f"<{name} />"


def _tool_xml(style: Style) -> str:
    return f"<tool>{_xml_literal('name', style.tool)}{_xml_literal('version', style.version)}</tool>"


def page_xml(page: Column, style: Style = DEFAULT_STYLE) -> Column:
    return F.concat(
        F.lit(f"<{style.root}>{_tool_xml(style)}<run><mode>page</mode>"),
        xml_element("source_url", page["url"]),
        xml_element("extracted_at", page["extracted_at"]),
        F.lit("</run><pages>"),
        page_xml_element(page),
        F.lit(f"</pages></{style.root}>\n"),
    )


def render_page(page: Column, fmt: str, style: Style = DEFAULT_STYLE) -> Column:
    from pagewright.functions.text import file_extension

    return {"md": page_markdown, "json": page_json, "xml": page_xml}[file_extension(fmt)](page, style)


def param_values(params: CrawlParams) -> dict:
    """The options that a dump records, in their order."""
    return {
        "max_pages": params.max_pages,
        "delay": params.delay,
        "jitter": params.jitter,
        "concurrency": params.concurrency,
        "respect_robots": params.respect_robots,
        "include_external": params.include_external,
        "query_filter": params.query_filter,
        "allow_patterns": list(params.allow_patterns),
        "deny_patterns": list(params.deny_patterns),
    }
