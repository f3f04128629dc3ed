"""Site dumps: counts, chunks of the three formats, assembled strings and files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions.text import file_extension, site_filename
from pagewright.functions.urls import url_host
from pagewright.operators import render
from pagewright.operators.prefix import running_total
from pagewright.operators.render import DEFAULT_STYLE, Style
from pagewright.schemas import CrawlParams
from pagewright.storage import materialize

# Longest site dump that is put together as one string; a row cannot hold much more. Longer ones stay chunks.
MAX_ASSEMBLED_CHARS = 512 * 1024 * 1024


def site_counts(sites: DataFrame, sitemap: DataFrame, pages: DataFrame) -> DataFrame:
    """Sites with ``discovered_urls_count`` and ``visited_urls_count``; counted before the shuffle."""
    both = sitemap.select("site_id", F.lit(1).alias("found"), F.lit(0).alias("visited")).unionByName(
        pages.select("site_id", F.lit(0).alias("found"), F.lit(1).alias("visited"))
    )
    counted = both.groupBy("site_id").agg(F.sum("found").alias("found"), F.sum("visited").alias("visited"))
    return (
        sites.join(counted, "site_id", "left")
        .withColumn("discovered_urls_count", F.coalesce("found", F.lit(0)))
        .withColumn("visited_urls_count", F.coalesce("visited", F.lit(0)))
        .drop("found", "visited")
    )


def skip_reason_counts(skipped: DataFrame) -> DataFrame:
    """(site_id, reason, n): how many URLs each site left out for each reason."""
    return skipped.groupBy("site_id", "reason").agg(F.count(F.lit(1)).alias("n"))


def skip_reason_rollup(skipped: DataFrame) -> DataFrame:
    """(site_id, reason, level, n): counts per site and reason (level 0), per site (1), per reason (2) and in all (3).

    Columns that a level sums over are NULL.
    """
    counts = skip_reason_counts(skipped).cube("site_id", "reason")
    return counts.agg(F.grouping_id().cast("int").alias("level"), F.sum("n").alias("n"))


def page_struct(pages: DataFrame) -> Column:
    names = [*render.TEXT_FIELDS, "extraction_attempts", "warnings"]
    return F.struct(*[pages[name].alias(name) for name in names])


def _chunks(frame: DataFrame, section: int, position: Column, chunk: Column) -> DataFrame:
    return frame.select(
        "site_id", F.lit(section).alias("section"), position.alias("position"), chunk.alias("chunk")
    )


def _union(*parts: DataFrame) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _items(frame: DataFrame, section: int, position: Column, item: Column, first_mark: str, mark: str) -> DataFrame:
    """Chunks of a list: the first item of a site starts with ``first_mark``, others with ``mark``.

    The first position per site comes from an aggregate, so no window over a site is needed.
    """
    placed = frame.select("site_id", position.alias("position"), item.alias("item"))
    if first_mark == mark:
        return _chunks(placed, section, F.col("position"), F.concat(F.lit(mark), F.col("item")))
    first = placed.groupBy("site_id").agg(F.min("position").alias("first_position"))
    joined = placed.join(first, "site_id")
    lead = F.when(F.col("position") == F.col("first_position"), F.lit(first_mark)).otherwise(F.lit(mark))
    return _chunks(joined, section, F.col("position"), F.concat(lead, F.col("item")))


def _counted_skips(skipped: DataFrame) -> DataFrame:
    """Equal skips of a site as one row with their number."""
    return skipped.groupBy("site_id", "url", "reason").agg(F.count(F.lit(1)).alias("times"))


def _repeated(item: Column, times: Column, separator: str) -> Column:
    return F.array_join(F.array_repeat(item, times.cast("int")), separator)


def _skip_position() -> Column:
    return F.concat_ws("\t", "url", "reason")


def markdown_chunks(
    sites: DataFrame, sitemap: DataFrame, pages: DataFrame, params: CrawlParams, style: Style = DEFAULT_STYLE
) -> DataFrame:
    values = render.param_values(params)
    shown = [
        f"  {name}: {str(value).lower() if isinstance(value, bool) else value}"
        for name, value in values.items()
        if not isinstance(value, list)
    ]
    header = F.concat_ws(
        "\n",
        F.lit(f"# {style.tool} site dump"),
        F.concat(F.lit("Start URL: "), F.col("start_url")),
        F.concat(F.lit("Extracted at: "), F.col("finished_at")),
        F.lit("\n".join(["Params:", *shown, "## Sitemap"])),
        F.when(F.col("discovered_urls_count") == 0, F.lit("- (empty)")),
    )
    entry = F.concat(F.lit("- [depth="), F.col("depth").cast("string"), F.lit("] "), F.col("url"))
    block = render.page_markdown(page_struct(pages), style, top_header=False)
    return _union(
        _chunks(sites, 0, F.lit(""), header),
        _chunks(sitemap, 1, F.col("url"), entry),
        _chunks(pages, 2, F.col("url"), F.concat(F.lit("\n"), F.rtrim(block, F.lit("\n")))),
    )


def json_chunks(
    sites: DataFrame,
    sitemap: DataFrame,
    pages: DataFrame,
    skipped: DataFrame,
    params: CrawlParams,
    style: Style = DEFAULT_STYLE,
) -> DataFrame:
    crawl = json.dumps(render.param_values(params), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    before_sitemap = F.concat(
        F.lit(f'],"run":{{"crawl_params":{crawl},"discovered_urls_count":'),
        F.col("discovered_urls_count").cast("string"),
        F.lit(',"finished_at":'),
        render._json_string(F.col("finished_at")),
        F.lit(',"mode":"site","sitemap":['),
    )
    tail = F.concat(
        F.lit('],"start_url":'),
        render._json_string(F.col("start_url")),
        F.lit(',"started_at":'),
        render._json_string(F.col("started_at")),
        F.lit(',"visited_urls_count":'),
        F.col("visited_urls_count").cast("string"),
        F.lit(f'}},"tool":{render._tool_json(style)}}}'),
    )
    entry = F.to_json(F.struct("depth", "url"))
    skip = F.to_json(F.struct("reason", "url"))
    skips = _counted_skips(skipped)
    return _union(
        _chunks(sites, 0, F.lit(""), F.lit('{"pages":[')),
        _items(pages, 1, F.col("url"), render.page_json_object(page_struct(pages)), "", ","),
        _chunks(sites, 2, F.lit(""), before_sitemap),
        _items(sitemap, 3, F.col("url"), entry, "", ","),
        _chunks(sites, 4, F.lit(""), F.lit('],"skipped_urls":[')),
        _items(skips, 5, _skip_position(), _repeated(skip, F.col("times"), "\n,"), "", ","),
        _chunks(sites, 6, F.lit(""), tail),
    )


def xml_chunks(
    sites: DataFrame,
    sitemap: DataFrame,
    pages: DataFrame,
    skipped: DataFrame,
    params: CrawlParams,
    style: Style = DEFAULT_STYLE,
) -> DataFrame:
    def shown(value: object) -> str:
        return str(value).lower() if isinstance(value, bool) else str(value)

    crawl = "".join(render._xml_literal(n, shown(v)) for n, v in render.param_values(params).items())
    element = render.xml_element
    head = F.concat(
        F.lit(f"<{style.root}>{render._tool_xml(style)}<run><mode>site</mode>"),
        element("start_url", F.col("start_url")),
        element("started_at", F.col("started_at")),
        element("finished_at", F.col("finished_at")),
        F.lit(f"<crawl_params>{crawl}</crawl_params>"),
        element("discovered_urls_count", F.col("discovered_urls_count")),
        element("visited_urls_count", F.col("visited_urls_count")),
        F.lit("<skipped_urls>"),
    )
    skip = F.concat(
        F.lit("<skipped>"), element("url", F.col("url")), element("reason", F.col("reason")), F.lit("</skipped>")
    )
    entry = F.concat(
        F.lit("<entry>"), element("url", F.col("url")), element("depth", F.col("depth")), F.lit("</entry>")
    )
    skips = _counted_skips(skipped)
    return _union(
        _chunks(sites, 0, F.lit(""), head),
        _chunks(skips, 1, _skip_position(), _repeated(skip, F.col("times"), "\n")),
        _chunks(sites, 2, F.lit(""), F.lit("</skipped_urls><sitemap>")),
        _chunks(sitemap, 3, F.col("url"), entry),
        _chunks(sites, 4, F.lit(""), F.lit("</sitemap></run><pages>")),
        _chunks(pages, 5, F.col("url"), render.page_xml_element(page_struct(pages))),
        _chunks(sites, 6, F.lit(""), F.lit(f"</pages></{style.root}>")),
    )


def site_chunks(
    fmt: str,
    sites: DataFrame,
    sitemap: DataFrame,
    pages: DataFrame,
    skipped: DataFrame,
    params: CrawlParams,
    style: Style = DEFAULT_STYLE,
) -> DataFrame:
    """Chunks of the site dumps. ``sites`` needs the counts, ``start_url`` and the two times."""
    extension = file_extension(fmt)
    if extension == "md":
        return markdown_chunks(sites, sitemap, pages, params, style)
    build = json_chunks if extension == "json" else xml_chunks
    return build(sites, sitemap, pages, skipped, params, style)


def chunk_sizes(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("site_id").agg(F.sum(F.length("chunk") + 1).alias("chars"))


def assemble(chunks: DataFrame, max_chars: int = MAX_ASSEMBLED_CHARS) -> DataFrame:
    """(site_id, content) of all sites. Fails if a dump is longer than ``max_chars``: use ``write_dump`` then.

    The sizes are summed before anything is brought together, so the failure comes before a row grows.
    """
    sized = chunks.join(chunk_sizes(chunks), "site_id")
    message = F.concat(F.lit("dump too long for one string, write its chunks: "), F.col("site_id"))
    checked = F.when(F.col("chars") <= max_chars, F.col("chunk")).otherwise(F.raise_error(message).cast("string"))
    ordered = F.array_sort(F.collect_list(F.struct("section", "position", checked.alias("chunk"))))
    lines = F.array_join(F.transform(ordered, lambda c: c["chunk"]), "\n")
    return sized.groupBy("site_id").agg(F.concat(lines, F.lit("\n")).alias("content"))


def collect_site(
    sitemap: DataFrame, pages: DataFrame, params: CrawlParams
) -> DataFrame:
    """(site_id, sitemap, pages) with nested lists in URL order.

    Both lists are cut to the page budget before, which bounds the row; skips are not bounded and
    stay a table.
    """
    entry = F.struct("url", "depth")
    doc_names = [*render.TEXT_FIELDS, "extraction_attempts", "warnings"]
    listed = sitemap.groupBy("site_id").agg(F.array_sort(F.collect_list(entry)).alias("sitemap"))
    nested = pages.groupBy("site_id").agg(
        F.array_sort(F.collect_list(F.struct(*doc_names))).alias("pages")
    )
    return listed.join(nested, "site_id", "full")


def dump_names(sites: DataFrame, fmt: str) -> DataFrame:
    """(site_id, dump). Of sites whose dumps would have the same name, each but the first in the order of site_id gets its number
    in the name."""
    name = site_filename(url_host(F.col("start_url")), F.col("finished_at"), fmt)
    names = sites.select("site_id", name.alias("name"))
    twins = Window.partitionBy("name").orderBy("site_id")
    number = F.row_number().over(twins)
    extension = F.lit("." + file_extension(fmt))
    unique = F.concat(F.expr(f"left(name, length(name) - {len(file_extension(fmt)) + 1})"), F.lit("-"), number, extension)
    return names.select("site_id", F.when(number == 1, F.col("name")).otherwise(unique).alias("dump"))


def write_dump(chunks: DataFrame, sites: DataFrame, path: str, fmt: str) -> None:
    """One folder per site, named like its dump; its text files in name order are the dump.

    Chunks are range-partitioned in dump order, so a large site is written by many tasks. For very many sites use
    ``write_dump_parts``.
    """
    named = chunks.join(dump_names(sites, fmt), "site_id")
    ordered = named.repartitionByRange("dump", "section", "position").sortWithinPartitions(
        "dump", "section", "position"
    )
    ordered.select("dump", F.col("chunk").alias("value")).write.partitionBy("dump").text(path)


def write_dump_parts(chunks: DataFrame, sites: DataFrame, path: str, fmt: str, part_bytes: int = 64 << 20) -> None:
    """All dumps one behind the other in text files of about ``part_bytes``, and an index of where each is.

    The number of files follows the bytes, not the sites: small dumps share a file, a large one goes on in the next. A chunk's
    place is the running sum of the sizes before it, in slices, so no task or row holds a site. ``path``/parts has a folder per
    part, ``path``/index (dump, part, start, bytes) the pieces of every dump.
    """
    named = chunks.join(dump_names(sites, fmt), "site_id").select("dump", "section", "position", "chunk")
    size = F.octet_length("chunk") + 1
    placed = running_total(named, [], ["dump", "section", "position"], size.cast("long"), "at")
    placed = materialize(placed.withColumn("part", F.floor(F.col("at") / part_bytes).cast("long")))
    whole = placed.repartition("part").sortWithinPartitions("part", "dump", "section", "position")
    whole.select("part", F.col("chunk").alias("value")).write.partitionBy("part").text(f"{path}/parts")
    # A chunk belongs to the part in which it begins, so a part begins with its first chunk.
    begins = placed.groupBy("part").agg(F.min("at").alias("first"))
    pieces = placed.groupBy("dump", "part").agg(F.min("at").alias("at"), F.sum(size).alias("bytes"))
    index = pieces.join(begins, "part").select("dump", "part", (F.col("at") - F.col("first")).alias("start"), "bytes")
    index.write.parquet(f"{path}/index")


def read_dump_parts(spark: SparkSession, path: str) -> DataFrame:
    """(dump, part, content) of every piece; the contents of a dump in the order of the parts are the dump."""
    files = spark.read.format("binaryFile").load(f"{path}/parts").select("part", F.col("content").alias("whole"))
    pieces = spark.read.parquet(f"{path}/index").join(files, "part")
    content = F.expr("substring(whole, cast(start + 1 as int), cast(bytes as int))").cast("string")
    return pieces.select("dump", "part", content.alias("content"))


def write_page_dumps(pages: DataFrame, path: str, fmt: str, style: Style = DEFAULT_STYLE) -> None:
    """Rendered pages as Parquet rows (file_name, content), one row per page."""
    from pagewright.functions.text import page_filename

    rendered = render.render_page(page_struct(pages), fmt, style).alias("content")
    pages.select(page_filename(F.col("url"), fmt).alias("file_name"), rendered).write.parquet(path)
