"""SQL building blocks for the DuckDB side, written from the rules and not from the Spark code."""

from __future__ import annotations

WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(8195) || chr(12288)"
BLOCKS = (
    "address|article|aside|blockquote|br|dd|div|dl|dt|figcaption|footer|h1|h2|h3|h4|h5|h6|header|hr|"
    "li|main|nav|ol|p|pre|section|table|td|th|tr|ul"
)
JUNK = r"(?is)<!--.*?-->|<!doctype[^>]*>|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<template[^>]*>.*?</template>"


def canon(url: str) -> str:
    """Canonical form of an absolute http(s) URL without dot segments and escapes."""
    scheme = f"lower(regexp_extract({url}, '^([A-Za-z]+)://', 1))"
    host = f"lower(regexp_extract({url}, '^[A-Za-z]+://([^/?#:]*)', 1))"
    raw_path = f"regexp_extract({url}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"
    path = f"rtrim(regexp_replace({raw_path}, '/+', '/', 'g'), '/')"
    query = f"regexp_extract({url}, '^[^?#]*\\?([^#]*)', 1)"
    items = f"list_sort(list_filter(string_split({query}, '&'), lambda q: q <> ''))"
    return (
        f"({scheme} || '://' || {host} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || "
        f"CASE WHEN {query} = '' THEN '' ELSE '?' || array_to_string({items}, '&') END)"
    )


def host(url: str) -> str:
    return f"lower(regexp_extract({url}, '^[A-Za-z]+://([^/?#:]*)', 1))"


def normalize(text: str) -> str:
    spaces = f"regexp_replace(replace(replace({text}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \\t]+', ' ', 'g')"
    lines = f"regexp_replace(regexp_replace({spaces}, ' *\\n *', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"trim({lines}, {WHITE})"


def decode(text: str) -> str:
    """The character references that occur in the data."""
    for name, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<")):
        text = f"replace({text}, '{name}', '{char}')"
    return f"regexp_replace({text}, '&amp;?', '&', 'g')"


def text_of(html: str) -> str:
    """Plain text of HTML."""
    clean = f"regexp_replace({html}, '{JUNK}', ' ', 'g')"
    broken = f"regexp_replace({clean}, '(?i)</?(?:{BLOCKS})(?:[\\s/][^>]*)?>', ' ' || chr(10) || ' ', 'g')"
    return normalize(decode(f"regexp_replace({broken}, '</?[a-zA-Z][^>]*>', ' ', 'g')"))


def penalty(text: str) -> str:
    lines = f"list_filter(list_transform(string_split({text}, chr(10)), lambda s: trim(s, {WHITE})), lambda s: s <> '')"
    n, d = f"len({lines})", f"len(list_distinct({lines}))"
    ratio = f"({d}::DOUBLE / greatest({n}, 1)::DOUBLE)"
    return (
        f"CASE WHEN {n} < 4 THEN 0 WHEN {ratio} > 0.85::DOUBLE THEN 0 "
        f"ELSE trunc((1.0::DOUBLE - {ratio}) * least(length({text}), 1200)::DOUBLE)::INT END"
    )


BASE = f"""base AS (
  SELECT page_id, url, html, {canon('url')} AS canon, {host('url')} AS site_id FROM pages
)"""

SITES = f"""{BASE}, sites AS (
  SELECT site_id, arg_min(canon, page_id) AS start_url FROM base GROUP BY site_id
)"""

ENTRIES = f"""{SITES}, entries AS (
  SELECT site_id, canon AS url, (min(page_id) % 3 + 1)::INT AS depth FROM base GROUP BY site_id, canon
)"""

INDEX = f"""{BASE}, idx AS (
  SELECT canon AS url, min(page_id) AS page_id FROM base GROUP BY canon
)"""


def hrefs(html: str = "html") -> str:
    return f"regexp_extract_all({html}, '<a href=\"([^\"]*)\"', 1)"


HREFS = f"""{BASE}, hrefs AS (
  SELECT page_id, url, canon, unnest({hrefs()}) AS href FROM base
)"""

# Links of the data are all of the form /name.
ROOT = "regexp_extract(canon, '^([a-z]+://[^/]+)', 1)"

LINKS = f"""{BASE}, links AS (
  SELECT DISTINCT page_id, canon, {ROOT} || href AS link
  FROM (SELECT page_id, canon, unnest({hrefs()}) AS href FROM base)
)"""

EDGES = f"""{LINKS}, edges AS (
  SELECT canon AS src, link AS dst FROM links
  UNION
  SELECT a.canon, b.canon FROM base a JOIN base b
    ON b.page_id IN (2 * a.page_id + 1, 2 * a.page_id + 2,
                     CASE WHEN a.page_id % 2 = 1 THEN a.page_id + 1 ELSE a.page_id - 1 END)
), sites AS (
  SELECT site_id, arg_min(canon, page_id) AS start_url FROM base GROUP BY site_id
)"""

# What the robots files of the derived hosts mean for our agent.
ALLOWED = """CASE
  WHEN site_id LIKE 'blog.%' THEN false
  WHEN site_id LIKE 'm.%' THEN NOT regexp_matches(url, '^[a-z]+://[^/]+/en/')
  WHEN site_id LIKE 'www.%' THEN NOT regexp_matches(url, '^[a-z]+://[^/]+/de/')
  ELSE true END"""


#: What ``tables.described`` puts in the head of a page; plain pages have none of it, and their queries do not show it.
DESCRIBED = """CASE WHEN contains(html, '</head>') THEN CASE page_id % 3 WHEN 0 THEN 'About ' || page_id || ' & more' WHEN 1 THEN 'Shared ' || page_id END END AS subtitle,
    CASE WHEN contains(html, '</head>') THEN CASE page_id % 4 WHEN 0 THEN 'A. ' || page_id WHEN 1 THEN 'Éva ' || page_id END END AS author,
    CASE WHEN contains(html, '</head>') THEN CASE page_id % 5 WHEN 0 THEN '2025-01-02T03:04:05Z' WHEN 1 THEN '2025-02-03' WHEN 2 THEN '2025-03-04' END END AS date_published"""


def texts(source: str = "pages") -> str:
    """page_id, title, lang, t_default, t_recall of pages with one article and no tables or comments; the fields of described pages."""
    article = f"regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1)"
    outside = "(?is)<title>[^<]*</title>|<nav>.*?</nav>|<footer>.*?(?:</footer>|$)"
    rest = f"regexp_replace(html, '{outside}', ' ' || chr(10) || ' ', 'g')"
    return f"""texts AS (
  SELECT page_id, url, html,
    nullif({decode("trim(regexp_extract(html, '<title>([^<]*)', 1), " + WHITE + ")")}, '') AS title,
    nullif(regexp_extract(html, '<html lang="([^"]*)"', 1), '') AS lang,
    {DESCRIBED},
    {text_of(article)} AS t_default, {text_of(rest)} AS t_recall
  FROM {source}
)"""


def candidates(min_chars: int, source: str = "pages") -> str:
    """All attempts of pages without tables, comments and links in their text."""
    short = f"length(t_default) < {min_chars}"
    rows = [("0", "'default'", "t_default", "NULL", "true")]
    for turn, (name, text) in enumerate(
        [
            ("favor_recall", "t_recall"),
            ("include_tables", "t_default"),
            ("include_links", "t_default"),
            ("include_comments", "t_default"),
            ("relaxed_combo", "t_recall"),
        ],
        1,
    ):
        rows.append((str(turn), f"'{name}'", text, "NULL", short))
    rows.append(("6", "'bare_extraction'", "t_recall", "title", "(t_recall <> '' OR title IS NOT NULL OR lang IS NOT NULL)"))
    union = "\n  UNION ALL ".join(
        f"SELECT page_id, {turn} AS turn, {name} AS strategy, {text} AS text, {title}::VARCHAR AS title "
        f"FROM texts WHERE {condition}"
        for turn, name, text, title, condition in rows
    )
    return f"""{texts(source)}, tried AS ({union}),
scored AS (
  SELECT *, length(text) + CASE WHEN title IS NOT NULL THEN 200 ELSE 0 END - {penalty('text')} AS score FROM tried
), best AS (
  SELECT * FROM scored WHERE text <> ''
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, turn) = 1
)"""


ATTEMPTS = (
    "string_agg(strategy || ':' || length(text) || ':' || (text <> ''), ',' ORDER BY turn)"
)


def docs(min_chars: int = 400, source: str = "pages") -> str:
    """One document per page: title, language, text, attempts, warnings (joined)."""
    return f"""{candidates(min_chars, source)}, attempts AS (
  SELECT page_id, {ATTEMPTS} AS attempts FROM tried GROUP BY page_id
), docs AS (
  SELECT t.page_id, t.url, CASE WHEN b.page_id IS NOT NULL THEN t.title END AS title,
    CASE WHEN b.page_id IS NOT NULL THEN t.lang END AS language,
    CASE WHEN b.page_id IS NOT NULL THEN t.subtitle END AS subtitle, CASE WHEN b.page_id IS NOT NULL THEN t.author END AS author,
    CASE WHEN b.page_id IS NOT NULL THEN t.date_published END AS date_published, coalesce(b.text, '') AS text, a.attempts,
    CASE WHEN b.page_id IS NULL THEN 'No extraction strategy returned text.'
         WHEN length(b.text) < {min_chars}
         THEN 'Extracted text length (' || length(b.text) || ') is below threshold ({min_chars}).'
         ELSE '' END AS warnings
  FROM texts t LEFT JOIN best b USING (page_id) LEFT JOIN attempts a USING (page_id)
)"""
