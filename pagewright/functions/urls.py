"""URL columns: canonical form, reference resolution, predicates and skip reasons.

Everything is a native expression. A URL that cannot be canonicalized becomes the empty string.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions import fixed
from pagewright.functions.binding import after, by_name, let

SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
HOST_RE = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)"
# Plain path segments need no work: no dot segment, empty segment, parameter, query or fragment.
PLAIN_PATH = r"(?:/[^\x00-\x20/?#;.][^\x00-\x20/?#;]*+)++\z"
PLAIN_URL_RE = r"\Ahttps?://[a-z0-9.\-]++(?:/\z|" + PLAIN_PATH + ")"
IPV6_RE = r"^\[(?:[0-9A-Fa-f]*:[0-9A-Fa-f:]*(?:[0-9]+(?:\.[0-9]+){3})?(?:%[^\]]+)?|v[0-9A-Fa-f]+\..+)\]$"


@functools.lru_cache(maxsize=1)
def _delimiter_lookalikes() -> str:
    """Characters that turn into a URL delimiter under NFKC; not allowed in an authority."""
    delimiters = set("/?#@:")
    return "".join(
        char
        for char in map(chr, range(0x80, sys.maxunicode + 1))
        if delimiters & set(unicodedata.normalize("NFKC", char))
    )


def split_url(url: Column) -> Column:
    """struct(scheme, authority, path, query); the fragment is dropped, absent parts are ''."""
    cleaned = F.regexp_replace(F.translate(url, "\t\r\n", ""), r"^[\x00-\x20]+", "")
    no_fragment = F.substring_index(cleaned, "#", 1)

    def with_head(whole: Column, head: Column) -> Column:
        def with_rest(rest: Column, scheme: Column) -> Column:
            authority = F.regexp_extract(rest, "^//([^/]*)", 1)
            has_authority = rest.startswith("//")
            return let(
                authority,
                lambda a: F.struct(
                    F.lower(scheme).alias("scheme"),
                    a.alias("authority"),
                    F.when(has_authority, after(rest, F.length(a) + 2)).otherwise(rest).alias("path"),
                    after(whole, F.length(head) + 1).alias("query"),
                ),
            )

        return let(
            F.regexp_extract(head, SCHEME_RE, 1),
            lambda s: let(
                F.when(s == "", head).otherwise(after(head, F.length(s) + 1)),
                lambda rest: with_rest(rest, s),
            ),
        )

    return let(no_fragment, lambda w: let(F.substring_index(w, "?", 1), lambda h: with_head(w, h)))


def _drop_params(scheme: Column, path: Column) -> Column:
    cut = F.regexp_replace(path, r";[^/]*\z", "")
    return F.when(
        path.contains(";") & ((scheme == "") | scheme.isin(*fixed.PARAM_SCHEMES)), cut
    ).otherwise(path)


def _pop_dots(segments: Column) -> Column:
    """Apply '..' to the segments before it; '.' has no effect."""
    return F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda kept, segment: F.when(segment == ".", kept)
        .when((segment == "..") & (F.size(kept) == 0), kept)
        .when(segment == "..", F.slice(kept, 1, F.size(kept) - 1))
        .otherwise(F.array_append(kept, segment)),
    )


def _normal_path(path: Column) -> Column:
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    resolved = F.concat(F.lit("/"), F.array_join(_pop_dots(segments), "/"))
    trimmed = F.when(path.isin("", "/"), F.lit("/")).otherwise(F.rtrim(path, F.lit("/")))
    return F.when(path.rlike(r"//|/\."), resolved).otherwise(trimmed)


def lenient_unquote(text: Column, plus_is_space: bool) -> Column:
    """Percent-decode; malformed escapes stay as they are."""
    escaped = F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")
    if not plus_is_space:
        escaped = F.replace(escaped, F.lit("+"), F.lit("%2B"))
    return F.when(text.rlike("[%+]"), F.try_url_decode(escaped)).otherwise(text)


def form_quote(text: Column) -> Column:
    encoded = F.url_encode(text)
    return F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _normal_query(query: Column) -> Column:
    def pair(item: Column) -> Column:
        return let(
            F.substring_index(item, "=", 1),
            lambda name: F.struct(
                lenient_unquote(name, True).alias("name"),
                lenient_unquote(after(item, F.length(name) + 1), True).alias("value"),
            ),
        )

    pairs = F.transform(F.filter(F.split(query, "&"), lambda item: item != ""), pair)
    encoded = F.transform(
        F.array_sort(pairs),
        lambda p: F.concat(form_quote(p["name"]), F.lit("="), form_quote(p["value"])),
    )
    joined = F.array_join(encoded, "&")
    return F.when(query == "", F.lit("")).otherwise(
        let(joined, lambda q: F.when(q == "", q).otherwise(F.concat(F.lit("?"), q)))
    )


def _network_location(scheme: Column, authority: Column) -> Column:
    """host[:port] without user info and default port; '' where the authority is not valid."""

    def build(host: Column, port: Column) -> Column:
        number = F.regexp_replace(port, "^0+(?=[0-9])", "")
        in_range = (port == "") | (
            port.rlike(r"^[0-9]+\z") & (F.length(number) <= 5) & (F.try_to_number(number, F.lit("99999")) <= 65535)
        )
        plain = (
            number.isin("", "0")
            | ((scheme == "http") & (number == "80"))
            | ((scheme == "https") & (number == "443"))
        )
        bracketed = host.startswith("[")
        valid = (
            in_range
            & (host != "")
            & (bracketed | ~authority.rlike(r"[\[\]]"))
            & (~bracketed | host.rlike(IPV6_RE))
            & ~authority.rlike("[" + _delimiter_lookalikes() + "]")
        )
        location = F.when(plain, F.lower(host)).otherwise(F.concat(F.lower(host), F.lit(":"), number))
        return F.when(valid, location).otherwise(F.lit(""))

    def split_port(place: Column) -> Column:
        host = F.when(place.startswith("["), F.regexp_extract(place, r"^(\[[^\]]*\])", 1)).otherwise(
            F.substring_index(place, ":", 1)
        )
        return let(
            host,
            lambda h: build(h, F.regexp_replace(after(place, F.length(h)), "^[^:]*:?", "")),
        )

    return let(F.substring_index(authority, "@", -1), split_port)


def _canonical(parts: Column) -> Column:
    scheme = F.when(parts["scheme"] == "", F.lit("https")).otherwise(parts["scheme"])
    return let(
        _network_location(scheme, parts["authority"]),
        lambda location: F.when(location == "", F.lit("")).otherwise(
            F.concat(
                scheme,
                F.lit("://"),
                location,
                _normal_path(_drop_params(parts["scheme"], parts["path"])),
                _normal_query(parts["query"]),
            )
        ),
    )


def _merge(ref: Column, base: Column) -> Column:
    """Parts of ``ref`` as seen from the parts of ``base``."""
    same_scheme = (ref["scheme"] == "") | (ref["scheme"] == base["scheme"])
    relative = same_scheme & ((base["scheme"] == "") | base["scheme"].isin(*fixed.RELATIVE_SCHEMES))
    rooted = F.when(
        ref["path"].contains(".."), F.array_join(_pop_dots(F.split(ref["path"], "/")), "/")
    ).otherwise(ref["path"])
    # An authority follows, so a path that lost its leading slash gets it back.
    rooted = F.when(rooted.startswith("/"), rooted).otherwise(F.concat(F.lit("/"), rooted))
    no_path = ref["path"].isin("", ";")
    path = (
        F.when(no_path, base["path"])
        .when(ref["path"].startswith("/"), rooted)
        .otherwise(F.concat(F.regexp_replace(base["path"], r"[^/]*\z", ""), ref["path"]))
    )
    query = F.when(no_path & (ref["query"] == ""), base["query"]).otherwise(ref["query"])
    merged = F.struct(
        base["scheme"].alias("scheme"),
        base["authority"].alias("authority"),
        F.when(path.startswith("/") | (path == ""), path)
        .otherwise(F.concat(F.lit("/"), path))
        .alias("path"),
        query.alias("query"),
    )
    with_scheme = F.struct(
        base["scheme"].alias("scheme"),
        ref["authority"].alias("authority"),
        ref["path"].alias("path"),
        ref["query"].alias("query"),
    )
    return F.when(~relative, ref).when(ref["authority"] != "", with_scheme).otherwise(merged)


def base_of(base: Column) -> Column:
    """struct(root, parts) of a base URL, split once for all references on its page."""
    return let(
        split_url(F.coalesce(base, F.lit(""))),
        lambda parts: F.struct(
            F.concat(
                parts["scheme"], F.lit("://"), _network_location(parts["scheme"], parts["authority"])
            ).alias("root"),
            parts.alias("parts"),
        ),
    )


def resolve_from(url: Column, base: Column) -> Column:
    """Canonical form of ``url`` seen from ``base_of`` a page; use it inside array lambdas."""
    parts = base["parts"]
    return (
        F.when(url.rlike(PLAIN_URL_RE), url)
        .when(url.rlike(r"\A" + PLAIN_PATH) & base["root"].rlike(r"\Ahttps?://."), F.concat(base["root"], url))
        .otherwise(
            let(
                split_url(url),
                lambda ref: let(F.when(url == "", parts).otherwise(_merge(ref, parts)), _canonical),
            )
        )
    )


@by_name(2)
def canonicalize_url(url: Column, base: Column | None = None) -> Column:
    """Canonical absolute URL, or '' if there is none."""
    url = F.coalesce(url, F.lit(""))
    alone = F.when(url.rlike(PLAIN_URL_RE), url).otherwise(let(split_url(url), _canonical))
    if base is None:
        return alone
    base = F.coalesce(base, F.lit(""))
    return F.when(base == "", alone).otherwise(let(base_of(base), lambda b: resolve_from(url, b)))


def resolve_url(url: Column, base: Column) -> Column:
    """Canonical form of a reference found on the page ``base``."""
    return canonicalize_url(url, base)


@by_name(1)
def url_host(url: Column) -> Column:
    """Lower-case host without port and user info; '' if there is none."""
    return F.lower(F.regexp_extract(url, HOST_RE, 1))


@by_name(1)
def host_key(url: Column) -> Column:
    """scheme://host:port of a canonical URL: the unit a robots file speaks for."""
    location = F.regexp_extract(url, r"^([a-z][a-z0-9+.\-]*://(?:\[[^\]]*\]|[^/?#:]*)(?::[0-9]+)?)", 1)
    return F.when(location.rlike(r":[0-9]+\z"), location).otherwise(F.concat(location, F.lit(":")))


@by_name(1)
def path_and_query(url: Column) -> Column:
    """Decoded path and query as robots rules see them."""
    return lenient_unquote(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", ""), False)


def is_binary_url(url: Column) -> Column:
    head = F.substring_index(F.substring_index(url, "#", 1), "?", 1)
    path = F.regexp_replace(head, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/]*)?", "")
    path = F.regexp_replace(path, r";[^/]*\z", "")
    extension = F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]*)\z", 1))
    return extension.isin(*fixed.BINARY_EXTENSIONS)


def is_query_heavy(
    url: Column,
    max_params: int = fixed.MAX_QUERY_PARAMS,
    max_query_len: int = fixed.MAX_QUERY_CHARS,
) -> Column:
    query = F.regexp_extract(url, r"^[^#?]*\?([^#]*)", 1)
    return (F.regexp_count(query, F.lit("[^&]+")) > max_params) | (F.length(query) > max_query_len)


def glob_regex(pattern: Column) -> Column:
    """Regular expression for a shell-style pattern: * ? [seq] [!seq], case-sensitive, whole URL."""
    pieces = F.regexp_extract_all(pattern, F.lit(r"(?s)\[!?\]?[^\]]*\]|."), F.lit(0))

    def translate(piece: Column) -> Column:
        inner = F.regexp_replace(F.regexp_replace(piece, r"^\[!?|\]\z", ""), r"([\\\[\]&^~|])", r"\\$1")
        opening = F.when(piece.startswith("[!"), F.lit("[^")).otherwise(F.lit("["))
        return (
            F.when(piece == "*", F.lit(".*"))
            .when(piece == "?", F.lit("."))
            .when(F.length(piece) > 1, F.concat(opening, inner, F.lit("]")))
            .otherwise(F.regexp_replace(piece, r"([^A-Za-z0-9_])", r"\\$1"))
        )

    return F.concat(F.lit(r"(?s)\A"), F.array_join(F.transform(pieces, translate), ""), F.lit(r"\z"))


def glob_match(url: Column, patterns: Sequence[str] | Column) -> Column:
    """Does any pattern match the whole URL? ``patterns`` is a list or an array column."""
    if isinstance(patterns, Column):
        return F.exists(patterns, lambda p: F.regexp_like(url, glob_regex(p)))
    matched = F.lit(False)
    for pattern in patterns:
        matched = matched | F.regexp_like(url, glob_regex(F.lit(pattern)))
    return matched


@by_name(1)
def skip_reason(
    url: Column,
    query_filter: bool = True,
    allow_patterns: Sequence[str] = (),
    deny_patterns: Sequence[str] = (),
) -> Column:
    """First reason to leave the URL out, or NULL."""
    reason = F.when(is_binary_url(url), F.lit(fixed.BINARY))
    if query_filter:
        reason = reason.when(is_query_heavy(url), F.lit(fixed.QUERY_HEAVY))
    if deny_patterns:
        reason = reason.when(glob_match(url, deny_patterns), F.lit(fixed.DENIED))
    if allow_patterns:
        reason = reason.when(~glob_match(url, allow_patterns), F.lit(fixed.NOT_ALLOWED))
    return reason
