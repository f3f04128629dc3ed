"""DuckDB SQL that gives the rows of the queries which SQL can express."""

from pagewright.llm import url_filter

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

LINE_DEDUP = f"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
    FROM documents
), keyed AS (SELECT *, translate(trim(line, {_BLANKS}), {_LOWER}) AS key FROM lines),
common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(common.key) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE common.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common USING (key) GROUP BY doc_id
"""


def _uniform(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 13))::BIGINT::DOUBLE / {1 << 52})"


POISSON_MIXING = f"""
WITH amounts AS (
    SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS amount FROM documents GROUP BY source
), rates AS (
    SELECT source, pow(amount, 0.7) / sum(pow(amount, 0.7)) OVER () * sum(amount) OVER () / amount AS rate
    FROM amounts WHERE amount > 0
), halves AS (SELECT *, greatest(ceil(rate / 32), 1)::INTEGER AS parts FROM rates),
sums AS (
    SELECT source, rate, parts,
        sum(exp(-(rate / parts) + k * ln(rate / parts) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS bound
    FROM halves, generate_series(0, 100) AS g(k)
), bounds AS (SELECT source, any_value(rate) AS rate, any_value(parts) AS parts, list(bound) AS bounds FROM sums GROUP BY source),
draws AS (
    SELECT doc_id, d.source, rate, text, bounds, unnest(range(1, parts + 1)) AS part
    FROM documents d JOIN bounds b ON d.source IS NOT DISTINCT FROM b.source
), counted AS (
    SELECT doc_id, source, rate, text,
        sum(len(list_filter(bounds, lambda x: x <= {_uniform("concat_ws(':', '17', doc_id, part)")})))::INTEGER AS copies
    FROM draws GROUP BY doc_id, source, rate, text
), copied AS (SELECT *, unnest(range(0, copies))::INTEGER AS copy FROM counted)
SELECT doc_id, source, round(rate, 9) AS rate, copies, copy, md5(text) AS text_md5,
    {_uniform("concat_ws(':', '17', 'place', doc_id, copy)")} AS place
FROM copied
"""



def _found(terms) -> str:
    """List of the terms that are whole words of ``whole``; constant patterns are compiled once."""
    border = r"[^\p{L}\p{N}]"
    hits = [f"CASE WHEN regexp_matches(whole, '(^|{border}){t}($|{border})') THEN '{t}' END" for t in sorted(terms)]
    return f"list_filter([{', '.join(hits)}], lambda t: t IS NOT NULL)"


_WEIGHT = ", ".join(f"('{t}', {w})" for t, w in sorted(url_filter.SOFT.items()))
_RULES = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in url_filter.RULES)

URL_VOCABULARY = f"""
WITH cut AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {_LOWER}) AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, lower(url_decode(translate(regexp_extract(rest, '^[^/?#]*'), {_LOWER}) || regexp_extract(rest, '^[^/?#]*([^#]*)', 1))) AS whole
    FROM cut
), terms AS (
    SELECT *, {_found(url_filter.STRICT)} AS strict, {_found(url_filter.SOFT)} AS soft FROM parts
), weighed AS (
    SELECT page_id, sum(w) AS weight FROM (SELECT page_id, unnest(soft) AS t FROM terms) JOIN (VALUES {_WEIGHT}) AS known(t, w) USING (t) GROUP BY page_id
), fits AS (
    SELECT page_id, arg_max(v, length(h || p)) AS verdict, arg_max(h || p, length(h || p)) AS rule
    FROM parts JOIN (VALUES {_RULES}) AS r(v, h, p)
        ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
    GROUP BY page_id
)
SELECT page_id, host, path, rule,
    coalesce(verdict, CASE WHEN len(strict) > 0 OR coalesce(weight, 0) >= {url_filter.SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
    array_to_string(strict, ',') AS strict_terms, array_to_string(soft, ',') AS soft_terms, coalesce(weight, 0)::DOUBLE AS soft_weight
FROM terms LEFT JOIN fits USING (page_id) LEFT JOIN weighed USING (page_id)
"""

_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> {}) & 31)::INTEGER + 1, 1)"

WARC_DICTIONARY = f"""
WITH hashed AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS sha1 FROM pages
), base32 AS (
    SELECT *, array_to_string(list_transform(
        list_transform(range(0, 8), lambda i: ('0x' || substr(sha1, i * 5 + 1, 5))::BIGINT),
        lambda v: {" || ".join(_DIGIT.format(n) for n in (15, 10, 5, 0))}), '') AS payload_digest,
        min(page_id) OVER (PARTITION BY sha1) AS first
    FROM hashed
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to
FROM base32
"""

_LETTERS = "(VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16))"
_BEFORE = "(CASE WHEN strpos(filter_order, '{}') < step THEN {} ELSE 0 END)"
_EARLIER = " + ".join(_BEFORE.format(name, bit) for name, bit in zip("ABCDE", (1, 2, 4, 8, 16), strict=True))

FILTER_AUDIT = f"""
WITH texts AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
    FROM documents
), marked AS (
    SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad,
        (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
        + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END)
        + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
        + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END) AS fails
    FROM texts LEFT JOIN labels USING (doc_id)
), counted AS (
    SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(bad) AS bad FROM marked GROUP BY part, fails
), orders AS (
    SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
    FROM {_LETTERS} a(l, x), {_LETTERS} b(l, x), {_LETTERS} c(l, x), {_LETTERS} d(l, x), {_LETTERS} e(l, x)
    WHERE a.x | b.x | c.x | d.x | e.x = 31
), plain AS (SELECT filter_order, unnest(range(1, 6))::INTEGER AS step FROM orders),
steps AS (
    SELECT filter_order, step, substr(filter_order, step, 1) AS letter, (1 << (ascii(substr(filter_order, step, 1)) - 65)) AS own,
        {_EARLIER} AS earlier
    FROM plain
), told AS (
    SELECT part, filter_order, step, letter,
        coalesce(sum(n) FILTER (WHERE fails & (earlier | own) = 0), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (WHERE fails & earlier = 0 AND fails & own > 0), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (WHERE fails & earlier > 0 AND fails & own > 0), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (WHERE fails = own), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (WHERE fails & earlier = 0 AND fails & own > 0), 0)::BIGINT AS good_lost,
        coalesce(sum(bad) FILTER (WHERE fails & earlier = 0 AND fails & own > 0), 0)::BIGINT AS toxic_lost
    FROM counted, steps GROUP BY part, filter_order, step, letter
)
SELECT * EXCLUDE (letter), (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM told
"""

# crc32 of the UTF-8 bytes of a word, by its table of 256 entries.
_CRC_STEP = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
_CRC_TABLE = "v"
for _ in range(8):
    _CRC_TABLE = f"list_transform([{_CRC_TABLE}], lambda c: {_CRC_STEP.format('c')})[1]"

IMPORTANCE = f"""
WITH crc AS (SELECT list({_CRC_TABLE} ORDER BY v) AS crc_table FROM (SELECT unnest(range(0, 256))::BIGINT AS v)),
words AS (
    SELECT 's' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
    UNION ALL
    SELECT 't', item_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark
), used AS (SELECT side, id, unnest(w) AS word FROM words),
hexed AS (SELECT word, hex(encode(word)) AS h FROM used GROUP BY word),
bytes AS (
    SELECT word, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, i * 2 + 1, 2))::BIGINT) AS data FROM hexed
), hashed AS (
    SELECT word, xor(list_reduce(list_prepend(4294967295, data),
        lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
    FROM bytes, crc
), placed AS (SELECT side, id, bucket FROM used JOIN hashed USING (word)),
sums AS (SELECT bucket, count_if(side = 's') AS s, count_if(side = 't') AS t FROM placed GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS ss, coalesce(sum(t), 0)::DOUBLE AS tt FROM sums),
gains AS (
    SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (ss + 10000)) / ((s + 1)::DOUBLE * (tt + 10000))))::BIGINT AS gain FROM sums, totals
), summed AS (
    SELECT id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
    FROM placed JOIN gains USING (bucket) WHERE side = 's' GROUP BY id
), scored AS (
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM documents LEFT JOIN summed ON id = doc_id
), drawn AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n
    FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * 10 // 100 THEN rank END AS rank
FROM scored LEFT JOIN drawn USING (doc_id)
"""
