"""Every operator on NULLs, empty and long texts, ties, repeated rows, clashing columns and an empty table."""

import pytest
from pyspark.sql import functions as F

from pagewright.llm import fingerprints, line_dedup, mixing, ngram_join, packing, ppm, quality, toxicity, url_filter, warc
from pagewright.storage import shared_path

CLASHES = ["n", "score", "key", "token", "kept", "common", "rate", "copies", "place", "range", "copy", "row", "features", "words", "digest", "shard", "length", "payload", "host", "_toxic", "_other", "toxic", "label", "turn", "fold", "held_out", "predicted"]
LONG = "word " * 30_000 + "\n" + "x" * 50_000
ROWS = [
    (1, None), (2, ""), (3, "one two three four five"), (3, "one two three four five"), (4, "One two\tthree four five"),
    (5, LONG), (None, "no id at all"), (6, " \n\t"), (7, "l1\nshared line\nl3"), (8, "Ünï ¿ \U0001f642\nyou IDIOT, you id1ot!!!"),
]


def table(spark, rows=ROWS):
    frame = spark.createDataFrame([(i, t, "en", None if i == 2 else "s", 9) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return frame.withColumns({c: F.lit("clash") for c in CLASHES})


def labels(spark, rows=((1, 0), (8, 1), (None, 1), (3, None), (99, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, toxic int")


OPERATORS = {
    "fingerprints": lambda s, d: fingerprints.neighbour_fingerprints(d),
    "ngram": lambda s, d: ngram_join.similar_documents(d),
    "toxicity": lambda s, d: toxicity.scored(d, labels(s)),
    "ppm": lambda s, d: ppm.score(d),
    "lines": lambda s, d: line_dedup.dedup_lines(d, 2),
    "packing": lambda s, d: packing.pack(d).where("start = 0"),
    "quality": lambda s, d: quality.judge(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_for_each_row(spark, name):
    assert OPERATORS[name](spark, table(spark)).count() == len(ROWS)
    assert OPERATORS[name](spark, table(spark, [])).count() == 0
    assert OPERATORS[name](spark, table(spark, [(9, None)])).count() == 1


def test_mixing_edges(spark):
    docs = table(spark)
    mixed = mixing.mix(docs, temperature=1.0)
    assert mixed.columns == docs.columns
    assert {r["text"] for r in mixed.select("text").collect()} <= {t for _, t in ROWS}
    assert mixing.mix(table(spark, [])).count() == 0
    # The source of NULL and the empty text have amount 0 in characters, but not in documents.
    by_rows = mixing.replicated(docs, total=40.0, unit="documents").groupBy("doc.source").count()
    assert {r["source"] for r in by_rows.collect()} == {None, "s"}
    wanted = spark.createDataFrame([("s", 1.0), ("absent", 5.0)], "source string, weight double")
    assert {r["s"] for r in mixing.mix(docs, targets=wanted, total=3.0).select(F.col("source").alias("s")).collect()} == {"s"}


def test_page_operators_edges(spark):
    rows = [(1, None, None), (2, "no scheme", ""), (3, "http://A.example.ORG/es/x", "p"), (4, "x://a.example.org/es?q", "p"), (5, "u", "p" * 100_000), (None, "u", "p")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in CLASHES + ["sha1", "first"] if c != "payload"})
    judged = {r["page_id"]: r for r in url_filter.judge_urls(pages).collect()}
    assert judged[1]["host"] == judged[2]["host"] == "" and judged[1]["verdict"] == "allow"
    assert (judged[3]["host"], judged[3]["rule"], judged[3]["verdict"]) == ("a.example.org", "example.org/es/", "block")
    assert (judged[4]["path"], judged[4]["rule"]) == ("/es", "org/")
    path = shared_path(spark)
    warc.write_archives(pages, path)
    read = warc.read_archives(spark, path).collect()
    assert len(read) == len(rows)
    by_id = {r["page_id"]: r for r in read}
    assert by_id[4]["refers_to"] == 3 and by_id[4]["record_type"] == "revisit" and by_id[4]["payload"] is None
    assert by_id[None]["refers_to"] == 3 and by_id[2]["refers_to"] == 1
    assert bytes(by_id[5]["payload"]) == b"p" * 100_000 and by_id[1]["url"] is None
    empty = pages.where("false")
    assert url_filter.judge_urls(empty).count() == 0
    warc.write_archives(empty, path := shared_path(spark))
    assert warc.read_archives(spark, path).count() == 0


def test_repeats_of_the_first_page_are_responses(spark):
    rows = [(1, "u", "p"), (1, "u", "p"), (1, "v", "q"), (2, "u", "p"), (2, "u", "p"), (None, "u", "p")]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path := shared_path(spark))
    read = warc.read_archives(spark, path).select("page_id", "url", "record_type", "refers_to", "payload").collect()
    got = [(i, url, kind, first, payload and bytes(payload)) for i, url, kind, first, payload in read]
    want = [(1, "u", "response", None, b"p")] * 2 + [(1, "v", "response", None, b"q")]
    want += [(2, "u", "revisit", 1, None)] * 2 + [(None, "u", "revisit", 1, None)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_filtering_stages_keep_all_columns(spark):
    docs = table(spark)
    kept = toxicity.without_toxic(docs, labels(spark))
    assert kept.columns == docs.columns and kept.count() <= len(ROWS)
    single = ngram_join.one_of_each(docs)
    # Exact copies of one doc_id stay, the one with a larger doc_id goes.
    assert single.columns == docs.columns and sorted(r["doc_id"] for r in single.collect() if r["doc_id"]) == [1, 2, 3, 3, 5, 6, 7, 8]


ODD = [(1, None), (2, ""), (3, "one two three four five"), (3, "one two three four five"), (4, "x " * 40_000 + "y" * 40_000), (5, "one two three four five")]


@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_pipeline_stages_on_odd_rows(spark, rows):
    import corpus_pipeline

    folder = shared_path(spark)
    table(spark, rows).write.parquet(f"{folder}/documents.parquet")
    labels(spark).write.parquet(f"{folder}/labels.parquet")
    pieces = corpus_pipeline.run(spark, folder).select("doc_id", "start", "length").collect()
    assert {r["doc_id"] for r in pieces} <= {1, 2, 3, 4} and bool(rows) >= bool(pieces)
