from pagewright.plans.jobs import page_docs
from pagewright.streaming import ingest
from pagewright.streaming.ingest import stream_page_docs, write_page_docs

SCHEMA = "url string, fetched_url string, status int, content_type string, html string"


def test_stream_gives_the_batch_documents(spark, tmp_path):
    rows = [
        (f"https://h.e/{i}", f"https://h.e/{i}", 200 if i % 3 else 404, "text/html", f"<title>T{i}</title><p>Text &amp; {i}</p>")
        for i in range(12)
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    frame.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = write_page_docs(stream_page_docs(stream), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("extracted_at")
    want = page_docs(frame)[0].drop("extracted_at")
    assert got.count() == 8
    assert got.orderBy("url").collect() == want.orderBy("url").collect()


def test_repeats_and_late_rows(spark, tmp_path):
    """Each round is a batch; a repeat within the delay is dropped, and so is a row behind the watermark."""
    schema = "url string, at timestamp"
    rounds = [
        [("https://h.e/a", "2024-01-01 10:00:00"), ("https://H.e:443/a#x", "2024-01-01 10:10:00"), ("mailto:x", "2024-01-01 10:00:00")],
        [("https://h.e/a/", "2024-01-01 10:20:00"), ("https://h.e/b", "2024-01-01 13:00:00")],
        [("https://h.e/late", "2024-01-01 08:00:00"), ("https://h.e/a", "2024-01-01 13:10:00")],
    ]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    found = ingest.without_repeats(stream, "at")
    for number, rows in enumerate(rounds):
        spark.createDataFrame(rows, "url string, at string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        query = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert query.awaitTermination(120), number
    got = [r["url"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    # The last page comes when the first one has been forgotten.
    assert len(got) == 3 and "https://h.e/b" in got and got.count("https://h.e/a") >= 1
    assert not {"https://h.e/late", "https://h.e/a/", "mailto:x"} & set(got)
