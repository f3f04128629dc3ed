"""WARC archives of Zstandard frames with a dictionary of their own, written and read by Spark.

An archive starts with a skippable frame that holds a Zstandard dictionary; every record after it is one
frame compressed with that dictionary, so a reader can jump to any record and still gets the compression of
shared markup. The dictionary is trained on a bounded, documented sample of what is to be archived: all payloads
are cut into pieces of ``SAMPLE_BYTES`` characters, and the ``SAMPLE_RECORDS`` pieces with the smallest hashes of
id, url and place are taken, so every part of every page is as likely to be among them. Everything else sees all
records. Payloads that occur again are stored as revisit records without payload.

Archives are written by Spark's text sink, so that its commit protocol takes care of lost executors and any
Hadoop file system will do: a row is the bytes of one frame, and the "line separator" is an empty skippable
frame, which Zstandard readers pass over.

Defined results: a NULL payload is an empty one, a NULL url gives no target header; of equal payloads of at
least ``min_bytes`` bytes the one with the smallest id is the response; rows that repeat that id with that
payload are responses too, each archived in full, as a revisit would refer to its own id; rows without id
follow all others; an empty table gives archives without records.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.sampling import bounded_pieces

DICTIONARY_FRAME = 0x184D2A5D
#: An empty skippable frame whose bytes are also plain ASCII text.
SEPARATOR = struct.pack("<II", 0x184D2A50, 0).decode("ascii")
SAMPLE_RECORDS = 1000
SAMPLE_BYTES = 16_384
DICTIONARY_BYTES = 65_536
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def record_bytes(page_id, url, payload: bytes, length: int, digest: str, refers_to, is_revisit: bool, date: str = DATE) -> bytes:
    """One WARC/1.1 record. A revisit has no block; ``length`` and ``digest`` describe the whole payload."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
    ]
    if url is not None:
        # A header value is one line.
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if is_revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        payload = b""
    head += [f"X-Payload-Length: {length}", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple:
    """The fields of ``RECORD``; length and digest of a response are measured, those of a revisit are as written."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    payload = rest[: int(fields["Content-Length"])]
    if rest[len(payload) :] != b"\r\n\r\n":
        raise ValueError("record of wrong length")

    def number(name: str):
        text = fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    kind, length = fields["WARC-Type"], int(fields["X-Payload-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response":
        measured = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if (measured, len(payload)) != (digest, length):
            raise ValueError("payload does not match its digest")
    return (
        number("WARC-Record-ID"),
        fields.get("WARC-Target-URI"),
        length,
        digest,
        kind,
        number("WARC-Refers-To"),
        payload if kind == "response" else None,
    )


def _frame_end(data: memoryview, place: int) -> int:
    """Where the Zstandard frame at ``place`` ends, by the lengths of its blocks."""
    head = data[place : place + 18]
    end = place + zstandard.frame_header_size(head)
    while True:
        block = int.from_bytes(data[end : end + 3], "little")
        repeated = (block >> 1) & 3 == 1
        end += 3 + (1 if repeated else block >> 3)
        if block & 1:
            return end + 4 * zstandard.get_frame_parameters(head).has_checksum


def archive_frames(content: bytes) -> Iterator[bytes]:
    """The records of one archive, decompressed one by one."""
    data, place, reader = memoryview(content), 0, zstandard.ZstdDecompressor()
    while place < len(data):
        magic, size = struct.unpack_from("<II", data, place)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if magic == DICTIONARY_FRAME:
                words = zstandard.ZstdCompressionDict(bytes(data[place + 8 : place + 8 + size]))
                reader = zstandard.ZstdDecompressor(dict_data=words)
            place += 8 + size
        else:
            end = _frame_end(data, place)
            yield reader.decompress(data[place:end])
            place = end


def _with_first(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, url, payload, n_bytes, digest, refers_to and whether the row is the response of its payload.

    The equal payloads meet as digests only: an aggregate finds the smallest id of each, and its result is
    joined to the rows by digest. A payload that a third of all rows share is one row on one side of that
    join, and the adaptive join can split the other.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")
    )
    rows = rows.withColumns({"n_bytes": F.length("payload").cast("long"), "sha1": F.unhex(F.sha1("payload"))})
    known = rows.where(F.col("n_bytes") >= min_bytes)
    first = known.groupBy("sha1").agg(F.min("page_id").alias("first"))
    return rows.join(first.withColumnRenamed("sha1", "_sha1"), F.col("sha1") == F.col("_sha1"), "left").drop("_sha1")


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary of at most ``DICTIONARY_BYTES`` from the bounded sample; empty if there is too little."""
    sample = bounded_pieces(pages.select("page_id", "url", "html"), "html", SAMPLE_BYTES, SAMPLE_RECORDS, "page_id", "url")
    rows = sample.select("text", "url").collect()
    digest = "A" * 32
    samples = [record_bytes(i, r["url"], (b := r["text"].encode()), len(b), digest, None, False) for i, r in enumerate(rows)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes() if samples else b""
    except zstandard.ZstdError:
        return b""


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write all rows of ``pages`` (page_id, url, html) as WARC records; one archive for each task."""
    words = train_dictionary(pages)
    rows = _with_first(pages, min_bytes)

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(words) if words else None
        writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        frames = [struct.pack("<II", DICTIONARY_FRAME, len(words)) + words] if words else []
        for batch in batches:
            columns = (batch[c] for c in ("page_id", "url", "payload", "n_bytes", "sha1", "first", "again"))
            for page_id, url, payload, n_bytes, sha1, first, again in zip(*columns, strict=True):
                digest = base64.b32encode(sha1.as_py()).decode()
                data = record_bytes(
                    page_id.as_py(), url.as_py(), payload.as_py() or b"", n_bytes.as_py(), digest, first.as_py(), again.as_py()
                )
                frames.append(writer.compress(data))
                if len(frames) >= 200:
                    yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])
                    frames = []
            if frames:
                yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])
                frames = []

    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    # Revisits go to Python without their payload.
    payload = F.when(~F.col("again"), F.col("payload")).alias("payload")
    ready = rows.withColumn("again", again).select("page_id", "url", payload, "n_bytes", "sha1", "first", "again")
    frames = ready.mapInArrow(compress, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below ``path``, with payloads; columns as in ``RECORD``."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
            + [("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
        )
        for batch in batches:
            for content in batch["content"]:
                rows: list[tuple] = []
                for data in archive_frames(content.as_py()):
                    rows.append(parse_record(data))
                    if len(rows) >= 200:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema
                        )
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema
                    )

    return files.mapInArrow(records, RECORD)
