"""Packing tokenized documents into sequences: bounded-space online packing with best fit.

Every task reads its documents once. It cuts whole sequences off long documents and keeps a fixed number of
open windows for the rest: a piece goes into the window it fills best; if it fits in none and no window is
free, the fullest is filled up with the piece's head and emitted, and the rest of the piece is placed. So a
task holds ``open_windows`` windows whatever it reads, and emits full sequences only. Pieces left in open
windows are written out and merged: groups of ``MERGE`` tasks' leftovers are packed again by decreasing
length, sequences that are nearly full are closed, and the others go to the next round, until one group is
left. A round's groups are bounded by MERGE x open_windows x length tokens, and no round moves closed pieces.

Tokens come from a file of the ``tokenizers`` library. Words between ASCII white space are tokenized once in
a task's lifetime and then looked up, which needs a tokenizer that drops white space and never joins words.

Defined results: a NULL or empty text is a document of the end token alone; rows that repeat a doc_id are
packed each; long documents give several pieces, numbered by ``start``; an empty table gives no rows.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.workers import lean
from pagewright.storage import materialize

TOKENIZER = "word_bpe_49k.json"
END = 1
MERGE = 16
NEARLY_FULL = 0.98
CACHED_WORDS = 1_000_000
PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, task long, is_open boolean"


def _byte_letters() -> dict[int, str]:
    """The character that byte-level BPE writes for each byte: itself if printable, else one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(256 + i) for i, b in enumerate(others)}


class WordTokenizer:
    """Ids of texts; keeps up to ``CACHED_WORDS`` words with their ids between calls.

    Most words are Latin letters, perhaps with a final mark. For them normalisation is lower-casing and
    pre-tokenization cuts off the mark, so the tokenizer's model is asked directly; all other words go
    through the whole tokenizer. ``exact`` turns that off.
    """

    #: Letters for which lower-casing is one to one and composition changes nothing.
    PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]?)")

    def __init__(self, path: str, exact: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer, self.exact = Tokenizer.from_file(path), exact
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.known: dict[bytes, bytes] = {}
        self.bodies: dict[str, bytes] = {}

    def _whole(self, words: list[str]) -> Iterator[bytes]:
        """Ids of each word, as bytes, by the whole tokenizer."""
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            found = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            counts = np.bincount(np.array(found.word_ids, dtype=np.int64), minlength=len(part))
            ids, begin = np.array(found.ids, dtype="<u4"), 0
            for stop in np.cumsum(counts).tolist():
                yield ids[begin:stop].tobytes()
                begin = stop

    def _body(self, body: str) -> bytes:
        """Ids of lower-case letters, or of one mark."""
        found = self.bodies.get(body)
        if found is None:
            spelled = body if body.isascii() else body.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.model.tokenize(spelled)]
            found = self.bodies[body] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def _learned(self, words: list[str]) -> dict[str, bytes]:
        learned, others = {}, []
        for word in words:
            if word.isascii() and word.isalpha() and not self.exact:
                learned[word] = self._body(word.lower())
            elif (plain := self.PLAIN.fullmatch(word)) and not self.exact:
                body, mark = plain.groups()
                learned[word] = self._body(body.lower()) + (self._body(mark) if mark else b"")
            else:
                others.append(word)
        learned.update(zip(others, self._whole(others), strict=True))
        return learned

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a string array without NULLs, as little-endian unsigned 32-bit numbers."""
        lists = pc.ascii_split_whitespace(texts)
        encoded = lists.flatten().dictionary_encode()
        words = encoded.dictionary.to_pylist()
        own = {w: ids for w in words if (ids := self.known.get(w)) is not None}
        # Sorted, so that equal calls ask in equal order.
        learned = self._learned(sorted(own.keys() ^ set(words)))
        if len(self.known) + len(learned) > CACHED_WORDS:
            self.known, self.bodies = dict(own), {}
        self.known |= learned
        own |= learned
        parts = [own[w] for w in words]
        ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4)
        ids = np.frombuffer(b"".join(parts), dtype="<u4")
        codes = encoded.indices.to_numpy()
        lengths = np.diff(ends, prepend=0)[codes]
        stops = np.cumsum(lengths)
        flat = ids[np.repeat(ends[codes] - stops, lengths) + np.arange(len(stops) and stops[-1])]
        bounds = np.concatenate([[0], stops])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return [flat[begin:stop] for begin, stop in zip(bounds[:-1], bounds[1:], strict=True)]


class Windows:
    """At most ``most`` open windows of ``size`` tokens. ``place`` returns what it closes."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.free: list[tuple[int, int]] = []  # (free tokens, window), ascending
        self.pieces: dict[int, list] = {}
        self.count = 0

    def _open(self) -> int:
        self.count += 1
        self.pieces[self.count - 1] = []
        insort(self.free, (self.size, self.count - 1))
        return self.count - 1

    def _put(self, at: int, piece: tuple) -> list:
        """Put a piece (doc, start, length) into the window at place ``at`` of ``free``."""
        free, window = self.free.pop(at)
        self.pieces[window].append((piece, self.size - free))
        if free > piece[2]:
            insort(self.free, (free - piece[2], window))
            return []
        return [(window, self.pieces.pop(window))]

    def place(self, doc, start: int, length: int) -> list:
        closed = []
        while length:
            at = bisect_left(self.free, (min(length, self.size), -1))
            if length < self.size and at < len(self.free):
                return closed + self._put(at, (doc, start, length))
            if length < self.size and len(self.free) < self.most:
                self._open()
                continue
            if length >= self.size:  # a whole sequence by itself
                self.count += 1
                closed.append((self.count - 1, [((doc, start, self.size), 0)]))
                start, length = start + self.size, length - self.size
                continue
            head = self.free[0][0]
            closed += self._put(0, (doc, start, head))
            start, length = start + head, length - head
        return closed


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())


def _slices(texts: pa.Array, most: int = 16 << 20) -> Iterator[pa.Array]:
    """Consecutive parts of an array of texts, of about ``most`` bytes each."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(ends):
        done = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield texts.slice(begin, stop - begin)
        begin = stop


def pack(
    docs: DataFrame,
    length: int = 2048,
    open_windows: int = 32,
    tokenizer: str | None = None,
    end: int = END,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; ``ids`` if wanted.

    ``tokenizer`` is the path of a tokenizer file that all executors can open. The same input files give the
    same pieces, so a task that is run again after a lost executor writes what it wrote before.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {PIECE}" + (", ids array<int>" if with_ids else "")
    names = ["doc_id"] + [x.split()[0] for x in PIECE.split(", ")] + ["ids"] * with_ids
    number = pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, windows = WordTokenizer(path), Windows(length, open_windows)
        task = TaskContext.get().partitionId()
        kept: dict[int, list] = {}  # document number: doc_id, ids, tokens not yet in a row

        def rows(window: int, pieces: list, is_open: bool) -> Iterator[tuple]:
            for (doc, start, n), offset in pieces:
                doc_id, ids, left = kept[doc]
                own = ids[start : start + n]
                left -= n
                if left:
                    kept[doc][2] = left
                else:
                    del kept[doc]
                row = (doc_id, start, n, _crc(own), len(ids), (task << 28) + window, offset, task, is_open)
                yield (*row, own.astype(np.int32)) if with_ids else row

        def batch_of(out: list) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            types = [id_type, *[number] * 7, pa.bool_()] + [pa.list_(pa.int32())] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        id_type, out, doc = pa.int64(), [], 0
        for batch in batches:
            id_type = batch["doc_id"].type
            ids = iter(batch["doc_id"].to_pylist())
            for part in _slices(pc.fill_null(batch["text"], "")):
                for tokens in words.encode(part):
                    doc_id = next(ids)
                    tokens = np.append(tokens, np.uint32(end))
                    kept[doc] = [doc_id, tokens, len(tokens)]
                    for window, pieces in windows.place(doc, 0, len(tokens)):
                        out += rows(window, pieces, False)
                    doc += 1
                if len(out) >= 2000:
                    yield batch_of(out)
                    out = []
        for window, pieces in sorted(windows.pieces.items()):
            out += rows(window, pieces, True)
        if out:
            yield batch_of(out)

    written = materialize(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lean(run), schema))
    result = [written.where(~F.col("is_open"))]
    left, turn = written.where("is_open"), 1
    while True:
        groups = (left.agg(F.max("task")).first()[0] or 0) // MERGE + 1
        merged = materialize(_merged(left, turn, groups == 1, length))
        result.append(merged.where(~F.col("is_open")))
        if groups == 1:
            break
        left, turn = merged.where("is_open"), turn + 1
    every = result[0]
    for part in result[1:]:
        every = every.unionByName(part)
    return every.drop("task", "is_open")


def _merged(left: DataFrame, turn: int, last: bool, length: int) -> DataFrame:
    """Pieces of open windows packed again, whole, by groups of tasks."""

    def merge(pieces: pd.DataFrame) -> pd.DataFrame:
        group = int(pieces["task"].iloc[0]) // MERGE
        # The order of rows in a group is not defined, so every column decides.
        order = ["length", "task", "sequence_id", "offset"]
        pieces = pieces.sort_values(order, ascending=[False, True, True, True]).reset_index(drop=True)
        free: list[tuple[int, int]] = []
        windows, offsets, filled = [], [], []
        for n in pieces["length"].tolist():
            at = bisect_left(free, (n, -1))
            room, window = free.pop(at) if at < len(free) else (length, len(filled))
            if window == len(filled):
                filled.append(0)
            windows.append(window)
            offsets.append(length - room)
            filled[window] = length - room + n
            if room > n:
                insort(free, (room - n, window))
        closed = np.array(filled)[windows] >= (0 if last else NEARLY_FULL * length)
        sequence = (turn << 56) + (group << 28) + np.array(windows)
        return pieces.assign(sequence_id=sequence, offset=offsets, task=group, is_open=~closed)

    groups = left.withColumn("group", F.floor(F.col("task") / MERGE))
    return groups.groupBy("group").applyInPandas(lambda pdf: merge(pdf.drop(columns="group")), left.schema)
