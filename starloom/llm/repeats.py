"""Segments of windows that may occur more than once, found with a count-min sketch that no machine holds as a whole.

First pass: every task adds the anchors of its documents to a sketch of its own, cut into shards of SHARD counters; a shard's
counters from all tasks are merged by adding. A window's estimate is the counter of its anchor: never below its true count.
Second pass: only segments whose counter reaches two go on. The sketch's width follows the input, so that a shard stays small
while the number of shards grows; counters travel as sorted differences, compressed.

A document is a row's (doc_id, text): rows alike in both are one document, a null doc_id comes last, and documents that share
a doc_id are in the order of a hash of their texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.llm import anchors
from starloom.llm.common import small_batches

SHARD = 1 << 21
#: Counters for each anchor expected, at least.
ROOM = 16
#: Anchors that a task counts before it hands its sketch on.
FLUSH = 1 << 20
NO_ID = (1 << 63) - 1
#: Layout of `place`, which orders the windows of a document: first window, number of windows less one.
FIRST_BITS, COUNT_BITS = 36, 9
SEGMENTS = "h long, k long, id long, tag binary, place long"


def keyed(docs: DataFrame, *more: str | Column) -> DataFrame:
    """id and tag, 128 bits of the text's SHA-256, which tell documents apart, with more columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tag = F.unhex(F.substring(F.sha2(text, 256), 1, 32))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), tag.alias("tag"), *more)


def first_of(place: Column) -> Column:
    return F.shiftright(place, COUNT_BITS)


def count_of(place: Column) -> Column:
    return place.bitwiseAND(F.lit((1 << COUNT_BITS) - 1)) + 1


def texts(batches: Iterator) -> Iterator[tuple[int, bytes, bytes]]:
    """(id, tag, text in UTF-8) of the rows of (id, tag, text binary)."""
    for b in batches:
        ids, tags = b.column("id").to_pylist(), b.column("tag").to_pylist()
        for at in range(0, b.num_rows, 64):
            part = b.column("text").slice(at, 64).to_pylist()
            yield from zip(ids[at : at + 64], tags[at : at + 64], (t or b"" for t in part), strict=True)


def text_rows(docs: DataFrame) -> DataFrame:
    return keyed(small_batches(docs), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def found(batches: Iterator, items: Callable[[bytes], np.ndarray], window: int, gram: int) -> Iterator[tuple[list, tuple]]:
    """([(id, tag)], arrays of segments), the arrays' document being a place in the list."""
    seen: list[tuple[int, bytes]] = []

    def documents() -> Iterator[tuple[int, np.ndarray]]:
        for i, tag, text in texts(batches):
            if len(text) >= window:
                seen.append((i, tag))
                yield len(seen) - 1, items(text)

    for arrays in anchors.segments(documents(), window, gram):
        yield seen, arrays


def sketches(batches: Iterator, items: Callable, window: int, gram: int, width: int) -> Iterator:
    """(shard, counters): a task's sketches. Counters of one are cells, those of two and more follow."""
    import pyarrow as pa

    held, size = [], 0

    def rows() -> pa.RecordBatch:
        cells, n = np.unique(np.concatenate(held) if held else np.empty(0, np.uint64), return_counts=True)
        shard = (cells // SHARD).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(cells) else np.empty(0, int)
        payload = []
        for a, b in zip(cut, np.r_[cut, len(cells)][1:], strict=True):
            low = (cells[a:b] % SHARD).astype(np.uint32)
            packed = low << 1 | (n[a:b] > 1)
            payload.append(zlib.compress(np.diff(packed, prepend=np.uint32(0)).astype(np.uint32).tobytes(), 1))
        return pa.RecordBatch.from_arrays([pa.array(shard[cut], pa.int64()), pa.array(payload, pa.binary())], names=["shard", "counters"])

    for _, (_, _, _, h, *_) in found(batches, items, window, gram):
        held.append(h % np.uint64(width))
        size += len(h)
        if size >= FLUSH:
            yield rows()
            held, size = [], 0
    yield rows()


def merged(group):
    """The cells of a shard whose counters reach two when all tasks' sketches are added."""
    import pyarrow as pa

    total = np.zeros(SHARD, np.uint8)
    for payload in group.column("counters").to_pylist():
        packed = np.cumsum(np.frombuffer(zlib.decompress(payload), np.uint32), dtype=np.uint32)
        cell = packed >> 1
        total[cell] = np.minimum(total[cell] + 1 + (packed & 1), 2)
    cells = np.flatnonzero(total >= 2) + group.column("shard")[0].as_py() * SHARD
    return pa.table({"cell": pa.array(cells, pa.int64())})


def all_segments(batches: Iterator, items: Callable, window: int, gram: int) -> Iterator:
    import pyarrow as pa

    for seen, (doc, first, n, h, k, _, _) in found(batches, items, window, gram):
        some, which = np.unique(doc, return_inverse=True)
        ids, tags = (pa.array(c, t).take(pa.array(which)) for c, t in zip(zip(*(seen[d] for d in some), strict=True), (pa.int64(), pa.binary()), strict=True))
        place = first << COUNT_BITS | (n - 1)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(k.view(np.int64)), ids, tags, pa.array(place)], names=["h", "k", "id", "tag", "place"])


def suspected(docs: DataFrame, items: Callable[[bytes], np.ndarray], window: int, gram: int, bytes_an_item: float) -> DataFrame:
    """(h, k, id, tag, place): segments whose anchor (h) is estimated to occur at least twice; k is the segment's own hash."""
    size = docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    expected = 2 * size / bytes_an_item / (window - gram + 2)
    width = max(SHARD, 1 << int(np.ceil(np.log2(max(1.0, ROOM * expected)))))
    rows = text_rows(docs)
    hot = rows.mapInArrow(lambda bs: sketches(bs, items, window, gram, width), "shard long, counters binary").groupBy("shard").applyInArrow(merged, "cell long")
    # h stands for an unsigned number; width is a power of two, so the low bits are the cell.
    segs = rows.mapInArrow(lambda bs: all_segments(bs, items, window, gram), SEGMENTS)
    return segs.join(hot, F.col("h").bitwiseAND(F.lit(width - 1)) == hot["cell"], "left_semi")


def packed(docs: DataFrame) -> DataFrame:
    """(id, tag, text) with compressed texts, for shuffling."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        c = zstandard.ZstdCompressor(level=1)
        for b in batches:
            out = [c.compress(t or b"") for at in range(0, b.num_rows, 64) for t in b.column("text").slice(at, 64).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("tag"), pa.array(out, pa.binary())], names=["id", "tag", "text"])

    return text_rows(docs).mapInArrow(run, "id long, tag binary, text binary")
