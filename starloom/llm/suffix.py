"""Removal of repeated byte strings by column-wise construction over many pieces.

Each byte that a string of `window` bytes covers which also starts anywhere else is removed; strings are judged on the input.

Which strings can repeat at all is found with anchors and a sketch (repeats.py): segments with one content are repeated as a
whole. Where different segments share an anchor, their pieces of text, of less than two windows, go through a column-wise
construction. Each round inserts one symbol per piece, from right to left, and updates two sequences over all pieces: their
order by suffix (the permutation behind the collection's Burrows-Wheeler transform) and the common prefixes of neighbours.
A new symbol moves a piece by a stable sort; neighbours that stay together keep the least common prefix between them, one symbol
longer. Neighbours with a common prefix of a whole window are a repeated string. Inserting whole documents that way would take as
many rounds as the longest has bytes, each over all data; pieces bound the rounds by twice the window, and a bucket's
sequences to memory, so the external files between rounds become arrays.

The windows of anchors with more than HOT different segments are counted one by one instead, a segment once: exact as well, with
counts added up before they are shuffled and no group in one task.

Defined results: a null or empty text has 0 bytes. Repeated rows count as other documents. Strings do not cross rows. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm import anchors, repeats
from starloom.llm.common import written
from starloom.llm.substring import with_ranges

WINDOW = 400
GRAM = 64
#: Different segments of an anchor that go through one construction together, at most.
HOT = 2000
#: Pieces of a bucket, about.
BUCKET = 16_000
#: Rows of one content that a join brings together in one task, at most.
MANY = 10_000
#: A random 64-bit number for each byte.
BYTES = anchors.mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def byte_items(text: bytes) -> np.ndarray:
    return BYTES[np.frombuffer(text, np.uint8)]


def columns(pieces: list[bytes], group: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """For each piece, which windows (by first byte) occur in another piece of its group; `at` is where all pieces of a group are aligned."""
    m = len(pieces)
    length = np.array([len(p) for p in pieces])
    left, right = int(at.max(initial=0)), int((length - at).max(initial=0))
    symbols = np.zeros((left + right, m), np.uint16)  # a row a column, so that a round reads one row; 0: no symbol
    for i, p in enumerate(pieces):
        symbols[left - at[i] : left - at[i] + length[i], i] = np.frombuffer(p, np.uint8).astype(np.uint16) + 1
    begin, last = left - at, left - at + length - window
    flags = np.zeros((m, max(1, int(length.max(initial=0)) - window + 1)), bool)
    order = np.argsort(group, kind="stable")
    major = group[order].astype(np.int64) * 512
    differ = np.full(m, left + right)  # column where a piece and the one before it in order first differ
    differ[np.flatnonzero(np.r_[True, major[1:] != major[:-1]])] = -1
    for col in range(left + right - 1, -1, -1):
        symbol = symbols[col][order]
        key = major + symbol
        move = np.argsort(key, kind="stable")
        key = key[move]
        alike = np.r_[False, (key[1:] == key[:-1]) & (key[1:] % 512 != 0)]
        fresh = np.full(m, col)
        near = np.r_[False, move[1:] == move[:-1] + 1]
        step = np.flatnonzero(alike & near)
        fresh[step] = differ[move[step]]
        far = np.flatnonzero(alike & ~near)
        if len(far):
            fresh[far] = least(differ, move[far - 1] + 1, move[far])
        order, differ = order[move], fresh
        hit = np.flatnonzero(differ - col >= window)
        if len(hit):
            both = order[np.union1d(hit, hit - 1)]
            both = both[(begin[both] <= col) & (col <= last[both])]
            flags[both, col - begin[both]] = True
    return flags


def least(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min(x[a[i] : b[i] + 1]) for each i, by tables of minima over powers of two."""
    out = np.empty(len(a), x.dtype)
    level = np.frexp((b - a + 1).astype(float))[1] - 1
    table, size = x, 1
    for k in range(int(level.max()) + 1):
        i = np.flatnonzero(level == k)
        out[i] = np.minimum(table[a[i]], table[b[i] - size + 1])
        if len(table) > size:
            table = np.minimum(table[:-size], table[size:])
        size *= 2
    return out


def constructed(window: int) -> Callable:
    """A bucket's pieces -> (id, tag, place) of runs of repeated windows."""

    def run(rows):
        import pyarrow as pa

        _, group = np.unique(rows.column("h").to_numpy(), return_inverse=True)
        place = rows.column("place").to_numpy()
        flags = columns(rows.column("piece").to_pylist(), group, rows.column("at").to_numpy(), window)
        edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, first = np.nonzero(edge == 1)
        end = np.nonzero(edge == -1)[1]
        out = ((place >> repeats.COUNT_BITS)[row] + first) << repeats.COUNT_BITS | (end - first - 1)
        return pa.table({"id": rows.column("id").take(pa.array(row)), "tag": rows.column("tag").take(pa.array(row)), "place": pa.array(out)})

    return run


def parts_of(batches: Iterator) -> Iterator[tuple[int, bytes, bytes, list, np.ndarray, np.ndarray]]:
    """(id, tag, text, asked segments, their first windows, numbers of windows) from rows (id, tag, text, asked)."""
    import zstandard

    d = zstandard.ZstdDecompressor()
    for b in batches:
        for at in range(b.num_rows):
            asked = b.column("asked")[at].as_py()
            p = np.array([a["place"] for a in asked], np.int64)
            first, n = p >> repeats.COUNT_BITS, (p & ((1 << repeats.COUNT_BITS) - 1)) + 1
            yield b.column("id")[at].as_py(), b.column("tag")[at].as_py(), d.decompress(b.column("text")[at].as_py()), asked, first, n


def piece_rows(window: int, gram: int) -> Callable[[Iterator], Iterator]:
    """(h, id, tag, place, at, piece) of asked segments; at: where the anchor begins in the piece."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[tuple] = []

        def rows() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=["h", "id", "tag", "place", "at", "piece"])

        for i, tag, text, asked, first, n in parts_of(batches):
            for a, f, m in zip(asked, first.tolist(), n.tolist(), strict=True):
                piece = text[f : f + m + window - 1]
                grams = anchors.Rolling(byte_items(piece), 0).every(gram)[: window - gram + 1]
                held.append((a["h"], i, tag, a["place"], int(np.argmin(grams >> anchors.PLACE)), piece))
            if len(held) > 4000:
                yield rows()
                held.clear()
        if held:
            yield rows()

    return run


def window_rows(window: int) -> Callable[[Iterator], Iterator]:
    """(h, k, id, tag, place): the windows of asked segments one by one, with two hashes of their content."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for i, tag, text, _, first, n in parts_of(batches):
            items = byte_items(text)
            one, two = anchors.Rolling(items, 0), anchors.Rolling(items, 1)
            s = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            columns = two.at(s, s + window).view(np.int64), one.at(s, s + window).view(np.int64), np.full(len(s), i, np.int64)
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.repeat(pa.scalar(tag, pa.binary()), len(s)), pa.array(s << repeats.COUNT_BITS)], names=["h", "k", "id", "tag", "place"])

    return run


def asked_texts(docs: DataFrame, segs: DataFrame) -> DataFrame:
    asked = segs.groupBy("id", "tag").agg(F.collect_set(F.struct("h", "place")).alias("asked"))
    return repeats.packed(docs).join(asked, ["id", "tag"]).select("id", "tag", "text", "asked")


def again(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, tag, place) of the rows whose (h, k) occurs more than once, which counts (h, k, n) say.

    Keys of more than MANY rows are looked up in a broadcast table, of at most one key for MANY rows; the join by key leaves them out.
    """
    many = F.broadcast(counts.where(F.col("n") > MANY).select("h", "k"))
    few = counts.where(F.col("n").between(2, MANY)).select("h", "k")
    rest = rows.join(many, ["h", "k"], "left_anti").join(few, ["h", "k"], "left_semi")
    return rows.join(many, ["h", "k"], "left_semi").unionByName(rest).select("id", "tag", "place")


def covers(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, bucket: int = BUCKET) -> DataFrame:
    """(id, tag, place) of runs of repeated windows."""
    s = written(repeats.suspected(docs, byte_items, window, gram, 1.0))
    # Written, so that the join below shuffles both sides anew: Spark splits a hot key there, but not where one side is an aggregate.
    seg = written(s.groupBy("h", "k").agg(F.count("*").alias("n"), F.min(F.struct("id", "tag", "place")).alias("first")))
    several = seg.groupBy("h").agg(F.count("*").alias("different")).where("different > 1")
    edge = written(seg.join(several, "h").select("h", "first.*", (F.col("different") > hot).alias("hot")))
    size = {r["hot"]: r["n"] for r in edge.groupBy("hot").agg(F.count("*").alias("n")).collect()}
    out = again(s, seg)
    if size.get(False):
        pieces = asked_texts(docs, edge.where("NOT hot")).mapInArrow(piece_rows(window, gram), "h long, id long, tag binary, place long, at long, piece binary")
        dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(-(-size[False] // bucket))))
        out = out.unionByName(dealt.groupBy("bucket").applyInArrow(constructed(window), "id long, tag binary, place long"))
    if size.get(True):
        w = written(asked_texts(docs, edge.where("hot")).mapInArrow(window_rows(window), repeats.SEGMENTS))
        out = out.unionByName(again(w, written(w.groupBy("h", "k").agg(F.count("*").alias("n")).where("n > 1"))))
    return out


def digest(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        d = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for at in range(b.num_rows):
                text = d.decompress(b.column("text")[at].as_py())
                r = b.column("ranges")[at].as_py() or []
                gone, spans, runs = anchors.union_length(np.array([x["a"] for x in r], np.int64), np.array([x["b"] for x in r], np.int64))
                sha, after = hashlib.sha256(), 0
                for a, z in runs:
                    sha.update(text[after:a])
                    after = z
                sha.update(text[after:])
                out.append((len(text), gone, spans, sha.hexdigest()))
            if out:
                n, gone, spans, sha = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = with_ranges(docs, covers(docs, window, gram, hot), window).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(repeats.NO_ID)))
