"""Removal of repeated substrings of words by a count-min prefilter.

A window is `window` consecutive words of a document. Each word that lies in a window whose words also begin earlier (in a
document with a smaller doc_id, or before in the same one) is removed; windows are judged on the input.

Segments of windows that the sketch (repeats.py) estimates to occur once are gone after the first pass; no repeated window is.
The rest are grouped exactly: a segment that an earlier one equals is covered as a whole. Only where segments with the same
anchor differ are their windows, of one occurrence of each segment, compared one by one.

Defined results: a null text has no words; the kept text of a document without kept words is empty. Rows alike in doc_id and
text are one document and share its result. Texts are taken whole. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm import anchors, repeats
from starloom.llm.common import written
from starloom.llm.repeats import count_of, first_of

WINDOW = 20
GRAM = 6


def word_items(text: bytes) -> np.ndarray:
    """64-bit hashes of the words: bytes.split() cuts at blank, tab, LF, VT, FF and CR."""
    import xxhash

    words = text.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_rows(window: int) -> Callable[[Iterator], Iterator]:
    """(w1, w2, id, tag, place): the windows of segments, one row each, from rows (id, tag, text, segments)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        d = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for i, tag, text, places in zip(*(b.column(c).to_pylist() for c in ("id", "tag", "text", "places")), strict=True):
                items = word_items(d.decompress(text))
                p = np.array(places, np.int64)
                first, n = p >> repeats.COUNT_BITS, (p & ((1 << repeats.COUNT_BITS) - 1)) + 1
                starts = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
                one, two = anchors.Rolling(items, 0), anchors.Rolling(items, 1)
                columns = one.at(starts, starts + window).view(np.int64), two.at(starts, starts + window).view(np.int64), np.full(len(starts), i, np.int64)
                out.append((*map(pa.array, columns), pa.repeat(pa.scalar(tag, pa.binary()), len(starts)), pa.array(starts << repeats.COUNT_BITS)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*out, strict=True)], names=["w1", "w2", "id", "tag", "place"])

    return run


def covers(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, tag, place) of segments whose windows all begin earlier too; a document may have several."""
    s = written(repeats.suspected(docs, word_items, window, gram, 6.0))
    at = F.struct("id", "tag", "place")
    # Written, so that the joins below shuffle both sides anew: Spark splits a hot key there, but not where one side is an aggregate.
    seg = written(s.groupBy("h", "k").agg(F.min(at).alias("first"), F.count("*").alias("n")))
    again = s.join(seg.where("n > 1"), ["h", "k"]).where(F.col("first") != at).select("id", "tag", "place")
    # Equal windows have equal anchors, so where an anchor has one segment only there is nothing else to find.
    several = seg.groupBy("h").agg(F.count("*").alias("different")).where("different > 1").select("h")
    edge = seg.join(several, "h", "left_semi").select("first.*")
    asked = edge.groupBy("id", "tag").agg(F.collect_set("place").alias("places"))
    rows = repeats.packed(docs).join(asked, ["id", "tag"]).mapInArrow(window_rows(window), "w1 long, w2 long, id long, tag binary, place long")
    w = written(rows)
    first = written(w.groupBy("w1", "w2").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    later = w.join(first, ["w1", "w2"]).where(F.col("first") != at).select("id", "tag", "place")
    return again.unionByName(later)


def ranges(cover: DataFrame, window: int) -> DataFrame:
    """(id, tag, ranges): one row for each document that has covers, a range being first item and end."""
    first = first_of(F.col("place"))
    span = F.struct(first.alias("a"), (first + count_of(F.col("place")) + (window - 1)).alias("b"))
    return cover.select("id", "tag", span.alias("r")).groupBy("id", "tag").agg(F.collect_list("r").alias("ranges"))


def with_ranges(docs: DataFrame, cover: DataFrame, window: int) -> DataFrame:
    """(id, tag, compressed text, ranges or null) for each row of docs."""
    return repeats.packed(docs).join(ranges(cover, window), ["id", "tag"], "left")


def digest(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        d = zstandard.ZstdDecompressor()
        for b in batches:
            n_words, n_removed, sha = [], [], []
            spans = b.column("ranges")
            for at in range(b.num_rows):
                words = d.decompress(b.column("text")[at].as_py()).split()
                r = spans[at].as_py() or []
                gone, _, runs = anchors.union_length(np.array([x["a"] for x in r], np.int64), np.array([x["b"] for x in r], np.int64))
                kept, after = [], 0
                for a, z in runs:
                    kept += words[after:a]
                    after = z
                kept += words[after:]
                n_words.append(len(words))
                n_removed.append(gone)
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    out = with_ranges(docs, covers(docs, window, gram), window).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(repeats.NO_ID)))


def deduplicate(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, kept): the kept words joined by blanks."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        d = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for at in range(b.num_rows):
                words = d.decompress(b.column("text")[at].as_py()).split()
                gone = np.zeros(len(words) + 1, bool)
                for x in b.column("ranges")[at].as_py() or []:
                    gone[x["a"] : x["b"]] = True
                out.append(b" ".join([w for w, g in zip(words, gone, strict=False) if not g]).decode())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.string())], names=["doc_id", "kept"])

    out = with_ranges(docs, covers(docs, window, gram), window).mapInArrow(run, "doc_id long, kept string")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(repeats.NO_ID)))
