"""Importance resampling towards a target distribution of hashed word runs, in two Arrow passes.

First pass: every partition counts the buckets of its features with np.bincount in one vector of BUCKETS numbers, and treeReduce
adds the vectors, so that the driver gets one, whatever the input. From the vectors of the documents and of the target
follow the buckets' gains. Second pass: the gains, BUCKETS numbers, are broadcast; each document's weight is the sum of its features' gains,
by np.bincount with weights. The best documents by weight plus Gumbel noise are drawn; their ranks come from a range-partitioned
running number, so no task or driver holds all scores.

A feature is 1 to 3 consecutive words joined by a blank, and its bucket the CRC-32 of its bytes. CRC-32 is linear: that of two
strings one after the other follows from theirs, so only words are hashed and runs are put together in arrays.

Defined results: a null or empty text has no features, weight 0 and a score from noise alone; it has under `least` words and is never
drawn. A null doc_id is hashed as an empty string and comes after all others on ties. Repeated rows have one score; their ranks follow
each other in any order. Texts are taken whole (in pieces that carry two words along). Empty documents give an empty result; an
empty target has no features and its counts are 0. Columns of any other name are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import small_batches, written
from starloom.llm.words import pieces, rows_of
from starloom.operators.numbering import running_sum

BUCKETS = 10_000
LONGEST = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = "42"
#: Words worked on together, at least.
TOGETHER = 1 << 16
#: Lengths in bytes that have a table of their own; longer shifts are put together from powers of two.
DIRECT = 64


@cache
def shift_tables() -> tuple[np.ndarray, np.ndarray]:
    """What a CRC becomes when n zero bytes follow, as 4 x 256 words each: for n < DIRECT, and for n = 2^k."""
    byte = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
    byte ^= byte[0]  # the linear part alone
    values = np.arange(256, dtype=np.uint32)
    direct = [np.stack([values << np.uint32(8 * b) for b in range(4)])]
    while len(direct) < DIRECT:
        t = direct[-1]
        direct.append((t >> np.uint32(8)) ^ byte[t & np.uint32(255)])
    powers = [direct[1]]
    while len(powers) < 40:
        powers.append(_looked_up(powers[-1], powers[-1]))
    return np.stack(direct), np.stack(powers)


def _looked_up(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    return table[0][c & np.uint32(255)] ^ table[1][c >> np.uint32(8) & np.uint32(255)] ^ table[2][c >> np.uint32(16) & np.uint32(255)] ^ table[3][c >> np.uint32(24)]


def shifted(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The CRCs c with n zero bytes behind."""
    direct, powers = shift_tables()
    near = np.minimum(n, DIRECT - 1)
    out = direct[near, 0, c & np.uint32(255)] ^ direct[near, 1, c >> np.uint32(8) & np.uint32(255)] ^ direct[near, 2, c >> np.uint32(16) & np.uint32(255)] ^ direct[near, 3, c >> np.uint32(24)]
    far = np.flatnonzero(n >= DIRECT)
    if len(far):
        c, left = c[far], n[far]
        for k in range(len(powers)):
            bit = (left >> k & 1).astype(bool)
            c[bit] = _looked_up(powers[k], c[bit])
        out[far] = c
    return out


def buckets(words: list[bytes], piece: np.ndarray, fresh: np.ndarray, n: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, place of its last word) of the features of each length; `piece` names each word's piece, features end in fresh words."""
    crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    behind_blank = shifted(np.full(len(words), zlib.crc32(b" "), np.uint32), size) ^ crc
    yield crc[fresh] % np.uint32(n), np.flatnonzero(fresh)
    run = crc
    for k in range(1, LONGEST):
        if len(words) <= k:
            return
        run = shifted(run[: len(words) - k], size[k:] + 1) ^ behind_blank[k:]
        whole = fresh[k:] & (piece[k:] == piece[: len(words) - k])
        yield run[whole] % np.uint32(n), np.flatnonzero(whole) + k


def blocks(texts: Iterator[bytes], size: int = TOGETHER) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """(words, piece of each, whether it is fresh, row of each piece): pieces of texts put together; a row's pieces overlap by two words."""
    words: list[bytes] = []
    rows, lengths, old = [], [], []

    def together() -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        n = np.array(lengths, np.int64)
        place = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
        return words, np.repeat(np.arange(len(n)), n), place >= np.repeat(np.array(old, np.int64), n), np.array(rows, np.int64)

    for row, text in enumerate(texts):
        before = 0
        for first, part, _ in pieces(text, LONGEST - 1):
            words += part
            rows.append(row)
            lengths.append(len(part))
            old.append(before - first)  # words of the piece that the one before had, too
            before = first + len(part)
            if len(words) >= size:
                yield together()
                words, rows, lengths, old = [], [], [], []
    if words:
        yield together()


def vectors(n: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(n, np.int64)
        for b in batches:
            for words, piece, fresh, _ in blocks(rows_of(b)):
                for bucket, _ in buckets(words, piece, fresh, n):
                    total += np.bincount(bucket, minlength=n)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    return run


def counts(texts: DataFrame, n: int = BUCKETS) -> np.ndarray:
    """How many features of texts(text) each bucket holds."""
    each = small_batches(texts).select(F.col("text").cast("string").alias("text")).mapInArrow(vectors(n), "counts binary").rdd
    none = texts.sparkSession.sparkContext.parallelize([None], 1)
    return each.union(none).map(lambda r: np.zeros(n, np.int64) if r is None else np.frombuffer(r[0], np.int64)).treeReduce(np.add)


def gains(of_documents: np.ndarray, of_target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + n) / ((s + 1)(T + n)))) of each bucket, in doubles."""
    n, big_s, big_t = len(of_documents), float(of_documents.sum()), float(of_target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (big_s + n) / ((float(s) + 1) * (big_t + n)))) for s, t in zip(of_documents, of_target, strict=True)], np.float64)


def noise(doc_id: int | None, seed: str) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


def scored(docs: DataFrame, target: DataFrame, n: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of each row of docs(doc_id, text), judged by target(text)."""
    gain = docs.sparkSession.sparkContext.broadcast(gains(counts(docs, n), counts(target, n)))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows, ids = b.num_rows, b.column("doc_id").to_pylist()
            n_words, n_features, weight = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            for words, piece, fresh, row in blocks(rows_of(b)):
                owner = row[piece]
                n_words += np.bincount(owner[fresh], minlength=rows)
                for bucket, last in buckets(words, piece, fresh, n):
                    n_features += np.bincount(owner[last], minlength=rows)
                    weight += np.bincount(owner[last], weights=gain.value[bucket], minlength=rows).astype(np.int64)
            score = weight + np.array([noise(i, seed) for i in ids], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in (n_words, n_features, weight, score))], names=[c.split()[0] for c in SCORED.split(", ")])

    thin = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return thin.mapInArrow(run, SCORED)


def drawn(scores: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """scores with rank (1, 2, ...) of the highest `percent` in a hundred of the rows with at least `least` words; null for all others."""
    kept = written(scores)
    fit = kept.where(F.col("n_words") >= least)
    most = percent * fit.count() // 100
    placed = running_sum(fit, [], [F.desc("score"), F.asc_nulls_last("doc_id"), "weight", "n_features"], "place")
    ranked = placed.withColumn("rank", F.when(F.col("place") < most, F.col("place") + 1)).drop("place")
    return ranked.unionByName(kept.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")))


def digest(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score, rank for each document."""
    return drawn(scored(docs, target)).select("doc_id", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """The drawn rows of docs, all columns. Rows alike in doc_id share a rank's fate: one is drawn as soon as any of them is."""
    chosen = drawn(scored(docs, target), percent, least).where("rank IS NOT NULL").select("doc_id").distinct()
    return docs.join(chosen, docs["doc_id"].cast("long").eqNullSafe(chosen["doc_id"]), "left_semi")
