"""Benchmark items inside documents, by a prefix-filtered set join on word shingles.

An item's windows are `window` consecutive words, or all of a shorter item. Shingles, runs of up to SHINGLE words, are ordered by rarity: the
number of their occurrences in all documents, then their hash. A document that contains a window contains all its shingles, so at
containment 1 the prefix that must be joined is the one rarest shingle of each window; a window of which some shingle occurs
nowhere is gone. Where a document has a window's rarest shingle, its place in the window bounds where the window begins and ends
there (position and length), and what passes is verified word by word over that window.

Both passes over the documents (counting shingles, then finding prefixes) leave out shingles that no item has by a bitmap of
2^BITS hashes: 8 MB, broadcast, whatever the benchmark's size; a larger benchmark lets more shingles through to the joins, which are
exact. A prefix met carries the few words around it that a window may reach, so that texts are never shuffled.

Defined results: a null or empty text has no words and no hits; an item without words has no windows. Items alike in item_id are one
item; one with a null item_id makes hits, but is neither listed nor counted. Each row of docs is a document of its own, whatever its
doc_id. Texts are taken whole, long ones in pieces that overlap by twice a window. Empty documents give an empty result, an empty benchmark no
hits. Columns of any other name are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm import anchors
from starloom.llm.common import free_name, small_batches, written
from starloom.llm.words import FOLD, pieces, rows_of

WINDOW = 10
SHINGLE = 3
BITS = 26
#: Bits of the bitmap that one task puts together.
SHARD_BITS = 17
#: Words worked on together, at least.
TOGETHER = 1 << 16
STEP = np.uint64(0x9E3779B97F4A7C15)


def hashed(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, from the words' hashes; of no run, if there are fewer."""
    n = len(h) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = out * STEP + h[j : j + n]
    return anchors.mixed(out)


def window_rows(window: int, shingle: int):
    """(item_id, words, shingles) of the windows of items."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            ids, rows = b.column("item_id").to_pylist(), []
            for i, text in zip(ids, rows_of(b), strict=True):
                words = text.translate(FOLD).split()
                k, size = min(shingle, len(words)), min(window, len(words))
                s = shingles(hashed(words), k).view(np.int64)
                rows += [(i, b" ".join(words[at : at + size]).decode(), s[at : at + size - k + 1].tolist()) for at in range(len(words) - size + 1) if size]
            columns = zip(*rows, strict=True) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.list_(pa.int64())), strict=True)], names=["item_id", "words", "shingles"])

    return run


def bitmap(hashes: DataFrame, bits: int = BITS) -> np.ndarray:
    """A bit for the low bits of each of hashes(shingle): 2^bits of them, put together in shards; the driver gets 2^bits / 8 bytes at most."""
    shard = min(SHARD_BITS, bits)

    def run(group):
        import pyarrow as pa

        cells = np.zeros(1 << shard, bool)
        cells[group.column("cell").to_numpy() & ((1 << shard) - 1)] = True
        return pa.table({"shard": pa.array([group.column("shard")[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(cells, bitorder="little").tobytes()], pa.binary())})

    cell = F.col("shingle").bitwiseAND(F.lit((1 << bits) - 1))
    cells = hashes.select(cell.alias("cell")).distinct().withColumn("shard", F.shiftright("cell", shard))
    out = np.zeros(1 << bits >> 3, np.uint8)
    for r in cells.groupBy("shard").applyInArrow(run, "shard long, bits binary").toLocalIterator():
        part = np.frombuffer(r["bits"], np.uint8)
        out[r["shard"] * len(part) : (r["shard"] + 1) * len(part)] = part
    return out


def known(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = h & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def met(texts: Iterator[bytes], bits: np.ndarray, sizes: list[int], window: int) -> Iterator[tuple[list[bytes], np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """(words, pieces, [(shingles, places)] for each size) of texts put together: shingles that the bitmap knows, each of a text once.

    pieces has row, first word's number in the text, begin, end, number of new words, and the places it answers for, one line for each: up to a
    window from its end, where the next piece takes over, but the last one up to the text's end.
    """
    words: list[bytes] = []
    held: list[tuple[int, ...]] = []

    def out():
        h, info = hashed(words), np.array(held, np.int64).reshape(-1, 7)
        n = info[:, 3] - info[:, 2]
        piece, place = np.repeat(np.arange(len(info)), n), np.arange(len(words))
        low, high = info[piece, 5], info[piece, 6]
        found = []
        for k in sizes:
            s = shingles(h, k)
            m = len(s)
            at = np.flatnonzero((piece[:m] == piece[k - 1 :][:m]) & (place[:m] >= low[:m]) & (place[:m] < high[:m]))
            at = at[known(s[at], bits)]
            found.append((s[at], at))
        return words, info, found

    for row, text in enumerate(texts):
        seen = done = 0
        for first, part, last in pieces(text, 2 * window):
            begin, end = len(words) - first, first + len(part)
            upto = end if last else max(done, end - window)
            held.append((row, first, begin + first, begin + end, end - seen, begin + done, begin + upto))
            seen, done = end, upto
            words += part
            if len(words) >= TOGETHER:
                yield out()
                words, held = [], []
    if held:
        yield out()


def count_rows(bits, sizes: list[int], window: int, flush: int = 1 << 18):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kept, size = [], 0

        def rows():
            s, n = np.unique(np.concatenate(kept) if kept else np.empty(0, np.uint64), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(n.astype(np.int64))], names=["shingle", "n"])

        for b in batches:
            for _, _, found in met(rows_of(b), bits.value, sizes, window):
                kept += [s for s, _ in found]
                size += sum(len(s) for s, _ in found)
                if size >= flush:
                    yield rows()
                    kept, size = [], 0
        yield rows()

    return run


MET = "row long, doc_id long, n_words long, met array<struct<shingle:long,at:long,before:int,around:string>>"


def met_rows(bits, sizes: list[int], window: int, shingle: int):
    """A row for each document: its number of words, and the prefixes met with the words around them."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            n_words, listed = np.zeros(b.num_rows, np.int64), [[] for _ in range(b.num_rows)]
            for words, info, found in met(rows_of(b), bits.value, sizes, window):
                np.add.at(n_words, info[:, 0], info[:, 4])
                for k, (s, at) in zip(sizes, found, strict=True):
                    reach = window - k if k == shingle else 0  # a shorter shingle is a whole item
                    piece = np.searchsorted(info[:, 2], at, side="right") - 1
                    low, high = np.maximum(at - reach, info[piece, 2]), np.minimum(at + k + reach, info[piece, 3])
                    number = at - info[piece, 2] + info[piece, 1]
                    for h, p, a, lo, hi, row in zip(s.view(np.int64).tolist(), number.tolist(), at.tolist(), low.tolist(), high.tolist(), info[piece, 0].tolist(), strict=True):
                        listed[row].append({"shingle": h, "at": p, "before": a - lo, "around": b" ".join(words[lo:hi]).decode()})
            kind = pa.list_(pa.struct([("shingle", pa.int64()), ("at", pa.int64()), ("before", pa.int32()), ("around", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(n_words), pa.array(listed, kind)], names=["row", "doc_id", "n_words", "met"])

    return run


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, bits: int = BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables (row, doc_id, n_words) of docs(doc_id, text), (row, start, size, words) of windows in them, and (words, item_id) of the windows of items(item_id, text).

    row numbers the documents.
    """
    session = docs.sparkSession
    texts = lambda d, key, kind: small_batches(d).select(F.col(key).cast(kind).alias(key), F.col("text").cast("string").alias("text"))
    windows = written(texts(items, "item_id", "string").mapInArrow(window_rows(window, shingle), "item_id string, words string, shingles array<long>").distinct())
    shapes = windows.select("words", "shingles").dropDuplicates(["words"])
    each = shapes.select("words", F.size(F.split("words", " ")).alias("size"), F.posexplode("shingles").alias("offset", "shingle"))
    sizes = sorted(r["k"] for r in each.select(F.least("size", F.lit(shingle)).alias("k")).distinct().collect())  # no more than `shingle` rows
    first = session.sparkContext.broadcast(bitmap(each.select("shingle"), bits))
    rows = texts(docs, "doc_id", "long")
    often = written(rows.mapInArrow(count_rows(first, sizes, window), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")))
    ordered = each.join(often, "shingle", "left").groupBy("words", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("rarest"))
    prefix = written(ordered.where("rarest.n > 0").select("words", "size", "rarest.shingle", "rarest.offset"))
    second = session.sparkContext.broadcast(bitmap(prefix.select("shingle"), bits))
    found = written(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(met_rows(second, sizes, window, shingle), MET))
    at = found.select("row", F.explode("met").alias("m")).select("row", "m.*").withColumn("around", F.split("around", " "))
    fits = (F.col("before") >= F.col("offset")) & (F.size("around") - F.col("before") >= F.col("size") - F.col("offset"))
    there = F.array_join(F.slice("around", F.col("before") - F.col("offset") + 1, F.col("size")), " ")
    hits = at.join(prefix, "shingle").where(fits).where(there == F.col("words")).select("row", (F.col("at") - F.col("offset")).alias("start"), "size", "words")
    return found.drop("met"), written(hits), windows.select("words", "item_id")


def judged(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, doc_id, n_words, spans, item_ids): maximal hit spans (first word, end) of each document and its items, null where there are none."""
    rows, hits, owners = occurrences(docs, items, window)
    span = F.struct(F.col("start").alias("a"), (F.col("start") + F.col("size")).alias("b"))
    grown = lambda acc, s: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], s["b"]).alias("b"))))
    union = F.aggregate("spans", F.slice("spans", 1, 0), lambda acc, s: F.when((F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1)["b"], F.lit(-1)) >= s["a"]), grown(acc, s)).otherwise(F.concat(acc, F.array(s))))
    spans = hits.select("row", span.alias("s")).distinct().groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("spans")).withColumn("spans", union)
    named = hits.select("row", "words").distinct().join(owners.where("item_id IS NOT NULL"), "words").select("row", "item_id").distinct()
    listed = named.groupBy("row").agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    return rows.join(spans, "row", "left").join(listed, "row", "left")


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each document."""
    j = judged(docs, items)
    n_hit = F.aggregate(F.coalesce("spans", F.array().cast("array<struct<a:bigint,b:bigint>>")), F.lit(0).cast("long"), lambda acc, s: acc + s["b"] - s["a"])
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return j.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: float = 0.0) -> DataFrame:
    """docs without the rows of which more than `share` of the words are hit; with 0, without all that are hit at all."""
    row = free_name(docs, "row")
    kept = written(docs.withColumn(row, F.monotonically_increasing_id()))
    # The row number stands for the doc_id, so that rows alike in doc_id are told apart.
    j = judged(kept.select(F.col(row).alias("doc_id"), "text"), items, window)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["b"] - s["a"])
    gone = j.where(F.col("spans").isNotNull()).where(hit > share * F.col("n_words")).select(F.col("doc_id").alias(row))
    return kept.join(gone, row, "left_anti").drop(row)
