"""Approximate nearest neighbours by counting collisions in sorted projections.

A segment of vectors keeps the sorted values of each of PROJECTIONS random projections. A query lays a window around its own
value in each, and widens them all together by virtual rehashing; only what a wider window adds is read. A vector that lies in
THRESHOLD of the windows is verified: its distance is computed on the original vectors. Widening ends when a vector as far as
the k-th best one would have collided often enough with probability SURE: a difference at distance s projects to a normal
variable of deviation s, so its number of collisions is binomial. What one segment found bounds the search in the next one,
whose windows open at that width at once; windows otherwise begin at the least width that a query needed there. Rows are in the
order of vec_id, so that reruns agree.

Every vector is indexed and meets every query, in one pass: queries are dealt into sets and vectors into slices, and each pair of
both is a group of rows, queries first. A task holds a set's queries (COMPONENTS numbers at most), their best vectors and one segment, however many
vectors follow; nothing is collected or broadcast. A slice yields k rows for each query, and slices are as many as tasks.

Defined results: vectors that are null, zero, or have null or non-finite components take no part; vectors of another length
than the query's are no candidates; rows with the query's own vec_id are the query's own. Ties go to the smaller vec_id. Vectors
alike collide alike, so of equal distances none is preferred but by vec_id. Repeated rows count once. Other columns are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from starloom.llm.common import small_batches, spread

PROJECTIONS = 32
THRESHOLD = 16
SURE = 0.95
WIDER = 1.25
SEGMENT = 8192
#: Numbers in the vectors of a set of queries, about: 32 MB.
COMPONENTS = 1 << 22
#: Vectors of a slice, at least.
SLICE = 1024


def usable(vector: Column) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & whole & F.exists(vector, lambda x: x != 0)


def reach(projections: int, threshold: int, sure: float) -> float:
    """Half a window, in units of a distance, in which a vector at that distance collides `threshold` times with probability `sure`."""

    def often(z: float) -> float:
        p = math.erf(z / math.sqrt(2))
        return sum(math.comb(projections, i) * p**i * (1 - p) ** (projections - i) for i in range(threshold, projections + 1))

    low, high = 0.0, 8.0
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if often(mid) < sure else (low, mid)
    return high


class Segment:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, axes: np.ndarray):
        self.ids, self.vectors = ids, vectors
        values = vectors @ axes.T
        order = np.argsort(values, axis=0, kind="stable").T
        self.member = order.ravel()
        sorted_values = np.take_along_axis(values.T, order, axis=1)
        low, high = (float(sorted_values.min()), float(sorted_values.max()))
        self.low, self.gap = low, (high - low) * 2 + 1
        # One ascending array: each projection's values begin a gap higher than the last one's.
        self.flat = (sorted_values - low + np.arange(len(axes))[:, None] * self.gap).ravel()
        self.squares = (vectors * vectors).sum(axis=1)
        self.typical = float(values.std()) or 1.0
        #: The least distance to a k-th best vector that a search here ended with.
        self.least = 0.0

    def _maybe(self, query: np.ndarray, of: np.ndarray, limit: float, k: int) -> np.ndarray:
        """Which of these vectors may be among the k nearest, by a product whose rounding is allowed for."""
        if not np.isfinite(self.squares.max(initial=0.0)):
            return np.arange(len(of))
        off = self.squares[of] - 2 * (self.vectors[of] @ query)
        own = float(query @ query)
        most = limit * limit - own if np.isfinite(limit) else np.partition(off, k - 1)[k - 1] if len(off) > k else np.inf
        return np.flatnonzero(off <= most + 1e-9 * (own + self.squares.max()))

    def search(self, query: np.ndarray, own: int, at: np.ndarray, k: int, threshold: int, z: float, best_d: np.ndarray, best_i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids of the k nearest found, here or before (best_d, best_i), in order."""
        n, m = len(self.ids), len(at)
        base = np.arange(m) * n
        centre = np.clip(at - self.low, -self.gap / 4, self.gap * 3 / 4) + np.arange(m) * self.gap
        left = right = np.searchsorted(self.flat, centre)
        hits = np.zeros(n, np.int64)
        checked = np.zeros(n, bool)
        # What was found before bounds the window; else no query here has needed a narrower one than `least` gives.
        half = z * best_d[-1] if len(best_d) == k else z * self.least or self.typical / 16
        while True:
            new_left = np.maximum(np.searchsorted(self.flat, centre - half, "left"), base)
            new_right = np.minimum(np.searchsorted(self.flat, centre + half, "right"), base + n)
            new_left, new_right = np.minimum(new_left, left), np.maximum(new_right, right)
            a, size = np.r_[new_left, right], np.r_[left - new_left, new_right - right]
            if total := int(size.sum()):
                hits += np.bincount(self.member[np.repeat(a - (np.cumsum(size) - size), size) + np.arange(total)], minlength=n)
            left, right = new_left, new_right
            fresh = np.flatnonzero((hits >= threshold) & ~checked)
            if len(fresh):
                checked[fresh] = True
                fresh = fresh[self.ids[fresh] != own]
                fresh = fresh[self._maybe(query, fresh, best_d[-1] if len(best_d) == k else np.inf, k)]
                off = self.vectors[fresh] - query
                best_d, best_i = np.r_[best_d, np.sqrt((off * off).sum(axis=1))], np.r_[best_i, self.ids[fresh]]
                order = np.lexsort((best_i, best_d))
                best_d, best_i = best_d[order], best_i[order]
                once = np.r_[True, (best_i[1:] != best_i[:-1]) | (best_d[1:] != best_d[:-1])][: len(best_d)]
                best_d, best_i = best_d[once][:k], best_i[once][:k]
            if (len(best_d) == k and half >= z * best_d[-1]) or checked.all():
                if len(best_d) == k:
                    self.least = min(self.least or best_d[-1], best_d[-1])
                return best_d, best_i
            half *= WIDER


def axes(length: int, projections: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng([17, length]).standard_normal((projections, length))


class Group:
    """A set of queries, and what a slice of vectors has nearest to them."""

    def __init__(self, k: int, projections: int, threshold: int, sure: float):
        self.k, self.projections, self.threshold = k, projections, threshold
        self.z = reach(projections, threshold, sure)
        self.queries: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.vectors: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.waiting: dict[int, int] = {}
        self.asked: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, list]] | None = None

    def add(self, length: int, asks: bool, ids: np.ndarray, vectors: np.ndarray) -> None:
        if asks:
            self.queries.setdefault(length, []).append((ids, vectors))
            return
        self._ready()
        if length not in self.asked:
            return
        held = self.vectors.setdefault(length, [])
        held.append((ids, vectors))
        self.waiting[length] = self.waiting.get(length, 0) + len(ids)
        if self.waiting[length] >= SEGMENT:
            self._search(length)

    def _ready(self) -> None:
        """Queries as arrays: ids, vectors, their projections, what is best so far."""
        if self.asked is None:
            self.asked = {}
            for n, parts in self.queries.items():
                ids, q = (np.concatenate(x) for x in zip(*parts, strict=True))
                self.asked[n] = ids, q, q @ axes(n, self.projections).T, [(np.empty(0), np.empty(0, np.int64))] * len(ids)
            self.queries = {}

    def _search(self, length: int) -> None:
        ids, x = (np.concatenate(c) for c in zip(*self.vectors.pop(length), strict=True))
        self.waiting[length] = 0
        s = Segment(ids, x, axes(length, self.projections))
        own, q, at, best = self.asked[length]
        for j in range(len(own)):
            best[j] = s.search(q[j], int(own[j]), at[j], self.k, self.threshold, self.z, *best[j])

    def answers(self) -> Iterator:
        """(query_id, vec_id, score), as batches."""
        import pyarrow as pa

        self._ready()
        for length in [*self.vectors]:
            self._search(length)
        for own, _, _, best in self.asked.values():
            for a in range(0, len(own), 4096):
                part = best[a : a + 4096]
                d, i = np.concatenate([b[0] for b in part]), np.concatenate([b[1] for b in part])
                q = np.repeat(own[a : a + 4096], [len(b[0]) for b in part])
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(d, pa.float64())], names=["query_id", "vec_id", "score"])


def answered(batches: Iterator, k: int, projections: int, threshold: int, sure: float) -> Iterator:
    """(query_id, vec_id, score) of rows (pair, asks, vec_id, vector) sorted by pair, those that ask first."""
    group, pair = None, None
    for b in batches:
        for at in range(0, b.num_rows, 1024):
            part = b.slice(at, 1024)
            pairs, asks, ids = (part.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "asks", "vec_id"))
            lists = part.column("vector")
            length = lists.value_lengths().to_numpy()
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(float), np.cumsum(length)
            cut = np.flatnonzero(np.r_[True, (pairs[1:] != pairs[:-1]) | (asks[1:] != asks[:-1]) | (length[1:] != length[:-1])])
            for a, z in zip(cut, np.r_[cut[1:], len(pairs)], strict=True):
                if pairs[a] != pair:
                    if group is not None:
                        yield from group.answers()
                    group, pair = Group(k, projections, threshold, sure), pairs[a]
                n = int(length[a])
                group.add(n, bool(asks[a]), ids[a:z].astype(np.int64), flat[ends[a] - n : ends[z - 1]].reshape(-1, n))
    if group is not None:
        yield from group.answers()


def search(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", projections: int = PROJECTIONS, threshold: int = THRESHOLD, sure: float = SURE, components: int = COMPONENTS, slice_: int = SLICE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which is_query holds."""
    spark = vectors.sparkSession
    kind = vectors.schema[vector].dataType
    # Floats travel as they are: half the bytes, and exact as doubles.
    number = "float" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else DoubleType().simpleString()
    named = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast(f"array<{number}>").alias("vector"), is_query.alias("asks"))
    used = named.where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    size = used.agg(F.count("*").alias("n"), F.sum(F.when(F.col("asks"), F.size("vector"))).alias("asked")).first()
    sets = max(1, -(-(size["asked"] or 0) // components))
    slices = max(1, min(-(-spread(spark) // sets), -(-size["n"] // slice_)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(n)), F.lit(n)).cast("int")
    pair = (F.col("set") * slices + F.col("slice")).cast("int").alias("pair")
    queries = used.where("asks").withColumn("set", dealt(sets)).withColumn("slice", every(slices)).select(pair, F.lit(True).alias("asks"), "vec_id", "vector")
    data = used.withColumn("slice", dealt(slices)).withColumn("set", every(sets)).select(pair, F.lit(False).alias("asks"), "vec_id", "vector")
    both = queries.unionByName(data)
    # A pair a partition: with as many keys as partitions, a hash would leave some empty.
    placed = both.repartitionById(sets * slices, "pair").sortWithinPartitions("pair", F.desc("asks"), "vec_id")
    out = small_batches(placed, 4096).mapInArrow(lambda bs: answered(bs, k, projections, threshold, sure), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return out.dropDuplicates().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
