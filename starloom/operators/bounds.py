"""Rigorous bounds of a group's pair sum from a hierarchy of cells, and the bound test that sums exactly only what they leave open.

The pair sum is that of properties.potential(): the earlier row's mass / sqrt(d^2 + s^2) over pairs. For two cells whose boxes' distances
lie in [near, far] and whose rows' masses in [light, heavy] it is between n_a n_b light / sqrt(far^2 + s^2) and n_a n_b heavy / sqrt(near^2 + s^2). A
pair of cells whose bounds are close is done; others fall apart into the pairs of their halves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.operators.blocks import ROWS, blocks, gap2, matrices, paired, small_batches, span2, with_rows
from starloom.operators.components import written
from starloom.operators.numbering import running_sums

SPACE = ("x", "y", "z")
#: Rows of a cell that isn't halved any more.
LEAF = 16
#: Largest ratio of upper to lower bound of a pair of cells that is not opened: of the blocks' boxes, and turn by turn of cells until the test is settled.
CLOSE = 2.0
TURNS = (8.0, 3.0)
#: Pairs of leaves evaluated at once.
BATCH = 4096
#: Ranges of pid that a group's exact sum is cut into, and the fewest and most rows of one.
CHUNKS, CHUNK = 48, (8192, 65_536)


def ordered(x: np.ndarray) -> np.ndarray:
    """Places in an order in which every cell of the hierarchy is a range: halves along the longest side of its box, over and over."""
    order = np.arange(len(x))
    todo = [(0, len(x))]
    while todo:
        a, b = todo.pop()
        if b - a <= LEAF:
            continue
        part = order[a:b]
        axis = int(np.ptp(x[part], axis=0).argmax())
        half = (b - a) // 2
        order[a:b] = part[np.argpartition(x[part, axis], half)]
        todo += [(a, a + half), (a + half, b)]
    return order


class Cells:
    """The hierarchy of halves: begin, end, box and masses of each cell, its halves being cells 2 i + 1 and 2 i + 2 of a list by levels."""

    def __init__(self, x: np.ndarray, m: np.ndarray):
        begin, end, first, level = [0], [len(x)], [-1], [0]
        while level:
            nxt = []
            for i in level:
                a, b = begin[i], end[i]
                if b - a > LEAF:
                    half = (b - a) // 2
                    first[i] = len(begin)
                    nxt += [len(begin), len(begin) + 1]
                    begin += [a, a + half]
                    end += [a + half, b]
                    first += [-1, -1]
            level = nxt
        self.begin, self.end, self.first = np.array(begin), np.array(end), np.array(first)
        self.low, self.high = np.empty((len(begin), 3)), np.empty((len(begin), 3))
        self.light, self.heavy = np.empty(len(begin)), np.empty(len(begin))
        for i in range(len(begin) - 1, -1, -1):
            f = first[i]
            if f < 0:
                part = slice(begin[i], end[i])
                self.low[i], self.high[i], self.light[i], self.heavy[i] = x[part].min(0), x[part].max(0), m[part].min(), m[part].max()
            else:
                self.low[i], self.high[i] = np.minimum(self.low[f], self.low[f + 1]), np.maximum(self.high[f], self.high[f + 1])
                self.light[i], self.heavy[i] = min(self.light[f], self.light[f + 1]), max(self.heavy[f], self.heavy[f + 1])


def interval(x: np.ndarray, m: np.ndarray, softening: float, close: float = CLOSE) -> tuple[float, float, int]:
    """(lower, upper, pairs of rows evaluated) of the pair sum of rows in the order of pid."""
    if len(x) < 2:
        return 0.0, 0.0, 0
    order = ordered(x)
    return cell_sums(x[order], m[order], order, Cells(x[order], m[order]), softening, close)


def leaf_sums(x: np.ndarray, m: np.ndarray, order: np.ndarray, c: Cells, a: np.ndarray, b: np.ndarray, s2: float) -> float:
    """The exact sum over pairs of leaves, padded to LEAF rows by rows without mass that come before all others."""
    total = 0.0
    for at in range(0, len(a), BATCH):
        sides = []
        for leaf in (a[at : at + BATCH], b[at : at + BATCH]):
            place = c.begin[leaf][:, None] + np.arange(LEAF)
            real = place < c.end[leaf][:, None]
            place = np.minimum(place, len(x) - 1)
            sides.append((x[place], np.where(real, m[place], 0.0), np.where(real, order[place], -1)))
        (p, mp, op), (q, mq, oq) = sides
        d2 = sum((p[:, :, None, k] - q[:, None, :, k]) ** 2 for k in range(3)) + s2
        earlier = op[:, :, None] < oq[:, None, :]
        other = np.where((a[at : at + BATCH] == b[at : at + BATCH])[:, None, None], 0.0, mq[:, None, :])
        mass = np.where(earlier, mp[:, :, None], other)
        total += float((mass / np.sqrt(np.where(mass > 0, d2, 1.0))).sum())
    return total


def cell_sums(x: np.ndarray, m: np.ndarray, order: np.ndarray, c: Cells, softening: float, close: float) -> tuple[float, float, int]:
    s2 = softening * softening
    low = high = 0.0
    tested = 0
    a, b = np.array([0]), np.array([0])
    while len(a):
        same = a == b
        leaf = (c.first[a] < 0) & (c.first[b] < 0)
        n = (c.end[a] - c.begin[a]) * (c.end[b] - c.begin[b]).astype(float)
        near = np.maximum(0.0, np.maximum(c.low[b] - c.high[a], c.low[a] - c.high[b]))
        far = np.maximum(c.high[b] - c.low[a], c.high[a] - c.low[b])
        with np.errstate(divide="ignore"):
            lo = n * np.minimum(c.light[a], c.light[b]) / np.sqrt((far * far).sum(1) + s2)
            hi = n * np.maximum(c.heavy[a], c.heavy[b]) / np.sqrt((near * near).sum(1) + s2)
        done = ~same & (hi <= close * lo)
        low += lo[done].sum()
        high += hi[done].sum()
        exact = ~done & leaf
        value = leaf_sums(x, m, order, c, a[exact], b[exact], s2)
        low += value
        high += value
        tested += int(n[exact].sum())
        open_ = ~done & ~leaf
        a, b, same = a[open_], b[open_], same[open_]
        # A cell is halved if it can be; a pair of one cell becomes three pairs of halves.
        f, g = c.first[a], c.first[b]
        split_a, split_b = f >= 0, g >= 0
        one, two = [], []
        for da in (0, 1):
            for db in (0, 1):
                use = (split_a | (da == 0)) & (split_b | (db == 0)) & ~(same & (da > db))
                one.append(np.where(split_a, f + da, a)[use])
                two.append(np.where(split_b, g + db, b)[use])
        a, b = np.concatenate(one), np.concatenate(two)
    # Sums are rounded; what that can make is far below this.
    return low * (1 - 1e-9), high * (1 + 1e-9), tested


def is_bound(x: np.ndarray, m: np.ndarray, ke: float, softening: float, factor: float) -> tuple[bool, int, float | None]:
    """Whether ke is at most factor times the pair sum of rows in the order of pid, how many pairs of rows that took, and the sum if it had to be made."""
    n = len(x)
    if n < 2 or factor <= 0:
        return False, 0, None
    tested = 0
    if n > 32 * LEAF:  # the few pairs of fewer rows are summed as fast as bounded
        order = ordered(x)
        xs, ms = x[order], m[order]
        c = Cells(xs, ms)
        for close in TURNS:
            low, high, k = cell_sums(xs, ms, order, c, softening, close)
            tested += k
            if low > 0 and ke <= factor * low:
                return True, tested, None
            if ke > factor * high:
                return False, tested, None
    total = summed(x, m, softening)
    return total > 0 and ke <= factor * total, tested + n * (n - 1) // 2, total


def crossed(x: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray, softening: float, block: int = 1 << 20) -> float:
    """The pair sum between rows a and rows b (places in the order of pid) that have none in common."""
    total, step = 0.0, max(1, block // max(1, len(b)))
    for at in range(0, len(a), step):
        some = a[at : at + step]
        d = np.sqrt(sum((x[some, None, k] - x[None, b, k]) ** 2 for k in range(3)) + softening**2)
        total += float((np.where(some[:, None] < b[None], m[some][:, None], m[b][None]) / d).sum())
    return total


def inverse(x: np.ndarray, y: np.ndarray, s2: float) -> np.ndarray:
    """1 / sqrt(d^2 + s2) of all pairs of rows of x and y, infinite at no distance; two matrices are held at a time."""
    d = x[:, 0, None] - y[None, :, 0]
    d *= d
    e = np.empty_like(d)
    for k in (1, 2):
        np.subtract(x[:, k, None], y[None, :, k], out=e)
        e *= e
        d += e
    d += s2
    np.sqrt(d, out=d)
    with np.errstate(divide="ignore"):
        return np.reciprocal(d, out=d)


def pair_sum(p: tuple[np.ndarray, np.ndarray], q: tuple[np.ndarray, np.ndarray], s2: float) -> float:
    """The pair sum between two sets (pids, rows x, y, z, mass) that have no row in common."""
    v = inverse(p[1], q[1], s2)
    mass = np.empty_like(v)
    mass[:] = p[1][:, 3, None]
    np.copyto(mass, q[1][None, :, 3], where=q[0][None] < p[0][:, None])
    mass *= v
    return float(mass.sum())


def not_cancelled(x: np.ndarray, y: np.ndarray, s2: float) -> bool:
    """Whether |x|^2 - 2 x y + |y|^2 + s2 keeps its digits: rounding makes some 1e-16 of the squares, which is nowhere above 1e-10 of s2 then."""
    return bool(s2 >= 1e-5 * max((x * x).sum(1).max(initial=0.0), (y * y).sum(1).max(initial=0.0)))


#: Rows of a strip and of a tile: their matrix stays in a core's cache.
STRIP, TILE = 64, 512


def crossed_in_order(x: np.ndarray, m: np.ndarray, y: np.ndarray, softening: float) -> float:
    """The pair sum between rows x with masses m and rows y that all come later in the order of pid, a strip by a tile at a time."""
    if not len(x) or not len(y):
        return 0.0
    total, s2, centre = 0.0, softening * softening, (x.mean(0) + y.mean(0)) / 2
    x, y = x - centre, y - centre
    fast = not_cancelled(x, y, s2)
    if fast:  # d^2 + s2 as one product of matrices
        left, right = np.column_stack([-2 * x, (x * x).sum(1) + s2, np.ones(len(x))]), np.vstack([y.T, np.ones(len(y)), (y * y).sum(1)])
    held = np.empty(STRIP * TILE)
    for at in range(0, len(x), STRIP):
        strip = slice(at, min(at + STRIP, len(x)))
        for to in range(0, len(y), TILE):
            tile = slice(to, min(to + TILE, len(y)))
            if fast:
                v = held[: (strip.stop - at) * (tile.stop - to)].reshape(strip.stop - at, -1)
                np.dot(left[strip], right[:, tile], out=v)
                np.sqrt(v, out=v)
                np.divide(1.0, v, out=v)
            else:
                v = inverse(x[strip], y[tile], s2)
            total += float(m[strip] @ v.sum(1))
    return total


def summed(x: np.ndarray, m: np.ndarray, softening: float, block: int = TILE) -> float:
    """The exact pair sum of rows in the order of pid, a tile at a time, whatever their number."""
    total, s2 = 0.0, softening * softening
    for at in range(0, len(x), block):
        part = x[at : at + block]
        own = inverse(part, part, s2)
        own[np.tril_indices(len(part))] = 0.0
        total += float(m[at : at + block] @ own.sum(1)) + crossed_in_order(part, m[at : at + block], x[at + block :], softening)
    return total


def decided(ke, low, high):
    """Whether a kinetic term is at most each potential of [low, high], at most none (False), or that depends (None); for columns."""
    return F.when((low > 0) & (ke <= low), True).when(ke > high, False).otherwise(F.lit(None).cast("boolean"))


def bounded_sums(kept: DataFrame, softening: float, key: str) -> DataFrame:
    """(key, low, high, open): bounds of the pair sum over the blocks of a group, and how many pairs of rows lie in pairs of blocks whose bounds are not close."""
    pairs = paired(kept, key, SPACE, more=("light", "heavy"))
    own = F.col("block_a") == F.col("block_b")
    n = F.when(own, F.col("n_a").cast("double") * (F.col("n_a") - 1) / 2).otherwise(F.col("n_a").cast("double") * F.col("n_b"))
    s2 = F.lit(softening * softening)
    low = n * F.least("light_a", "light_b") / F.sqrt(span2(SPACE) + s2)
    near = F.sqrt(gap2(SPACE) + s2)
    high = F.when(n == 0, F.lit(0.0)).when(near > 0, n * F.greatest("heavy_a", "heavy_b") / near).otherwise(F.lit(float("inf")))
    low = F.when(n == 0, F.lit(0.0)).otherwise(low)
    return pairs.groupBy(key).agg(F.sum(low).alias("low"), F.sum(high).alias("high"))


def pair_rows(key: str, softening: float):
    """(key, low, high, tested) of pairs of blocks: bounds by the hierarchy inside a block, exact sums of two."""
    s2 = softening * softening

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for one, two in zip(matrices(batch.column("rows_a"), SPACE, ("mass",)), matrices(batch.column("rows_b"), SPACE, ("mass",)), strict=True):
                if two is None:
                    order = np.argsort(one[0], kind="stable")
                    out.append(interval(one[1][order, :3], one[1][order, 3], softening))
                    continue
                value = pair_sum(one, two, s2)
                out.append((value, value, len(one[0]) * len(two[0])))
            low, high, tested = zip(*out, strict=True) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(low, pa.float64()), pa.array(high, pa.float64()), pa.array(tested, pa.int64())], names=[key, "low", "high", "tested"])

    return run


def packed(c: DataFrame, key: str, rows: int = ROWS) -> DataFrame:
    """Blocks of c with the masses' range, as a table."""
    masses = lambda f: f(F.transform("rows", lambda r: r["mass"]))
    return written(small_batches(blocks(c, key, SPACE, ("mass",), rows)).withColumns({"light": masses(F.array_min), "heavy": masses(F.array_max)}))


def chunk_sums(key: str, softening: float):
    """(key, s, tested) of two chunks of a group, or of one with itself, from their rows in the order of pid."""

    def run(t):
        import pyarrow as pa

        t = t.sort_by("_place")
        chunk, x, m = t.column("_chunk").to_numpy(), np.column_stack([t.column(a).to_numpy() for a in SPACE]), t.column("mass").to_numpy()
        n = int(np.searchsorted(chunk, chunk[0], "right"))
        if n == len(x):
            value, tested = summed(x, m, softening), n * (n - 1) // 2
        else:
            value, tested = crossed_in_order(x[:n], m[:n], x[n:], softening), n * (len(x) - n)
        return pa.table({key: t.column(key)[:1], "s": pa.array([value], pa.float64()), "tested": pa.array([tested], pa.int64())})

    return run


def sent_to_ranges(c: DataFrame, key: str, chunks: int = CHUNKS, chunk: tuple[int, int] = CHUNK) -> DataFrame:
    """(key, x, y, z, mass, _place, _chunk, _a, _b): each row of c once for every pair of ranges of pid (_a, _b) that its own one is in.

    A group is cut into `chunks` ranges at most, so what is shuffled grows with the rows, not with the pairs. Ranges have between chunk[0] and
    chunk[1] rows, so that tasks stay bounded: only groups of more than chunks * chunk[1] rows are cut into more. Rows with a null among their
    places are left out, as in blocks().
    """
    there = c.select(key, "pid", *SPACE, "mass").where(F.col(key).isNotNull()).dropna(subset=[*SPACE])
    placed = running_sums(there, [key], ["pid"], {"_place": None}, {"_place": "_rows"})
    size = F.greatest(F.lit(chunk[0]), F.least(F.lit(chunk[1]), F.ceil(F.col("_rows") / chunks)))
    cut = placed.withColumns({"_chunk": F.floor(F.col("_place") / size), "_last": F.floor((F.col("_rows") - 1) / size)})
    sent = cut.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))))
    return sent.select(key, *SPACE, "mass", "_place", "_chunk", F.least("_chunk", "_other").alias("_a"), F.greatest("_chunk", "_other").alias("_b"))


def exact_sums(c: DataFrame, softening: float, key: str, chunks: int = CHUNKS, chunk: tuple[int, int] = CHUNK) -> DataFrame:
    """(key, s, tested): the pair sum of each group of c(key, pid, x, y, z, mass), two ranges of its rows at a time, and the number of pairs."""
    kind, by = dict(c.dtypes)[key], [key, "_a", "_b"]
    # Much work in few bytes: Spark would merge partitions by their size otherwise.
    dealt = sent_to_ranges(c, key, chunks, chunk).repartition(int(c.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
    sums = dealt.groupBy(*by).applyInArrow(chunk_sums(key, softening), f"{key} {kind}, s double, tested long")
    return sums.groupBy(key).agg(F.sum("s").alias("s"), F.sum("tested").alias("tested"))


def bound_flags(c: DataFrame, kinetic: DataFrame, softening: float, factor: float, key: str = "halo_id", rows: int = ROWS) -> DataFrame:
    """(key, ke, ge_low, ge_high, real, tested): the bound test of centred rows, with kinetic(key, ke) and how many pairs of rows it took.

    First, boxes of blocks; where that leaves the test open, pairs of blocks whose bounds are not close are evaluated, and only if the test
    is still open all others as well.
    """
    kind, out = dict(c.dtypes)[key], ["ke", "ge_low", "ge_high", "tested"]
    kept = packed(c, key, rows)
    first = bounded_sums(kept, softening, key)
    none = lambda col: F.coalesce(col, F.lit(0.0)) * factor
    state = written(kinetic.select(key, "ke").join(first, key, "left").select(key, "ke", none(F.col("low")).alias("ge_low"), none(F.col("high")).alias("ge_high"), F.lit(0).cast("long").alias("tested")))
    verdict = decided(F.col("ke"), F.col("ge_low"), F.col("ge_high"))
    done = [state.where(verdict.isNotNull())]
    s2 = F.lit(softening * softening)
    n = F.col("n_a").cast("double") * F.col("n_b")
    far_low, far_high = n * F.least("light_a", "light_b") / F.sqrt(span2(SPACE) + s2), n * F.greatest("heavy_a", "heavy_b") / F.sqrt(gap2(SPACE) + s2)
    close = (F.col("block_a") < F.col("block_b")) & (gap2(SPACE) + s2 > 0) & (far_high <= CLOSE * far_low)
    for whole in (False, True):
        state = state.where(verdict.isNull())
        if state.isEmpty():
            break
        if whole:
            total = exact_sums(c.join(state.select(key), key, "left_semi"), softening, key).select(key, F.col("s").alias("low"), F.col("s").alias("high"), "tested")
        else:
            some = kept.join(state.select(key), key, "left_semi")
            pairs = paired(some, key, SPACE, more=("light", "heavy"))
            far = pairs.where(close).groupBy(key).agg(F.sum(far_low).alias("low"), F.sum(far_high).alias("high")).withColumn("tested", F.lit(0).cast("long"))
            near = pairs.where(~close).select(key, "block_a", "block_b")
            sums = with_rows(near, some, key).mapInArrow(pair_rows(key, softening), f"{key} {kind}, low double, high double, tested long")
            total = sums.unionByName(far).groupBy(key).agg(*[F.sum(x).alias(x) for x in ("low", "high", "tested")])
        # Rounded sums of the bounds; a whole sum is taken as it is.
        slack = (1.0, 1.0) if whole else (1 - 1e-9, 1 + 1e-9)
        old = state.select(key, "ke", F.col("tested").alias("before"))
        state = written(old.join(total, key, "left").select(key, "ke", (none(F.col("low")) * slack[0]).alias("ge_low"), (none(F.col("high")) * slack[1]).alias("ge_high"), (F.coalesce("tested", F.lit(0)) + F.col("before")).alias("tested")))
        done.append(state.where(verdict.isNotNull() | F.lit(whole)))
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    return result.select(key, *out[:3], F.coalesce(verdict, F.lit(False)).alias("real"), "tested")
