"""Minimum spanning forests of groups in phase space.

Two particles of a group are friends at velocity linking length vl if 4 dx^2 / l^2 + dv^2 / vl^2 <= 2. With the weight
w^2 = dv^2 / (2 - 4 dx^2 / l^2) of pairs in reach (4 dx^2 <= 2 l^2) that is w <= vl, so one minimum spanning forest gives a group's components for
every vl, and those of what it falls apart into at any smaller one: its edges up to vl are a forest of the friends at vl.

Edges of a forest of the union of edge sets are in the union of their forests, as long as edges of one weight have one order
everywhere (weight, then both pids). So each block (blocks.py) gives the forest of its own rows, each pair of blocks whose boxes may hold friends what the forest
of both has between them, and what those leave goes through Boruvka's rounds: each component takes its lightest edge outwards, and at least half of the components go. Up to FEW_EDGES of them, counted
first, one task takes by Kruskal's order; tests run both ways.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.operators.blocks import ROWS, blocks, gap2, matrices, paired, small_batches, with_rows
from starloom.operators.components import FEW_EDGES, written

SPACE, SPEED = ("x", "y", "z"), ("vx", "vy", "vz")
AXES = SPACE + SPEED
EDGES = "a long, b long, w2 double"


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place of each place's component, by passing minima along edges and jumping to them."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def weights(x: np.ndarray, y: np.ndarray, linking: float, most2: float) -> np.ndarray:
    """w^2 of all pairs of rows of x and y (columns x .. vz); infinite out of reach and above most2."""
    squares = [(x[:, k, None] - y[None, :, k]) ** 2 for k in range(6)]
    room = 2 - 4 * (squares[0] + squares[1] + squares[2]) / (linking * linking)
    w2 = squares[3] + squares[4] + squares[5]
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.where(room > 0, w2 / room, np.where((room == 0) & (w2 == 0), 0.0, np.inf))
    out[out > most2] = np.inf
    return out


def local_forest(pids: np.ndarray, w2: np.ndarray, rows: np.ndarray, columns: np.ndarray, more: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one place, other place, w^2) of the forest of a matrix of weights between places and of more edges (place, place, w^2).

    Pids rise along the rows and along the columns, so that the first of equal weights is the first by pids, too. The matrix is used up.
    """
    top, out = np.arange(len(pids)), [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    a, b, w = more
    while True:
        w2[top[rows][:, None] == top[columns][None, :]] = np.inf
        apart = top[a] != top[b]
        a, b, w = a[apart], b[apart], w[apart]
        i, j = w2.argmin(1), w2.argmin(0)
        u, v = np.concatenate([rows, rows[j], a]), np.concatenate([columns[i], columns, b])
        weight = np.concatenate([w2[np.arange(len(rows)), i], w2[j, np.arange(len(columns))], w])
        some = weight < np.inf
        if not some.any():
            return tuple(np.concatenate(c) for c in zip(*out, strict=True))
        u, v, weight = u[some], v[some], weight[some]
        group = np.concatenate([top[u], top[v]])
        low, high = np.minimum(pids[u], pids[v]), np.maximum(pids[u], pids[v])
        order = np.lexsort((np.tile(high, 2), np.tile(low, 2), np.tile(weight, 2), group))
        best = order[np.r_[True, group[order][1:] != group[order][:-1]]] % len(u)
        _, first = np.unique(np.stack([low[best], high[best]]), axis=1, return_index=True)
        best = best[first]
        out.append((u[best], v[best], weight[best]))
        top = labels(len(pids), top[u[best]], top[v[best]])[top]


def _sorted(matrix: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(matrix[0], kind="stable")
    return matrix[0][order], matrix[1][order]


INNER = "inner array<struct<a:long,b:long,w2:double>>"


def inner_rows(linking: float):
    """Blocks with their own forest, as an array of edges."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("w2", pa.float64())]))
        for batch in batches:
            most2, listed = batch.column("most2").to_pylist(), []
            for i, m in enumerate(matrices(batch.column("rows"), AXES)):
                pids, rows = _sorted(m)
                all_ = np.arange(len(pids))
                w2 = weights(rows, rows, linking, most2[i])
                np.fill_diagonal(w2, np.inf)
                p, q, w = local_forest(pids, w2, all_, all_, (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)))
                ends = np.minimum(pids[p], pids[q]), np.maximum(pids[p], pids[q]), w
                listed.append([{"a": a, "b": b, "w2": x} for a, b, x in zip(*(c.tolist() for c in ends), strict=True)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(listed, kind)], names=[*batch.schema.names, "inner"])

    return run


def cross_rows(key: str, linking: float):
    """(key, a, b, w2): edges between two blocks in the forest of both, their own forests included."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            groups, most2 = batch.column(key), batch.column("most2").to_pylist()
            inner = [list(edge_lists(batch.column(f"inner_{s}"))) for s in "ab"]
            which, a, b, w2 = [], [], [], []
            for i, (one, two) in enumerate(zip(matrices(batch.column("rows_a"), AXES), matrices(batch.column("rows_b"), AXES), strict=True)):
                (p1, x1), (p2, x2) = _sorted(one), _sorted(two)
                # Rows out of the other block's reach are there as ends of their own block's forest only.
                all1, all2 = (np.unique(np.concatenate([p, e[0], e[1]])) for p, e in ((p1, inner[0][i]), (p2, inner[1][i])))
                n = len(all1)
                ends = [(np.searchsorted(p, e[0]) + at, np.searchsorted(p, e[1]) + at, e[2]) for p, e, at in ((all1, inner[0][i], 0), (all2, inner[1][i], n))]
                more = tuple(np.concatenate(c) for c in zip(*ends, strict=True))
                pids = np.concatenate([all1, all2])
                p, q, w = local_forest(pids, weights(x1, x2, linking, most2[i]), np.searchsorted(all1, p1), np.searchsorted(all2, p2) + n, more)
                cross = (p < n) != (q < n)
                p, q, w = p[cross], q[cross], w[cross]
                which += [i] * len(p)
                a.append(np.minimum(pids[p], pids[q]))
                b.append(np.maximum(pids[p], pids[q]))
                w2.append(w)
            columns = [pa.array(np.concatenate(c) if c else [], k) for c, k in ((a, pa.int64()), (b, pa.int64()), (w2, pa.float64()))]
            yield pa.RecordBatch.from_arrays([groups.take(pa.array(which, pa.int64())), *columns], names=[key, "a", "b", "w2"])

    return run


def edge_lists(column) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    flat, ends = column.flatten(), np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
    fields = [flat.field(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "w2")]
    for lo, hi in zip(ends[:-1], ends[1:], strict=True):
        yield tuple(f[lo:hi] for f in fields)


def forest(parts: DataFrame, linking: float, key: str = "halo_id", most: str | None = None, rows: int = ROWS, report: dict | None = None, few: int = FEW_EDGES) -> DataFrame:
    """(key, a, b, w2): a minimum spanning forest of each group of parts(key, pid, x .. vz), a < b; only weights up to the column `most`, if given.

    Positions must be on one side of the box. report gets how many pairs of rows the boxes left over.
    """
    kind = dict(parts.dtypes)[key]
    p = parts.withColumn("_most2", F.col(most) * F.col(most) if most else F.lit(float("inf")))
    # In the order of their places: the first lengths reach over all velocities of a group.
    b = blocks(p, key, AXES, ("_most2",), rows, SPACE)
    b = b.withColumn("most2", F.array_max(F.transform("rows", lambda r: r["_most2"])))
    slim = b.withColumn("rows", F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in ("pid", *AXES)])))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields)
    kept = written(small_batches(slim).mapInArrow(inner_rows(linking), f"{fields}, {INNER}"))
    own = kept.select(key, F.explode("inner").alias("e")).select(key, "e.*")
    several = written(kept.groupBy(key).agg(F.count("*").alias("blocks")).where("blocks > 1").select(key))
    if report is not None:
        report["blocks"] = kept.count()
    if several.isEmpty():  # a group in one block has its forest already
        return own
    room = 2 - 4 * gap2(SPACE) / (linking * linking)
    near = (room >= 0) & (gap2(SPEED) <= F.least("most2_a", "most2_b") * room * (1 + 1e-9)) & (F.col("block_a") < F.col("block_b"))
    boxes = [f"{x}_{e}_{s}" for s in "ab" for x in AXES for e in ("lo", "hi")]
    pairs = paired(kept, key, AXES, near, ("most2",)).select(key, "block_a", "block_b", "n_a", "n_b", F.col("most2_a").alias("most2"), *boxes)
    if report is not None:
        pairs = written(pairs)
        report |= pairs.agg(F.count("*").alias("pairs_of_blocks"), F.coalesce(F.sum(F.col("n_a").cast("long") * F.col("n_b")), F.lit(0)).alias("pairs")).first().asDict()
    across = with_rows(pairs.drop("n_a", "n_b"), kept, key, ("inner",), reaching(linking)).mapInArrow(cross_rows(key, linking), f"{key} {kind}, {EDGES}")
    found = written(across.unionByName(own.join(several, key, "left_semi")))
    whole = boruvka(found, key, report) if found.count() > few else found.coalesce(1).mapInArrow(kruskal(key), f"{key} {kind}, {EDGES}")
    return own.join(several, key, "left_anti").unionByName(whole)


def reaching(linking: float):
    """Which rows of a block may have a friend in the other block's box: of the others no weight is finite."""

    def trim(row: Column, side: str) -> Column:
        o = "b" if side == "a" else "a"
        gaps = {x: F.greatest(F.lit(0.0), F.col(f"{x}_lo_{o}") - row[x], row[x] - F.col(f"{x}_hi_{o}")) for x in AXES}
        dx2, dv2 = (sum((gaps[x] * gaps[x] for x in axes), F.lit(0.0)) for axes in (SPACE, SPEED))
        room = 2 - 4 * dx2 / (linking * linking)
        return (room >= 0) & (dv2 <= F.col("most2") * room * (1 + 1e-9))

    return trim


def kruskal(key: str):
    """The forest of edges (key, a, b, w2) that one task holds, by their order."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        a, b, w2 = (t.column(c).to_numpy() for c in ("a", "b", "w2"))
        up: dict[int, int] = {}

        def top(x: int) -> int:
            up.setdefault(x, x)
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        kept = []
        for i in np.lexsort((b, a, w2)).tolist():
            x, y = top(int(a[i])), top(int(b[i]))
            if x != y:
                up[x] = y
                kept.append(i)
        yield from t.take(pa.array(kept, pa.int64())).select([key, "a", "b", "w2"]).to_batches()

    return run


def boruvka(edges: DataFrame, key: str, report: dict | None = None, most: int = 60) -> DataFrame:
    """The minimum spanning forest of edges(key, a, b, w2), in rounds that at least halve the components."""
    now = written(edges.dropDuplicates(["a", "b"]).withColumns({"ca": F.col("a"), "cb": F.col("b")}))
    chosen = []
    for turn in range(most):
        if now.isEmpty():
            break
        step = F.struct("w2", "a", "b", key, F.col("cb").alias("to"))
        back = now.select(F.col("cb").alias("c"), F.struct("w2", "a", "b", key, F.col("ca").alias("to")).alias("e"))
        best = written(now.select(F.col("ca").alias("c"), step.alias("e")).unionByName(back).groupBy("c").agg(F.min("e").alias("e")).select("c", "e.*"))
        chosen.append(written(best.select(key, "a", "b", "w2").dropDuplicates(["a", "b"])))
        up = rooted(best.select("c", F.col("to").alias("up")))
        named = lambda side: up.select(F.col("c").alias(side), F.col("up").alias(f"n{side}"))  # noqa: B023, E731
        moved = now.join(named("ca"), "ca", "left").join(named("cb"), "cb", "left")
        moved = moved.select(*edges.columns, F.coalesce("nca", "ca").alias("ca"), F.coalesce("ncb", "cb").alias("cb")).where("ca <> cb")
        # Of the edges between two components only the lightest can be taken.
        two = moved.groupBy(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).agg(F.min(F.struct("w2", "a", "b", key)).alias("e"))
        now = written(two.select("e.*", "ca", "cb"))
        if report is not None:
            report["rounds"] = turn + 1
    else:
        raise RuntimeError(f"no end after {most} rounds")
    out = edges.limit(0)
    for c in chosen:
        out = out.unionByName(c)
    return out


def rooted(step: DataFrame) -> DataFrame:
    """(c, up): where each component's steps lead, of one step (c, up) each; steps that meet head-on end at the smaller one."""
    other = step.select(F.col("c").alias("up"), F.col("up").alias("back"))
    now = written(step.join(other, "up", "left").select("c", F.when(F.col("back").isNull(), F.col("up")).when((F.col("back") == F.col("c")) & (F.col("c") < F.col("up")), F.col("c")).otherwise(F.col("up")).alias("up")))
    while True:
        ahead = now.select(F.col("c").alias("up"), F.col("up").alias("next"))
        new = written(now.join(ahead, "up", "left").select("c", F.coalesce("next", "up").alias("next"), "up"))
        if new.where("next <> up").isEmpty():
            return new.select("c", "up")
        now = new.select("c", F.col("next").alias("up"))
