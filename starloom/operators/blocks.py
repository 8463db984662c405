"""Groups cut into blocks of bounded size whose rows lie close together, so that work on pairs of rows is work on pairs of blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.operators.components import written
from starloom.operators.numbering import running_sum

#: Rows of a block, at most.
ROWS = 512


def interleaved(cells: list[str], bits: int) -> Column:
    """One number from columns of `bits` bits each, their highest bits first: cells that are near mostly have near numbers."""
    each = (f"shiftleft(shiftright({c}, {bit}) & 1L, {bit * len(cells) + len(cells) - 1 - k})" for bit in range(bits) for k, c in enumerate(cells))
    return F.expr(" | ".join(each))


def blocks(parts: DataFrame, key: str, axes: tuple[str, ...], more: tuple[str, ...] = (), rows: int = ROWS, along: tuple[str, ...] | None = None) -> DataFrame:
    """(key, block, n, <axis>_lo, <axis>_hi, rows): each group's rows in the order of a curve through their axes (or some of them), cut after every `rows`.

    `rows` holds pid, the axes and `more` as an array of structs. Rows without a group, or with a null among the axes, are left out. No task
    holds a group: the order is made by ranges, and a block is all that is ever put together.
    """
    along = along or axes
    bits = 60 // len(along)
    p = parts.select(key, "pid", *axes, *more).where(F.col(key).isNotNull()).dropna(subset=[*axes])
    ends = written(p.groupBy(key).agg(*[f(a).alias(f"{a}_{n}") for a in along for n, f in (("lo", F.min), ("hi", F.max))]))
    cells = [F.expr(f"coalesce(least(cast(({a} - {a}_lo) / nullif({a}_hi - {a}_lo, 0D) * {1 << bits} AS long), {(1 << bits) - 1}L), 0L)").alias(f"_c{a}") for a in along]
    coded = p.join(ends, key).select(*p.columns, *cells).select(*p.columns, interleaved([f"_c{a}" for a in along], bits).alias("_code"))
    placed = running_sum(coded, [key], ["_code", "pid"], "_place")
    boxes = [f(a).alias(f"{a}_{n}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))]
    held = F.collect_list(F.struct("pid", *axes, *more)).alias("rows")
    return placed.withColumn("block", F.floor(F.col("_place") / rows).cast("int")).groupBy(key, "block").agg(F.count("*").cast("int").alias("n"), *boxes, held)


def gap2(axes: tuple[str, ...]) -> Column:
    """The least squared distance of a row of box a and one of box b (columns <axis>_lo_a ... <axis>_hi_b)."""
    total = F.lit(0.0)
    for x in axes:
        d = F.greatest(F.lit(0.0), F.col(f"{x}_lo_b") - F.col(f"{x}_hi_a"), F.col(f"{x}_lo_a") - F.col(f"{x}_hi_b"))
        total = total + d * d
    return total


def span2(axes: tuple[str, ...]) -> Column:
    """The largest squared distance of such rows."""
    total = F.lit(0.0)
    for x in axes:
        d = F.greatest(F.col(f"{x}_hi_b") - F.col(f"{x}_lo_a"), F.col(f"{x}_hi_a") - F.col(f"{x}_lo_b"))
        total = total + d * d
    return total


def paired(kept: DataFrame, key: str, axes: tuple[str, ...], near: Column | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """(key, block_a, block_b, ...): pairs of a group's blocks, each once and each block with itself, where `near` holds.

    kept must be a written table, so that Spark can split the join of a group with many blocks. Only boxes are joined, not rows.
    """
    held = ["block", "n", *more, *[f"{a}_{e}" for a in axes for e in ("lo", "hi")]]
    a = kept.select(key, *[F.col(c).alias(f"{c}_a") for c in held])
    b = kept.select(key, *[F.col(c).alias(f"{c}_b") for c in held])
    j = a.join(b, key).where(F.col("block_a") <= F.col("block_b"))
    return j if near is None else j.where(near)


def small_batches(df: DataFrame, rows: int = 256) -> DataFrame:
    """df; its session hands Python at most so many rows (blocks) at a time from now on: Spark takes the setting when a plan is run."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    known = int(df.sparkSession.conf.get(name))
    if known <= 0 or known > rows:
        df.sparkSession.conf.set(name, str(rows))
    return df


def with_rows(pairs: DataFrame, kept: DataFrame, key: str, more: tuple[str, ...] = (), trim: Callable[[Column, str], Column] | None = None) -> DataFrame:
    """pairs(key, block_a, block_b, ...) with rows_a and rows_b, the latter null where a block meets itself, and more columns of both blocks.

    trim(row, side) says which rows of two blocks are needed, by columns of pairs; it is asked before they are shuffled, and pairs that it leaves without rows go.

    A pair is much work in few bytes, so pairs are dealt to all partitions of a shuffle, which Spark would merge by their size otherwise.
    """
    held = ("rows", *more)
    a = kept.select(key, F.col("block").alias("block_a"), *[F.col(c).alias(f"{c}_a") for c in held])
    b = kept.select(key, F.col("block").alias("block_b"), *[F.col(c).alias(f"{c}_b") for c in held])
    self_, other = pairs.where("block_a = block_b"), pairs.where("block_a < block_b")
    alone = self_.join(a, [key, "block_a"]).withColumns({f"{c}_b": F.lit(None).cast(kept.schema[c].dataType) for c in held})
    needed = lambda df, s: df if trim is None else df.withColumn(f"rows_{s}", F.filter(f"rows_{s}", lambda r: trim(r, s))).where(F.size(f"rows_{s}") > 0)
    both = needed(needed(other.join(a, [key, "block_a"]), "a").join(b, [key, "block_b"]), "b").select(*alone.columns).unionByName(alone)
    return both.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), key, "block_a", "block_b")


def matrices(column, axes: tuple[str, ...], more: tuple[str, ...] = ()) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """(pids, rows x (axes + more)) of each array of structs in an Arrow column; None for a null one."""
    flat, ends, there = column.flatten(), np.r_[0, np.cumsum(np.where(column.is_valid().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0))].astype(np.int64), column.is_valid().to_pylist()
    pids = flat.field("pid").to_numpy(zero_copy_only=False)
    values = np.column_stack([flat.field(c).to_numpy(zero_copy_only=False) for c in (*axes, *more)]) if len(flat) else np.empty((0, len(axes) + len(more)))
    for i, ok in enumerate(there):
        yield (pids[ends[i] : ends[i + 1]], values[ends[i] : ends[i + 1]]) if ok else None
