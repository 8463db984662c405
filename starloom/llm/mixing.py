"""Mixing sources to target weights by balanced sampling with the cube method.

Each source has a target number of words; its documents are taken floor(target / size of the source) times, and once more with
the fraction that is left as inclusion probability. The cube method's flight phase moves these probabilities along the
null space of two constraints (words taken, documents taken) until each is 0 or 1, but for two at most. It runs in blocks of
a source side by side. Documents far longer than the others fly first, each against all others at once along the null space of the
words alone: its length goes to or comes from all of them, and no few others could make up for it later. A dozen of the rest,
taken evenly over the sizes, sit the flight out and go on to the next round with its last two, until one block a source is left,
where they land on the choice nearest to the target. A document that is too long to be taken, or to be left out, with the target
still in reach isn't dealt by lot.

Defined results: a null text has no words; a document without words is taken 0 words, whatever its copies. Documents without a
source form a source of their own, the last; a null doc_id is an id as any other. Texts count whole, of any length. Documents of
one length are in the order of their hashes. Rows alike in doc_id, source and text are counted: as many of them as their share says are taken
once more, the first by the hash of the row, and only what is left of the share is dealt by lot. Long documents fly along the words alone, so that
the number of documents taken is balanced only among the others. Reruns agree: blocks, order and random numbers come from hashes of the rows. An empty table gives an empty result. mix() keeps the
columns of the input.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import WORD_JAVA, written
from starloom.operators.numbering import running_sum

#: Documents of a block, about.
BLOCK = 4096
#: Units of the landing problem, besides the two that a flight leaves: 2^14 choices are compared.
LANDING = 12
#: A document of so many times the mean length of those still open flies against all others.
LONG = 4.0
#: Sources whose table is broadcast, at most.
SMALL = 10_000
NEAR = 1e-9


def targets(sizes: Sequence[int], weights: Sequence[float], most: float) -> list[float]:
    """Shares of sum(sizes) by weight, each at most `most` times its size; what is above is shared again by weight."""
    out, total = [0.0] * len(sizes), float(sum(sizes))
    open_ = [i for i, n in enumerate(sizes) if n > 0]
    while open_:
        share = total / sum(weights[i] for i in open_)
        full = [i for i in open_ if share * weights[i] >= most * sizes[i]]
        for i in full:
            out[i] = most * sizes[i]
            total -= out[i]
        if not full:
            for i in open_:
                out[i] = share * weights[i]
            break
        open_ = [i for i in open_ if i not in set(full)]
    return out


def direction(words: list[float], count: list[float]) -> list[float] | None:
    """A step of two or three units that changes neither sum(words) nor sum(count); None if there is none."""
    if len(words) == 3:
        a = [count[1] * words[2] - count[2] * words[1], count[2] * words[0] - count[0] * words[2], count[0] * words[1] - count[1] * words[0]]
        if any(a):
            return a
        return [count[1], -count[0], 0.0]
    if len(words) == 2 and count[0] * words[1] == count[1] * words[0]:
        return [count[1], -count[0]]
    return None


def flight(p: np.ndarray, words: np.ndarray, count: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """p moved until at most two of it are neither 0 nor 1."""
    out = p.astype(float).copy()
    waiting = iter(np.flatnonzero((out > NEAR) & (out < 1 - NEAR)).tolist())
    words, count = words.astype(float).tolist(), count.astype(float).tolist()
    active: list[int] = []
    while True:
        while len(active) < 3 and (i := next(waiting, None)) is not None:
            active.append(i)
        step = direction([words[i] for i in active], [count[i] for i in active])
        if step is None:
            return out
        up = min((1 - out[i]) / s if s > 0 else -out[i] / s for i, s in zip(active, step, strict=True) if s)
        down = min(out[i] / s if s > 0 else (out[i] - 1) / s for i, s in zip(active, step, strict=True) if s)
        by = up if rng.random() * (up + down) < down else -down
        for i, s in zip(active, step, strict=True):
            x = out[i] + by * s
            out[i] = 0.0 if x < NEAR else 1.0 if x > 1 - NEAR else x
        left = [i for i in active if 0 < out[i] < 1]
        if len(left) == len(active):  # rounding: settle the one nearest to a bound
            i = min(active, key=lambda k: min(out[k], 1 - out[k]))
            out[i] = round(out[i])
            left = [k for k in active if k != i]
        active = left


def landing(p: np.ndarray, words: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The 0s and 1s for the few units that are left that come nearest to their expected words and, with less weight, documents."""
    out = p.copy()
    rest = open_of(p)
    bits = (np.arange(1 << len(rest))[:, None] >> np.arange(len(rest))) & 1
    off = np.abs(bits @ words[rest] - p[rest] @ words[rest]) + 0.1 * words[rest].sum() / max(1, len(rest)) * np.abs(bits @ count[rest] - p[rest] @ count[rest])
    out[rest] = bits[int(np.argmin(off))]
    return np.round(out)


def open_of(p: np.ndarray) -> np.ndarray:
    return np.flatnonzero((p > NEAR) & (p < 1 - NEAR))


def long_first(p: np.ndarray, words: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """p after the flight of the long units; rows in order of words, longest first.

    A long unit moves by all of what it lacks, up or down, and the others together by the same number of words the other way, each
    in proportion to p (1 - p). That is a step in the null space of the words which ends at the long unit's bound, unless
    another one is reached first; of two bounds out of reach the unit stays open, and of one the other is taken.
    """
    out = p.astype(float).copy()
    for i in open_of(out).tolist():
        rest = open_of(out)
        rest = rest[rest != i]
        if len(rest) < LANDING or words[i] <= LONG * words[rest].mean():
            break
        share = out[rest] * (1 - out[rest])
        by = share * (words[i] / (share @ words[rest])) if share @ words[rest] > 0 else np.full(len(rest), np.inf)
        up, down = 1 - out[i], out[i]
        with np.errstate(invalid="ignore"):
            may_up, may_down = bool((out[rest] - up * by >= 0).all()), bool((out[rest] + down * by <= 1).all())
        if not (may_up or may_down):
            continue
        to = up if may_up and (not may_down or rng.random() < out[i]) else -down
        out[i] = 1.0 if to > 0 else 0.0
        out[rest] = np.clip(out[rest] - to * by, 0.0, 1.0)
    return out


def held(p: np.ndarray) -> np.ndarray:
    """Units kept from a flight for the landing problem: LANDING of those still open, evenly over the order by size."""
    rest = open_of(p)
    return rest[np.unique(np.linspace(0, len(rest) - 1, LANDING).astype(int))] if len(rest) else rest


def settled(p: np.ndarray, words: np.ndarray, count: np.ndarray, last: bool, rng: np.random.Generator) -> np.ndarray:
    """p of a block, longest units first, after their flight; the last one lands too, at once if few units are open."""
    if not last or len(open_of(p)) > LANDING + 2:
        p = long_first(p, words, rng)
        free = np.setdiff1d(np.arange(len(p)), held(p))
        p[free] = flight(p[free], words[free], count[free], rng)
    return landing(p, words, count) if last else p


def one_round(units: DataFrame, last: bool, seed: int) -> DataFrame:
    """units(..., sid, block, words, m, p) after the flight of each (sid, block); the last round lands too."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["words", "h", "doc_id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        rng = np.random.default_rng([seed, int(rows["sid"][0]), int(rows["block"][0]), len(rows)])
        rows["p"] = settled(rows["p"].to_numpy().copy(), rows["words"].to_numpy().astype(float), rows["m"].to_numpy(), last, rng)
        return rows

    return units.groupBy("sid", "block").applyInPandas(run, units.schema)


def decide(units: DataFrame, per_source: dict[int, int], seed: int, block: int) -> DataFrame:
    """units(doc_id, h, sid, words, m, p) with p 0 or 1."""
    spark, done, level = units.sparkSession, [], 0
    while True:
        blocks = {sid: -(-n // block) for sid, n in per_source.items()}
        last = max(blocks.values(), default=1) <= 1
        table = small(spark.createDataFrame([*blocks.items()] or [(-1, 1)], "sid int, blocks long"), len(blocks))
        dealt = units.join(table, "sid").withColumn("block", F.pmod(F.xxhash64("h", F.lit(seed + level)), "blocks")).drop("blocks")
        moved = written(one_round(dealt, last, seed + level).drop("block"))
        done.append(moved.where("p <= 0 OR p >= 1"))
        if last:
            break
        units, level = moved.where("p > 0 AND p < 1"), level + 1
        per_source = {r["sid"]: r["n"] for r in units.groupBy("sid").agg(F.count("*").alias("n")).collect()}
        if not per_source:
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def small(table: DataFrame, rows: int) -> DataFrame:
    """A table of sources, broadcast while it has at most SMALL rows; Spark joins a longer one by shuffling, splitting what is skewed."""
    return F.broadcast(table) if rows <= SMALL else table


def plan(base: DataFrame, weights: Sequence[float], most: float, seed: int, block: int) -> DataFrame:
    """For base(doc_id, source, size, h): (doc_id, h, source, source_size, target, whole, rows, extra) of each unit, the rows alike in doc_id, h and
    source: each of its rows is taken `whole` times, and `extra` of them once more.

    The driver holds one row for each source, not for each document.
    """
    spark = base.sparkSession
    units = base.groupBy("doc_id", "source", "h").agg(F.first("size").alias("words"), F.count("*").alias("rows"))
    # Rows of units, so that those without a doc_id count as well: a block holds as many of them as of any others.
    found = units.groupBy("source").agg(F.sum(F.col("words") * F.col("rows")).alias("size"), F.count("*").alias("n")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["size"] or 0) for r in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], most)
    ratio = [g / n if n else 0.0 for g, n in zip(goal, sizes, strict=True)]
    rows = [(i, r["source"], n, g, int(q + NEAR), max(0.0, q - int(q + NEAR))) for i, (r, n, g, q) in enumerate(zip(found, sizes, goal, ratio, strict=True))]
    table = small(spark.createDataFrame(rows, "sid int, source string, source_size long, target double, whole int, share double"), len(rows))
    named = units.join(table.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    # Of rows alike, as many as their share says are taken once more for sure; one of them is dealt by lot for what is left of it.
    sure = F.floor(F.col("rows") * F.col("share") + NEAR)
    dealt = named.select("doc_id", "h", "sid", "words", F.lit(1).cast("long").alias("m"), F.greatest(F.lit(0.0), F.col("rows") * F.col("share") - sure).alias("p"), "rows", sure.alias("sure"))
    sampled = decide(dealt, {i: max(r["n"], 1) for i, r in enumerate(found)}, seed, block)
    return sampled.join(table.drop("share"), "sid").select("doc_id", "h", "source", "source_size", "target", "whole", "rows", (F.col("sure") + F.col("p").cast("long")).alias("extra"))


def numbered(rows: DataFrame, copies: DataFrame, order: Column) -> DataFrame:
    """rows(doc_id, h, ...) with copies, source_size and target, from plan()'s table: the first `extra` of rows alike, in this order, are taken once more.

    Only rows alike that are not all taken alike are numbered, by ranges, so that no task holds all copies of a row.
    """
    c = copies.select(F.col("doc_id").alias("_c_id"), F.col("h").alias("_c_h"), "source_size", "target", "whole", F.col("rows").alias("_rows"), "extra")
    j = rows.join(c, rows["doc_id"].eqNullSafe(c["_c_id"]) & (rows["h"] == c["_c_h"]))
    alike = (F.col("extra") == 0) | (F.col("extra") >= F.col("_rows"))
    out = [*rows.columns, "source_size", "target"]
    even = j.where(alike).select(*out, (F.col("whole") + (F.col("extra") > 0).cast("int")).alias("copies"))
    if copies.where("extra > 0 AND extra < rows").isEmpty():
        return even
    part = running_sum(j.where(~alike).withColumn("_order", order), ["_c_id", "_c_h"], ["_order"], "_number")
    return even.unionByName(part.select(*out, (F.col("whole") + (F.col("_number") < F.col("extra")).cast("int")).alias("copies")))


def row_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull(), "source", "doc_id")


def base_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD_JAVA)), F.lit(0)).cast("long").alias("size"), row_hash().alias("h"))


def allot(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, h: one row for each row of docs, without its text."""
    base = written(base_of(docs))
    return numbered(base, plan(base, weights, most, seed, block), F.col("size")).select("doc_id", "source", "size", "source_size", "target", "copies", "h")


def digest(docs: DataFrame) -> DataFrame:
    return allot(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """Rows of docs as often as the mix takes them, with all their columns."""
    copies = plan(written(base_of(docs)), weights, most, seed, block)
    # The input's columns travel in a struct, where their names can't clash with those used here.
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", row_hash().alias("h"))
    kept = numbered(rows, copies, F.xxhash64("row")).where("copies > 0")
    return kept.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
