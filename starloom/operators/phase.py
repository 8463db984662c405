"""Groups in phase space: splitting groups until what is left is bound.

The velocity linking length of a group only shrinks, so its minimum spanning forest (forest.py) holds all that it can fall apart into: a length
cuts the forest's edges above it. Pairs of particles are looked at once, whatever the number of lengths.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.operators.blocks import ROWS
from starloom.operators.bounds import bound_flags, crossed, exact_sums, is_bound, summed
from starloom.operators.components import components, written
from starloom.operators.forest import forest, labels
from starloom.operators.properties import centred, kinetic

SPEED = ("vx", "vy", "vz")
#: Groups below this size end in phase space.
LEAST = 10
#: Particles up to which the forest of a group is cut in one task (which holds its rows and as many edges); larger ones go through distributed rounds.
WHOLE = 100_000


def with_length(parts: DataFrame, alpha: float, velocity_factor: float, key: str) -> DataFrame:
    """parts with vl = alpha * factor * (mass of the group)^(1/3)."""
    # Written, so that Spark can split a group that holds most rows.
    mass = written(parts.where(F.col(key).isNotNull()).groupBy(key).agg((alpha * velocity_factor * F.pow(F.sum("mass"), F.lit(1 / 3))).alias("vl")))
    return parts.join(mass, key)


def step(parts: DataFrame, alpha: float, velocity_factor: float, linking: float, key: str = "halo_id", rows: int = ROWS) -> DataFrame:
    """parts with phase_id: within each group, friends linked if 4 dx^2 / l^2 + dv^2 / vl^2 <= 2, vl = alpha * factor * mass^(1/3).

    The smallest pid names a group; a particle alone is one. Not periodic: positions must be on one side of the box.
    """
    edges = forest(with_length(parts, alpha, velocity_factor, key), linking, key, "vl", rows)
    c = components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnsRenamed({"node": "pid", "component": "phase_id"})
    return parts.join(c, "pid", "left").withColumn("phase_id", F.coalesce("phase_id", "pid"))


def lowered(alpha: float, decrement: float) -> float:
    return 10 ** (math.log10(alpha) - decrement)


def lengths(start: float, end: float, decrement: float) -> list[float]:
    """The coefficients of the velocity linking length in turn; what isn't bound at the last one, the first below `end`, stays so."""
    out = [float(start)]
    while out[-1] >= end:
        out.append(lowered(out[-1], decrement))
    return out


def kinetic_of(v: np.ndarray, m: np.ndarray) -> float:
    v = v - (m[:, None] * v).sum(0) / m.sum()
    return float(0.5 * (v * v).sum())


def refined(x: np.ndarray, v: np.ndarray, m: np.ndarray, edges: tuple[np.ndarray, np.ndarray, np.ndarray], alphas: list[float], velocity_factor: float, softening: float, factor: float, least: int, turn: int = 0, tested: bool = False) -> list[tuple[np.ndarray, int, bool, float | None]]:
    """(rows, turn, real, pair sum if known) of what a group (rows by pid) falls apart into; edges (a, b, w^2) are its forest, a and b being rows.

    A group that has been tested and isn't bound stays as it is until a length cuts its heaviest edge, so turns before that are skipped. Whether it is
    bound is settled by bounds; once the whole sum had to be made, what a group loses is taken off it, which is linear in the group for each row lost.
    """
    a, b, w2 = edges
    scale = (np.array(alphas) * velocity_factor) ** 2
    last, done = len(alphas) - 1, []
    pending = [(np.arange(len(x)), np.arange(len(a)), turn, tested, None)]
    while pending:
        rows, e, turn, tested, total = pending.pop()
        vl2 = scale * m[rows].sum() ** (2 / 3)
        if tested:
            cuts = np.flatnonzero(vl2[turn:] < w2[e].max(initial=-1.0))
            turn = turn + int(cuts[0]) if len(cuts) else last
        kept = e[w2[e] <= vl2[turn]]
        label = labels(len(rows), np.searchsorted(rows, a[kept]), np.searchsorted(rows, b[kept]))
        order = np.argsort(label, kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(label[order]) > 0, True])
        of_edge = label[np.searchsorted(rows, a[kept])]
        kept = kept[np.argsort(of_edge, kind="stable")]
        of_edge = np.sort(of_edge)
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if hi - lo < least:
                continue
            inside = rows[order[lo:hi]]
            if tested and len(inside) == len(rows):
                real, own = False, total
            elif total is not None and 8 * (len(rows) - len(inside)) <= len(rows):
                lost = np.setdiff1d(rows, inside, assume_unique=True)
                own = total - crossed(x, m, lost, inside, softening) - summed(x[lost], m[lost], softening)
                real = own > 0 and kinetic_of(v[inside], m[inside]) <= factor * own
            else:
                real, _, own = is_bound(x[inside], m[inside], kinetic_of(v[inside], m[inside]), softening, factor)
            if real or turn == last:
                done.append((inside, turn, real, own))
            else:
                first, end = np.searchsorted(of_edge, label[order[lo]], "left"), np.searchsorted(of_edge, label[order[lo]], "right")
                pending.append((inside, kept[first:end], turn + 1, True, own))
    return done


REFINED = "host_id long, pid long, halo_id long, ke double, ge double, exit_alpha double, real boolean"
PENDING = ["host_id", "group", "turn", "tested"]


def refine(parts: DataFrame, linking: float, velocity_factor: float, softening: float, factor: float, start: float = 10.0, end: float = 0.8, decrement: float = 0.01, least: int = LEAST, key: str = "halo_id", whole: int = WHOLE, rows: int = ROWS, report: dict | None = None) -> DataFrame:
    """Each group (wrapped positions) refined on its own: the velocity linking length shrinks for what is not bound yet.

    All groups' forests are made first. The forest of a group of at most `whole` particles is then cut by one call of Python; larger ones are cut side by
    side, a round for each length that splits any of them, until what is left is done or small enough. Whether a group is bound is settled by
    bounds of its pair sum where they suffice. Particles that end in no group, or had none, are left out. The smallest pid names a group.
    """
    alphas = lengths(start, end, decrement)
    p = parts.select(F.col(key).cast("long").alias("host_id"), "pid", "x", "y", "z", *SPEED, "mass").where(F.col("host_id").isNotNull())
    long = written(with_length(p, alphas[0], velocity_factor, "host_id"))
    found = written(forest(long, linking, "host_id", "vl", rows, report))
    n = written(long.groupBy("host_id").agg(F.count("*").alias("n")))
    fresh = {"group": F.col("host_id"), "turn": F.lit(0), "tested": F.lit(False)}
    members, edges = long.drop("vl").join(n, "host_id").withColumns(fresh), found.join(n, "host_id").withColumns(fresh)
    small, done, turns = [(members.where(F.col("n") <= whole).drop("n"), edges.where(F.col("n") <= whole).drop("n"))], [], 0
    members, edges = members.where(F.col("n") > whole).drop("n"), edges.where(F.col("n") > whole).drop("n")
    pending = not n.where(F.col("n") > whole).isEmpty()
    if pending:
        members, edges = written(members), written(edges)
    while pending:
        turns += 1
        new, kept = _cut(members, edges, alphas, velocity_factor, softening, factor, least, rows)
        over = F.col("real") | (F.col("turn") == len(alphas) - 1)
        done.append(new.where(over))
        left = new.where(~over).withColumns({"turn": F.col("turn") + 1, "tested": F.lit(True)})
        state = left.select("group", "turn", "n").distinct()
        left_edges = kept.drop("turn", "tested").join(state, "group").withColumn("tested", F.lit(True))
        small.append((left.where(F.col("n") <= whole).select(*members.columns), left_edges.where(F.col("n") <= whole).select(*edges.columns)))
        members = written(left.where(F.col("n") > whole).select(*members.columns))
        edges = written(left_edges.where(F.col("n") > whole).select(*edges.columns))
        pending = not members.isEmpty()
    if report is not None:
        report["turns"] = turns
    out = _mapped(_all([s[0] for s in small]), _all([s[1] for s in small]), alphas, velocity_factor, softening, factor, least)
    return out.unionByName(_accepted(_all(done), alphas, softening, factor)) if done else out


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _cut(members: DataFrame, edges: DataFrame, alphas: list[float], velocity_factor: float, softening: float, factor: float, least: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """What each group falls apart into at its next length that splits it: members with n, turn and real, and the edges left in each."""
    size = members.groupBy("group", "turn", "tested").agg(F.count("*").alias("before"), F.sum("mass").alias("group_mass"))
    top = edges.groupBy("group").agg(F.max("w2").alias("top"))
    squares = F.array(*[F.lit((a * velocity_factor) ** 2) for a in alphas])
    vl2 = lambda turn: F.element_at(squares, turn + 1) * F.pow("group_mass", F.lit(2 / 3))
    cuts = F.filter(F.sequence(F.col("turn"), F.lit(len(alphas) - 1)), lambda t: vl2(t) < F.coalesce("top", F.lit(-1.0)))
    at = F.when(F.col("tested"), F.coalesce(F.get(cuts, F.lit(0)), F.lit(len(alphas) - 1))).otherwise(F.col("turn"))
    state = size.join(top, "group", "left").withColumn("turn", at)
    state = written(state.withColumn("vl2", vl2(F.col("turn"))).select("group", "turn", F.col("tested").alias("was_tested"), "before", "vl2"))
    kept = written(edges.drop("turn").join(state, "group").where(F.col("w2") <= F.col("vl2")).select("host_id", "group", "turn", "tested", "a", "b", "w2"))
    named = written(components(kept.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    split = members.drop("turn", "tested").join(named, F.col("pid") == F.col("node"), "left").withColumn("into", F.coalesce("component", "pid")).drop("node", "component")
    count = written(split.groupBy("group", "into").agg(F.count("*").alias("n")).where(F.col("n") >= least).join(state, "group"))
    fit = written(split.drop("group").join(count.select("into", "n"), "into").withColumnRenamed("into", "group"))
    known = count.where(F.col("was_tested") & (F.col("n") == F.col("before"))).select(F.col("into").alias("group"))
    c = centred(fit.join(known, "group", "left_anti"), "group")
    c = written(c.select("group", "pid", "x", "y", "z", *SPEED, "mass"))
    flags = bound_flags(c, kinetic(c, "group"), softening, factor, "group", rows).select("group", "real")
    judged = written(count.select(F.col("into").alias("group"), "turn").join(flags, "group", "left").select("group", "turn", F.coalesce("real", F.lit(False)).alias("real")))
    new = written(fit.join(judged, "group").withColumn("tested", F.lit(True)))
    edges_of = kept.drop("group").join(named.select(F.col("node").alias("a"), F.col("component").alias("group")), "a")
    return new, edges_of.select("host_id", "group", "turn", "tested", "a", "b", "w2")


def _accepted(done: DataFrame, alphas: list[float], softening: float, factor: float) -> DataFrame:
    c = written(centred(done.select("group", "pid", "x", "y", "z", *SPEED, "mass"), "group").select("group", "pid", "x", "y", "z", *SPEED, "mass"))
    energy = kinetic(c, "group").join(exact_sums(c, softening, "group").select("group", "s"), "group", "left")
    exits = F.element_at(F.array(*[F.lit(a) for a in alphas]), F.col("turn") + 1)
    return done.join(written(energy), "group").select("host_id", "pid", F.col("group").alias("halo_id"), "ke", (F.coalesce("s", F.lit(0.0)) * factor).alias("ge"), exits.alias("exit_alpha"), "real")


def _mapped(members: DataFrame, edges: DataFrame, alphas: list[float], velocity_factor: float, softening: float, factor: float, least: int) -> DataFrame:
    def run(t: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(t):
            return pd.DataFrame(columns=[c.split()[0] for c in REFINED.split(", ")])
        t = t.sort_values("pid", kind="stable")
        pid, first = t["pid"].to_numpy(), t.iloc[0]
        x, v, m = t[["x", "y", "z"]].to_numpy(float), t[[*SPEED]].to_numpy(float), t["mass"].to_numpy(float)
        ends = np.searchsorted(pid, e["a"].to_numpy()), np.searchsorted(pid, e["b"].to_numpy()), e["w2"].to_numpy(float)
        found = refined(x, v, m, ends, alphas, velocity_factor, softening, factor, least, int(first["turn"]), bool(first["tested"]))
        rows = []
        for i, turn, real, total in found:
            ke, ge = kinetic_of(v[i], m[i]), factor * (summed(x[i], m[i], softening) if total is None else total)
            rows.append(pd.DataFrame({"host_id": t["host_id"].iloc[0], "pid": pid[i], "halo_id": pid[i].min(), "ke": ke, "ge": ge, "exit_alpha": alphas[turn], "real": real}))
        return pd.concat(rows) if rows else pd.DataFrame(columns=[c.split()[0] for c in REFINED.split(", ")])

    by = ["host_id", "group"]
    return members.groupBy(*by).cogroup(edges.groupBy(*by)).applyInPandas(run, REFINED)
