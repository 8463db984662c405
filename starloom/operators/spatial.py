"""Cells, radius joins and friends-of-friends groups of particles (pid, x, y, z, ...)."""

from __future__ import annotations

import math
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.operators.components import components, written
from starloom.operators.numbering import running_sum

AXES = ("x", "y", "z")
#: A box is given by one side or by its three sides, along x, y and z.
Box = float | tuple[float, float, float]


def sides(box: Box) -> tuple[float, float, float]:
    return tuple(box) if isinstance(box, (tuple, list)) else (box,) * 3


def cell_count(box: float, radius: float) -> int:
    """Cells an axis, each at least as wide as the radius."""
    return max(1, int(box / radius))


def cell_counts(box: Box, radius: float) -> tuple[int, int, int]:
    return tuple(cell_count(s, radius) for s in sides(box))


def cell(axis: str, box: float, cells: int, origin: float = 0.0) -> Column:
    return F.floor((F.col(axis) - F.lit(origin)) / F.lit(box / cells)).cast("int")


def with_cells(parts: DataFrame, box: Box, cells: int | tuple[int, int, int]) -> DataFrame:
    """parts with cx, cy, cz and cell_id = cz + cells_z * (cy + cells_y * cx)."""
    n = sides(cells)
    out = parts.withColumns({f"c{a}": cell(a, s, k) for a, s, k in zip(AXES, sides(box), n, strict=True)})
    return out.withColumn("cell_id", (F.col("cz") + n[2] * (F.col("cy") + n[1] * F.col("cx").cast("long"))).cast("long"))


def cell_stripe(cells: int, ranks: int) -> Column:
    """Which of `ranks` contiguous stripes of cells a cell is in."""
    return F.floor(F.col("cell_id") * ranks / F.lit(cells**3)).cast("int")


def offsets(cells: int | tuple[int, int, int], half: bool) -> list[tuple[int, int, int]]:
    """Neighbouring cells; half of them (and the cell itself) if each pair of cells shall meet once."""
    around = [o for o in product((-1, 0, 1), repeat=3)]
    return [o for o in around if o >= (0, 0, 0)] if half and min(sides(cells)) >= 3 else around


def ghosts(parts: DataFrame, box: Box, cells: int | tuple[int, int, int], periodic: bool = True, half: bool = False) -> DataFrame:
    """A copy of each particle for each cell (gx, gy, gz) around its own where it may have neighbours, with the offset."""
    moves = F.array(*[F.struct(*[F.lit(v).alias(f"o{a}") for a, v in zip(AXES, o, strict=True)]) for o in offsets(cells, half)])
    out = with_cells(parts, box, cells).withColumn("o", F.explode(moves))
    g = {f"g{a}": F.col(f"c{a}") + F.col("o")[f"o{a}"] for a in AXES}
    if periodic:
        g = {f"g{a}": F.pmod(g[f"g{a}"], F.lit(n)) for a, n in zip(AXES, sides(cells), strict=True)}
    out = out.withColumns(g)
    if not periodic:
        return out.where(" AND ".join(f"g{a} BETWEEN 0 AND {n - 1}" for a, n in zip(AXES, sides(cells), strict=True)))
    more = [c for c in ("snap_ord",) if c in parts.columns]
    return out if min(sides(cells)) >= 3 else out.dropDuplicates([*more, "pid", "gx", "gy", "gz"])


def separation(a: str, b: str, box: Box, periodic: bool) -> Column:
    """Squared distance of rows with columns <axis>_<a> and <axis>_<b>, to the nearest image if periodic."""
    total = F.lit(0.0)
    for axis, length in zip(AXES, sides(box), strict=True):
        d = F.abs(F.col(f"{axis}_{a}") - F.col(f"{axis}_{b}"))
        d = F.least(d, F.lit(length) - d) if periodic else d
        total = total + d * d
    return total


def side(parts: DataFrame, s: str, keys: list[str], more: tuple[str, ...] = ()) -> DataFrame:
    return parts.select(*keys, *[F.col(c).alias(f"{c}_{s}") for c in ("pid", *AXES, *more)])


def near_pairs(parts: DataFrame, radius: float, box: Box, periodic: bool = True, within: str | None = None, more: tuple[str, ...] = (), where: Column | None = None) -> DataFrame:
    """(src, dst, d2): pairs at most `radius` apart, each once; only pairs alike in the column `within`, if given.

    An equi-join on cells: every pair of neighbouring cells meets once, and distances are checked inside the join. `where` may test d2
    and the columns <name>_a and <name>_b of `more`.
    """
    cells = cell_counts(box, radius)
    half = min(cells) >= 3
    # Beyond the box every coordinate still has a cell: without periodicity, cells are not wrapped and not cut off.
    a = with_cells(parts, box, cells).withColumnsRenamed({f"c{x}": f"g{x}" for x in AXES})
    moves = F.array(*[F.struct(*[F.lit(v).alias(f"o{x}") for x, v in zip(AXES, o, strict=True)]) for o in offsets(cells, half)])
    b = with_cells(parts, box, cells).withColumn("o", F.explode(moves))
    wrap = (lambda c, n: F.pmod(c, F.lit(n))) if periodic else (lambda c, n: c)
    b = b.withColumns({f"g{x}": wrap(F.col(f"c{x}") + F.col("o")[f"o{x}"], n) for x, n in zip(AXES, cells, strict=True)})
    own = (F.col("o")["ox"] == 0) & (F.col("o")["oy"] == 0) & (F.col("o")["oz"] == 0)
    b = b.withColumn("own", own if half else F.lit(True))
    keys = ["gx", "gy", "gz", *([within] if within else [])]
    left, right = side(a, "a", keys, more), side(b, "b", [*keys, "own"], more)
    pairs = left.join(right, keys).withColumn("d2", separation("a", "b", box, periodic))
    pairs = pairs.where((F.col("d2") <= radius * radius) & (~F.col("own") | (F.col("pid_a") < F.col("pid_b"))))
    pairs = pairs if where is None else pairs.where(where)
    out = pairs.select(F.least("pid_a", "pid_b").alias("src"), F.greatest("pid_a", "pid_b").alias("dst"), "d2", *([within] if within else []))
    return out if half else out.distinct()


#: Products of two cells' rows beyond which a few outermost points are tried before all that may be near.
TRIED = 256
OUTER = [d for d in product((-1, 0, 1), repeat=3) if sum(map(abs, d)) in (1, 3)]


def _gaps(a: str, b: str, box: Box, periodic: bool) -> tuple[Column, Column]:
    """Least and largest squared distance that rows of the boxes <axis>_lo_<a>, <axis>_hi_<a> and those of b can have.

    Both are monotone in floating point: no pair of rows comes out nearer or farther than they say.
    """
    least, most = F.lit(0.0), F.lit(0.0)
    for x, length in zip(AXES, sides(box), strict=True):
        ahead, behind = F.col(f"{x}_lo_{b}") - F.col(f"{x}_hi_{a}"), F.col(f"{x}_lo_{a}") - F.col(f"{x}_hi_{b}")
        near = F.greatest(F.lit(0.0), ahead, behind)
        far = F.greatest(F.col(f"{x}_hi_{b}") - F.col(f"{x}_lo_{a}"), F.col(f"{x}_hi_{a}") - F.col(f"{x}_lo_{b}"))
        low = F.least(near, F.greatest(F.lit(0.0), F.lit(length) - far)) if periodic else near
        high = F.least(far, F.greatest(F.abs(F.lit(length) - near), F.abs(F.lit(length) - far))) if periodic else far
        least, most = least + low * low, most + high * high
    return least, most


def _apart(p: Column, q: Column, box: Box, periodic: bool) -> Column:
    total = F.lit(0.0)
    for x, length in zip(AXES, sides(box), strict=True):
        d = F.abs(p[x] - q[x])
        d = F.least(d, F.lit(length) - d) if periodic else d
        total = total + d * d
    return total


def friend_edges(parts: DataFrame, radius: float, box: Box, periodic: bool = True, within: str | None = None, tried: int = TRIED) -> DataFrame:
    """(src, dst): edges with the components of near_pairs(), about as many as particles however dense a cell is.

    Cells of half the width of near_pairs()' (a third or fourth where the box is only a few radii wide) are narrower than radius / sqrt(3), so all
    particles of one are friends: each is linked to the cell's smallest pid, and two cells need one edge at most. Pairs of cells (mostly at most 111 a cell) are settled by their
    bounding boxes where these are near or far enough, then, if they hold many rows, by their outermost points in 14 directions. What is
    left is joined row by row, with only those rows of a cell that lie within the radius of the other's box. Rows with a null, NaN or
    infinite coordinate have no friends.
    """
    cells, r2, more = cell_counts(box, radius), radius * radius, [within] if within else []
    parted = 2
    while math.sqrt(sum((s / (parted * n)) ** 2 for s, n in zip(sides(box), cells, strict=True))) > radius * (1 - 1e-9):
        parted += 1
    half = min(cells) >= 3
    wrap = (lambda c, n: F.pmod(c, F.lit(n))) if periodic else (lambda c, n: c)
    finite = " AND ".join(f"abs({a}) < double('infinity')" for a in AXES)
    p = parts.select("pid", *AXES, *more).where(finite).withColumns({f"f{a}": wrap(F.floor(F.col(a) / F.lit(s / (parted * n))), parted * n) for a, s, n in zip(AXES, sides(box), cells, strict=True)})
    if within:
        p = p.where(F.col(within).isNotNull())
    fine = [*more, "fx", "fy", "fz"]
    point = F.struct("pid", *AXES)
    outer = F.array(*[F.min_by(point, sum((d * F.col(a) for d, a in zip(o, AXES, strict=True)), F.lit(0.0))) for o in OUTER])
    boxes = [f(a).alias(f"{a}_{n}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))]
    rep = written(p.groupBy(*fine).agg(F.min("pid").alias("rep"), F.count("*").alias("n"), outer.alias("outer"), *boxes))
    members = p.join(rep.where("n > 1").select(*fine, "rep"), fine).where("pid <> rep").select(F.col("pid").alias("src"), F.col("rep").alias("dst"))

    wide = rep.withColumns({f"g{a}": F.floor(F.col(f"f{a}") / parted) for a in AXES})
    moves = F.array(*[F.struct(*[F.lit(v).alias(f"o{a}") for a, v in zip(AXES, o, strict=True)]) for o in offsets(cells, True)])
    moved = wide.withColumn("o", F.explode(moves))
    moved = moved.withColumn("own", (F.col("o")["ox"] == 0) & (F.col("o")["oy"] == 0) & (F.col("o")["oz"] == 0))
    moved = moved.withColumns({f"g{a}": wrap(F.col(f"g{a}") + F.col("o")[f"o{a}"], n) for a, n in zip(AXES, cells, strict=True)}).drop("o")
    if not half:  # all neighbours, some of them more than once
        moved = moved.withColumn("own", F.lit(True))
    keys = [*more, "gx", "gy", "gz"]
    held = ["rep", "n", "outer", "fx", "fy", "fz", *[f"{a}_{n}" for a in AXES for n in ("lo", "hi")]]
    named = [d.select(*keys, *[F.col(c).alias(f"{c}_{s}") for c in held], *rest) for d, s, rest in ((wide, "a", []), (moved, "b", ["own"]))]
    least, most = _gaps("a", "b", box, periodic)
    # As in _nearest_within(): the table of moved cells is larger than Spark takes it for.
    pairs = named[0].join(named[1].hint("merge"), keys).where((~F.col("own") | (F.col("rep_a") < F.col("rep_b"))) & (least <= r2)).withColumn("most", most)
    pairs = pairs if half else pairs.dropDuplicates(["rep_a", "rep_b"])
    tries = F.exists("outer_a", lambda u: F.exists("outer_b", lambda v: _apart(u, v, box, periodic) <= r2))
    sure = (F.col("n_a") * F.col("n_b") == 1) | (F.col("most") <= r2) | F.when(F.col("n_a") * F.col("n_b") > tried, tries).otherwise(False)
    settled = written(pairs.withColumn("sure", sure).drop("outer_a", "outer_b", "own", "most", *keys[len(more) :]))

    # Rows of either cell that may reach the other, then those joined: a row is a box of no width.
    def reaching(s: str, t: str) -> DataFrame:
        rows = p.select(*more, *[F.col(f"f{a}").alias(f"f{a}_{s}") for a in AXES], *[F.col(a).alias(f"{a}_at_{s}") for a in AXES])
        j = settled.where(~F.col("sure")).drop(*[f"{a}_{n}_{s}" for a in AXES for n in ("lo", "hi")]).join(rows, [*more, *[f"f{a}_{s}" for a in AXES]])
        j = j.withColumns({f"{a}_{n}_{s}": F.col(f"{a}_at_{s}") for a in AXES for n in ("lo", "hi")})
        return j.where(_gaps(s, t, box, periodic)[0] <= r2).select("rep_a", "rep_b", *[F.col(f"{a}_at_{s}").alias(f"{a}_{s}") for a in AXES])

    near = reaching("a", "b").join(reaching("b", "a"), ["rep_a", "rep_b"]).where(separation("a", "b", box, periodic) <= r2).select("rep_a", "rep_b").distinct()
    across = settled.where("sure").select("rep_a", "rep_b").unionByName(near).where("rep_a <> rep_b")
    return members.unionByName(across.select(F.least("rep_a", "rep_b").alias("src"), F.greatest("rep_a", "rep_b").alias("dst")))


def friends(parts: DataFrame, radius: float, box: Box, periodic: bool = True, within: str | None = None) -> DataFrame:
    """parts with halo_id: the smallest pid of the friends-of-friends group, null for particles alone."""
    c = components(friend_edges(parts, radius, box, periodic, within))
    return parts.join(c.withColumnsRenamed({"node": "pid", "component": "halo_id"}), "pid", "left")


def at_least(grouped: DataFrame, n: int, key: str = "halo_id") -> DataFrame:
    """Rows of groups with n rows at least."""
    size = grouped.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("size")).where(F.col("size") >= n).select(key)
    return grouped.join(size, key, "left_semi")


#: Distinct others of the fullest cell beyond which nearest_other() tries half the radius first, and how often it is halved at most.
CROWD, HALVINGS = 8, 20


def nearest_other(parts: DataFrame, others: DataFrame, radius: float, box: Box, periodic: bool = True, crowd: int = CROWD) -> DataFrame:
    """(pid, other_pid, d2): the nearest of others closer than radius; ties to the smaller pid.

    Radii grow from one whose cells hold few others: who finds any within a radius has found the nearest, and only the rest goes on to twice
    that radius. So rows meet a bounded number of others where these thin out smoothly, not all within the radius. Others at one place are one. Rows with a null, NaN
    or infinite coordinate have no neighbours. Coordinates may lie beyond the box.
    """
    finite = " AND ".join(f"abs({a}) < double('infinity')" for a in AXES)
    spots = written(others.where(finite).groupBy(*AXES).agg(F.min("pid").alias("pid")))
    halvings = 0
    while halvings < HALVINGS:
        cells = _search_cells(spots, radius / 2**halvings, box, periodic).groupBy("gx", "gy", "gz").count()
        if (cells.agg(F.max("count")).first()[0] or 0) <= crowd:
            break
        halvings += 1
    left, found = parts.select("pid", *AXES).where(finite), []
    for k in range(halvings, -1, -1):
        best = _nearest_within(left, spots, radius / 2**k, box, periodic)
        if k == 0:
            found.append(best)
            break
        found.append(written(best))
        left = written(left.join(found[-1].select("pid"), "pid", "left_anti"))
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def _search_cells(parts: DataFrame, radius: float, box: Box, periodic: bool, around: bool = False) -> DataFrame:
    """parts with the cell (gx, gy, gz) of each row, no narrower than the radius, or a row for each cell around it."""
    wide = radius * (1 + 1e-9)
    n = cell_counts(box, wide)
    at = {a: F.floor(F.col(a) / F.lit(s / k if periodic else wide)) for a, s, k in zip(AXES, sides(box), n, strict=True)}
    if around:
        moves = F.array(*[F.struct(*[F.lit(v).alias(f"o{a}") for a, v in zip(AXES, o, strict=True)]) for o in offsets(n, False)])
        parts = parts.withColumn("o", F.explode(moves))
        at = {a: c + F.col("o")[f"o{a}"] for a, c in at.items()}
    # In a box of fewer than three cells some are met twice, which a minimum may.
    return parts.withColumns({f"g{a}": F.pmod(at[a], F.lit(k)) if periodic else at[a] for a, k in zip(AXES, n, strict=True)})


def _nearest_within(parts: DataFrame, others: DataFrame, radius: float, box: Box, periodic: bool) -> DataFrame:
    keys = ["gx", "gy", "gz"]
    a, b = _search_cells(parts, radius, box, periodic, True), _search_cells(others, radius, box, periodic)
    # Spark takes a's rows for as few as before explode() and would send them all to every task; sorted by cell, they may be spilled.
    pairs = side(a, "a", keys).hint("merge").join(side(b, "b", keys), keys).withColumn("d2", separation("a", "b", box, periodic)).where(F.col("d2") < radius * radius)
    best = pairs.groupBy("pid_a").agg(F.min(F.struct("d2", "pid_b")).alias("m"))
    return best.select(F.col("pid_a").alias("pid"), F.col("m")["pid_b"].alias("other_pid"), F.col("m")["d2"].alias("d2"))


def joint_groups(one: DataFrame, two: DataFrame, radius_one: float, radius_two: float, box: Box, periodic: bool = True) -> DataFrame:
    """(pid, halo_id) over two species: groups of each, joined where a grouped particle's nearest of the other species is close.

    halo_id is the smallest pid of the joint group.
    """
    cols = ["pid", *AXES]
    f1 = friends(one.select(*cols), radius_one, box, periodic).where("halo_id IS NOT NULL")
    f2 = friends(two.select(*cols), radius_two, box, periodic).where("halo_id IS NOT NULL")
    n1 = nearest_other(f1, two, radius_one, box, periodic)
    n2 = nearest_other(f2, one, radius_two, box, periodic)
    inner = [f.select(F.col("pid").alias("src"), F.col("halo_id").alias("dst")) for f in (f1, f2)]
    cross = [n.select(F.col("pid").alias("src"), F.col("other_pid").alias("dst")) for n in (n1, n2)]
    edges = inner[0].unionByName(inner[1]).unionByName(cross[0]).unionByName(cross[1])
    return components(edges).withColumnsRenamed({"node": "pid", "component": "halo_id"})


def zoom_region(points: DataFrame, cells: int) -> DataFrame:
    """One row: a cube around all points, padded by half a cell: centre, side, and lower corner an axis."""
    b = points.agg(*[f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("low", F.min), ("high", F.max))])
    extent = F.greatest(*[F.col(f"high_{a}") - F.col(f"low_{a}") for a in AXES])
    b = b.withColumn("side", extent * (1 + 1 / (2 * cells)))
    for a in AXES:
        b = b.withColumn(f"centre_{a}", (F.col(f"low_{a}") + F.col(f"high_{a}")) / 2).withColumn(f"corner_{a}", (F.col(f"low_{a}") + F.col(f"high_{a}")) / 2 - F.col("side") / 2)
    return b.select("side", *[f"centre_{a}" for a in AXES], *[f"corner_{a}" for a in AXES])


def occupancy(subs: DataFrame, hosts: DataFrame) -> DataFrame:
    """(host_id, n_subs, n_hosts): subgroups of each host; n_hosts is the largest number of hosts of a subgroup, which must be 1."""
    j = subs.select("pid", F.col("halo_id").alias("sub_id")).join(hosts.select("pid", F.col("halo_id").alias("host_id")), "pid")
    one = j.groupBy("sub_id").agg(F.min("host_id").alias("host_id"), F.countDistinct("host_id").alias("n"))
    return one.groupBy("host_id").agg(F.count("*").alias("n_subs"), F.max("n").alias("n_hosts"))


def dense_ids(grouped: DataFrame) -> DataFrame:
    """grouped with dense_id: groups numbered from 0 in the order of their first particle."""
    ids = running_sum(grouped.where("halo_id IS NOT NULL").groupBy("halo_id").agg(F.min("pid").alias("first")), [], ["first"], "dense_id")
    return grouped.join(ids.select("halo_id", "dense_id"), "halo_id", "left")


def even_share(total: int, ranks: int) -> list[tuple[int, int, int]]:
    """(rank, first, end): contiguous parts of `total` rows that differ by one at most."""
    return [(r, total * r // ranks, total * (r + 1) // ranks) for r in range(ranks)]


def balanced(groups: DataFrame, ranks: int) -> DataFrame:
    """groups with a rank, of `ranks`: by size, largest first, to and fro, so that ranks get about the same number of particles."""
    placed = running_sum(groups, [], [F.desc("npart"), "halo_id"], "turn")
    back = (F.col("turn") / ranks).cast("long") % 2 == 1
    return placed.withColumn("rank", F.when(back, ranks - 1 - F.col("turn") % ranks).otherwise(F.col("turn") % ranks).cast("int")).drop("turn")
