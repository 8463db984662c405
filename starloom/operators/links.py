"""Links between the groups of neighbouring snapshots, and what is derived from them.

A member is a row (snap_ord, halo_id, pid, part_type, mass); a particle has one group per snapshot. Links therefore need no join:
a window over each particle's snapshots puts its two groups side by side, with one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.operators import spatial
from starloom.operators.components import written

TYPES = (0, 1, 4, 5)
#: Groups below this size are real only if an earlier one says so.
REAL_SIZE = 20


def shared(members: DataFrame) -> DataFrame:
    """A row for each particle that is in groups of two successive snapshots: (snap_ord, halo_id, prev_id, type and mass on both sides)."""
    w = Window.partitionBy("pid").orderBy("snap_ord")
    before = F.lag(F.struct("snap_ord", "halo_id", "part_type", "mass")).over(w)
    m = members.select("pid", "snap_ord", "halo_id", "part_type", "mass", before.alias("p"))
    return m.where(F.col("p")["snap_ord"] == F.col("snap_ord") - 1).select("snap_ord", "halo_id", F.col("p")["halo_id"].alias("prev_id"), "part_type", "mass", F.col("p")["part_type"].alias("prev_type"), F.col("p")["mass"].alias("prev_mass"))


def of_type(value: Column, kind: str, t: int) -> Column:
    return F.when(F.col(kind) == t, value)


def overlaps(members: DataFrame) -> DataFrame:
    """(snap_ord, halo_id, prev_id) with shared counts and masses of both sides, in all and by type."""
    one = F.lit(1)
    by_type = [F.count(of_type(one, k, t)).alias(f"n_{s}{t}") for t in TYPES for k, s in (("prev_type", "prev_"), ("part_type", ""))]
    mass = [F.coalesce(F.sum(of_type(F.col(m), k, t)), F.lit(0.0)).alias(f"mass_{s}{t}") for t in TYPES for m, k, s in (("prev_mass", "prev_type", "prev_"), ("mass", "part_type", ""))]
    return shared(members).groupBy("snap_ord", "halo_id", "prev_id").agg(F.count("*").alias("n_shared"), F.sum("mass").alias("mass_shared"), F.sum("prev_mass").alias("prev_mass_shared"), *by_type, *mass)


def halos(members: DataFrame) -> DataFrame:
    """(snap_ord, halo_id, npart, mass) with counts and masses by type."""
    counts = [F.count(F.when(F.col("part_type") == t, 1)).alias(f"npart_{t}") for t in TYPES]
    mass = [F.coalesce(F.sum(F.when(F.col("part_type") == t, F.col("mass"))), F.lit(0.0)).alias(f"mass_{t}") for t in TYPES]
    return members.groupBy("snap_ord", "halo_id").agg(F.count("*").alias("npart"), F.sum("mass").alias("mass"), *counts, *mass)


def progenitors(members: DataFrame, threshold: int = 10) -> DataFrame:
    """(snap_ord, halo_id, other_id, rank, n_shared, mass_shared, ...): groups one snapshot earlier that share at least `threshold` particles.

    Masses are those of the other side; rank 1 shares most, ties go to the smaller id.
    """
    o = overlaps(members).where(F.col("n_shared") >= threshold)
    named = o.select("snap_ord", "halo_id", F.col("prev_id").alias("other_id"), "n_shared", F.col("prev_mass_shared").alias("mass_shared"), *[F.col(f"{a}_prev_{t}").alias(f"{a}_shared_{t}") for a in ("n", "mass") for t in TYPES])
    return ranked(named)


def descendants(members: DataFrame, threshold: int = 10) -> DataFrame:
    """The same for groups one snapshot later."""
    o = overlaps(members).where(F.col("n_shared") >= threshold)
    named = o.select((F.col("snap_ord") - 1).alias("snap_ord"), F.col("prev_id").alias("halo_id"), F.col("halo_id").alias("other_id"), "n_shared", "mass_shared", *[F.col(f"{a}_{t}").alias(f"{a}_shared_{t}") for a in ("n", "mass") for t in TYPES])
    return ranked(named)


def ranked(links: DataFrame) -> DataFrame:
    w = Window.partitionBy("snap_ord", "halo_id").orderBy(F.desc("n_shared"), "other_id")
    return links.withColumn("rank", F.row_number().over(w))


def sweep(groups: DataFrame, times: DataFrame, per_time: float = 1.0, least: float = 2.0) -> DataFrame:
    """(snap_ord, radius): how far a group of a snapshot can be from one of the snapshot before that it shares particles with.

    The fastest group's speed, groups(snap_ord, mean_vx, mean_vy, mean_vz) of either snapshot, times the time between both, times(snap_ord, since), in units of
    length for each unit of speed and time (a little more, against rounding); at least `least`.
    """
    speed = F.sqrt(F.col("mean_vx") * F.col("mean_vx") + F.col("mean_vy") * F.col("mean_vy") + F.col("mean_vz") * F.col("mean_vz"))
    top = groups.groupBy("snap_ord").agg(F.max(speed).alias("top"))
    both = top.unionByName(top.withColumn("snap_ord", F.col("snap_ord") + 1)).groupBy("snap_ord").agg(F.max("top").alias("top"))
    return both.join(times, "snap_ord").select("snap_ord", F.greatest(F.lit(least), F.col("top") * F.col("since") * (per_time * (1 + 1e-9))).alias("radius"))


def within_sweep(groups: DataFrame, radii: DataFrame, box: spatial.Box, periodic: bool = True) -> DataFrame:
    """(snap_ord, halo_id, other_id): groups(snap_ord, halo_id, mean_x, mean_y, mean_z) and those of the snapshot before within its radius.

    An equi-join on snapshot and cells as wide as the largest radius; the driver holds that one number.
    """
    widest = radii.agg(F.max("radius")).first()[0]
    at = [F.col(f"mean_{a}").alias(a) for a in spatial.AXES]
    # A wrapped group's mean may lie beyond the box.
    inside = [F.pmod(c, F.lit(float(s))).alias(a) for c, a, s in zip(at, spatial.AXES, spatial.sides(box), strict=True)] if periodic else at
    cells = spatial.cell_counts(box, widest or min(spatial.sides(box)))
    here = spatial.ghosts(groups.join(radii, "snap_ord").select("snap_ord", F.col("halo_id").alias("pid"), "radius", *inside), box, cells, periodic)
    before = spatial.with_cells(groups.select((F.col("snap_ord") + 1).alias("snap_ord"), F.col("halo_id").alias("pid"), *inside), box, cells).withColumnsRenamed({f"c{a}": f"g{a}" for a in spatial.AXES})
    keys = ["snap_ord", "gx", "gy", "gz"]
    pairs = spatial.side(here, "a", [*keys, "radius"]).join(spatial.side(before, "b", keys), keys)
    return pairs.where(spatial.separation("a", "b", box, periodic) <= F.col("radius") * F.col("radius")).select("snap_ord", F.col("pid_a").alias("halo_id"), F.col("pid_b").alias("other_id"))


def progenitors_within(members: DataFrame, near: DataFrame, threshold: int = 10) -> DataFrame:
    """progenitors() of pairs of groups near each other, near(snap_ord, halo_id, other_id): members of groups that are near none aren't joined at all."""
    some = written(near)
    own = some.select("snap_ord", "halo_id").unionByName(some.select((F.col("snap_ord") - 1).alias("snap_ord"), F.col("other_id").alias("halo_id"))).distinct()
    read = members.join(own, ["snap_ord", "halo_id"], "left_semi")
    kept = progenitors(read, threshold).drop("rank").join(some, ["snap_ord", "halo_id", "other_id"], "left_semi")
    return ranked(kept)


def with_other(links: DataFrame, groups: DataFrame, step: int) -> DataFrame:
    """links with size and mass of the other group, `step` snapshots away."""
    o = groups.select((F.col("snap_ord") - step).alias("snap_ord"), F.col("halo_id").alias("other_id"), F.col("npart").alias("other_npart"), F.col("mass").alias("other_mass"))
    return links.join(o, ["snap_ord", "other_id"])


def link_counts(groups: DataFrame, prog: DataFrame, desc: DataFrame) -> DataFrame:
    """groups with n_progs and n_descs; 0 where a link was looked for and none found, null where there is no such snapshot."""
    p = prog.groupBy("snap_ord", "halo_id").agg(F.count("*").alias("n_progs"))
    d = desc.groupBy("snap_ord", "halo_id").agg(F.count("*").alias("n_descs"))
    first, last = groups.agg(F.min("snap_ord"), F.max("snap_ord")).first()
    g = groups.join(p, ["snap_ord", "halo_id"], "left").join(d, ["snap_ord", "halo_id"], "left")
    return g.withColumn("n_progs", F.when(F.col("snap_ord") > first, F.coalesce("n_progs", F.lit(0)))).withColumn("n_descs", F.when(F.col("snap_ord") < last, F.coalesce("n_descs", F.lit(0))))


def transient_counts(counted: DataFrame) -> DataFrame:
    """By snapshot: groups without progenitor and too small to be real, and other groups without any link."""
    no_prog, no_desc = F.coalesce("n_progs", F.lit(0)) == 0, F.coalesce("n_descs", F.lit(0)) == 0
    small = no_prog & (F.col("npart") < REAL_SIZE)
    return counted.groupBy("snap_ord").agg(F.count("*").alias("n_halos"), F.count(F.when(small, 1)).alias("n_not_real"), F.count(F.when(~small & no_prog & no_desc, 1)).alias("n_transient"))


def main_descendants(members: DataFrame, groups: DataFrame, threshold: int = 10, least: int = 10) -> DataFrame:
    """The older linker: of real groups of at least `least` particles the single best descendant of that size."""
    sized = groups.where(F.col("npart") >= least)
    d = ranked(large_other(descendants(members, threshold), groups, 1, least)).where("rank = 1").select("snap_ord", "halo_id", "other_id", "n_shared")
    return d.join(sized.where("real").select("snap_ord", "halo_id"), ["snap_ord", "halo_id"], "left_semi")


def real_progenitors(members: DataFrame, groups: DataFrame, threshold: int = 10, least: int = 10) -> DataFrame:
    """The older linker's other half: of real groups of at least `least` particles the real progenitors of that size, ranked anew."""
    real = groups.where("real").where(F.col("npart") >= least).select("snap_ord", "halo_id")
    other = real.select((F.col("snap_ord") + 1).alias("snap_ord"), F.col("halo_id").alias("other_id"))
    p = progenitors(members, threshold).join(other, ["snap_ord", "other_id"], "left_semi").join(real, ["snap_ord", "halo_id"], "left_semi")
    return ranked(p.select("snap_ord", "halo_id", "other_id", "n_shared"))


def legacy_flags(groups: DataFrame, prog: DataFrame, desc: DataFrame, least: int = 10) -> DataFrame:
    """The older writer's verdict on real groups of at least `least` particles, once, on the flags as they come.

    Without a real progenitor and a descendant: not real. Without a real progenitor and small: not real. Else kept. What that
    changes in the flags of other groups is left out; legacy_chain() has it.
    """
    real = groups.where("real").select((F.col("snap_ord") + 1).alias("snap_ord"), F.col("halo_id").alias("other_id"))
    real_progs = prog.join(real, ["snap_ord", "other_id"], "left_semi").groupBy("snap_ord", "halo_id").agg(F.count("*").alias("n_real_progs"))
    best = desc.where("rank = 1").select("snap_ord", "halo_id", F.col("other_id").alias("desc_id"))
    g = groups.where("real").where(F.col("npart") >= least).select("snap_ord", "halo_id", "npart").join(real_progs, ["snap_ord", "halo_id"], "left").join(best, ["snap_ord", "halo_id"], "left")
    n = F.coalesce("n_real_progs", F.lit(0))
    state = F.when((n == 0) & F.col("desc_id").isNull(), "unlinked").when((n == 0) & (F.col("npart") < REAL_SIZE), "small").otherwise("kept")
    return g.select("snap_ord", "halo_id", "npart", n.cast("long").alias("n_real_progs"), "desc_id", state.alias("state"))


def legacy_chain(groups: DataFrame, prog: DataFrame, desc: DataFrame, least: int = 10) -> DataFrame:
    """The older writer's verdict with flags carried on, for each group of at least `least` particles that is real when its turn comes.

    States are those of legacy_flags(). A kept group makes its best descendant real, an unlinked or small one stops being real, and
    the next snapshot is judged by these flags; so snapshots are walked through in order, within one everything is a join.
    The first snapshot has no progenitors to look for (n_real_progs is null) and the last no descendants, so nothing is unlinked
    there, nor small in the first. `prog` and `desc` are links before any ranking by flags.
    """
    first, last = groups.agg(F.min("snap_ord"), F.max("snap_ord")).first()
    groups = written(groups.select("snap_ord", "halo_id", "npart", "real"))
    prog = written(large_other(prog, groups, -1, least).select("snap_ord", "halo_id", "other_id"))
    best = written(ranked(large_other(desc, groups, 1, least)).where("rank = 1").select("snap_ord", "halo_id", F.col("other_id").alias("desc_id")))
    out = before = promoted = None
    for snap in range(first, last + 1) if first is not None else ():
        here = groups.where(F.col("snap_ord") == snap)
        if promoted is not None:
            here = here.join(promoted, "halo_id", "left").withColumn("real", F.col("real") | F.col("promoted").isNotNull()).drop("promoted")
        here = written(here.where("real"))
        n = F.lit(None).cast("long")
        g = here.where(F.col("npart") >= least).join(best.where(F.col("snap_ord") == snap).drop("snap_ord"), "halo_id", "left")
        if before is not None:
            count = prog.where(F.col("snap_ord") == snap).join(before, "other_id", "left_semi").groupBy("halo_id").agg(F.count("*").alias("n"))
            g, n = g.join(count, "halo_id", "left"), F.coalesce("n", F.lit(0))
        linked = F.lit(snap != first or first == last) & F.lit(snap != last or first == last)
        state = F.when(linked & (F.coalesce(n, F.lit(0)) == 0) & F.col("desc_id").isNull(), "unlinked").when((n == 0) & (F.col("npart") < REAL_SIZE), "small").otherwise("kept")
        g = written(g.select("snap_ord", "halo_id", "npart", n.alias("n_real_progs"), "desc_id", state.alias("state")))
        out = g if out is None else out.unionByName(g)
        kept = g.where("state = 'kept'")
        before = here.where(F.col("npart") < least).select(F.col("halo_id").alias("other_id")).unionByName(kept.select(F.col("halo_id").alias("other_id")))
        promoted = kept.where("desc_id IS NOT NULL").select(F.col("desc_id").alias("halo_id"), F.lit(True).alias("promoted")).distinct()
    return legacy_flags(groups, prog, ranked(desc), least).limit(0) if out is None else out


def large_other(links: DataFrame, groups: DataFrame, step: int, least: int) -> DataFrame:
    """links to groups of at least `least` particles, `step` snapshots away."""
    o = groups.where(F.col("npart") >= least).select((F.col("snap_ord") - step).alias("snap_ord"), F.col("halo_id").alias("other_id"))
    return links.join(o, ["snap_ord", "other_id"], "left_semi")


def cut(prog: DataFrame, desc: DataFrame) -> DataFrame:
    """Progenitor links whose progenitor has this group as its main descendant."""
    main = desc.where("rank = 1").select((F.col("snap_ord") + 1).alias("snap_ord"), F.col("halo_id").alias("other_id"), F.col("other_id").alias("halo_id"))
    return prog.join(main, ["snap_ord", "halo_id", "other_id"], "left_semi")


def pruned(prog: DataFrame, groups: DataFrame) -> DataFrame:
    """Progenitor links without those to groups that are not real; the first link always stays."""
    flags = groups.select((F.col("snap_ord") + 1).alias("snap_ord"), F.col("halo_id").alias("other_id"), F.col("real").alias("other_real"))
    return prog.join(flags, ["snap_ord", "other_id"]).where("rank = 1 OR other_real")


def unlinked(groups: DataFrame, prog: DataFrame, desc: DataFrame) -> DataFrame:
    """Groups that are not real and have no link either way."""
    key = ["snap_ord", "halo_id"]
    return groups.where("NOT real").join(prog.select(*key), key, "left_anti").join(desc.select(*key), key, "left_anti")


def symmetry(prog: DataFrame, desc: DataFrame) -> DataFrame:
    """How many links there are each way, and how many the other way lacks."""
    p = prog.select("snap_ord", "halo_id", "other_id", "n_shared")
    d = desc.select((F.col("snap_ord") + 1).alias("snap_ord"), F.col("other_id").alias("halo_id"), F.col("halo_id").alias("other_id"), F.col("n_shared").alias("n_back"))
    j = p.join(d, ["snap_ord", "halo_id", "other_id"], "full")
    return j.agg(F.count("n_shared").alias("n_forward"), F.count("n_back").alias("n_backward"), F.count(F.when(~F.col("n_shared").eqNullSafe(F.col("n_back")), 1)).alias("n_violations"))


def self_links(members: DataFrame, threshold: int = 10) -> DataFrame:
    """Each group linked to the same snapshot: its first link must be itself with all its particles."""
    again = members.select("snap_ord", F.col("halo_id").alias("other_id"), "pid")
    n = members.join(again, ["snap_ord", "pid"]).groupBy("snap_ord", "halo_id", "other_id").agg(F.count("*").alias("n_shared"))
    return ranked(n.where(F.col("n_shared") >= threshold))
