"""Splitting groups by their descendants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.operators import properties
from starloom.operators.components import written
from starloom.operators.links import shared

GLUE = 0.85
SPACE, SPEED = ("x", "y", "z"), ("vx", "vy", "vz")


def fragments(members: DataFrame, threshold: int = 10) -> DataFrame:
    """(snap_ord, halo_id, desc_id, n_shared, fragment_mass, main): parts of each group that has two descendants at least.

    Particles in no counted descendant are shared out in proportion to what the descendants took. The main part took most.
    """
    s = shared(members).select((F.col("snap_ord") - 1).alias("snap_ord"), F.col("prev_id").alias("halo_id"), F.col("halo_id").alias("desc_id"))
    n = s.groupBy("snap_ord", "halo_id", "desc_id").agg(F.count("*").alias("n_shared")).where(F.col("n_shared") >= threshold)
    w = Window.partitionBy("snap_ord", "halo_id")
    n = n.withColumns({"took": F.sum("n_shared").over(w), "n_desc": F.count("*").over(w), "rank": F.row_number().over(w.orderBy(F.desc("n_shared"), "desc_id"))}).where("n_desc > 1")
    size = members.groupBy("snap_ord", "halo_id").agg(F.count("*").alias("npart"))
    j = n.join(size, ["snap_ord", "halo_id"])
    mass = F.col("n_shared") + (F.col("npart") - F.col("took")) * (F.col("n_shared") / F.col("took"))
    return j.select("snap_ord", "halo_id", "desc_id", "n_shared", mass.alias("fragment_mass"), (F.col("rank") == 1).alias("main"))


def extents(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and characteristic radius sqrt(5/3 mean r^2) of fragments, in space and in velocity; members weigh alike."""
    mean = parts.groupBy(*keys).agg(F.count("*").alias("npart"), *[F.avg(a).alias(f"mean_{a}") for a in (*SPACE, *SPEED)])
    j = parts.select(*keys, *SPACE, *SPEED).join(mean.drop("npart"), keys)
    r2 = lambda axes: sum(((F.col(a) - F.col(f"mean_{a}")) * (F.col(a) - F.col(f"mean_{a}")) for a in axes), F.lit(0.0))
    size = j.groupBy(*keys).agg(F.sqrt(5 / 3 * F.avg(r2(SPACE))).alias("radius"), F.sqrt(5 / 3 * F.avg(r2(SPEED))).alias("v_radius"))
    return mean.join(size, keys)


def overlaps(parts: DataFrame, box: float, halo: str = "halo_id", fragment: str = "fragment") -> DataFrame:
    """(halo, main, other, overlap, v_overlap): distance over the sum of radii between the largest fragment and each other one."""
    e = extents(parts, [halo, fragment])
    order = F.row_number().over(Window.partitionBy(halo).orderBy(F.desc("npart"), fragment))
    e = e.withColumn("rank", order)
    cols = [fragment, "radius", "v_radius", *[f"mean_{a}" for a in (*SPACE, *SPEED)]]
    a = e.where("rank = 1").select(halo, *[F.col(c).alias(f"{c}_a") for c in cols])
    b = e.where("rank > 1").select(halo, *[F.col(c).alias(f"{c}_b") for c in cols])
    j = a.join(b, halo)
    d = F.lit(0.0)
    for x in SPACE:
        gap = F.abs(F.col(f"mean_{x}_a") - F.col(f"mean_{x}_b"))
        gap = F.least(gap, F.lit(box) - gap)
        d = d + gap * gap
    v = sum(((F.col(f"mean_{x}_a") - F.col(f"mean_{x}_b")) * (F.col(f"mean_{x}_a") - F.col(f"mean_{x}_b")) for x in SPEED), F.lit(0.0))
    return j.select(halo, F.col(f"{fragment}_a").alias("main"), F.col(f"{fragment}_b").alias("other"), (F.sqrt(d) / F.nullif(F.col("radius_a") + F.col("radius_b"), F.lit(0.0))).alias("overlap"), (F.sqrt(v) / F.nullif(F.col("v_radius_a") + F.col("v_radius_b"), F.lit(0.0))).alias("v_overlap"))


def glued(parts: DataFrame, energy: DataFrame, box: float, halo: str = "halo_id", fragment: str = "fragment") -> DataFrame:
    """(halo, fragment, glued): fragments that overlap the main one, while one of both is unbound, become one named by the smallest.

    energy(halo, fragment, e): a fragment is unbound if e > 0.
    """
    o = overlaps(parts, box, halo, fragment)
    e = energy.select(halo, F.col(fragment).alias("f"), "e")
    j = o.join(e.withColumnsRenamed({"f": "main", "e": "e_main"}), [halo, "main"]).join(e.withColumnsRenamed({"f": "other", "e": "e_other"}), [halo, "other"])
    links = j.where(((F.col("e_main") > 0) | (F.col("e_other") > 0)) & (F.col("overlap") + F.col("v_overlap") < GLUE))
    least = links.groupBy(halo, "main").agg(F.min("other").alias("low")).select(halo, "main", F.least("main", "low").alias("glued"))
    both = links.select(halo, "main", F.col("other").alias(fragment)).unionByName(least.select(halo, "main", F.col("main").alias(fragment))).join(least, [halo, "main"]).select(halo, fragment, "glued")
    return parts.select(halo, fragment).distinct().join(both, [halo, fragment], "left").withColumn("glued", F.coalesce("glued", fragment))


def split_back(members: DataFrame, threshold: int = 10) -> DataFrame:
    """All snapshots split from the last one backwards: a group that has several descendants becomes its fragments.

    (snap_ord, pid, original_id, halo_id): each snapshot is split by the groups that the next one was split into, so the snapshots
    are walked through in order; within one, everything is a join and a window. Of a fragment only the particles that are in its
    descendant go on; a group with one descendant keeps all. Groups without descendant leave, but in the last snapshot. New ids
    are the first of the fragment's particles.
    """
    first, last = members.agg(F.min("snap_ord"), F.max("snap_ord")).first()
    now = written(members.where(F.col("snap_ord") == last).select("snap_ord", "pid", F.col("halo_id").alias("original_id"), "halo_id"))
    out = now
    for snap in range(last - 1, first - 1, -1):
        here = members.where(F.col("snap_ord") == snap).select("snap_ord", "pid", F.col("halo_id").alias("original_id"))
        with_next = here.join(now.select("pid", F.col("halo_id").alias("desc_id")), "pid", "left")
        n = F.when(F.col("desc_id").isNotNull(), F.count("*").over(Window.partitionBy("original_id", "desc_id")))
        counted = with_next.withColumn("counted", F.when(n >= threshold, F.col("desc_id")))
        w = Window.partitionBy("original_id")
        single = counted.withColumn("single", F.min("counted").over(w) == F.max("counted").over(w))
        kept = single.where(F.col("single") | F.col("counted").isNotNull()).withColumn("part", F.when(~F.col("single"), F.col("counted")))
        now = written(kept.withColumn("halo_id", F.min("pid").over(Window.partitionBy("original_id", "part"))).select("snap_ord", "pid", "original_id", "halo_id"))
        out = out.unionByName(now)
    return out


def split_walk(members: DataFrame, groups: DataFrame, box: float, softening: float, particle_mass: float, redshift: float = 0.0, h: float = 1.0, g: float = 1.0, threshold: int = 10, glue: bool = True) -> tuple[DataFrame, DataFrame]:
    """split_back() with energies: of each group's fragments, those that overlap the main one while one of both is unbound are glued to it.

    members(snap_ord, halo_id, pid, x .. vz) and groups(snap_ord, halo_id, real) give (snap_ord, pid, original_id, halo_id) and the catalogue of
    all snapshots but the last: (snap_ord, halo_id, original_id, npart, n_persist, split, ke, ge, e, real). npart is a fragment's share
    of its group, particles in no counted descendant shared out by what the descendants took; n_persist counts the particles in
    the descendant; split is the number of the group's fragments after glueing. Energies are those of the persistent particles, of
    one mass. A fragment is real if bound (e <= 0), and a group with one descendant, which stays whole, as it was before. Without glue every
    fragment stays on its own.
    """
    columns = ["snap_ord", "pid", "original_id", "halo_id"]
    first, last = members.agg(F.min("snap_ord"), F.max("snap_ord")).first()
    now = written(members.where(F.col("snap_ord") == last).select("snap_ord", "pid", F.col("halo_id").alias("original_id"), "halo_id"))
    out, catalogue = now, None

    def energies(parts: DataFrame, key: str) -> DataFrame:
        return properties.equal_mass_energy(properties.wrapped(parts, box, key), softening, particle_mass, redshift, h, g, key)

    for snap in range(last - 1, first - 1, -1) if first is not None else ():
        here = members.where(F.col("snap_ord") == snap).select("snap_ord", "pid", F.col("halo_id").alias("original_id"), *SPACE, *SPEED)
        with_next = here.join(now.select("pid", F.col("halo_id").alias("desc_id")), "pid", "left")
        n = F.when(F.col("desc_id").isNotNull(), F.count("*").over(Window.partitionBy("original_id", "desc_id")))
        w = Window.partitionBy("original_id")
        counted = with_next.withColumn("counted", F.when(n >= threshold, F.col("desc_id")))
        counted = counted.withColumns({"single": F.min("counted").over(w) == F.max("counted").over(w), "whole": F.count("*").over(w), "took": F.count("counted").over(w)})
        kept = counted.where(F.col("single") | F.col("counted").isNotNull()).withColumn("part", F.when(~F.col("single"), F.col("counted")))
        rows = written(kept.withColumn("fragment", F.min("pid").over(Window.partitionBy("original_id", "part"))))
        persistent = rows.where("counted IS NOT NULL")
        several = persistent.where("NOT single")
        energy = written(energies(persistent, "fragment"))
        own = several.select("original_id", "fragment").distinct()
        if glue:
            names = written(glued(properties.wrapped(several, box, "fragment"), own.join(energy.select("fragment", "e"), "fragment"), box, "original_id"))
        else:
            names = own.withColumn("glued", F.col("fragment"))
        named = rows.join(names.select("fragment", "glued"), "fragment", "left").withColumn("halo_id", F.coalesce("glued", "fragment"))
        named = written(named.select(*columns, "single", "whole", "took", "counted", *SPACE, *SPEED))
        # Energies of fragments that were glued are those of the whole; all others are known.
        new = names.groupBy("glued").agg(F.count("*").alias("n")).where("n > 1").select(F.col("glued").alias("halo_id"))
        again = energies(named.where("counted IS NOT NULL").join(new, "halo_id", "left_semi"), "halo_id")
        all_energies = energy.withColumnRenamed("fragment", "halo_id").join(new, "halo_id", "left_anti").unionByName(again)
        sizes = named.groupBy("snap_ord", "halo_id", "original_id").agg(F.count("counted").alias("n_persist"), F.first("single").alias("single"), F.first("whole").alias("whole"), F.first("took").alias("took"))
        share = F.when(F.col("single"), F.col("whole").cast("double")).otherwise(F.col("n_persist") + (F.col("whole") - F.col("took")) * (F.col("n_persist") / F.col("took")))
        was = groups.where(F.col("snap_ord") == snap).select(F.col("halo_id").alias("original_id"), F.col("real").alias("was_real"))
        step = sizes.withColumn("split", F.count("*").over(Window.partitionBy("original_id"))).join(all_energies, "halo_id").join(was, "original_id", "left")
        real = F.when(F.col("single"), F.col("was_real")).otherwise(F.col("e") <= 0)
        step = written(step.select("snap_ord", "halo_id", "original_id", share.alias("npart"), "n_persist", "split", "ke", "ge", "e", real.alias("real")))
        catalogue = step if catalogue is None else catalogue.unionByName(step)
        now = named.select(*columns)
        out = out.unionByName(now)
    if catalogue is None:
        catalogue = members.sparkSession.createDataFrame([], "snap_ord int, halo_id long, original_id long, npart double, n_persist long, split long, ke double, ge double, e double, real boolean")
    return out, catalogue
