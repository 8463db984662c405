"""Properties of groups, from rows (halo_id, pid, x, y, z, vx, vy, vz, mass, part_type).

Masses sum to exact numbers if they are integral. Where the order of a group's rows matters it is that of pid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.operators.bounds import exact_sums
from starloom.operators.components import written
from starloom.operators.numbering import running_sums

SPACE, SPEED = ("x", "y", "z"), ("vx", "vy", "vz")
#: Members up to which the pair sum of a group is a join; it is summed in ranges of rows beyond.
PAIRS = 2_000


def wrapped(parts: DataFrame, box: float | tuple[float, float, float], key: str = "halo_id") -> DataFrame:
    """Positions on one side of the box: a coordinate more than half a side below its group's largest moves up by the side.

    The largest ones are a written table, so that Spark can split the join of a group that holds most rows.
    """
    lengths = box if isinstance(box, (tuple, list)) else (box,) * 3
    far = written(parts.groupBy(key).agg(*[F.max(a).alias(f"_far_{a}") for a in SPACE]))
    moved = {a: F.when(F.col(f"_far_{a}") - F.col(a) > s / 2, F.col(a) + s).otherwise(F.col(a)) for a, s in zip(SPACE, lengths, strict=True)}
    return parts.join(far, key).withColumns(moved).select(*parts.columns)


def mass_by_type(parts: DataFrame, types: tuple[int, ...], key: str = "halo_id") -> DataFrame:
    n = [F.count(F.when(F.col("part_type") == t, 1)).alias(f"npart_{t}") for t in types]
    m = [F.coalesce(F.sum(F.when(F.col("part_type") == t, F.col("mass"))), F.lit(0.0)).alias(f"mass_{t}") for t in types]
    return parts.groupBy(key).agg(F.count("*").alias("npart"), F.sum("mass").alias("mass"), *n, *m)


def centres(parts: DataFrame, key: str = "halo_id") -> DataFrame:
    """Mass-weighted mean positions and velocities."""
    return parts.groupBy(key).agg(F.count("*").alias("npart"), *[(F.sum(F.col("mass") * F.col(a)) / F.sum("mass")).alias(f"mean_{a}") for a in (*SPACE, *SPEED)])


def centred(parts: DataFrame, key: str = "halo_id") -> DataFrame:
    """parts relative to their group's centres, which are a written table for the same reason as in wrapped()."""
    c = written(centres(parts, key).drop("npart"))
    j = parts.join(c, key)
    return j.withColumns({a: F.col(a) - F.col(f"mean_{a}") for a in (*SPACE, *SPEED)}).drop(*[f"mean_{a}" for a in (*SPACE, *SPEED)])


def squared(axes: tuple[str, ...]):
    return sum((F.col(a) * F.col(a) for a in axes[1:]), F.col(axes[0]) * F.col(axes[0]))


def spread_of(c: DataFrame, key: str = "halo_id") -> DataFrame:
    """RMS radii in space and velocity, and velocity dispersions an axis and in all, of centred rows."""
    std = [F.stddev_pop(a).alias(f"disp_{a}") for a in SPEED]
    g = c.groupBy(key).agg(F.sqrt(F.avg(squared(SPACE))).alias("rms_r"), F.sqrt(F.avg(squared(SPEED))).alias("rms_vr"), *std)
    return g.withColumn("disp_3d", F.sqrt(squared(tuple(f"disp_{a}" for a in SPEED))))


def by_radius(c: DataFrame, axes: tuple[str, ...] = SPACE, key: str = "halo_id") -> DataFrame:
    """Centred rows with radius r, mass within (of rows up to this one, by radius, then pid), total mass and place in that order.

    Sums and places run over ranges (numbering.py), so that no task holds a group.
    """
    r = c.withColumn("r", F.sqrt(squared(axes)))
    placed = running_sums(r, [key], ["r", "pid"], {"within": "mass", "place": None}, {"within": "total"})
    return placed.withColumns({"within": F.col("within") + F.col("mass"), "place": F.col("place") + 1})


def half_mass_radius(c: DataFrame, axes: tuple[str, ...] = SPACE, key: str = "halo_id", to: str = "half_mass_r") -> DataFrame:
    """Radius of the row whose mass within is closest to half of all; the first on ties."""
    return by_radius(c, axes, key).groupBy(key).agg(_half_mass(to))


def _half_mass(to: str) -> Column:
    return F.min_by("r", F.struct(F.abs(F.col("within") - F.col("total") / 2), "place")).alias(to)


def _vmax(g: float) -> Column:
    return F.max(F.when(F.col("r") > 0, F.lit(g) * F.col("within") / F.col("r"))).alias("vmax")


def vmax(c: DataFrame, g: float, key: str = "halo_id") -> DataFrame:
    """The largest g * mass within / r (no square root, as the catalogue defines it); rows at the centre are left out."""
    return by_radius(c, SPACE, key).where("r > 0").groupBy(key).agg(_vmax(g))


def kinetic(c: DataFrame, key: str = "halo_id") -> DataFrame:
    """Half the sum of squared centred velocities; masses don't enter."""
    return c.groupBy(key).agg(F.sum(0.5 * squared(SPEED)).alias("ke"))


def potential(c: DataFrame, softening: float, factor: float = 1.0, key: str = "halo_id", pairs: int = PAIRS) -> DataFrame:
    """Sum over pairs of the earlier row's mass / sqrt(distance^2 + softening^2), times factor.

    Groups of at most `pairs` rows are joined with themselves; larger ones go through ranges of rows (bounds.exact_sums), two of them at a
    time, so that no task holds a whole group. Where only the bound test is asked for, bounds.bound_flags() does with far fewer pairs.
    """
    n = c.groupBy(key).agg(F.count("*").alias("n"))
    sized = c.select(key, "pid", *SPACE, "mass").join(n, key)
    small = sized.where(F.col("n") <= pairs)
    a = small.select(key, F.col("pid").alias("pid_a"), F.col("mass").alias("mass_a"), *[F.col(s).alias(f"{s}_a") for s in SPACE])
    b = small.select(F.col(key).alias("key_b"), F.col("pid").alias("pid_b"), *[F.col(s).alias(f"{s}_b") for s in SPACE])
    d2 = sum(((F.col(f"{s}_a") - F.col(f"{s}_b")) * (F.col(f"{s}_a") - F.col(f"{s}_b")) for s in SPACE), F.lit(softening * softening))
    joined = a.join(b, (F.col(key) == F.col("key_b")) & (F.col("pid_a") < F.col("pid_b"))).groupBy(key).agg(F.sum(F.col("mass_a") / F.sqrt(d2)).alias("s"))
    large = n.where(F.col("n") > pairs)
    out = joined if large.isEmpty() else joined.unionByName(exact_sums(sized.where(F.col("n") > pairs), softening, key).select(key, "s"))
    return n.join(out, key, "left").select(key, (F.coalesce("s", F.lit(0.0)) * factor).alias("ge"))


def bound(c: DataFrame, softening: float, factor: float, key: str = "halo_id") -> DataFrame:
    """(key, ke, ge, ratio, real): bound if (kinetic + 0 thermal) / potential is at most 1; null ratio without potential."""
    j = kinetic(c, key).join(potential(c, softening, factor, key), key)
    ratio = F.col("ke") / F.nullif("ge", F.lit(0.0))
    return j.withColumn("ratio", ratio).withColumn("real", F.coalesce(ratio <= 1, F.lit(False)))


def shell_energy(c: DataFrame, factor: float, key: str = "halo_id") -> DataFrame:
    """The quick estimate: kinetic from the dispersion, potential from shells: mass inside a row's radius over that radius."""
    s = by_radius(c, SPACE, key)
    ge = s.where("r > 0").groupBy(key).agg(F.sum(factor * F.col("mass") * (F.col("within") - F.col("mass")) / F.col("r")).alias("ge_shell"))
    ke = c.groupBy(key).agg((0.5 * F.count("*") * sum((F.var_pop(a) for a in SPEED[1:]), F.var_pop(SPEED[0]))).alias("ke_disp"))
    return ke.join(ge, key)


def equal_mass_energy(parts: DataFrame, softening: float, particle_mass: float, redshift: float, h: float, g: float, key: str = "halo_id") -> DataFrame:
    """(key, ke, ge, e) for particles of one mass: kinetic from velocity variances / (1 + z), potential over all pairs x h (1 + z)."""
    n = parts.groupBy(key).agg((0.5 * particle_mass / (1 + redshift) * F.count("*") * sum((F.var_pop(a) for a in SPEED[1:]), F.var_pop(SPEED[0]))).alias("ke"))
    one = parts.withColumn("mass", F.lit(1.0))
    j = n.join(potential(one, softening, g * particle_mass**2 * h * (1 + redshift), key), key)
    return j.withColumn("e", F.col("ke") - F.col("ge"))


def catalogue(parts: DataFrame, softening: float, factor: float, g: float, types: tuple[int, ...] = (0, 1, 4, 5), key: str = "halo_id") -> DataFrame:
    """One row a group with all of the above."""
    c = centred(parts, key)
    out = mass_by_type(parts, types, key).join(centres(parts, key).drop("npart"), key).join(spread_of(c, key), key)
    by_space = by_radius(c, SPACE, key).groupBy(key).agg(_half_mass("half_mass_r"), _vmax(g))
    for more in (by_space, half_mass_radius(c, SPEED, key, "half_mass_vr"), bound(c, softening, factor, key)):
        out = out.join(more, key, "left")
    return out
