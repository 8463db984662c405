"""Tables of particles, members and groups, from native files or from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.operators.numbering import running_sum


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def snapshot_list(spark: SparkSession, path: str) -> DataFrame:
    """(snap_ord, snap) from a text file with a snapshot's name a line, in the order of the names' numbers."""
    names = spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").alias("snap"))
    return names.select((F.row_number().over(Window.orderBy(F.col("snap").cast("long"), "snap")) - 1).alias("snap_ord"), "snap")


def neighbours(snapshots: DataFrame) -> DataFrame:
    """snapshots(snap_ord, redshift, ...) with the redshifts of the ones before and after."""
    w = Window.orderBy("snap_ord")  # one row a snapshot
    return snapshots.withColumns({"prev_redshift": F.lag("redshift").over(w), "next_redshift": F.lead("redshift").over(w)})


def species(particles: DataFrame, limit: int = 6, dark_only: bool = False) -> DataFrame:
    """Particles of the species that are read: not 2 and 3, below the limit, 1 alone if dark_only."""
    return particles.where("part_type = 1") if dark_only else particles.where((F.col("part_type") < limit) & ~F.col("part_type").isin(2, 3))


def subset(particles: DataFrame, wanted: DataFrame, *columns: str) -> DataFrame:
    """The named columns of the particles in wanted(pid)."""
    return particles.select("pid", *columns).join(wanted.select("pid"), "pid", "left_semi")


def row_range(particles: DataFrame, low: int, high: int) -> DataFrame:
    """Rows low .. high - 1 in the order of pid, by a stored row_idx if there is one."""
    if "row_idx" not in particles.columns:
        return running_sum(particles, [], ["pid"], "row_idx").where((F.col("row_idx") >= low) & (F.col("row_idx") < high)).drop("row_idx")
    return particles.where((F.col("row_idx") >= low) & (F.col("row_idx") < high))


def pids(particles: DataFrame, kind: int) -> DataFrame:
    """The ids of all particles of a species."""
    return particles.where(F.col("part_type") == kind).select("pid")


def baryons(particles: DataFrame) -> DataFrame:
    """Positions of all species that are read but dark matter."""
    return species(particles).where("part_type <> 1").select("pid", "part_type", "x", "y", "z")


def physical(particles: DataFrame, wanted: DataFrame, factors: dict[str, float]) -> DataFrame:
    """The columns named by factors of the particles in wanted(pid), in physical units: each times the factor stored with it."""
    return subset(particles.select("pid", *[in_units(c, f).alias(c) for c, f in factors.items()]), wanted, *factors)


def gathered(members: DataFrame, particles: DataFrame, hubble: float, box: float | tuple[float, float, float]) -> DataFrame:
    """(halo_id, pid, x .. vz, mass, part_type) of the particles of many groups, over all species, velocities with the expansion's part."""
    j = members.select("halo_id", "pid").join(particles, "pid")
    return with_flow(j, hubble, box).select("halo_id", "pid", "x", "y", "z", "vx", "vy", "vz", "mass", "part_type")


def halo_range(catalogue: DataFrame, level: int, low: int, high: int) -> DataFrame:
    """Rows low .. high - 1 of a catalogue's hosts (level 0) or subgroups (level 1), in the order of halo_id."""
    placed = running_sum(catalogue.where(F.col("level") == level), [], ["halo_id"], "row_idx")
    return placed.where((F.col("row_idx") >= low) & (F.col("row_idx") < high)).drop("row_idx")


def linked(lists: DataFrame, links: str = "links", start: str = "start_index", count: str = "n_links") -> DataFrame:
    """lists with `own`: each row's part of its flat list of links, by start and count; null where there is none."""
    return lists.withColumn("own", F.when(F.col(count) > 0, F.slice(links, F.col(start).cast("int") + 1, F.col(count).cast("int"))))


def with_flow(particles: DataFrame, hubble: float, box: float | tuple[float, float, float]) -> DataFrame:
    """Velocities with the expansion's part: v + H (x - L / 2), L being the box's side along each axis."""
    sides = box if isinstance(box, (tuple, list)) else (box,) * 3
    return particles.withColumns({f"v{a}": F.col(f"v{a}") + F.lit(hubble) * (F.col(a) - F.lit(s / 2)) for a, s in zip("xyz", sides, strict=True)})


def in_units(column: str, factor: float) -> Column:
    return F.col(column) * F.lit(factor)


def converted(particles: DataFrame, volume: float) -> DataFrame:
    """(part_type, npart, mass, mean_separation) of each species, and of all of them as species -1."""
    per = particles.groupBy("part_type").agg(F.count("*").alias("npart"), F.sum("mass").alias("mass"))
    whole = particles.agg(F.count("*").alias("npart"), F.sum("mass").alias("mass")).select(F.lit(-1).alias("part_type"), "npart", "mass")
    return per.unionByName(whole).withColumn("mean_separation", F.pow(F.lit(volume) / F.col("npart"), F.lit(1 / 3)))


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Particles made from embeddings: the first three components are a place in a box of side 1, the next three a velocity."""
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    place = [(at(i) + 0.5).alias(a) for i, a in enumerate("xyz")]
    speed = [at(i + 3).alias(f"v{a}") for i, a in enumerate("xyz")]
    kind = F.when(F.col("label") % 2 == 0, 1).otherwise(0)
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), *place, *speed, (F.col("label") + 1).cast("double").alias("mass"), kind.alias("part_type"), "label")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership over years: a part belongs to the nation that supplied most of it."""
    li = load(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", F.year("l_shipdate").alias("snap_ord"))
    s = load(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("halo_id"))
    q = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("snap_ord", F.col("l_partkey").alias("pid"), "halo_id").agg(F.sum("l_quantity").alias("q"))
    m = q.groupBy("snap_ord", "pid").agg(F.sum("q").alias("mass"), F.max(F.struct("q", (-F.col("halo_id")).alias("minus"))).alias("m"))
    kind = F.when(F.col("p_size") % 3 == 0, 0).when(F.col("p_size") % 3 == 1, 1).otherwise(4)
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("pid"), kind.alias("part_type"))
    return m.select("snap_ord", "pid", "mass", (-F.col("m")["minus"]).alias("halo_id")).join(p, "pid").select("snap_ord", "halo_id", "pid", "part_type", "mass")


def cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership over days: a user belongs to the event type with the largest summed value."""
    e = load(spark, sf_dir, "events").select(F.dayofyear("ts").alias("snap_ord"), F.col("user_id").alias("pid"), "event_type", "value")
    v = e.groupBy("snap_ord", "pid", "event_type").agg(F.sum("value").alias("v"))
    best = v.groupBy("snap_ord", "pid").agg(F.min(F.struct((-F.round("v", 6)).alias("minus"), "event_type")).alias("m"))
    return best.select("snap_ord", "pid", F.col("m")["event_type"].alias("halo_id"))
