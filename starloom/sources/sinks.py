"""Writing catalogues: Parquet by snapshot, ragged lists as start and stride."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.operators.components import written
from starloom.operators.numbering import running_sum
from starloom.sources.publish import publish

#: Written where there is nothing to point at, and for particles in no group.
NO_DATA = 1 << 30
NO_GROUP = -2


def write_snapshots(table: DataFrame, path: str) -> None:
    """Replaces the snapshots that the table has, and leaves all others."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("snap_ord").parquet(path)


def ragged(members: DataFrame, *keys: str) -> DataFrame:
    """(keys, halo_id, stride, start_index): where each group's members begin in the list of all, sorted by group, and how many they are."""
    n = members.groupBy(*keys, "halo_id").agg(F.count("*").alias("stride"))
    return running_sum(n, [*keys], ["halo_id"], "start_index", "stride")


def member_list(members: DataFrame, *keys: str) -> DataFrame:
    """The list itself: a place for each member."""
    return running_sum(members, [*keys], ["halo_id", "pid"], "place")


def particle_map(particles: DataFrame, grouped: DataFrame) -> DataFrame:
    """(pid, halo_id) for every particle; NO_GROUP for those in none."""
    return particles.select("pid").join(grouped.select("pid", "halo_id"), "pid", "left").withColumn("halo_id", F.coalesce("halo_id", F.lit(NO_GROUP)))


def exported_links(groups: DataFrame, links: DataFrame) -> DataFrame:
    """(snap_ord, halo_id, n_links, start_index): NO_DATA where a group has no links."""
    n = links.groupBy("snap_ord", "halo_id").agg(F.count("*").alias("n"))
    g = groups.select("snap_ord", "halo_id").join(n, ["snap_ord", "halo_id"], "left").withColumn("n_links", F.coalesce("n", F.lit(0)))
    g = running_sum(g.drop("n"), ["snap_ord"], ["halo_id"], "start_index", "n_links")
    return g.withColumn("start_index", F.when(F.col("n_links") > 0, F.col("start_index")).otherwise(F.lit(NO_DATA)))


def replace_flags(catalogue: DataFrame, flags: DataFrame) -> DataFrame:
    """catalogue with real replaced by the flags' linked_real, for write_snapshots()."""
    f = flags.select("snap_ord", "halo_id", "linked_real")
    return catalogue.drop("linked_real").join(f, ["snap_ord", "halo_id"], "left").withColumn("real", F.coalesce("linked_real", "real")).drop("linked_real")


def levels(hosts: DataFrame, subs: DataFrame) -> DataFrame:
    """(level, halo_id, host_id, npart, occupancy) of members hosts(pid, halo_id) and subs(pid, halo_id, host): hosts are level 0 with the
    number of their subgroups, subgroups level 1 with their host.
    """
    n_subs = subs.select("halo_id", "host").distinct().groupBy(F.col("host").alias("halo_id")).agg(F.count("*").alias("occupancy"))
    h = hosts.groupBy("halo_id").agg(F.count("*").alias("npart")).join(n_subs, "halo_id", "left")
    host = h.select(F.lit(0).alias("level"), "halo_id", F.lit(None).cast("long").alias("host_id"), "npart", F.coalesce("occupancy", F.lit(0)).alias("occupancy"))
    sub = subs.groupBy("halo_id", F.col("host").alias("host_id")).agg(F.count("*").alias("npart"))
    return host.unionByName(sub.select(F.lit(1).alias("level"), "halo_id", "host_id", "npart", F.lit(None).cast("long").alias("occupancy")))


def catalogue_lists(hosts: DataFrame, subs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a catalogue file holds: groups of both levels with where their members begin, and the members' list (level, halo_id, pid, place),
    with the members' species and masses where both tables have them.
    """
    more = [c for c in ("part_type", "mass") if c in hosts.columns and c in subs.columns]
    members = hosts.select(F.lit(0).alias("level"), "halo_id", "pid", *more).unionByName(subs.select(F.lit(1).alias("level"), "halo_id", "pid", *more))
    groups = levels(hosts, subs).join(ragged(members, "level"), ["level", "halo_id"])
    return groups, member_list(members, "level")


def write_catalogue(spark: SparkSession, path: str, snap_ord: int, particles: DataFrame, hosts: DataFrame, subs: DataFrame, properties: DataFrame | None = None, more: dict[str, DataFrame] | None = None) -> int:
    """One snapshot of a catalogue in one step (publish.py): tables halos, members and particle_map, and `more`; others are left as they are.

    properties(level, halo_id, ...), if given, are columns of halos.
    """
    hosts, subs = written(hosts), written(subs)
    groups, members = catalogue_lists(hosts, subs)
    groups = groups if properties is None else groups.join(properties, ["level", "halo_id"], "left")
    where = subs.select("pid", F.col("halo_id").alias("sub_id"))
    in_map = particle_map(particles, hosts).join(where, "pid", "left").withColumn("sub_id", F.coalesce("sub_id", F.lit(NO_GROUP)))
    return publish(spark, path, {"halos": groups, "members": members, "particle_map": in_map} | (more or {}), snap_ord)


def cleaned_export(groups: DataFrame, prog: DataFrame, desc: DataFrame) -> DataFrame:
    """(snap_ord, halo_id, real, n_progs, prog_start, n_descs, desc_start): links after cleaning as lists, for groups with linked_real."""
    p = exported_links(groups, prog).withColumnsRenamed({"n_links": "n_progs", "start_index": "prog_start"})
    d = exported_links(groups, desc).withColumnsRenamed({"n_links": "n_descs", "start_index": "desc_start"})
    return groups.select("snap_ord", "halo_id", F.col("linked_real").alias("real")).join(p, ["snap_ord", "halo_id"]).join(d, ["snap_ord", "halo_id"])


def sorted_particles(particles: DataFrame) -> DataFrame:
    """particles with their place among those of their species in the order of pid, and among all (`all_place`): the converted snapshot's order."""
    return running_sum(running_sum(particles, ["part_type"], ["pid"], "place"), [], ["pid"], "all_place")
