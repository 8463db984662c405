"""The two programs: a parameter file and a snapshot's place in the list make a written catalogue, then links, flags and graphs.

    python -m starloom.plans.programs halos <parameters.yml> <snapshot's place>
    python -m starloom.plans.programs graph <parameters.yml> <snapshot's place>
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.operators import graph, links
from starloom.operators.components import release, scope, written
from starloom.plans.pipeline import Catalogue, find_in_snapshot
from starloom.sources import binary, native, publish
from starloom.sources.params import Params, read_params
from starloom.sources.sinks import write_catalogue
from starloom.sources.tables import snapshot_list, species

LEVELS = {0: "graphdirect", 1: "subgraphdirect"}


@dataclass(frozen=True)
class Input:
    particles: DataFrame
    redshift: float
    box: tuple[float, float, float]


def snapshot_names(spark: SparkSession, p: Params) -> list[str]:
    return [r["snap"] for r in snapshot_list(spark, p.inputs["snapList"]).orderBy("snap_ord").collect()]  # a row a snapshot


def read_input(spark: SparkSession, p: Params, snap: str, snap_ord: int) -> Input:
    """A snapshot's particles and header: data_type BINARY for length-framed files, SWIFT and GADGET_split for HDF5 ones, whose path may have <snap> in it."""
    kind, path = p.simulation["data_type"], f"{p.inputs.get('data', '')}{p.inputs.get('basename', '')}"
    path = path.replace("<snap>", snap) if "<snap>" in path else path + snap
    if kind == "BINARY":
        head = binary.header(path)
        return Input(binary.read_binary(spark, path, snap_ord), head["redshift"], tuple(head["box"]))
    path = path if path.endswith(".hdf5") else f"{path}.hdf5"
    head = native.header(path)
    return Input(native.read_snapshot(spark, path, snap_ord), head["redshift"], tuple(head["box"]))


def save(spark: SparkSession, p: Params, snap: str, snap_ord: int, data: Input, found: Catalogue) -> int:
    """One version of the halo catalogue with this snapshot's halos, members, particle map and scalars."""
    columns = ["pid", "halo_id", "part_type", "mass"]
    none = found.members.where("false")
    subs = found.sub_members if found.sub_members is not None else none
    groups = [g.withColumn("level", F.lit(level)).drop("host_id", "npart") for level, g in ((0, found.groups), (1, found.sub_groups)) if g is not None]
    properties = groups[0] if len(groups) == 1 else groups[0].unionByName(groups[1])
    box = dict(zip(("box_x", "box_y", "box_z"), data.box, strict=True))
    one = spark.createDataFrame([(snap, data.redshift, *box.values())], "snap string, redshift double, box_x double, box_y double, box_z double")
    read = species(data.particles, int(p.simulation["ignored_species_lim"]), bool(p.flags["DMO"]))
    return write_catalogue(spark, p.inputs["haloSavePath"], snap_ord, read, found.members.select(*columns), subs.select(*columns, F.col("host_id").alias("host")), properties, {"snapshots": one})


def halos(spark: SparkSession, p: Params, snap_ord: int) -> int:
    """Finds a snapshot's groups (and subgroups, with find_subs) and writes them to haloSavePath; returns the catalogue's version."""
    snap = snapshot_names(spark, p)[snap_ord]
    with scope() as mine:
        data = read_input(spark, p, snap, snap_ord)
        kept = Input(written(data.particles), data.redshift, data.box)
        number = save(spark, p, snap, snap_ord, kept, find_in_snapshot(kept.particles, p, data.redshift, data.box))
    release(spark, mine)
    return number


def members_of(spark: SparkSession, p: Params, level: int, snaps: list[int]) -> DataFrame:
    m = publish.table(spark, p.inputs["haloSavePath"], "members", snaps)
    return m.where(F.col("level") == level).select("snap_ord", "halo_id", "pid", "part_type", "mass")


def direct(spark: SparkSession, p: Params, snap_ord: int, count: int) -> int | None:
    """Links of a snapshot's groups with those before and after, of the levels that the flags ask for, as one version of directgraphSavePath."""
    around = [s for s in (snap_ord - 1, snap_ord, snap_ord + 1) if 0 <= s < count]
    least = int(p.parameters["link_threshold"])
    prog, desc = [], []
    for level, flag in LEVELS.items():
        if p.flags[flag]:
            m = members_of(spark, p, level, around)
            own = F.col("snap_ord") == snap_ord
            prog.append(links.progenitors(m, least).where(own).withColumn("level", F.lit(level)))
            desc.append(links.descendants(m, least).where(own).withColumn("level", F.lit(level)))
    if not prog:
        return None
    tables = {name: t[0] if len(t) == 1 else t[0].unionByName(t[1]) for name, t in (("progenitors", prog), ("descendants", desc))}
    return publish.publish(spark, p.inputs["directgraphSavePath"], tables, snap_ord)


def of_level(spark: SparkSession, p: Params, level: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups and links of all snapshots, of one level."""
    own = F.col("level") == level
    g = publish.table(spark, p.inputs["haloSavePath"], "halos").where(own).select("snap_ord", "halo_id", "host_id", "npart", "real")
    return g, *(publish.table(spark, p.inputs["directgraphSavePath"], t).where(own) for t in ("progenitors", "descendants"))


def clean(spark: SparkSession, p: Params) -> int:
    """Flags over time and the links to really real groups, of all levels that have links: one version with tables of all snapshots."""
    flags, cleaned = [], []
    for level, flag in LEVELS.items():
        if p.flags[flag]:
            g, prog, _ = of_level(spark, p, level)
            f = written(graph.temporal_flags(g, prog))
            flags.append(f.select("snap_ord", F.lit(level).alias("level"), "halo_id", "real", "linked_real"))
            cleaned.append(graph.cleaned_progenitors(prog, f))
    tables = {name: t[0] if len(t) == 1 else t[0].unionByName(t[1]) for name, t in (("flags", flags), ("cleaned_progenitors", cleaned))}
    return publish.publish(spark, p.inputs["directgraphSavePath"], tables)


def whole_graphs(spark: SparkSession, p: Params) -> int:
    """Merger graphs of groups and, with the flag subgraph, those of subgroups in them: one version of graphSavePath."""
    g, prog, desc = of_level(spark, p, 0)
    nodes = written(graph.numbered(graph.rooted(graph.graphs(g, prog, desc))))
    level = lambda t, n: t.withColumn("level", F.lit(n))
    tables = {"nodes": [level(nodes, 0)], "edges": [level(graph.graph_edges(nodes, prog), 0)], "generations": [level(graph.generations(nodes), 0)], "summaries": [level(graph.summary(nodes), 0)]}
    if p.flags["subgraph"]:
        s, sub_prog, sub_desc = of_level(spark, p, 1)
        subs = written(graph.numbered(graph.hosted(graph.graphs(s, sub_prog, sub_desc), s, nodes)))
        of_hosts = graph.host_graphs(subs, s, nodes)
        for name, t in (("nodes", subs), ("edges", graph.graph_edges(subs, sub_prog)), ("generations", graph.generations(subs)), ("summaries", graph.summary(subs))):
            tables[name].append(level(t, 1))
        tables["host_graphs"] = [of_hosts]
    return publish.publish(spark, p.inputs["graphSavePath"], {n: t[0] if len(t) == 1 else t[0].unionByName(t[1]) for n, t in tables.items()})


def graphs(spark: SparkSession, p: Params, snap_ord: int) -> None:
    """Links of one snapshot; at the last one flags over time and whole graphs as well, if the flags ask for them."""
    count = len(snapshot_names(spark, p))
    with scope() as mine:
        direct(spark, p, snap_ord, count)
        if snap_ord == count - 1:
            if p.flags["clean_real_flags"]:
                clean(spark, p)
            if p.flags["graph"]:
                whole_graphs(spark, p)
    release(spark, mine)


def main(arguments: list[str]) -> None:
    program, path, place = arguments
    spark = SparkSession.builder.appName(f"starloom {program}").getOrCreate()
    {"halos": halos, "graph": graphs}[program](spark, read_params(path), int(place))


if __name__ == "__main__":
    main(sys.argv[1:])
