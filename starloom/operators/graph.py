"""Flags over time, trees and merger graphs on tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.operators.components import components, written
from starloom.operators.links import REAL_SIZE, ranked
from starloom.operators.numbering import running_sum


def temporal_flags(groups: DataFrame, prog: DataFrame) -> DataFrame:
    """groups with linked_real: real if the group, or one that it descends from over progenitor links, is large and bound.

    That is the closed form of the forward sweep over snapshots (a group is real if a real progenitor is left, else if it is large
    and real by energy). Each round carries flags one snapshot on and keeps only groups that become real in it.
    """
    spark = groups.sparkSession
    seed = groups.where((F.col("npart") >= REAL_SIZE) & F.col("real")).select("snap_ord", "halo_id")
    edges = written(prog.select((F.col("snap_ord") - 1).alias("from_ord"), F.col("other_id").alias("from_id"), "snap_ord", "halo_id"))
    real = reach(spark, seed, edges)
    return groups.join(real.withColumn("linked_real", F.lit(True)), ["snap_ord", "halo_id"], "left").withColumn("linked_real", F.coalesce("linked_real", F.lit(False)))


def reach(spark: SparkSession, start: DataFrame, edges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """All (keys, snap_ord, halo_id) that edges(from_ord, from_id, snap_ord, halo_id) lead to from start, start included."""
    cols = [*keys, "snap_ord", "halo_id"]
    front = written(start.select(*cols).distinct())
    found = front
    while True:
        step = front.withColumnsRenamed({"snap_ord": "from_ord", "halo_id": "from_id"}).join(edges, ["from_ord", "from_id"]).select(*cols).distinct()
        # What was found stays where it is written; a round writes its own front only.
        front = written(step.join(found, cols, "left_anti"))
        if front.isEmpty():
            return found
        found = found.unionByName(front)


def cleaned_progenitors(prog: DataFrame, flags: DataFrame) -> DataFrame:
    """Progenitor links to really real groups only, ranked anew."""
    real = flags.where("linked_real").select((F.col("snap_ord") + 1).alias("snap_ord"), F.col("halo_id").alias("other_id"))
    return ranked(prog.drop("rank").join(real, ["snap_ord", "other_id"], "left_semi"))


def main_branches(groups: DataFrame, prog: DataFrame, report: dict | None = None) -> DataFrame:
    """(halo_id, npart, length): steps along first progenitors from each group of the last snapshot.

    Jumps of all groups double until each ends where a branch does, so rounds are the logarithm of the longest branch; report gets their number.
    """
    last = groups.agg(F.max("snap_ord")).first()[0]
    one = prog.where("rank = 1").select("snap_ord", "halo_id", (F.col("snap_ord") - 1).alias("to_ord"), F.col("other_id").alias("to_id"), F.lit(1).cast("long").alias("length"))
    jumps, rounds = written(one), 0
    while True:
        ahead = jumps.select(F.col("snap_ord").alias("to_ord"), F.col("halo_id").alias("to_id"), F.col("to_ord").alias("next_ord"), F.col("to_id").alias("next_id"), F.col("length").alias("more"))
        longer = jumps.join(ahead, ["to_ord", "to_id"], "left")
        moved = F.col("more").isNotNull()
        new = written(longer.select("snap_ord", "halo_id", F.coalesce("next_ord", "to_ord").alias("to_ord"), F.coalesce("next_id", "to_id").alias("to_id"), (F.col("length") + F.coalesce("more", F.lit(0))).alias("length"), moved.alias("moved")))
        jumps, rounds = new.drop("moved"), rounds + 1
        if new.where("moved").isEmpty():
            break
    if report is not None:
        report["rounds"] = rounds
    roots = groups.where(F.col("snap_ord") == last).select("snap_ord", "halo_id", "npart")
    return roots.join(jumps, ["snap_ord", "halo_id"], "left").select("halo_id", "npart", F.coalesce("length", F.lit(0)).alias("length"))


def trees(groups: DataFrame, prog: DataFrame, least: int = REAL_SIZE) -> DataFrame:
    """(root, snap_ord, halo_id): all progenitors, of any generation, of each real root of the last snapshot with `least` particles."""
    last = groups.agg(F.max("snap_ord")).first()[0]
    roots = groups.where((F.col("snap_ord") == last) & F.col("real") & (F.col("npart") >= least)).select(F.col("halo_id").alias("root"), "snap_ord", "halo_id")
    edges = written(prog.select(F.col("snap_ord").alias("from_ord"), F.col("halo_id").alias("from_id"), (F.col("snap_ord") - 1).alias("snap_ord"), F.col("other_id").alias("halo_id")))
    return reach(groups.sparkSession, roots, edges, ("root",))


#: Roots that share one number of bits.
BITS = 64


def root_bits(groups: DataFrame, prog: DataFrame, least: int = REAL_SIZE) -> DataFrame:
    """(snap_ord, halo_id, word, bits): whose trees a group is in, as bits of the roots' numbers, BITS of them in a word.

    What trees() says with a row for each root and group. Roots are numbered along the smallest descendant-side id of their first progenitor, so
    those that share a past mostly share a word; words pass from a snapshot to the one before and are merged there, one row a group and word.
    """
    first, last = groups.agg(F.min("snap_ord"), F.max("snap_ord")).first()
    links = written(prog.select("snap_ord", "halo_id", "other_id", "rank"))
    roots = groups.where((F.col("snap_ord") == last) & F.col("real") & (F.col("npart") >= least)).select("snap_ord", "halo_id")
    main = links.where("rank = 1").select("snap_ord", "halo_id", "other_id")
    placed = running_sum(roots.join(main, ["snap_ord", "halo_id"], "left"), [], ["other_id", "halo_id"], "number").drop("other_id")
    word, bit = F.floor(F.col("number") / BITS), (F.col("number") % BITS).cast("int")
    front = written(placed.select("snap_ord", "halo_id", word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bits")))
    out = front
    for snap in range(last, first, -1) if first is not None else ():
        step = front.join(links.where(F.col("snap_ord") == snap).drop("rank"), ["snap_ord", "halo_id"])
        front = written(step.groupBy((F.col("snap_ord") - 1).alias("snap_ord"), F.col("other_id").alias("halo_id"), "word").agg(F.bit_or("bits").alias("bits")))
        out = out.unionByName(front)
    return out


def appearances(groups: DataFrame, prog: DataFrame, least: int = REAL_SIZE) -> DataFrame:
    """(n_trees, n_halos): how many groups appear in how many trees."""
    n = root_bits(groups, prog, least).groupBy("snap_ord", "halo_id").agg(F.sum(F.bit_count("bits")).cast("long").alias("n_trees"))
    return n.groupBy("n_trees").agg(F.count("*").alias("n_halos"))


def row_appearances(tree: DataFrame) -> DataFrame:
    """The same from trees()."""
    return tree.groupBy("snap_ord", "halo_id").agg(F.count("*").alias("n_trees")).groupBy("n_trees").agg(F.count("*").alias("n_halos"))


#: A node's key: snapshot and group in one number.
SPAN = 1 << 40


def node(snap: str = "snap_ord", halo: str = "halo_id"):
    return F.col(snap).cast("long") * SPAN + F.col(halo)


def graphs(groups: DataFrame, prog: DataFrame, desc: DataFrame) -> DataFrame:
    """(graph_id, snap_ord, halo_id, npart, real): components over links of both directions; graph_id is the smallest node key."""
    p = prog.select(node().alias("src"), (F.col("snap_ord") - 1).cast("long").alias("o"), "other_id")
    d = desc.select(node().alias("src"), (F.col("snap_ord") + 1).cast("long").alias("o"), "other_id")
    edges = p.unionByName(d).select("src", (F.col("o") * SPAN + F.col("other_id")).alias("dst"))
    c = components(edges)
    g = groups.withColumn("node", node())
    return written(g.join(c, "node", "left").select(F.coalesce("component", "node").alias("graph_id"), "snap_ord", "halo_id", "npart", "real"))


def grown(nodes: DataFrame, names: DataFrame, groups: DataFrame, prog: DataFrame, desc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new nodes, new names): stored graphs after one more snapshot, found from its groups and links alone.

    nodes(snap_ord, halo_id, npart, real, root) are never changed: root is the graph a group was in when it came. names(root, graph_id) says which graph
    that is by now, a row for each graph that ever was. Links with what is stored are contracted onto graphs, so that old links are not looked at again.
    """
    known = nodes.select("snap_ord", "halo_id", "root").join(names, "root").select("snap_ord", "halo_id", "graph_id")
    new = groups.select("snap_ord", "halo_id", "npart", "real").withColumn("node", node())
    ends = lambda links, by: links.select("snap_ord", "halo_id", (F.col("snap_ord") + by).cast(groups.schema["snap_ord"].dataType).alias("to_ord"), F.col("other_id").alias("to_id"))
    backwards = ends(prog, -1)
    forwards = ends(desc, 1).select(F.col("to_ord").alias("snap_ord"), F.col("to_id").alias("halo_id"), F.col("snap_ord").alias("to_ord"), F.col("halo_id").alias("to_id"))
    pairs = backwards.unionByName(forwards).distinct().join(new.select("snap_ord", "halo_id", "node"), ["snap_ord", "halo_id"])
    old = known.withColumnsRenamed({"snap_ord": "to_ord", "halo_id": "to_id"})
    c = written(components(pairs.join(old, ["to_ord", "to_id"]).select(F.col("node").alias("src"), F.col("graph_id").alias("dst"))))
    placed = written(new.join(c, "node", "left").select("snap_ord", "halo_id", "npart", "real", F.coalesce("component", "node").alias("root")))
    moved = names.join(c, F.col("graph_id") == F.col("node"), "left").select("root", F.coalesce("component", "graph_id").alias("graph_id"))
    fresh = placed.select("root").distinct().join(names, "root", "left_anti").withColumn("graph_id", F.col("root"))
    return placed, written(moved.unionByName(fresh))


def rooted(all_graphs: DataFrame) -> DataFrame:
    """Graphs that hold a real group of the last snapshot, all of their nodes."""
    last = all_graphs.agg(F.max("snap_ord")).first()[0]
    roots = all_graphs.where((F.col("snap_ord") == last) & F.col("real")).select("graph_id").distinct()
    return all_graphs.join(roots, "graph_id", "left_semi")


def hosted(all_graphs: DataFrame, subs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Graphs of subgroups that hold a subgroup of a host in one of the hosts' graphs, nodes(snap_ord, halo_id, ...); subs has each one's host_id."""
    seeds = subs.select("snap_ord", "halo_id", "host_id").join(nodes.select("snap_ord", F.col("halo_id").alias("host_id")), ["snap_ord", "host_id"], "left_semi")
    seeded = all_graphs.join(seeds.select("snap_ord", "halo_id"), ["snap_ord", "halo_id"], "left_semi").select("graph_id").distinct()
    return all_graphs.join(seeded, "graph_id", "left_semi")


def host_graphs(sub_nodes: DataFrame, subs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, host_graph, n_subs): in which graphs of hosts the hosts of each graph of subgroups lie, and how many subgroups of it; null for hosts in none."""
    of = sub_nodes.select("graph_id", "snap_ord", "halo_id").join(subs.select("snap_ord", "halo_id", "host_id"), ["snap_ord", "halo_id"])
    h = nodes.select("snap_ord", F.col("halo_id").alias("host_id"), F.col("graph_id").alias("host_graph"))
    return of.join(h, ["snap_ord", "host_id"], "left").groupBy("graph_id", "host_graph").agg(F.count("*").alias("n_subs"))


def numbered(graph: DataFrame) -> DataFrame:
    """graph with node_id: from past to present, larger groups first."""
    return running_sum(graph, ["graph_id"], ["snap_ord", F.desc("npart"), "halo_id"], "node_id")


def forest(tree: DataFrame, groups: DataFrame) -> DataFrame:
    """(root, node_id, snap_ord, halo_id, npart): each tree's groups in the order of a forest file, from the root back, larger ones first."""
    sized = tree.join(groups.select("snap_ord", "halo_id", "npart"), ["snap_ord", "halo_id"])
    return running_sum(sized, ["root"], [F.desc("snap_ord"), F.desc("npart"), "halo_id"], "node_id").select("root", "node_id", "snap_ord", "halo_id", "npart")


def generations(nodes: DataFrame) -> DataFrame:
    """(graph_id, snap_ord, start_index, length) of each graph's generations."""
    return nodes.groupBy("graph_id", "snap_ord").agg(F.min("node_id").alias("start_index"), F.count("*").alias("length"))


def graph_edges(nodes: DataFrame, prog: DataFrame) -> DataFrame:
    """(graph_id, src_node, dst_node, n_shared): from progenitor to descendant."""
    n = nodes.select("graph_id", "snap_ord", "halo_id", "node_id")
    e = prog.select("snap_ord", "halo_id", "other_id", "n_shared").join(n.withColumnRenamed("node_id", "dst_node"), ["snap_ord", "halo_id"])
    before = n.select(F.col("graph_id").alias("g"), (F.col("snap_ord") + 1).alias("snap_ord"), F.col("halo_id").alias("other_id"), F.col("node_id").alias("src_node"))
    return e.join(before, ["snap_ord", "other_id"]).select("graph_id", "src_node", "dst_node", "n_shared")


def summary(graph: DataFrame) -> DataFrame:
    """(graph_id, n_nodes, length in snapshots, root_npart): the largest group of the last snapshot, null if the graph has none there."""
    last = graph.agg(F.max("snap_ord")).first()[0]
    return graph.groupBy("graph_id").agg(F.count("*").alias("n_nodes"), F.countDistinct("snap_ord").alias("length"), F.max(F.when(F.col("snap_ord") == last, F.col("npart"))).alias("root_npart"))


def layout_edges(prog: DataFrame, desc: DataFrame) -> DataFrame:
    """Distinct edges of both directions, from earlier to later, for drawing."""
    p = prog.select((F.col("snap_ord") - 1).alias("from_ord"), F.col("other_id").alias("from_id"), F.col("snap_ord").alias("to_ord"), F.col("halo_id").alias("to_id"))
    d = desc.select(F.col("snap_ord").alias("from_ord"), F.col("halo_id").alias("from_id"), (F.col("snap_ord") + 1).alias("to_ord"), F.col("other_id").alias("to_id"))
    return p.unionByName(d).distinct()


def sub_attachment(subs: DataFrame) -> DataFrame:
    """subs(host_id, halo_id, npart) in the order of their hosts, with each sub's place and its host's start and count."""
    placed = running_sum(subs.select("host_id", "halo_id", "npart"), [], ["host_id", F.desc("npart"), "halo_id"], "sub_index")
    start = placed.groupBy("host_id").agg(F.min("sub_index").alias("start_index"), F.count("*").alias("n_subs"))
    return placed.join(start, "host_id").select("host_id", "halo_id", "npart", "start_index", "n_subs", "sub_index")


def hosts_across_graphs(subs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, n_hosts): of a graph of subgroups, subs(graph_id, snap_ord, host_id), in how many graphs of hosts, nodes(graph_id,
    snap_ord, halo_id), its hosts lie, for those with more than one: there should be none.
    """
    h = nodes.select(F.col("graph_id").alias("host_graph"), "snap_ord", F.col("halo_id").alias("host_id"))
    return subs.join(h, ["snap_ord", "host_id"]).groupBy("graph_id").agg(F.countDistinct("host_graph").alias("n_hosts")).where("n_hosts > 1")


def drawn_nodes(graph: DataFrame, particle_mass: float, least: int = 10_000) -> DataFrame:
    """(graph_id, snap_ord, halo_id, size): nodes for drawing, sized by log10 of their mass, of graphs whose largest group has `least` particles."""
    big = graph.groupBy("graph_id").agg(F.max("npart").alias("m")).where(F.col("m") >= least).select("graph_id")
    return graph.join(big, "graph_id", "left_semi").select("graph_id", "snap_ord", "halo_id", F.log10(F.col("npart") * F.lit(particle_mass)).alias("size"))
