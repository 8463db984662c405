"""Binary snapshots, one-step publication, the two programs, and graphs that grow snapshot by snapshot."""

import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.operators import graph, links
from starloom.plans import programs
from starloom.sources import binary, publish, sinks
from starloom.sources.params import read_params
from starloom.sources.tables import members

SF = "/root/testdata/sf0.001"


def file_bytes(parts, totals, files=1, box=8.0, redshift=0.5, masses=(0, 0, 0, 0, 0, 0), order="<", wide=False, named=False):
    """The bytes of one file: parts maps a species to (ids, places, velocities, masses, energies)."""
    kind, ids = (f"{order}f8", f"{order}u8") if wide else (f"{order}f4", f"{order}u4")
    counts = [len(parts[t][0]) if t in parts else 0 for t in range(6)]
    out = b""

    def block(name, data):
        nonlocal out
        if named:
            out += struct.pack(f"{order}I4sII", 8, name.ljust(4).encode(), len(data) + 8, 8)
        out += struct.pack(f"{order}I", len(data)) + data + struct.pack(f"{order}I", len(data))

    head = struct.pack(order + binary.HEAD, *counts, *map(float, masses), 1 / (1 + redshift), redshift, 0, 0, *totals, 0, files, box, 0.3, 0.7, 0.677, 0, 0, *[0] * 6)
    block("HEAD", head.ljust(256, b"\0"))
    there = [parts[t] for t in sorted(parts)]
    for name, place, k in (("POS", 1, kind), ("VEL", 2, kind), ("ID", 0, ids)):
        block(name, b"".join(np.asarray(p[place]).astype(k).tobytes() for p in there))
    if any(c and not m for c, m in zip(counts, masses, strict=True)):
        block("MASS", b"".join(np.asarray(parts[t][3]).astype(kind).tobytes() for t in sorted(parts) if not masses[t]))
    if counts[0]:
        block("U", np.asarray(parts[0][4]).astype(kind).tobytes())
    return out


def some(rng, n, first):
    return np.arange(first, first + n), rng.random((n, 3)) * 8, rng.normal(0, 1, (n, 3)), rng.integers(1, 5, n).astype(float), rng.random(n)


@pytest.mark.parametrize("order,wide,named", [("<", False, False), (">", True, False), ("<", True, True)])
def test_binary_snapshot(spark, tmp_path, order, wide, named):
    rng = np.random.default_rng(1)
    parts = {0: some(rng, 7, 100), 1: some(rng, 25, 200), 4: some(rng, 3, 900)}
    (tmp_path / "one").write_bytes(file_bytes(parts, [7, 25, 0, 0, 3, 0], masses=(0, 2.5, 0, 0, 0, 0), order=order, wide=wide, named=named))
    path = str(tmp_path / "one")
    head = binary.header(path)
    assert head["box"] == [8.0] * 3 and head["counts"] == {0: 7, 1: 25, 2: 0, 3: 0, 4: 3, 5: 0} and (head["redshift"], head["h"]) == (0.5, 0.677)
    df = binary.read_binary(spark, path, 3, rows=10)
    assert df.rdd.getNumPartitions() == 5
    got = {r.pid: r for r in df.collect()}
    assert len(got) == 35 and {r.snap_ord for r in got.values()} == {3}
    exact = (lambda v: float(v)) if wide else (lambda v: float(np.float32(v)))
    for t, (ids, x, v, m, u) in parts.items():
        for i, pid in enumerate(ids):
            r = got[pid]
            assert (r.part_type, r.x, r.z, r.vy) == (t, exact(x[i, 0]), exact(x[i, 2]), exact(v[i, 1]))
            assert r.mass == (2.5 if t == 1 else exact(m[i])) and r.int_energy == (exact(u[i]) if t == 0 else 0.0)
    thin = binary.read_binary(spark, path, columns=("mass", "pid"))
    assert thin.columns == ["mass", "pid"] and thin.count() == 35


def test_binary_snapshot_of_many_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    totals, files = [0, 30, 0, 0, 0, 0], {}
    for k in range(3):
        files[k] = some(rng, 10, 10 * k)
        (tmp_path / f"snap.{k}").write_bytes(file_bytes({1: files[k]}, totals, 3))
    base = str(tmp_path / "snap")
    assert binary.header(base)["counts"][1] == 30 == binary.header(str(tmp_path))["counts"][1]
    got = binary.read_binary(spark, base).select("pid", "mass").collect()
    assert sorted((r.pid, r.mass) for r in got) == [(10 * k + i, float(files[k][3][i])) for k in range(3) for i in range(10)]
    os.remove(tmp_path / "snap.2")
    with pytest.raises(ValueError, match="20"):
        binary.header(base)
    (tmp_path / "snap.1").write_bytes((tmp_path / "snap.1").read_bytes()[:-6])
    with pytest.raises(ValueError, match="no block"):
        binary.layout(str(tmp_path / "snap.1"))
    with pytest.raises(FileNotFoundError):
        binary.files_of(str(tmp_path / "nothing"))


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_publish_changes_all_tables_or_none(spark, tmp_path):
    path = f"file://{tmp_path}/cat"
    a, b = spark.createDataFrame([(1, 10)], "halo_id long, n long"), spark.createDataFrame([(2, 20), (3, 30)], "halo_id long, n long")
    assert publish.version(spark, path) == (0, {})
    assert publish.publish(spark, path, {"halos": a, "members": b}, 0) == 1
    assert publish.publish(spark, path, {"halos": b}, 1) == 2
    bad = b.withColumn("n", F.expr("if(halo_id = 3, raise_error('lost'), n)"))
    with pytest.raises(Exception, match="lost"):
        publish.publish(spark, path, {"halos": b, "members": bad}, 0)
    assert publish.version(spark, path)[0] == 2
    assert rows(publish.table(spark, path, "halos"), "snap_ord", "halo_id") == [(0, 1), (1, 2), (1, 3)]
    assert rows(publish.table(spark, path, "members", [0]), "halo_id", "n") == [(2, 20), (3, 30)]
    assert len(os.listdir(tmp_path / "cat" / "data")) == 2  # the failed one left nothing
    assert publish.publish(spark, path, {"halos": a, "members": a}, 0) == 3
    assert rows(publish.table(spark, path, "members"), "snap_ord", "n") == [(0, 10)]
    assert publish.vacuum(spark, path) == 1 and rows(publish.table(spark, path, "halos"), "snap_ord", "halo_id") == [(0, 1), (1, 2), (1, 3)]
    with pytest.raises(ValueError):
        publish.table(spark, path, "links")
    (tmp_path / "cat" / "versions" / "00000004.json").write_text(json.dumps({}))
    with pytest.raises(RuntimeError, match="another program"):
        publish._commit(spark, path, 4, {})


def test_write_catalogue(spark, tmp_path):
    path = f"file://{tmp_path}/cat"
    parts = spark.createDataFrame([(i,) for i in range(6)], "pid long")
    hosts = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (4, 4)], "pid long, halo_id long")
    subs = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "pid long, halo_id long, host long")
    mass = spark.createDataFrame([(0, 0, 3.0), (0, 4, 1.0), (1, 1, 2.0)], "level int, halo_id long, mass double")
    sinks.write_catalogue(spark, path, 5, parts, hosts, subs, mass)
    assert rows(publish.table(spark, path, "halos"), "snap_ord", "level", "halo_id", "npart", "start_index", "stride", "mass") == [(5, 0, 0, 3, 0, 3, 3.0), (5, 0, 4, 1, 3, 1, 1.0), (5, 1, 1, 2, 0, 2, 2.0)]
    assert rows(publish.table(spark, path, "members"), "level", "halo_id", "pid", "place") == [(0, 0, 0, 0), (0, 0, 1, 1), (0, 0, 2, 2), (0, 4, 4, 3), (1, 1, 1, 0), (1, 1, 2, 1)]
    assert rows(publish.table(spark, path, "particle_map"), "pid", "halo_id", "sub_id") == [(0, 0, -2), (1, 0, 1), (2, 0, 1), (3, -2, -2), (4, 4, -2), (5, -2, -2)]


PARAMETERS = """
inputs: {{data: "{at}/", basename: snap_, snapList: "{at}/list.txt", haloSavePath: "file://{at}/halos", directgraphSavePath: "file://{at}/links", graphSavePath: "file://{at}/graphs"}}
flags: {{DMO: 1, find_subs: 1, clean_real_flags: 1, graphdirect: 1, subgraphdirect: 1, graph: 1, subgraph: 1}}
parameters: {{part_threshold: 8, llcoeff: 0.2, sub_llcoeff: 0.15, decrement: 0.3, link_threshold: 4}}
simulation: {{data_type: BINARY}}
"""


def test_programs_from_files_to_graphs(spark, tmp_path):
    """Two snapshots of binary files, found, linked, flagged and joined to graphs; what is written is what the plans give."""
    rng = np.random.default_rng(5)
    centre = rng.random((5, 3)) * 6 + 1
    n = 5 * 30
    for k, snap in enumerate(("000", "001")):
        at = np.repeat(centre + 0.05 * k, 30, axis=0) + rng.normal(0, 0.04, (n, 3))
        part = (np.arange(n), at, rng.normal(0, 5, (n, 3)), np.full(n, 50.0), np.zeros(n))
        for f in range(2):
            piece = tuple(c[f::2] for c in part)
            (tmp_path / f"snap_{snap}.{f}").write_bytes(file_bytes({1: piece}, [0, n, 0, 0, 0, 0], 2, redshift=0.5 - 0.5 * k, wide=True))
    (tmp_path / "list.txt").write_text("000\n001\n")
    text = PARAMETERS.format(at=tmp_path)
    p = read_params(text)
    assert [programs.halos(spark, p, k) for k in (0, 1)] == [1, 2]
    halos = publish.table(spark, p.inputs["haloSavePath"], "halos")
    assert halos.where("level = 0").groupBy("snap_ord").count().where("count >= 3").count() == 2
    assert rows(publish.table(spark, p.inputs["haloSavePath"], "snapshots"), "snap_ord", "snap", "redshift", "box_x") == [(0, "000", 0.5, 8.0), (1, "001", 0.0, 8.0)]
    data = programs.read_input(spark, p, "001", 1)
    assert data.particles.count() == n and (data.redshift, data.box) == (0.0, (8.0, 8.0, 8.0))
    stored = publish.table(spark, p.inputs["haloSavePath"], "members")
    assert rows(stored.groupBy("snap_ord", "level", "halo_id").count(), "snap_ord", "level", "halo_id", "count") == rows(halos, "snap_ord", "level", "halo_id", "npart")
    assert rows(stored.groupBy("snap_ord", "level", "halo_id").agg(F.sum("mass").alias("mass")), "snap_ord", "level", "halo_id", "mass") == rows(halos, "snap_ord", "level", "halo_id", "mass")
    for k in (0, 1):
        programs.graphs(spark, p, k)
    every = programs.members_of(spark, p, 0, [0, 1])
    found = publish.table(spark, p.inputs["directgraphSavePath"], "progenitors").where("level = 0")
    assert rows(found, "snap_ord", "halo_id", "other_id", "n_shared", "rank") == rows(links.progenitors(every, 4), "snap_ord", "halo_id", "other_id", "n_shared", "rank") != []
    flags = publish.table(spark, p.inputs["directgraphSavePath"], "flags")
    assert rows(flags.where("level = 0"), "snap_ord", "halo_id", "linked_real") == rows(graph.temporal_flags(halos.where("level = 0"), found), "snap_ord", "halo_id", "linked_real")
    nodes = publish.table(spark, p.inputs["graphSavePath"], "nodes")
    assert nodes.where("level = 0").count() >= 6 and publish.table(spark, p.inputs["graphSavePath"], "edges").where("level = 0").count() >= 3
    if nodes.where("level = 1").count():
        assert publish.table(spark, p.inputs["graphSavePath"], "host_graphs").groupBy("graph_id").count().where("count > 1").count() == 0


def test_graphs_that_grow(spark):
    """After each of seven snapshots the stored graphs are those of a full run over what has come so far."""
    m = members(spark, "/root/testdata/sf0.01").persist()
    g = links.halos(m).withColumn("real", F.col("halo_id") % 3 != 0).persist()
    p, d = links.progenitors(m).persist(), links.descendants(m).persist()
    snaps = sorted(r[0] for r in g.select("snap_ord").distinct().collect())
    nodes = spark.createDataFrame([], "snap_ord int, halo_id long, npart long, real boolean, root long")
    names = spark.createDataFrame([], "root long, graph_id long")
    for s in snaps:
        new, names = graph.grown(nodes, names, g.where(F.col("snap_ord") == s), p.where(F.col("snap_ord") == s), d.where(F.col("snap_ord") == s - 1))
        nodes = nodes.unionByName(new)
        so_far = F.col("snap_ord") <= s
        want = graph.graphs(g.where(so_far), p.where(so_far), d.where(F.col("snap_ord") < s))
        assert rows(nodes.join(names, "root"), "graph_id", "snap_ord", "halo_id") == rows(want, "graph_id", "snap_ord", "halo_id")
    assert len(snaps) == 7 and names.where("root <> graph_id").count() > 0


def test_root_bits_are_the_trees(spark):
    m = members(spark, SF).persist()
    g, p = links.halos(m).withColumn("real", F.lit(True)).persist(), links.progenitors(m, 2).persist()
    bits = graph.root_bits(g, p, 1)
    n = bits.groupBy("snap_ord", "halo_id").agg(F.sum(F.bit_count("bits")).alias("n"))
    want = graph.trees(g, p, 1).groupBy("snap_ord", "halo_id").agg(F.count("*").alias("n"))
    assert rows(n, "snap_ord", "halo_id", "n") == rows(want, "snap_ord", "halo_id", "n") and want.where("n > 3").count()
    many = spark.createDataFrame([(1, i, 30, True) for i in range(150)] + [(0, 0, 9, True)], "snap_ord int, halo_id long, npart long, real boolean")
    link = spark.createDataFrame([(1, i, 0, 1, 9) for i in range(0, 150)], "snap_ord int, halo_id long, other_id long, rank int, n_shared long")
    assert rows(graph.appearances(many, link), "n_trees", "n_halos") == [(1, 150), (150, 1)] == rows(graph.row_appearances(graph.trees(many, link)), "n_trees", "n_halos")


def test_branches_by_doubling_jumps(spark):
    """62 snapshots take as many rounds as the logarithm of the longest branch."""
    chain = [(s, 1, 1, 1) for s in range(1, 62)] + [(s, 2, 2, 1) for s in range(40, 62)] + [(61, 3, 2, 1), (30, 2, 2, 1)]
    p = spark.createDataFrame(chain, "snap_ord int, halo_id long, other_id long, rank int")
    g = spark.createDataFrame([(s, h, 10 * h) for s in range(62) for h in (1, 2, 3, 4)], "snap_ord int, halo_id long, npart long")
    report = {}
    assert rows(graph.main_branches(g, p, report), "halo_id", "npart", "length") == [(1, 10, 61), (2, 20, 22), (3, 30, 22), (4, 40, 0)]
    assert report["rounds"] <= 7
    assert rows(graph.main_branches(g, p.limit(0)), "halo_id", "length") == [(h, 0) for h in (1, 2, 3, 4)]


