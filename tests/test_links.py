"""Links, flags and graphs on small random histories against plain Python."""

import math
import random

import pytest

from starloom.functions import cosmology
from starloom.operators import graph, links, split
from starloom.plans.pipeline import find_groups, trace
from starloom.sources.params import read_params, snapshot
from starloom.sources.sinks import write_snapshots
from starloom.streaming.ingest import keep_links

MEMBERS = "snap_ord int, halo_id long, pid long, part_type int, mass double"


def history(seed, snaps=5, particles=120, groups=8):
    rng = random.Random(seed)
    rows, at = [], {p: rng.randrange(groups) for p in range(particles)}
    for s in range(snaps):
        for p in at:
            if rng.random() < 0.3:
                at[p] = rng.randrange(groups)
            if rng.random() < 0.9:
                rows.append((s, at[p], p, rng.choice([0, 1, 4]), float(rng.randint(1, 5))))
    return rows


def sweep(rows, prog, real):
    """The forward rule, snapshot by snapshot."""
    size, out = {}, {}
    for s, h, *_ in rows:
        size[s, h] = size.get((s, h), 0) + 1
    for s, h in sorted(size):
        kept = [o for o in prog.get((s, h), []) if out[s - 1, o]]
        out[s, h] = True if kept else False if size[s, h] < 20 else real(s, h)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_flags_follow_the_sweep(spark, seed):
    rows = history(seed)
    m = spark.createDataFrame(rows, MEMBERS)
    p = links.progenitors(m, 5)
    g = links.halos(m).selectExpr("*", "halo_id % 3 <> 0 AS real")
    prog = {}
    for r in p.collect():
        prog.setdefault((r.snap_ord, r.halo_id), []).append(r.other_id)
    want = sweep(rows, prog, lambda s, h: h % 3 != 0)
    got = {(r.snap_ord, r.halo_id): r.linked_real for r in graph.temporal_flags(g, p).collect()}
    assert got == want


def test_links_are_symmetric_and_unique(spark):
    m = spark.createDataFrame(history(9), MEMBERS)
    p, d = links.progenitors(m, 3), links.descendants(m, 3)
    assert links.symmetry(p, d).first()["n_violations"] == 0
    assert p.count() == p.select("snap_ord", "halo_id", "other_id").distinct().count()


def test_self_links(spark):
    m = spark.createDataFrame(history(3), MEMBERS)
    first = links.self_links(m, 1).where("rank = 1")
    g = links.halos(m)
    assert first.join(g, ["snap_ord", "halo_id"]).where("other_id <> halo_id OR n_shared <> npart").count() == 0
    assert first.count() == g.count()


def test_gap_in_snapshots_is_no_link(spark):
    m = spark.createDataFrame([(0, 1, p, 1, 1.0) for p in range(12)] + [(2, 1, p, 1, 1.0) for p in range(12)], MEMBERS)
    assert links.progenitors(m).count() == 0
    counts = {r.snap_ord: (r.n_progs, r.n_descs) for r in links.link_counts(links.halos(m), links.progenitors(m), links.descendants(m)).collect()}
    assert counts == {0: (None, 0), 2: (0, None)}


def test_trace(spark):
    m = spark.createDataFrame(history(5), MEMBERS)
    g = links.halos(m).selectExpr("*", "true AS real")
    t = trace(m, g, 4)
    nodes = t.nodes.collect()
    assert {r.graph_id for r in nodes}
    for gid in {r.graph_id for r in nodes}:
        mine = sorted((r.snap_ord, -r.npart, r.halo_id, r.node_id) for r in nodes if r.graph_id == gid)
        assert [r[3] for r in mine] == list(range(len(mine)))
    assert t.edges.where("src_node >= dst_node").count() == 0


def test_fragments_share_out_all_mass(spark):
    rows = [(0, 1, p, 1, 1.0) for p in range(30)] + [(1, 1 if p < 18 else 2, p, 1, 1.0) for p in range(28)]
    m = spark.createDataFrame(rows, MEMBERS)
    f = {r.desc_id: (r.n_shared, r.fragment_mass, r.main) for r in split.fragments(m).collect()}
    assert f == {1: (18, 18 + 2 * 18 / 28, True), 2: (10, 10 + 2 * 10 / 28, False)}
    back = split.split_back(m).where("snap_ord = 0").groupBy("halo_id").count().collect()
    assert sorted((r["halo_id"], r["count"]) for r in back) == [(0, 18), (18, 10)]


def walked_back(rows, threshold):
    """Splitting by plain sets, from the last snapshot backwards: {(snap, pid): (original id, new id)}; and the groups with one descendant that keep more than it has."""
    groups, out, whole = {}, {}, 0
    for s, h, p, *_ in rows:
        groups.setdefault(s, {}).setdefault(h, set()).add(p)
    after = {}
    for s in sorted(groups, reverse=True):
        now = {}
        for h, pids in groups[s].items():
            descs = {}
            for p in pids & after.keys():
                descs.setdefault(after[p], set()).add(p)
            parts = [d for d in descs.values() if len(d) >= threshold]
            if s == max(groups):
                now |= dict.fromkeys(pids, h)
            elif len(parts) == 1:
                whole += parts[0] != pids
                now |= dict.fromkeys(pids, min(pids))
            else:
                for d in parts:
                    now |= dict.fromkeys(d, min(d))
            out |= {(s, p): (h, now[p]) for p in pids if p in now}
        after = now
    return out, whole


def walked_with_energies(rows, real, box, soft, mass, g, threshold, glue):
    """The splitter with energies and glueing by plain loops: {(snap, pid): new id}, {(snap, new id): catalogue row}."""
    import numpy as np

    groups, at = {}, {}
    for s, h, p, *phase in rows:
        groups.setdefault(s, {}).setdefault(h, set()).add(p)
        at[s, p] = np.array(phase)

    def energy(s, pids):
        x = np.array([at[s, p] for p in sorted(pids)])
        pos = np.where(x[:, :3].max(0) - x[:, :3] > box / 2, x[:, :3] + box, x[:, :3])
        ke = 0.5 * mass * len(x) * x[:, 3:].var(axis=0).sum()
        ge = sum(1 / np.sqrt(((pos[i] - pos[j]) ** 2).sum() + soft**2) for i in range(len(x)) for j in range(i)) * g * mass**2
        return ke, ge, ke - ge

    def extent(s, pids):
        x = np.array([at[s, p] for p in sorted(pids)])
        x[:, :3] = np.where(x[:, :3].max(0) - x[:, :3] > box / 2, x[:, :3] + box, x[:, :3])
        m = x.mean(0)
        return m, np.sqrt(5 / 3 * ((x - m)[:, :3] ** 2).sum(1).mean()), np.sqrt(5 / 3 * ((x - m)[:, 3:] ** 2).sum(1).mean())

    out, cat, after, stuck = {}, {}, {}, 0
    for s in sorted(groups, reverse=True):
        now = {}
        for h, pids in groups[s].items():
            if s == max(groups):
                now |= dict.fromkeys(pids, h)
                continue
            descs = {}
            for p in pids & after.keys():
                descs.setdefault(after[p], set()).add(p)
            parts = [d for d in descs.values() if len(d) >= threshold]
            took = sum(map(len, parts))
            if len(parts) == 1:
                now |= dict.fromkeys(pids, min(pids))
                cat[s, min(pids)] = (h, len(pids), len(parts[0]), 1, energy(s, parts[0])[2], real(s, h))
            elif parts:
                parts.sort(key=lambda d: (-len(d), min(d)))
                main, rest = parts[0], []
                e_main, (m, r, v) = energy(s, main)[2], extent(s, main)
                joined = set(main)
                for d in parts[1:]:
                    m2, r2, v2 = extent(s, d)
                    gap = np.abs(m - m2)[:3]
                    off = np.sqrt((np.minimum(gap, box - gap) ** 2).sum()) / (r + r2) + np.sqrt(((m - m2)[3:] ** 2).sum()) / (v + v2)
                    if glue and (e_main > 0 or energy(s, d)[2] > 0) and off < 0.85:
                        joined |= d
                    else:
                        rest.append(d)
                stuck += joined != main
                for d in [joined, *rest]:
                    now |= dict.fromkeys(d, min(d))
                    e = energy(s, d)[2]
                    cat[s, min(d)] = (h, len(d) + (len(pids) - took) * len(d) / took, len(d), 1 + len(rest), e, e <= 0)
        out |= {(s, p): i for p, i in now.items()}
        after = now
    return out, cat, stuck


@pytest.mark.parametrize("g,glue", [(0.002, True), (0.02, True), (0.002, False)])
def test_split_walk_with_energies(spark, g, glue):
    rng = random.Random(11)
    rows = [(s, h, p, *(rng.gauss(h / 8, 0.05) % 1.0 for _ in range(3)), *(rng.gauss(0, 0.2) for _ in range(3))) for s, h, p, *_ in history(4, snaps=3)]
    m = spark.createDataFrame(rows, "snap_ord int, halo_id long, pid long, x double, y double, z double, vx double, vy double, vz double")
    groups = m.select("snap_ord", "halo_id").distinct().selectExpr("*", "halo_id % 2 = 0 AS real")
    got, cat = split.split_walk(m, groups, 1.0, 0.02, 1.5, g=g, threshold=2, glue=glue)
    want, rows_, stuck = walked_with_energies(rows, lambda s, h: h % 2 == 0, 1.0, 0.02, 1.5, g, 2, glue)
    assert {(r.snap_ord, r.pid): r.halo_id for r in got.collect()} == want
    found = {(r.snap_ord, r.halo_id): (r.original_id, r.npart, r.n_persist, r.split, r.e, r.real) for r in cat.collect()}
    assert found.keys() == rows_.keys() and len(found) > 10
    for k, (h, n, persist, count, e, real) in rows_.items():
        assert found[k][0] == h and found[k][2:4] == (persist, count) and found[k][5] == real
        assert found[k][1] == pytest.approx(n) and found[k][4] == pytest.approx(e, abs=1e-9)
    assert bool(stuck) == (glue and g < 0.01)


@pytest.mark.parametrize("seed, threshold", [(1, 10), (2, 8), (3, 3)])
def test_split_back_follows_the_walk(spark, seed, threshold):
    rows = history(seed)
    want, whole = walked_back(rows, threshold)
    got = split.split_back(spark.createDataFrame(rows, MEMBERS), threshold).collect()
    assert {(r.snap_ord, r.pid): (r.original_id, r.halo_id) for r in got} == want and len(got) == len(want)
    assert whole or threshold < 8


def chained(rows, real, threshold, least):
    """The older writer, group by group, snapshot by snapshot, with flags written back: {(snap, group): (real progenitors, descendant, state)}."""
    groups = {}
    for s, h, p, *_ in rows:
        groups.setdefault((s, h), set()).add(p)
    flag = {k: real(*k) for k in groups}
    first, last = min(s for s, _ in groups), max(s for s, _ in groups)
    out = {}
    for s, h in sorted(groups):
        if not flag[s, h] or len(groups[s, h]) < least:
            continue

        def others(t):
            n = {o: len(groups[s, h] & groups[u, o]) for u, o in groups if u == t and len(groups[u, o]) >= least}  # noqa: B023
            return {o: m for o, m in n.items() if m >= threshold}

        nprog = -1 if s == first else sum(flag[s - 1, o] for o in others(s - 1))
        after = others(s + 1)
        ndesc = -1 if s == last else min(1, len(after))
        desc = min(after, key=lambda o: (-after[o], o)) if after else None
        state = "unlinked" if nprog == ndesc and nprog in (-1, 0) else "small" if nprog == 0 and len(groups[s, h]) < links.REAL_SIZE else "kept"
        flag[s, h] = state == "kept"
        if state == "kept" and desc is not None:
            flag[s + 1, desc] = True
        out[s, h] = (None if nprog < 0 else nprog, desc, state)
    return out


@pytest.mark.parametrize("seed, threshold, least", [(1, 5, 10), (4, 8, 10), (6, 10, 14)])
def test_legacy_flags_are_carried_on(spark, seed, threshold, least):
    rows = history(seed, snaps=6, particles=130)
    m = spark.createDataFrame(rows, MEMBERS)
    g = links.halos(m).selectExpr("*", "(halo_id + snap_ord) % 3 = 0 AS real")
    got = links.legacy_chain(g, links.progenitors(m, threshold), links.descendants(m, threshold), least).collect()
    want = chained(rows, lambda s, h: (h + s) % 3 == 0, threshold, least)
    assert {(r.snap_ord, r.halo_id): (r.n_real_progs, r.desc_id, r.state) for r in got} == want and len(got) == len(want)
    assert any((h + s) % 3 for s, h in want)  # real by a progenitor only
    assert {v[2] for v in want.values()} > {"kept"}


@pytest.mark.parametrize("threshold, least", [(3, 15), (5, 10)])
def test_legacy_links_by_size_and_flag(spark, threshold, least):
    rows = history(8)
    m = spark.createDataFrame(rows, MEMBERS)
    g = links.halos(m).selectExpr("*", "(halo_id + snap_ord) % 3 <> 0 AS real")
    groups = {}
    for s, h, p, *_ in rows:
        groups.setdefault((s, h), set()).add(p)
    large = {k for k in groups if len(groups[k]) >= least}
    real = {(s, h) for s, h in large if (s + h) % 3}
    n = {(s, h, t, o): len(groups[s, h] & groups[t, o]) for s, h in real for t, o in large if abs(s - t) == 1}
    prog, desc = {}, {}
    for (s, h, t, o), shared in n.items():
        if shared >= threshold and (t > s or (t, o) in real):
            (desc if t > s else prog).setdefault((s, h), []).append((-shared, o))
    want = {(s, h, o, k + 1, -c) for (s, h), others in prog.items() for k, (c, o) in enumerate(sorted(others))}
    cols = ["snap_ord", "halo_id", "other_id", "rank", "n_shared"]
    assert {tuple(r) for r in links.real_progenitors(m, g, threshold, least).select(*cols).collect()} == want
    best = {(s, h, min(others)[1], -min(others)[0]) for (s, h), others in desc.items()}
    got = links.main_descendants(m, g, threshold, least).select("snap_ord", "halo_id", "other_id", "n_shared").collect()
    assert {tuple(r) for r in got} == best and want and best


def test_parameters_and_cosmology():
    p = read_params("parameters:\n  link_threshold: 7\nflags:\n  DMO: 0\n")
    assert p.parameters["link_threshold"] == 7 and p.parameters["part_threshold"] == 10
    s = snapshot(p, 1.0, (100.0, 100.0, 100.0), {0: 500, 1: 1000, 2: 9, 4: 500})
    assert set(s.counts) == {0, 1, 4}
    assert s.mean_separation[1] == pytest.approx(10.0) and s.mean_separation[0] == pytest.approx(10.0)
    assert s.linking[1] == pytest.approx(2.0) and s.sub_velocity_factor == pytest.approx(s.velocity_factor * 2**0.5)
    assert s.softening == pytest.approx(0.004222 * 2)
    c = p.cosmology
    assert cosmology.age(0.0, c) == pytest.approx(13.93, abs=0.05)
    flat = c | {"Tcmb0": 0.0, "Om0": 1.0}
    assert cosmology.age(0.0, flat) == pytest.approx(2 / 3 / (67.7 / cosmology.MPC_KM) / cosmology.YEAR_S / 1e9, rel=1e-6)
    assert cosmology.hubble(0.0, c) == pytest.approx(67.7)


def test_find_groups(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = []
    for k, centre in enumerate((0.02, 0.5)):
        for i in range(40):
            x = (rng.normal(0, 0.01, 3) + centre) % 1.0
            rows.append((100 * k + i, *map(float, x), *map(float, rng.normal(0, 0.01, 3)), 1.0, 1))
    p = spark.createDataFrame(rows, "pid long, x double, y double, z double, vx double, vy double, vz double, mass double, part_type int")
    c = find_groups(p, 1.0, 0.06, 0.2, 0.01, 1.0, sub_linking=0.05)
    assert c.groups.count() == 2
    assert c.groups.where("real").count() == 2
    assert c.sub_groups.count() >= 1


def test_stream_keeps_links(spark, tmp_path):
    rows = history(2)
    at = str(tmp_path / "in")
    m = spark.createDataFrame(rows, MEMBERS)
    for s in range(5):
        m.where(f"snap_ord = {s}").coalesce(1).write.mode("append").parquet(at)
    stream = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(at)
    keep_links(spark, stream, str(tmp_path / "m"), str(tmp_path / "l"), str(tmp_path / "c"), 4).awaitTermination()
    cols = ["snap_ord", "halo_id", "other_id", "rank", "n_shared"]
    got = spark.read.parquet(str(tmp_path / "l")).select(*cols)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, links.progenitors(m, 4).select(*cols).collect()))


def test_snapshot_partitions_are_replaced(spark, tmp_path):
    at = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "snap_ord int, v string")
    write_snapshots(df, at)
    write_snapshots(spark.createDataFrame([(2, "c")], "snap_ord int, v string"), at)
    assert sorted((r.snap_ord, r.v) for r in spark.read.parquet(at).collect()) == [(1, "a"), (2, "c")]


@pytest.mark.parametrize("speed,periodic", [(0.02, True), (0.4, True), (0.02, False)])
def test_links_within_the_sweep_of_speeds(spark, speed, periodic):
    """Groups that drift keep all links when only those within reach are looked at, and fewer members are read."""
    rng = random.Random(21)
    rows, means = [], []
    for h in range(40):
        x, v = [rng.random() for _ in range(3)], [rng.uniform(-1, 1) * speed for _ in range(3)]
        if not periodic:
            x = [0.3 + 0.4 * c for c in x]
        for s in range(3):
            alone = h >= 30 and s != h % 3  # here in one snapshot only
            if not alone:
                rows += [(s, h + 100 * s, 1000 * h + i, 1, 1.0) for i in range(12)]
                means.append((s, h + 100 * s, *(c + s * d for c, d in zip(x, v, strict=True)), *v))
    m = spark.createDataFrame(rows, MEMBERS)
    g = spark.createDataFrame(means, "snap_ord int, halo_id long, mean_x double, mean_y double, mean_z double, mean_vx double, mean_vy double, mean_vz double")
    times = spark.createDataFrame([(s, 1.0) for s in (1, 2)], "snap_ord int, since double")
    radii = links.sweep(g, times, least=0.01)
    top = max(math.dist(r[5:], (0, 0, 0)) for r in means)
    assert all(0.01 <= r.radius <= top * (1 + 1e-6) for r in radii.collect())
    near = links.within_sweep(g, radii, 1.0, periodic)
    by, want = {r.snap_ord: r.radius for r in radii.collect()}, set()
    for a in means:
        for b in means:
            if a[0] == b[0] + 1:
                d = [abs(p % 1.0 - q % 1.0) if periodic else abs(p - q) for p, q in zip(a[2:5], b[2:5], strict=True)]
                if math.sqrt(sum(min(x, 1 - x) ** 2 if periodic else x * x for x in d)) <= by[a[0]]:
                    want.add((a[0], a[1], b[1]))
    got = [(r.snap_ord, r.halo_id, r.other_id) for r in near.collect()]
    assert set(got) == want and len(got) == len(want)
    key = lambda df: sorted((r.snap_ord, r.halo_id, r.other_id, r["rank"], r.n_shared) for r in df.collect())
    assert key(links.progenitors_within(m, near)) == key(links.progenitors(m)) != []
