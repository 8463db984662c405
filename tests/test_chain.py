"""The whole finder, with expansion, subgroups and two species in a box of three sides, against a plain version of the same chain."""

import math

import numpy as np
import pytest

from starloom.functions import cosmology as cosmo
from starloom.operators import properties
from starloom.plans import pipeline
from starloom.sources.params import read_params, snapshot
from tests.test_groups import COLUMNS, brute, distance2, partition, plain_refine

BOX = (8.0, 5.0, 6.0)
HUBBLE = 0.4
LINK, SUB, GAS = 0.22, 0.12, 0.25
FACTOR, SOFT, VF = 3e-4, 0.01, 0.18
STEPS = (10.0, 0.8, 0.15, 6)


def clumps(seed, n=26, gas=False):
    """Groups on the border and inside, some of two clumps with velocities of their own, and particles alone."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        centre = rng.random(3) * BOX
        for part in range(1 + c % 2):
            size = int(rng.integers(12, 26))
            place = centre + (part * 0.15 if c % 4 == 1 else 0.0) + rng.normal(0, 0.06, (size, 3))
            speed = rng.normal(0, 0.15 if c % 3 else 1.5, (size, 3)) + part * 4.0
            rows += [(len(rows) + i, *map(float, place[i] % BOX), *map(float, speed[i]), float(rng.integers(1, 4)), int(rng.random() < 0.7) if gas else 1) for i in range(size)]
    lone = rng.random((60, 3)) * BOX
    return rows + [(5000 + i, *map(float, p), 0.0, 0.0, 0.0, 1.0, 1) for i, p in enumerate(lone)]


def flowed(rows):
    return [(*r[:4], *(r[4 + i] + HUBBLE * (r[1 + i] - BOX[i] / 2) for i in range(3)), *r[7:]) for r in rows]


def gathered(rows, label):
    out = {}
    for r in rows:
        if label.get(r[0]) is not None:
            out.setdefault(label[r[0]], []).append(r)
    return out


def wrapped(group):
    far = [max(r[i] for r in group) for i in (1, 2, 3)]
    return [(r[0], *(r[i] + BOX[i - 1] if far[i - 1] - r[i] > BOX[i - 1] / 2 else r[i] for i in (1, 2, 3)), *r[4:]) for r in group]


def plain_joint(rows):
    dark, gas = [r for r in rows if r[8] == 1], [r for r in rows if r[8] != 1]
    one, two = brute(dark, LINK, BOX, True), brute(gas, GAS, BOX, True)
    edges = [*one.items(), *two.items()]
    for mine, label, others, radius in ((dark, one, gas, LINK), (gas, two, dark, GAS)):
        for a in mine:
            if a[0] in label:
                d, b = min((distance2(a, o, BOX, True), o[0]) for o in others)
                if d < radius**2:
                    edges.append((a[0], b))
    return partition(edges, {x for e in edges for x in e})


def plain_chain(rows, joint=False):
    rows = flowed(rows)
    label = plain_joint(rows) if joint else brute(rows, LINK, BOX, True)
    hosts, subs = {}, {}
    for group in gathered(rows, label).values():
        if len(group) < STEPS[3]:
            continue
        group = wrapped(group)
        for pids, real in plain_refine(group, max(LINK, GAS) if joint else LINK, VF, SOFT, FACTOR, *STEPS):
            hosts[pids] = real
            inside = [r for r in group if r[0] in pids]
            for sub in gathered(inside, brute(inside, SUB, 1.0, False)).values():
                if len(sub) >= STEPS[3]:
                    for found, sub_real in plain_refine(sub, SUB, VF * math.sqrt(LINK / SUB), SOFT, FACTOR, *STEPS):
                        subs[found] = (sub_real, min(pids))
    return hosts, subs


def sets(members):
    out = {}
    for r in members.select("halo_id", "pid").collect():
        out.setdefault(r.halo_id, set()).add(r.pid)
    return {min(v): frozenset(v) for v in out.values()}


def find(spark, rows, **more):
    return pipeline.find_groups(spark.createDataFrame(rows, COLUMNS), BOX, LINK, VF, SOFT, FACTOR, 4.3, STEPS[3], True, *STEPS[:3], hubble=HUBBLE, **more)


def test_hosts_and_subgroups(spark):
    rows = clumps(1)
    hosts, subs = plain_chain(rows)
    got = find(spark, rows, sub_linking=SUB)
    members, sub_members = sets(got.members), sets(got.sub_members)
    catalogue = {r.halo_id: r for r in got.groups.collect()}
    assert {members[k]: r.real for k, r in catalogue.items()} == hosts and len(hosts) >= 20 and len(set(hosts.values())) == 2
    sub_catalogue = {r.halo_id: r for r in got.sub_groups.collect()}
    assert {sub_members[k]: r.real for k, r in sub_catalogue.items()} == {k: v[0] for k, v in subs.items()} and len(subs) > 10
    without = {k for k in plain_chain([(*r[:4], *(r[4 + i] - HUBBLE * (r[1 + i] - BOX[i] / 2) for i in range(3)), *r[7:]) for r in rows])[0]}
    assert without != set(hosts)  # the expansion matters here
    by = {r[0]: r for r in flowed(rows)}
    for k, r in catalogue.items():
        g = sorted(wrapped([by[p] for p in members[k]]))
        x, v, m = (np.array([[*q[a:b]] for q in g]) for a, b in ((1, 4), (4, 7), (7, 8)))
        m = m[:, 0]
        mean, mean_v = (m[:, None] * x).sum(0) / m.sum(), (m[:, None] * v).sum(0) / m.sum()
        x, v = x - mean, v - mean_v
        radius = np.sqrt((x * x).sum(1))
        order = np.lexsort((np.arange(len(g)), radius))
        within = np.cumsum(m[order])
        ge = FACTOR * sum(m[i] / math.sqrt(((x[i] - x[j]) ** 2).sum() + SOFT**2) for i in range(len(g)) for j in range(i + 1, len(g)))
        want = {"npart": len(g), "mass": m.sum(), "mean_x": mean[0], "mean_vz": mean_v[2], "ke": 0.5 * (v * v).sum(), "ge": ge, "rms_r": math.sqrt((radius**2).mean()), "disp_vy": v[:, 1].std(), "vmax": (4.3 * within / radius[order]).max(), "half_mass_r": radius[order][np.abs(within - m.sum() / 2).argmin()]}
        for name, value in want.items():
            assert math.isclose(r[name], value, rel_tol=1e-7), (k, name, r[name], value)


def test_joint_species(spark):
    rows = clumps(2, 20, gas=True)
    hosts, _ = plain_chain(rows, joint=True)
    got = find(spark, rows, baryon_linking=GAS)
    members = sets(got.members)
    assert {members[r.halo_id]: r.real for r in got.groups.collect()} == hosts and len(hosts) >= 15


def test_finder_from_a_parameter_file(spark):
    """All lengths and factors come from the snapshot's scalars."""
    p = read_params("flags:\n  DMO: 1\n  find_subs: 1\nparameters:\n  llcoeff: 0.35\n  sub_llcoeff: 0.2\n  part_threshold: 6\n  decrement: 0.15\n")
    rows = [(*r[:4], *(300 * s for s in r[4:7]), r[7] * 10, r[8]) for r in clumps(3, 12)]
    df = spark.createDataFrame([*rows, (9000, 0.1, 0.1, 0.1, 0.0, 0.0, 0.0, 1.0, 2)], COLUMNS)
    snap = snapshot(p, 0.5, BOX, {1: len(rows)})
    got = pipeline.find_in_snapshot(df, p, 0.5, BOX)
    factor = cosmo.G_KM * 1.5 * 1e10 / 3.086e19
    same = pipeline.find_groups(spark.createDataFrame(rows, COLUMNS), BOX, snap.linking[1], snap.velocity_factor, snap.softening, factor, cosmo.G_KM, 6, True, 10.0, 0.8, 0.15, snap.sub_linking[1], None, hubble=cosmo.hubble(0.5, p.cosmology))
    assert math.isclose(snap.sub_velocity_factor, snap.velocity_factor * math.sqrt(0.35 / 0.2))
    assert sets(got.members) == sets(same.members) != {} and sets(got.sub_members) == sets(same.sub_members)


@pytest.mark.parametrize("share", [0.9])
def test_a_group_with_most_rows_is_in_no_single_task(spark, share):
    """Wrapping, centring and radii of a table of which one group holds nine rows in ten: same numbers as on its own."""
    rng = np.random.default_rng(4)
    n = 4000
    rows = [(0 if i < share * n else 1 + i % 40, i, *map(float, rng.random(6)), 1.0, 1) for i in range(n)]
    df = spark.createDataFrame(rows, "halo_id long, " + COLUMNS)
    c = properties.by_radius(properties.centred(properties.wrapped(df, 1.0)))
    dealt = [r["count"] for r in c.where("halo_id = 0").selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()]
    assert len(dealt) > 1
    one = {r.halo_id: (round(r.half_mass_r, 9), round(r.vmax, 6)) for r in properties.half_mass_radius(properties.centred(df)).join(properties.vmax(properties.centred(df), 4.3), "halo_id").collect()}
    m = np.array([r[2:5] for r in rows if r[0] == 0])
    radius = np.sort(np.sqrt(((m - m.mean(0)) ** 2).sum(1)))
    within = np.arange(1, len(radius) + 1)
    assert one[0] == (round(radius[np.abs(within - len(radius) / 2).argmin()], 9), round((4.3 * within / radius).max(), 6)) and len(one) == 41
