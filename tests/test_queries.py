"""Every query that has SQL gives the rows that DuckDB gives for it."""

import os
import random

import duckdb
import pytest

from starloom.operators import components, graph, phase, spatial, stats
from starloom.plans import queries
from starloom.plans.queries import QUERIES, SQL

real = components.components

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module", autouse=True)
def grouped_once():
    """Groups that many queries start from are made once; fof_groups and others make their own."""
    real_one, known = queries.grouped, {}

    def once(spark, sf_dir, *more):
        if (sf_dir, more) not in known:
            known[sf_dir, more] = components.written(real_one(spark, sf_dir, *more))
        return known[sf_dir, more]

    queries.grouped = once
    yield
    queries.grouped = real_one


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, db, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    mine = sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)
    q = db.execute(SQL[name])
    there = [d[0] for d in q.description]
    assert sorted(there) == names
    place = [there.index(c) for c in names]
    assert mine == sorted((tuple(r[i] for i in place) for r in q.fetchall()), key=str)


#: Queries that SQL can't express, their keys, and where a brute-force version tests them.
WITHOUT_SQL = {
    "exit_alpha_refined": ["real", "bin"],
    "phase_space_refine": ["halo_id", "pid"],  # tests/test_groups.py
    "halo_catalogue": ["halo_id"],  # tests/test_groups.py, test_links.py
    "sub_catalogue": ["halo_id"],
    "joint_catalogue": ["halo_id"],
    "split_catalogue": ["snap_ord", "halo_id"],  # tests/test_links.py
}


def test_every_query_without_sql(spark):
    """They are the ones listed; each has rows with keys that are unique and never null."""
    assert set(QUERIES) - set(SQL) == set(WITHOUT_SQL)
    for name, keys in WITHOUT_SQL.items():
        found = [tuple(r[k] for k in keys) for r in QUERIES[name](spark, "/root/testdata/sf0.01").collect()]
        assert found and len(set(found)) == len(found) and all(v is not None for f in found for v in f), name


@pytest.mark.parametrize("name", ["fof_groups", "fof_within_group", "joint_species_groups", "merger_graph_components", "phase_space_step"])
def test_distributed_components_give_the_same(spark, db, monkeypatch, name):
    """The rounds of large-star and small-star, which few edges never reach otherwise."""
    for module in (components, graph, phase, spatial):
        if hasattr(module, "components") and callable(module.components):
            monkeypatch.setattr(module, "components", lambda e: real(e, few=0))
    monkeypatch.setattr(components, "components", real)
    test_same_rows(spark, db, name)


@pytest.mark.parametrize("counts", [[25, 25, 25], [0, 0, None], [1], [0, 3, 4, 4]])
def test_bins_of_equal_counts(spark, counts):
    """Where all counts are one the bins have no width; the bin and edges are those of the query's SQL."""
    sql = SQL["progenitor_bins"]
    c = duckdb.connect()
    c.execute("CREATE TABLE cnt (n_progs BIGINT)")
    c.executemany("INSERT INTO cnt VALUES (?)", [(n,) for n in counts])
    there = c.execute("WITH b AS" + sql.split(", b AS")[-1]).fetchall()
    df = stats.equal_bins(spark.createDataFrame([(n,) for n in counts], "n_progs long"), "n_progs")
    mine = [tuple(r) for r in queries.rounded(df, "low", "high").collect()]
    assert sorted(map(str, mine)) == sorted(map(str, there))  # NaN equals itself only as text


EDGES = ["cross_species_neighbours", "joint_species_groups", "fof_groups", "particle_map", "fof_within_group", "gather_groups", "group_centres", "bound_flag", "phase_space_step"]


@pytest.mark.parametrize("name", EDGES)
def test_beyond_the_box(spark, tmp_path, name):
    """Rows at both ends of the box and beyond it: the SQL's distances end at no box."""
    rng = random.Random(5)
    ends = [[rng.choice([-0.52, -0.48, -0.5, 0.49, 0.51, 0.0]) + rng.uniform(-0.02, 0.02), rng.uniform(-0.03, 0.03), rng.uniform(-0.03, 0.03)] for _ in range(240)]
    rows = [(i, [*e, *(rng.uniform(-0.2, 0.2) for _ in range(3))], rng.randrange(10)) for i, e in enumerate(ends)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    q = c.execute(f"SELECT {', '.join(f'"{n}"' for n in df.columns)} FROM ({SQL[name]})")
    assert sorted(map(tuple, df.collect())) == sorted(q.fetchall())


def test_nearest_of_a_crowd(spark):
    """Several radii in turn give what all pairs give, with and without the box, with others at one place and ties."""
    rng = random.Random(6)
    at = lambda: [round(rng.choice([0.01, 0.5, 0.98, 1.01]) + rng.gauss(0, 0.02), 3) for _ in range(3)]
    two = [at() for _ in range(300)]
    two += two[:60]
    one, two = [(i, *at()) for i in range(200)], [(1000 + i, *p) for i, p in enumerate(two)]
    kind = "pid long, x double, y double, z double"
    for periodic in (True, False):
        def apart(p, q):
            d = [abs(a - b) for a, b in zip(p[1:], q[1:], strict=True)]
            d = [min(v, 1.0 - v) for v in d] if periodic else d  # noqa: B023
            return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]

        want = [(p[0], *reversed(min((apart(p, q), q[0]) for q in two))) for p in one]
        want = sorted(w for w in want if w[2] < 0.1 * 0.1)
        got = spatial.nearest_other(spark.createDataFrame(one, kind), spark.createDataFrame(two, kind), 0.1, 1.0, periodic, crowd=2)
        assert len(want) > 100 and sorted(map(tuple, got.collect())) == want
