"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.llm import neighbours


def plain(ids, x, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    return [int(ids[i]) for i in np.lexsort((ids, d)) if ids[i] != ids[q]][:k]


def test_recall_and_distances(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found = {}
    for r in neighbours.search(df, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hit = 0
    for q in np.flatnonzero(ids % 10 == 0):
        got = found[int(ids[q])]
        assert len(got) == 10
        hit += len({i for i, _ in got} & set(plain(ids, x, q)))
        at = {int(i): v for i, v in zip(ids, x, strict=True)}
        assert [s for _, s in got] == pytest.approx([float(np.sqrt(((at[i] - x[q]) ** 2).sum())) for i, _ in got])
    assert hit >= 0.9 * 10 * len(found)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.0, 0.0]), (100, [1.0, nan]), (200, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [1.0, None]), (5, [1.0]), (None, [2.0, 1.0]), (300, [inf, 1.0]), (400, [1.0, 0.0]), (400, [1.0, 0.0]), (6, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in neighbours.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(200, 1, 400, 0.0), (200, 2, 1, 1.0), (200, 3, 2, 1.0), (400, 1, 200, 0.0), (400, 2, 1, 1.0), (400, 3, 2, 1.0)]
    assert neighbours.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_sets_slices_and_segments_change_little(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SEGMENT", 64)  # for the driver's side only; workers keep theirs
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found = {}
    for r in neighbours.search(df, F.col("vec_id") % 10 == 0, components=64 * 9, slice_=100).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hit = sum(len(found[int(ids[q])] & set(plain(ids, x, q))) for q in np.flatnonzero(ids % 10 == 0))
    assert all(len(f) == 10 for f in found.values()) and hit >= 0.95 * 10 * len(found)


def test_a_group_over_many_segments(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(neighbours, "SEGMENT", 50)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 16))
    rows = [(0, True, i, x[i].tolist()) for i in range(0, 400, 20)] + [(0, False, i, x[i].tolist()) for i in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["pair", "asks", "vec_id", "vector"])
    found = {}
    for b in neighbours.answered(iter([batch.slice(0, 33), batch.slice(33)]), 10, 32, 16, 0.95):
        for q, i in zip(b["query_id"].to_pylist(), b["vec_id"].to_pylist(), strict=True):
            found.setdefault(q, []).append(i)
    hit = sum(len(set(found[i]) & set(plain(np.arange(400), x, i))) for i in range(0, 400, 20))
    assert hit >= 0.95 * 200


def test_other_columns_and_doubles(spark):
    rows = [(100 * i, [float(i), 1.0], i, "x", True, 3) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, vector string, asks boolean, `set` int")
    got = neighbours.search(df, F.col("vec_id") % 200 == 0, k=2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got][:2] == [(0, 100, 1.0), (0, 200, 2.0)] and len(got) == 6


def test_ties_go_to_smaller_ids(spark):
    rows = [(0, [1.0, 2.0])] + [(i, [1.0, 2.5]) for i in range(1, 40)]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(1, 11))
