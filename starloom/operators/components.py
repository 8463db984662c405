"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges up to which one task finds components; more go through the distributed rounds.
FEW_EDGES = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session. Only a local master gets a temporary one where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        own = tempfile.mkdtemp(prefix="starloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        at = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


#: Paths of the tables written inside each open scope, innermost last.
_scopes: list[list[str]] = []


@contextmanager
def scope() -> Iterator[list[str]]:
    """Paths of the tables written inside, for release() once nothing reads them any more."""
    mine: list[str] = []
    _scopes.append(mine)
    try:
        yield mine
    finally:
        _scopes.remove(mine)


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Deletes the tables at these paths; all of this application's if none are given, which no result may need any more."""
    paths = [f"{shared_dir(spark)}/starloom-{spark.sparkContext.applicationId}"] if paths is None else paths
    jvm = spark._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there and lost executors don't take it along.

    Tables lie in a folder of the application and stay until release(), since results that are yet to be computed read them.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/starloom-{spark.sparkContext.applicationId}/table-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(at)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", most: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; a component is named by its smallest node.

    Alternating large-star and small-star steps: each links the neighbours of a node to the smallest of them. They shuffle edges
    and one minimum for each node, nothing that grows with a component, and end after a number of rounds that grows with the
    logarithm of the longest path. Loops are allowed; nulls are not nodes.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    nodes = e.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    now = written(e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(most):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state["n"]:
            break
        before = state
        now = written(_small_star(_large_star(now)))
    else:
        raise RuntimeError(f"no end after {most} rounds")
    return nodes.join(now, F.col("node") == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("component"))


def _large_star(e: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the least of the node and its neighbours."""
    both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Written, so that the join shuffles both sides anew and Spark can split a node that most others link to.
    least = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")))
    return both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of those."""
    least = e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
    joined = e.join(least, F.col("a") == F.col("u"))
    down = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return down.unionByName(own).distinct()


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """(node, component) of (src, dst): in one task while the edges are few, by distributed rounds beyond."""
    kept = written(edges.select("src", "dst"))
    if kept.count() > few:
        return connected_components(kept)
    return kept.coalesce(1).mapInArrow(_union_find, "node long, component long")


def _union_find(batches: Iterator) -> Iterator:
    import pyarrow as pa

    up: dict[int, int] = {}

    def top(x: int) -> int:
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = top(x), top(y)
            if x != y:
                up[max(x, y)] = min(x, y)
    nodes = sorted(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], names=["node", "component"])
