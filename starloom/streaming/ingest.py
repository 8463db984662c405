"""Membership that arrives snapshot by snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from starloom.operators.links import progenitors
from starloom.sources.sinks import write_snapshots


def keep_links(spark: SparkSession, incoming: DataFrame, members_path: str, links_path: str, checkpoint: str, threshold: int = 10) -> StreamingQuery:
    """Writes each arriving snapshot's members, and the links of every snapshot whose members or predecessor changed.

    Both tables are partitioned by snapshot and replaced snapshot by snapshot, so a repeated batch has the same result.
    """

    def batch(rows: DataFrame, _: int) -> None:
        rows = rows.persist()
        snaps = [r[0] for r in rows.select("snap_ord").distinct().collect()]
        if snaps:
            write_snapshots(rows, members_path)
            changed = sorted({s + d for s in snaps for d in (0, 1)})
            around = sorted({s - 1 for s in changed} | set(changed))
            m = spark.read.parquet(members_path).where(F.col("snap_ord").isin(around))
            write_snapshots(progenitors(m, threshold).where(F.col("snap_ord").isin(changed)), links_path)
        rows.unpersist()

    return incoming.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
