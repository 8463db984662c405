"""What several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starloom.operators.components import release, scope, written

__all__ = ["BATCH", "WORD_JAVA", "free_name", "read", "release", "scope", "small_batches", "spread", "written"]

#: A word, as the contracts define it, for Java: a maximal run without blank, tab, LF, VT, FF and CR.
WORD_JAVA = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows of an Arrow batch, at most: the session's default would put thousands of whole texts into one.
BATCH = 512


def small_batches(df: DataFrame, rows: int = BATCH) -> DataFrame:
    """df; its session hands Python at most so many rows at a time from now on.

    Spark takes the setting when a plan is run, after the operator has returned, so it can't be put back here.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    known = int(df.sparkSession.conf.get(key))
    if known <= 0 or known > rows:
        df.sparkSession.conf.set(key, str(rows))
    return df


def spread(spark: SparkSession, least: int = 1) -> int:
    """How many partitions a shuffle of this session has."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it until df has no such column (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
