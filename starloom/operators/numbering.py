"""Running sums and row numbers in a given order, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.operators.components import written


def running_sums(df: DataFrame, keys: list[str], order: list[str | Column], sums: dict[str, str | None], totals: dict[str, str] | None = None) -> DataFrame:
    """df with, for each name in sums, the sum of a column (1 for each row if that is None) over the rows before, in this order, within its keys.

    Rows are dealt by range, so that a group of any size lies in several partitions; each partition sums its own rows, and what lies
    in earlier partitions is added from a table of one row for each group and partition. The order must tell rows apart, or those
    it doesn't are numbered in any order. Rows with null keys are a group like others. Numbers of rows are long, sums of the column's own kind.
    totals names columns for the whole sums of some of these.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    # The id counts rows of a partition in their order, its high bits number the partition.
    placed = written(sorted_.withColumn("_row", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_row", 33))
    what = {to: F.lit(1).cast("long") if value is None else F.col(value) for to, value in sums.items()}
    parts = placed.groupBy(*keys, "_part").agg(*[F.sum(w).alias(f"_sum_{to}") for to, w in what.items()])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], F.col("_part").alias("_in"), *[F.coalesce(F.sum(f"_sum_{to}").over(earlier), F.lit(0)).alias(f"_before_{to}") for to in sums], *[F.sum(f"_sum_{to}").over(Window.partitionBy(*keys)).alias(name) for to, name in (totals or {}).items()])
    inner = placed.withColumns({f"_inner_{to}": F.coalesce(F.sum(w).over(inside), F.lit(0)) for to, w in what.items()})
    same = F.col("_part") == F.col("_in")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    out = inner.join(offsets, same)
    return out.select(*df.columns, *[(F.col(f"_before_{to}") + F.col(f"_inner_{to}")).alias(to) for to in sums], *(totals or {}).values())


def running_sum(df: DataFrame, keys: list[str], order: list[str | Column], to: str, value: str | None = None) -> DataFrame:
    """df with one such column, as a long."""
    return running_sums(df, keys, order, {to: value}).withColumn(to, F.col(to).cast("long"))
