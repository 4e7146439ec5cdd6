"""Global order without a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from muralis.scratch import written


def global_rank(df: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """Row numbers over the whole table, nulls first; rows that tie in ``order`` are numbered in any order.  Rows are
    dealt by ranges once and written with the number of their range, so that all later steps see the same ranges;
    ranges' sizes, one row each, give the offsets."""
    ranged = written(df.select(F.struct("*").alias("row"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(order)]).repartitionByRange(*[f"k{i}" for i in range(len(order))]).withColumn("part", F.spark_partition_id()), "ranged")
    local = ranged.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy(*[f"k{i}" for i in range(len(order))])))
    sizes = ranged.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return local.join(F.broadcast(before), "part").select("row.*", (F.col("before") + F.col("n") + (start - 1)).cast("long").alias(name))
