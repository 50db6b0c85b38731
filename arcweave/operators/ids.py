"""Dense indices for external ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcweave.plans.tables import partitions, stored


def dense_index(values: DataFrame, column: str, counted: bool = False) -> DataFrame:
    """(`column`, idx) for the distinct values of a column: idx counts from 0 in the values' order. With `counted`, occurs
    too: how many rows have the value.

    Values are sorted by ranges; only one row per range meets in one place, to add up the ranges' sizes.
    """
    n = partitions(values.sparkSession)
    given = values.select(column).where(F.col(column).isNotNull())
    distinct = given.groupBy(column).agg(F.count(F.lit(1)).alias("occurs")) if counted else given.distinct()
    ranged = stored(distinct.repartitionByRange(n, column).withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("part").count()
    starts = sizes.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(column)) - 1
    return ranged.withColumn("place", place).join(F.broadcast(starts), "part").select(
        column, (F.col("start") + F.col("place")).alias("idx"), *(["occurs"] if counted else [])
    )


def lookup(ids: DataFrame, vertices: DataFrame, column: str = "ext_id") -> DataFrame:
    """`ids` with idx; ValueError if a value of `column` is no vertex."""
    found = stored(ids.join(vertices.select(F.col("ext_id").alias(column), "idx"), column, "left"), "lookup")
    unknown = found.where("idx IS NULL").select(column).limit(1).collect()
    if unknown:
        raise ValueError(f"unknown vertex id {unknown[0][0]!r}")
    return found
