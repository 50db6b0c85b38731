"""The first rows of a table in an order, whatever their number, without a sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcweave.plans.tables import discard, fresh_path, partitions, stored


class Ranges:
    """A table dealt into ranges of `order`, stored by range, with the size of each.

    The ranges are those of Spark's range partitioner, one a shuffle partition; the driver holds a number for each. Rows
    that are equal in `order` are in one range, so `order` should end in a column that tells rows apart.
    """

    def __init__(self, rows: DataFrame, order: list[str], name: str):
        spark = rows.sparkSession
        self.order, self.path = order, fresh_path(spark, name)
        dealt = rows.repartitionByRange(partitions(spark), *order).withColumn("range", F.spark_partition_id())
        dealt.write.partitionBy("range").parquet(self.path)  # so that a range is read without the others
        self.rows = spark.read.schema(dealt.schema).parquet(self.path)
        self.rows.stored_at = self.path
        found = self.rows.groupBy("range").count().collect()
        self.sizes = [n for _, n in sorted((r["range"], r["count"]) for r in found)]
        self.names = sorted(r["range"] for r in found)

    def first(self, cap: int) -> DataFrame:
        """The `cap` first rows: whole ranges before the one that the cap falls in, which alone is ranked."""
        before = 0
        for name, size in zip(self.names, self.sizes, strict=True):
            if before + size > cap:
                break
            before += size
        else:
            return self.rows.drop("range")
        whole = self.rows.where(F.col("range") < name).drop("range")
        if before == cap:
            return whole
        place = F.row_number().over(Window.partitionBy("range").orderBy(*self.order))
        split = self.rows.where(F.col("range") == name).withColumn("place", place).where(F.col("place") <= cap - before)
        return whole.unionByName(split.drop("range", "place"))


def first_rows(rows: DataFrame, order: list[str], cap: int, name: str) -> DataFrame:
    """The `cap` first rows of a table in `order`, stored."""
    ranges = Ranges(rows, order, f"{name}-ranges")
    found = stored(ranges.first(cap), name)
    discard(ranges.rows)
    return found
