"""Joins of many rows with one row per key, where few keys have many of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.plans.tables import partitions

#: A key with more than 1 / (HUB_SHARE * partitions) of the rows is a hub; there are at most HUB_SHARE * partitions.
HUB_SHARE = 4


def hub_threshold(rows: int, spark) -> int:
    """Rows that a key must exceed to be a hub; small tables have none."""
    return max(1_000, rows // (HUB_SHARE * partitions(spark)))


def join_value(rows: DataFrame, table: DataFrame, key: str, value: str, hubs: DataFrame | None) -> DataFrame:
    """`rows` with `value` of their `key` from `table`, which has a key once; rows whose key it lacks, or is null, go.

    `hubs` holds those rows of `table` whose keys are hubs of `rows`, None if there are none. They are broadcast, their
    number being bounded by hub_threshold, and rows that have found their value there are dealt out by a hash of the whole
    row, instead of by their key, in the exchange that brings the others to theirs. So the exchange is even without any
    help at run time, and rows are read once. Rows that are equal in all columns stay together.
    """
    if hubs is None:
        return rows.join(table.select(key, value), key).select(*rows.columns, value)
    few = F.broadcast(hubs.select(key, F.col(value).alias("hub_value")))
    # a place that no row of the table has, so a dealt row meets none there
    place = F.when(F.col("hub_value").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*rows.columns), F.lit(2**31)))
    dealt = rows.join(few, key, "left").withColumn("place", place.cast("bigint"))
    # always 0, but no constant: the optimizer would take that out of the join's keys, and rows would be dealt by `key` alone
    zero = F.pmod(F.xxhash64(key), F.lit(1).cast("bigint"))
    own = table.select(key, F.col(value).alias("own_value"), zero.alias("place"))
    found = dealt.join(own, [key, "place"], "left").withColumn(value, F.coalesce("hub_value", "own_value"))
    return found.where(F.col(value).isNotNull()).select(*rows.columns, value)
