"""Synthetic graphs, generated on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rmat(spark: SparkSession, scale: int, edge_factor: int = 16, seed: int = 1, a: float = 0.57, b: float = 0.19, c: float = 0.19) -> DataFrame:
    """(edge_id, src, dst): edge_factor * 2**scale edges over 2**scale vertices by recursive quadrants.

    Each bit is a hash of the edge id, so a lost partition is generated alike.
    """
    rows = spark.range(edge_factor << scale).withColumnRenamed("id", "edge_id")
    src = dst = F.lit(0).cast("bigint")
    for bit in range(scale):
        u = F.pmod(F.xxhash64("edge_id", F.lit(seed), F.lit(bit)), F.lit(1 << 40)) / float(1 << 40)
        src = src * 2 + (u >= a + b).cast("bigint")
        dst = dst * 2 + (((u >= a) & (u < a + b)) | (u >= a + b + c)).cast("bigint")
    return rows.select("edge_id", src.alias("src"), dst.alias("dst"))


def power_law(spark: SparkSession, vertices: int, edges: int, seed: int = 7, exponent: float = 1.6) -> DataFrame:
    """(edge_id, src, dst, weight): ends by inverse Pareto, so low indices are hubs; weights from 0.1 to 2."""
    rows = spark.range(edges).withColumnRenamed("id", "edge_id")

    def uniform(k: int):
        return (F.pmod(F.xxhash64("edge_id", F.lit(seed), F.lit(k)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)

    def end(k: int):
        return F.pmod(F.floor(F.pow(uniform(k), F.lit(-1 / (exponent - 1)))) - 1, F.lit(vertices)).cast("bigint")

    return rows.select("edge_id", end(0).alias("src"), end(1).alias("dst"), (0.1 + 1.9 * uniform(2)).alias("weight"))
