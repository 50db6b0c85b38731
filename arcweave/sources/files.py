"""Edge lists in text files, and edge lists from Python sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_edge_text(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) from lines of two integers between white space; lines that start with # are comments. Gzip is fine."""
    lines = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    parts = F.split(F.trim("value"), r"\s+")
    return lines.select(F.get(parts, F.lit(0)).cast("bigint").alias("src"), F.get(parts, F.lit(1)).cast("bigint").alias("dst"))


def edges_from_arrays(spark: SparkSession, src, dst, weights=None) -> DataFrame:
    """(edge_id, src, dst[, weight]) from sequences of equal length; an edge's id is its position."""
    src, dst = list(src), list(dst)
    if len(src) != len(dst) or weights is not None and len(weights) != len(src):
        raise ValueError("src, dst and weights differ in length")
    texts = [isinstance(x, str) for x in (*src, *dst)]
    if any(isinstance(x, bool) or not isinstance(x, (int, str)) for x in (*src, *dst)) or len(set(texts)) > 1:
        raise ValueError("vertex ids must be all integers or all strings")
    kind = "string" if texts and texts[0] else "bigint"
    rows = [(i, *e) for i, e in enumerate(zip(src, dst, *([] if weights is None else [map(float, weights)]), strict=True))]
    return spark.createDataFrame(rows, f"edge_id bigint, src {kind}, dst {kind}" + (", weight double" if weights is not None else ""))
