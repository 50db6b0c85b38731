"""Degree statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.operators.graph import Graph

#: Least degree of each class.
BINS = (("huge", 16384), ("high", 1024), ("mid", 32), ("low", 1), ("zero", 0))


def degree_histogram(graph: Graph, direction: str = "out") -> DataFrame:
    """(degree, vertices): how many vertices have how many stored edges."""
    return graph.vertices.groupBy(F.col(f"{direction}_deg").alias("degree")).agg(F.count(F.lit(1)).alias("vertices"))


def degree_bins(graph: Graph, direction: str = "out") -> DataFrame:
    """(bin, vertices, edges) by class of degree, the skew of a graph at a glance."""
    name = F.expr("CASE " + " ".join(f"WHEN {direction}_deg >= {least} THEN '{b}'" for b, least in BINS) + " END")
    return graph.vertices.groupBy(name.alias("bin")).agg(F.count(F.lit(1)).alias("vertices"), F.sum(f"{direction}_deg").alias("edges"))
