"""Weakly connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.operators.contraction import component_labels
from arcweave.operators.graph import Graph, check_graph
from arcweave.operators.ids import dense_index
from arcweave.plans.runtime import recorded
from arcweave.plans.tables import stored


def wcc(graph: Graph) -> DataFrame:
    """(idx, comp) of every vertex; components are numbered from 0 in the order of their smallest vertex."""
    check_graph(graph)
    with recorded("wcc") as info:
        found, info.iterations = component_labels(graph.edges.select("src", "dst"), stored)
        every = graph.vertices.select("idx").join(found.withColumnRenamed("node", "idx"), "idx", "left")
        every = stored(every.select("idx", F.coalesce("label", "idx").alias("label")), "labels")
        numbers = stored(dense_index(every, "label").withColumnRenamed("idx", "comp"), "numbers")
        return every.join(numbers, "label").select("idx", "comp")


def wcc_count(graph: Graph) -> int:
    """Number of weakly connected components."""
    return wcc(graph).select("comp").distinct().count()
