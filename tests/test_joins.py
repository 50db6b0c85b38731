"""Joins and builds whose keys are uneven, without any help of adaptive execution."""

from statistics import median

import pytest
from pyspark.sql import functions as F

from arcweave import Graph
from arcweave.operators.ids import dense_index
from arcweave.operators.joins import hub_threshold, join_value

EDGES = 200_000


@pytest.fixture
def plain(spark):
    """Without adaptive execution and without broadcasts that the size of a table suggests."""
    ours = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in ours}
    for k, v in ours.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def even(counts):
    counts = [r["count"] for r in counts]
    return len(counts) == 8 and max(counts) <= 2 * median(counts)


def test_values_equal_a_plain_join(plain):
    rows = plain.range(50_000).selectExpr("id AS n", "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 50 = 1 THEN null ELSE id % 400 END AS key", "id % 5 AS hub_like")
    table = plain.range(300).selectExpr("id AS key", "id * 10 AS value", "'x' AS n")
    want = rows.join(table.select("key", "value"), "key").select("n", "key", "hub_like", "value")
    for hubs in (None, table.where("key = 7"), table.where("key IN (7, 8, 999)"), table.where("false")):
        found = join_value(rows, table, "key", "value", hubs)
        assert found.columns == ["n", "key", "hub_like", "value"]
        assert found.count() == want.count()
        assert found.exceptAll(want).isEmpty()
    assert join_value(rows.where("false"), table, "key", "value", table.where("key = 7")).isEmpty()
    assert join_value(rows, table.where("false"), "key", "value", table.where("false")).isEmpty()


def test_a_key_of_most_rows_is_dealt_out(plain):
    rows = plain.range(EDGES).selectExpr("id AS n", "IF(id % 10 = 0, id, 7) AS key")
    table = plain.range(EDGES).selectExpr("id AS key", "id + 1 AS value")
    assert not even(join_value(rows, table, "key", "value", None).groupBy(F.spark_partition_id()).count().collect())
    found = join_value(rows, table, "key", "value", table.where("key = 7"))
    assert even(found.groupBy(F.spark_partition_id()).count().collect())
    assert found.where("value <> key + 1").isEmpty() and found.count() == EDGES


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_a_star_builds_evenly(plain, kind):
    """Leaves point to a centre, so the last join of the build would bring all edges to its task, and all of the centre's
    shares to another in the transposed star."""
    star = plain.range(1, EDGES + 1).selectExpr(f"CAST(id AS {kind}) AS src", f"CAST(0 AS {kind}) AS dst", "id AS edge_id")
    graph = Graph.from_edges(star, edge_id="edge_id")
    assert even(graph.edges.groupBy("_metadata.file_name").count().collect())
    assert (graph.num_vertices, graph.num_edges) == (EDGES + 1, EDGES)
    names = graph.external_ids
    back = graph.edges.join(names.selectExpr("idx AS src", "ext_id AS leaf"), "src").where("leaf <> edge_id")
    assert back.isEmpty() and graph.edges.select("dst").distinct().count() == 1

    out = Graph.from_edges(star.selectExpr("dst AS src", "src AS dst", "edge_id"), edge_id="edge_id")
    assert out.most_out == EDGES
    laid = out.adjacency("out")
    assert laid.hub_count == 1 and laid.heavy.where(f"abs(share - 1 / {EDGES}) > 1e-15").isEmpty() and laid.heavy.count() == EDGES
    assert even(laid.heavy.groupBy(F.spark_partition_id()).count().collect())
    out.unpersist()


def test_a_universe_with_a_hub(plain):
    edges = plain.range(20_000).selectExpr("id AS edge_id", "id % 2 AS src", "id % 9000 AS dst", "1.0D AS weight")
    graph = Graph.from_universe(edges, plain.range(0, 8_000).selectExpr("id AS ext_id"))
    want = edges.where("dst < 8000").selectExpr("edge_id", "src", "dst", "weight")  # ids are indices here
    assert graph.edges.count() == want.count() and graph.edges.select(*want.columns).exceptAll(want).isEmpty()
    assert graph.num_vertices == 8_000


def test_occurrences_are_counted(spark):
    values = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "v string")
    rows = {tuple(r) for r in dense_index(values, "v", counted=True).select("v", "idx", "occurs").collect()}
    assert rows == {("a", 0, 1), ("b", 1, 2)}
    assert hub_threshold(10, spark) == 1_000 and hub_threshold(10**9, spark) == 10**9 // 16
