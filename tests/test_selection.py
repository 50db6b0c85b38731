import pytest
from pyspark.sql import functions as F

from arcweave import Graph, k_hop
from arcweave.operators import selection, traverse
from arcweave.operators.selection import Ranges, first_rows


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("cap", [0, 1, 2_500, 9_999, 10_000, 10_001])
def test_first_rows_equal_a_sort(spark, cap):
    """Numbers in no order, a third of them tied in the first column."""
    rows = spark.range(10_000).selectExpr("IF(id % 3 = 0, 5L, pmod(id * 7919, 1000)) AS a", "pmod(id * 7919, 10000) AS b", "id")
    found = first_rows(rows, ["a", "b"], cap, "first")
    expected = sorted(((r.a, r.b, r.id) for r in rows.collect()))[:cap]
    assert sorted(tuple(r) for r in found.collect()) == expected and found.columns == ["a", "b", "id"]


def test_only_one_range_is_ranked(spark):
    """Half of a table: no task takes more than a range, and the plan has no sort of all rows."""
    ranges = Ranges(spark.range(40_000).selectExpr("pmod(id * 7919, 40000) AS id"), ["id"], "halves")
    assert sum(ranges.sizes) == 40_000 and max(ranges.sizes) < 2 * 40_000 / len(ranges.sizes) and len(ranges.sizes) == 4
    half = ranges.first(20_123)
    plan = plan_of(half)
    assert "TakeOrdered" not in plan and "Limit" not in plan.replace("WindowGroupLimit", "") and "PartitionFilters" in plan
    assert half.agg(F.count("id"), F.max("id")).first()[:] == (20_123, 20_122)
    assert Ranges(spark.range(0), ["id"], "none").first(5).count() == 0


def test_capped_neighbourhoods_without_a_task_for_all(spark, monkeypatch):
    """Caps of half a table of vertices and of edges; the tables of the search are gone afterwards."""
    n = 6_000
    rows = spark.range(n - 1).selectExpr("id AS edge_id", "0L AS src", "id + 1 AS dst")
    graph = Graph.from_edges(rows, edge_id="edge_id", num_vertices=n)
    seen, real = [], selection.Ranges.first
    monkeypatch.setattr(selection.Ranges, "first", lambda self, cap: (seen.append((max(self.sizes), sum(self.sizes))), real(self, cap))[1])
    gone, drop = [], traverse.remove
    monkeypatch.setattr(traverse, "remove", lambda s, p: (gone.append(p), drop(s, p))[1])
    got = k_hop(graph, 0, k=2, max_vertices=n // 2, max_edges=n // 4)
    assert [r.idx for r in got.vertices.collect()] == list(range(n // 2))
    assert [r.edge_id for r in got.edges.collect()] == list(range(n // 4))
    assert len(seen) == 2 and all(most < 2 * every / 4 for most, every in seen)
    assert "TakeOrdered" not in plan_of(got.vertices) + plan_of(got.edges)
    assert any("/levels-" in p for p in gone)
