import glob
import os

import pytest

from arcweave import Graph, bfs, k_hop, pagerank
from arcweave.operators import graph as graph_module
from arcweave.sources import snapshots
from arcweave.sources.files import edges_from_arrays
from arcweave.sources.snapshots import StaleSnapshot, cached_graph, load_edges, open_graph, save_edges, save_graph


def hub_edges(spark):
    """A hub with 3,000 edges out, and a chain; external ids in steps of 10."""
    rows = [(0, (i % 997 + 1) * 10, 1.0 + i % 3) for i in range(3000)] + [(i * 10, i * 10 + 10, 2.0) for i in range(1, 997)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "edge_id bigint, src bigint, dst bigint, weight double")


OPTIONS = {"weight": "weight", "edge_id": "edge_id"}


def rounded(df):
    return sorted((r.idx, round(r.rank, 12)) for r in df.collect())


@pytest.fixture(scope="module")
def graph(spark):
    return Graph.from_edges(hub_edges(spark), **OPTIONS)


@pytest.fixture(scope="module")
def path(graph, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("snapshots") / "g")
    save_graph(graph, path, directions=("out", "both"))
    return path


def test_an_opened_graph_gives_the_same_results(spark, graph, path):
    again = open_graph(spark, path)
    assert repr(again) == repr(graph) and again.adjacency("out").hub_count == graph.adjacency("out").hub_count == 1
    assert sorted(map(tuple, again.stored.collect())) == sorted(map(tuple, graph.stored.collect()))
    assert rounded(pagerank(again, tol=1e-30, max_iter=2)) == rounded(pagerank(graph, tol=1e-30, max_iter=2))
    assert sorted(map(tuple, bfs(again, [30], "both").collect())) == sorted(map(tuple, bfs(graph, [30], "both").collect()))
    assert sorted(r.edge_id for r in k_hop(again, 5, k=1, direction="in").edges.collect()) == sorted(r.edge_id for r in k_hop(graph, 5, k=1, direction="in").edges.collect())


def test_an_undirected_graph_opens(spark, tmp_path):
    table = edges_from_arrays(spark, ["a", "é", "b"], ["b", "日", "b"], [1.0, 2.0, 0.5])
    words = Graph.from_edges(table, weight="weight", edge_id="edge_id", directed=False)
    save_graph(words, str(tmp_path / "w"), directions=("in",))
    again = open_graph(spark, str(tmp_path / "w"))
    assert again.index_of(["日", "a"]) == [3, 0] and repr(again) == repr(words)
    assert sorted(map(tuple, again.stored.collect())) == sorted(map(tuple, words.stored.collect()))
    assert rounded(pagerank(again, max_iter=1)) == rounded(pagerank(words, max_iter=1))


def test_opening_moves_no_edges(spark, path):
    """The plan of a step over an opened graph exchanges vertices only, also where the session has other partitions."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for n in ("4", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            again = open_graph(spark, path)
            stored = again.adjacency("out").light._jdf.queryExecution().executedPlan().toString()
            assert "Bucketed: true" in stored and "Exchange" not in stored
            plan = again.adjacency("out").expand(again.vertices.select("idx"))._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning(at") == 1 and "SortMergeJoin" in plan
            again.unpersist()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_lookup_reads_the_files_that_have_the_ids(spark, path):
    graph = open_graph(spark, path)
    every = len(graph.vertices.inputFiles())
    assert every == 4 and len(graph.vertices_with([50]).inputFiles()) == 1 and len(graph.vertices_with([0, 9970]).inputFiles()) == 2
    assert graph.index_of(50) == 5 and graph.index_of([9970, 0, 9970]) == [997, 0, 997] and graph.index_of([]) == []
    for absent in (55, -1, 99999):
        with pytest.raises(ValueError, match="unknown"):
            graph.index_of(absent)


def test_a_cached_graph_is_built_once(spark, tmp_path, monkeypatch):
    built, real = [], Graph.from_edges.__func__
    monkeypatch.setattr(graph_module.Graph, "from_edges", classmethod(lambda cls, *a, **k: (built.append(1), real(cls, *a, **k))[1]))
    edges, path = edges_from_arrays(spark, [5, 7, 9], [7, 9, 5], [1.0, 2.0, 0.5]), str(tmp_path / "g")
    assert cached_graph(edges, path, **OPTIONS).num_edges == 3
    assert cached_graph(edges.repartition(7), path, **OPTIONS).num_edges == 3 and len(built) == 1
    assert not cached_graph(edges, path, directed=False, **OPTIONS).directed and len(built) == 2  # other options
    other = edges.where("edge_id <> 1")
    assert cached_graph(other, path, **OPTIONS).num_edges == 2 and len(built) == 3  # another source
    monkeypatch.setattr(snapshots, "VERSION", 99)
    assert cached_graph(other, path, **OPTIONS).num_vertices == 3 and len(built) == 4  # an old version
    with pytest.raises(ValueError, match="3 vertices"):
        cached_graph(edges, str(tmp_path / "h"), expected_vertices=4, **OPTIONS)
    with pytest.raises(StaleSnapshot):
        open_graph(spark, str(tmp_path / "h"))


def test_damaged_snapshots_are_rejected_and_rebuilt(spark, path, tmp_path):
    for part in ("edges", "vertices", "out-light", "out-heavy"):
        file = max(glob.glob(f"{path}/graph-*/{part}/*.parquet"), key=os.path.getsize)
        os.rename(file, str(tmp_path / "kept"))
        with pytest.raises(StaleSnapshot):
            open_graph(spark, path)
        os.rename(str(tmp_path / "kept"), file)
    assert open_graph(spark, path).num_vertices == 998
    edges, other = edges_from_arrays(spark, [5, 7, 9], [7, 9, 5], [1.0, 2.0, 0.5]), str(tmp_path / "o")
    cached_graph(edges, other, **OPTIONS)
    os.remove(max(glob.glob(f"{other}/graph-*/edges/*.parquet"), key=os.path.getsize))
    assert cached_graph(edges, other, **OPTIONS).edges.count() == 3
    with pytest.raises(StaleSnapshot):
        open_graph(spark, str(tmp_path / "nothing"))


def test_edge_snapshots_are_checked(spark, tmp_path):
    path = str(tmp_path / "e")
    save_edges(hub_edges(spark), path, directed=True, num_vertices=998)
    assert load_edges(spark, path, verify=True, directed=True).count() == 3996
    for wrong in ({"directed": False}, {"num_vertices": 5}, {"source": "x"}):
        with pytest.raises(StaleSnapshot):
            load_edges(spark, path, **wrong)
    save_edges(edges_from_arrays(spark, ["a"], ["b"]), path)  # the newest counts
    assert [tuple(r) for r in load_edges(spark, path).select("src", "dst").collect()] == [("a", "b")]
    with pytest.raises(StaleSnapshot):
        open_graph(spark, path)  # edges are no graph
    for f in glob.glob(f"{path}/edges-*/*.parquet"):
        os.remove(f)
    with pytest.raises(StaleSnapshot):
        load_edges(spark, path)
