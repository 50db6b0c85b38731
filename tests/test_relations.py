import pytest

from arcweave import Graph, experimental
from arcweave.sources import relations as rel


def test_long_conversations_stay_apart(spark, tmp_path):
    rows = [(c, t) for c, n in ((-1, 3), (1, 1200), (2, 5), (2**62, 2)) for t in range(n)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint").write.parquet(f"{tmp_path}/conversations.parquet")
    found = experimental.wcc(Graph.from_edges(rel.conversation_turns(spark, str(tmp_path)))).orderBy("idx").collect()
    assert [r.comp for r in found] == [0] * 3 + [1] * 1200 + [2] * 5 + [3] * 2


def test_levels_of_the_hierarchy_stay_apart(spark, tmp_path):
    tables = {
        "nation": ("n_nationkey int, n_regionkey int", [(7, 150), (50, 1)]),
        "customer": ("c_custkey bigint, c_nationkey int", [(8_000_001, 7), (3, 50)]),
        "orders": ("o_orderkey bigint, o_custkey bigint", [(1, 3), (2, 8_000_001)]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    edges = rel.hierarchy(spark, str(tmp_path))
    assert edges.select("src").union(edges.select("dst")).distinct().count() == 8
    assert set(r.n for r in edges.groupBy("dst").count().selectExpr("count AS n").collect()) == {1}


def test_documents_without_text_are_one_group(spark, tmp_path):
    rows = [(1, "a"), (2, None), (3, "a"), (4, None), (5, "")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in rel.equal_documents(spark, str(tmp_path)).collect()) == [(1, 1), (2, 2), (3, 1), (4, 2), (5, 5)]


def test_supplier_keys_that_would_meet_parts_fail(spark, tmp_path):
    lines = [(1, 1_000_000 - 1, 5.0), (1, 1_000_000, 5.0)]
    for i, row in enumerate(lines):
        spark.createDataFrame([row], "l_partkey bigint, l_suppkey bigint, l_quantity double").write.parquet(f"{tmp_path}/{i}/lineitem.parquet")
    assert rel.supplier_part(spark, f"{tmp_path}/0").count() == 1
    with pytest.raises(Exception, match="must be below"):
        rel.supplier_part(spark, f"{tmp_path}/1").collect()
