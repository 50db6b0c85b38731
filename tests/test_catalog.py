import duckdb
import pytest

from arcweave import catalog, last_run_info


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for t in "nation customer supplier part orders lineitem events documents pages conversations".split():
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows(found):
    return sorted(tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(name, spark, sf_dir, tables):
    df, expected = catalog.queries()[name](spark, sf_dir), tables.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows(tuple(r) for r in df.select(*expected.columns).collect()) == rows(expected.fetchall())


def test_no_query_reads_part_of_a_table(spark, sf_dir, tables):
    assert not any("l_orderkey <" in sql for sql in catalog.oracle_sql().values())
    vertices = tables.sql("select count(distinct l_suppkey) + count(distinct l_partkey) from lineitem").fetchall()[0][0]
    assert catalog.queries()["bfs_undirected_sp"](spark, sf_dir).count() == vertices
    assert catalog.queries()["khop_edges"](spark, sf_dir).count() > 0


def test_convergence_queries_end_before_their_last_step(spark, sf_dir):
    catalog.queries()["pagerank_converged"](spark, sf_dir)
    assert 0 < last_run_info()["iterations"] < 60
    catalog.queries()["ppr_topk_frozen"](spark, sf_dir)
    assert 0 < last_run_info()["iterations"] < 60


def test_entry_point_without_the_optional_subpackage(monkeypatch):
    import builtins
    import sys

    import __spark_entry__ as entry

    real = builtins.__import__

    def absent(name, *args, **kwargs):
        if name == "corpus_pipeline" or name.startswith("arcweave.llm"):
            raise ModuleNotFoundError(name=name.split(".catalog")[0] if name != "corpus_pipeline" else name)
        return real(name, *args, **kwargs)

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("arcweave.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", absent)
    assert set(entry.queries()) == set(catalog.queries()) and set(entry.oracle_sql()) == set(catalog.oracle_sql())


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
