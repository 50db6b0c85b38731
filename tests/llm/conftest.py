import duckdb
import pytest
from pyspark.sql import SparkSession

from arcweave.llm import catalog

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, task int, hits string"


def rows_of(df, columns=None):
    columns = sorted(columns or df.columns)
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def close(rows):
    return sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows], key=repr)


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table with extra columns whose names clash with those of the operators."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, 0, "x", 1, "y") for i, t, s in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def oracle(sf_dir):
    def run(name):
        con = duckdb.connect()
        for t in ("documents", "pages", "benchmark", "labels", "conversations"):
            con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        found = con.sql(catalog.oracle_sql()[name])
        order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
        return sorted(found.columns), [tuple(r[i] for i in order) for r in found.fetchall()]

    return run


@pytest.fixture(scope="session")
def query(spark: SparkSession, sf_dir):
    def run(name):
        df = catalog.queries()[name](spark, sf_dir)
        columns = sorted(df.columns)
        return columns, [tuple(r) for r in df.select(*columns).collect()]

    return run
