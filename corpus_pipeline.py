"""A corpus pipeline: toxicity, near dedup, benchmark decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arcweave.functions.shipping import ship
from arcweave.llm import decontaminate, mixing, near_dedup, token_store, toxicity
from arcweave.llm.store import fresh_path, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier chain, fitted on the labelled ones, rejects."""
    ship(spark)
    model = toxicity.fit_chain(docs, toxicity.labelled(table(spark, sf_dir, "labels")))
    return toxicity.toxicity(docs, model).where("NOT toxic").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    ship(spark)
    return near_dedup.keep_one(docs, k=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of a benchmark item."""
    ship(spark)
    held = [c for c in docs.columns if c != "text"]
    marked = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), with_text=True).where("NOT contaminated")
    return marked.select(*held, "clean_text").withColumnRenamed("clean_text", "text").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources; a document that it takes twice is there twice."""
    ship(spark)
    return mixing.mixed_documents(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards, and what is read back from them."""
    ship(spark)
    return token_store.stored_documents(token_store.write_tokens(docs, fresh_path(spark, "pipeline-tokens")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token_output", write_token_ids),
]

#: SQL cannot express the classifier of the first stage; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
