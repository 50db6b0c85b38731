"""Edge tables derived from relational tables: the graphs that the catalogue's queries run on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PART, CUSTOMER = 1_000_000, 2_000_000
#: First digit of a vertex of the hierarchy, in the order of its levels.
REGION, NATION, BUYER, ORDER = "0123"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sortable(number: Column) -> Column:
    """16 hexadecimal digits of any 64-bit integer, in the order of the numbers."""
    return F.lpad(F.hex(number.cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")


def _below(key: str, limit: int) -> Column:
    """The key; a run fails if it would meet the keys that are moved up by `limit`."""
    return F.when((F.col(key) < limit) | F.col(key).isNull(), F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"{key} must be below {limit}: "), F.col(key).cast("string"))))


def supplier_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier to part with the quantity sold."""
    lines = _read(spark, sf_dir, "lineitem")
    return lines.groupBy(_below("l_suppkey", PART).alias("src"), (F.col("l_partkey") + PART).alias("dst")).agg(F.sum("l_quantity").alias("weight"))


def customer_supplier(spark: SparkSession, sf_dir: str, multi: bool = False) -> DataFrame:
    """Customer to supplier with the money spent, or an edge for every order line."""
    joined = _read(spark, sf_dir, "orders").join(_read(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    lines = joined.select((F.col("o_custkey") + CUSTOMER).alias("src"), _below("l_suppkey", CUSTOMER).alias("dst"), "l_extendedprice")
    if multi:
        return lines.select("src", "dst")
    return lines.groupBy("src", "dst").agg(F.round(F.sum("l_extendedprice"), 2).alias("weight"))


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region to nation to customer to order; a vertex is its level and its key."""

    def vertex(level: str, key: str) -> Column:
        return F.concat(F.lit(level), _sortable(F.col(key)))

    nations = _read(spark, sf_dir, "nation").select(vertex(REGION, "n_regionkey").alias("src"), vertex(NATION, "n_nationkey").alias("dst"))
    customers = _read(spark, sf_dir, "customer").select(vertex(NATION, "c_nationkey").alias("src"), vertex(BUYER, "c_custkey").alias("dst"))
    orders = _read(spark, sf_dir, "orders").select(vertex(BUYER, "o_custkey").alias("src"), vertex(ORDER, "o_orderkey").alias("dst"))
    return nations.union(customers).union(orders)


def _next(table: DataFrame, key: str, value, *order: str) -> DataFrame:
    following = F.lead(value).over(Window.partitionBy(key).orderBy(*order))
    return table.select(value.alias("src"), following.alias("dst")).where("dst IS NOT NULL")


def event_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type of an event to the type of the user's next event, an edge each time."""
    return _next(_read(spark, sf_dir, "events"), "user_id", F.col("event_type"), "ts", "event_id")


def event_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event to the user's next event."""
    return _next(_read(spark, sf_dir, "events"), "user_id", F.col("event_id"), "ts", "event_id")


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn to next turn of a conversation; a vertex is both numbers in full."""
    return _next(_read(spark, sf_dir, "conversations"), "conv_id", F.concat(_sortable(F.col("conv_id")), _sortable(F.col("turn"))), "turn")


def equal_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document to the smallest doc_id with the same text (a loop for that one); null is one text, unlike the empty one."""
    keyed = _read(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")).alias("digest"))
    firsts = keyed.groupBy("digest").agg(F.min("doc_id").alias("dst"))
    return keyed.join(firsts, "digest").select(F.col("doc_id").alias("src"), "dst")


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page URL to its host."""
    return _read(spark, sf_dir, "pages").select(F.col("url").alias("src"), F.regexp_extract("url", "//([^/]*)", 1).alias("dst"))
