"""Stored snapshots that are checked when they are read: edge tables, and graphs laid out for their operators.

A snapshot is a folder with a manifest: a Parquet table with a row per generation, which is written last. So a snapshot
whose writer failed does not exist, one that is written while another is read leaves that one alone, and of several the
newest counts. The manifest says what must be there - the schema's version, a digest of the source, row counts - and
what is not as it says is rejected with StaleSnapshot: rows are counted from the footers of the files, not read.

A graph's folder holds the vertices in ranges of ext_id, with the least and the largest of each file, and for each
direction its adjacency: light edges bucketed and sorted by `at`, hubs' edges spread by `to`, and the hubs. A graph that
is opened expands vertices over the buckets as they lie, without an exchange of edges, and looks ids up in the files
whose range has them.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.functions.checks import check_direction
from arcweave.operators.graph import Adjacency, Graph
from arcweave.plans.tables import partitions

#: Version of the layout below; snapshots of another one are rejected.
VERSION = 1
_MANIFEST = "generation bigint, version int, kind string, folder string, digest string, facts string"
_EDGES = "at bigint, to bigint, edge_id bigint, share double"


class StaleSnapshot(ValueError):
    """There is no snapshot, or it is not what its manifest or the caller says."""


def table_digest(rows: DataFrame, **facts) -> str:
    """Digest of a table's columns and rows, whatever their order and layout, and of facts about them."""
    columns = sorted(rows.columns)
    one, two = (F.xxhash64(*[F.struct(F.col(f"`{c}`"), F.lit(seed)) for c in columns]).cast("decimal(38,0)") for seed in (0, 1))
    found = rows.agg(F.count(F.lit(1)), F.sum(one), F.sum(two)).first()
    kinds = sorted(rows.dtypes)
    return hashlib.sha256(json.dumps([kinds, [str(x) for x in found], sorted(facts.items())]).encode()).hexdigest()


def _manifest(spark: SparkSession, path: str) -> list:
    try:
        return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").orderBy(F.col("generation").desc()).collect()  # a row per time it was stored
    except AnalysisException:
        return []


def _publish(spark: SparkSession, path: str, kind: str, folder: str, digest: str, facts: dict) -> None:
    newest = _manifest(spark, path)
    row = (newest[0].generation + 1 if newest else 0, VERSION, kind, folder, digest, json.dumps(facts))
    spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def _newest(spark: SparkSession, path: str, kind: str, digest: str | None) -> tuple[str, dict]:
    """Folder and facts of the newest snapshot at `path`."""
    found = _manifest(spark, path)
    if not found:
        raise StaleSnapshot(f"{path} holds no snapshot")
    row = found[0]
    if (row.version, row.kind) != (VERSION, kind):
        raise StaleSnapshot(f"{path} holds {row.kind} of version {row.version}, not {kind} of version {VERSION}")
    if digest is not None and row.digest != digest:
        raise StaleSnapshot(f"{path} was made from another source")
    return f"{path}/{row.folder}", json.loads(row.facts)


def _checked(spark: SparkSession, path: str, schema, rows: int) -> DataFrame:
    """The table at `path`, if it has so many rows."""
    try:
        table = spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
        # an option of its own, or the count could be that of a copy which the session cached
        n = spark.read.option("checked", uuid.uuid4().hex).schema(table.schema).parquet(path).count()
    except AnalysisException:
        if rows:
            raise StaleSnapshot(f"{path} is missing") from None
        return spark.createDataFrame([], schema)
    if n != rows:
        raise StaleSnapshot(f"{path} has {n} rows, not {rows}")
    return table


# edge tables


def save_edges(edges: DataFrame, path: str, **facts) -> None:
    """A snapshot of an edge table to reload instead of parsing or generating again. `facts` (strings, numbers, booleans,
    such as directed=True) are kept in the manifest and can be asked for by load_edges."""
    path, folder = path.rstrip("/"), f"edges-{uuid.uuid4().hex}"
    edges.write.parquet(f"{path}/{folder}")
    written = edges.sparkSession.read.parquet(f"{path}/{folder}")
    _publish(edges.sparkSession, path, "edges", folder, table_digest(written), {"rows": written.count(), "columns": sorted(edges.columns), "facts": facts})


def load_edges(spark: SparkSession, path: str, verify: bool = False, **facts) -> DataFrame:
    """The edge table saved at `path`; StaleSnapshot, a ValueError, if there is none, if files are missing or cut short, if
    it has no src and dst, or if it was saved with other `facts`. `verify` reads all rows and compares their digest too."""
    folder, known = _newest(spark, path.rstrip("/"), "edges", None)
    if not {"src", "dst"} <= set(known["columns"]) or any(known["facts"].get(k) != v for k, v in facts.items()):
        raise StaleSnapshot(f"{path} holds other edges")
    edges = _checked(spark, folder, None, known["rows"])
    if verify:
        _newest(spark, path.rstrip("/"), "edges", table_digest(edges))
    return edges


# graphs


def _bucketed(spark: SparkSession, location: str, buckets: int) -> DataFrame:
    name = "adjacency_" + hashlib.md5(location.encode()).hexdigest()
    if not spark.catalog.tableExists(name):
        spark.sql(f"CREATE TABLE {name} ({_EDGES.replace('at ', '`at` ').replace('to ', '`to` ')}) USING parquet OPTIONS (path '{location}') CLUSTERED BY (`at`) SORTED BY (`at`) INTO {buckets} BUCKETS")
    return spark.table(name)


def save_graph(graph: Graph, path: str, directions=("out",), digest: str = "") -> None:
    """Store `graph` at `path`, with the adjacency of each direction, so that open_graph finds it laid out."""
    spark, path, folder = graph.spark, path.rstrip("/"), f"graph-{uuid.uuid4().hex}"
    at, n = f"{path}/{folder}", partitions(graph.spark)
    graph.edges.select("edge_id", "src", "dst", "weight").write.parquet(f"{at}/edges")
    graph.vertices.repartitionByRange(n, "ext_id").sortWithinPartitions("ext_id").write.parquet(f"{at}/vertices")
    placed = spark.read.parquet(f"{at}/vertices").select("ext_id", F.col("_metadata.file_name").alias("file"))
    placed.groupBy("file").agg(F.min("ext_id").alias("low"), F.max("ext_id").alias("high")).coalesce(1).write.parquet(f"{at}/ranges")
    sides = {}
    for direction in dict.fromkeys("out" if not graph.directed else check_direction(d) for d in directions):
        laid = graph.adjacency(direction)
        side = {"buckets": n, "hubs": laid.hub_count, "light": 0, "heavy": 0}
        _bucketed(spark, f"{at}/{direction}-light", n)
        light = laid.light.select("at", "to", "edge_id", "share").repartition(n, "at")
        name = "adjacency_" + hashlib.md5(f"{at}/{direction}-light".encode()).hexdigest()
        light.write.mode("append").format("parquet").option("path", f"{at}/{direction}-light").bucketBy(n, "at").sortBy("at").saveAsTable(name)
        side["light"] = spark.table(name).count()
        if laid.heavy is not None:
            laid.heavy.select("at", "to", "edge_id", "share").write.parquet(f"{at}/{direction}-heavy")
            laid.hubs.write.parquet(f"{at}/{direction}-hubs")
            side["heavy"] = spark.read.parquet(f"{at}/{direction}-heavy").count()
        sides[direction] = side
    facts = {k: getattr(graph, k) for k in ("directed", "weighted", "identity", "num_edges", "num_vertices", "stored_count", "dangling_count")}
    facts |= {"vertices": graph.vertices.schema.simpleString()[7:-1], "sides": sides}
    _publish(spark, path, "graph", folder, digest, facts)


def open_graph(spark: SparkSession, path: str, digest: str | None = None) -> Graph:
    """The graph stored at `path`, not built again. StaleSnapshot if there is none, if it was made from a source with another
    digest, or if vertices, edges or an adjacency have not the rows that the manifest counts."""
    at, facts = _newest(spark, path.rstrip("/"), "graph", digest)
    graph = object.__new__(Graph)
    graph.spark = spark
    for k in ("directed", "weighted", "identity", "num_edges", "num_vertices", "stored_count", "dangling_count"):
        setattr(graph, k, facts[k])
    kinds = ", ".join(x.replace(":", " ", 1) for x in facts["vertices"].split(","))
    graph.edges = _checked(spark, f"{at}/edges", "edge_id bigint, src bigint, dst bigint, weight double", facts["num_edges"])
    graph.vertices = _checked(spark, f"{at}/vertices", kinds, facts["num_vertices"])
    graph.stored = graph.edges if graph.directed else graph.both_ways(graph.edges)
    graph._adjacency = {}
    graph.vertex_files = f"{at}/vertices", f"{at}/ranges"
    for direction, side in facts["sides"].items():
        _checked(spark, f"{at}/{direction}-light", _EDGES, side["light"])
        heavy = _checked(spark, f"{at}/{direction}-heavy", _EDGES, side["heavy"]) if side["hubs"] else None
        hubs = _checked(spark, f"{at}/{direction}-hubs", "at bigint", side["hubs"]) if side["hubs"] else None
        graph._adjacency[direction] = Adjacency.of_tables(_bucketed(spark, f"{at}/{direction}-light", side["buckets"]), heavy, hubs, side["hubs"], side["buckets"])
    return graph


def cached_graph(edges: DataFrame, path: str, directions=("out",), expected_vertices: int | None = None, **options) -> Graph:
    """Graph.from_edges(edges, **options), from the snapshot at `path` if that was made from these rows and options; else
    built, and stored there. Other sources, options and versions, and damaged snapshots, are built anew. ValueError if the
    graph has not `expected_vertices`, and nothing is stored then."""
    wanted = {"directions": sorted({check_direction(d) for d in directions}), **options}
    digest = table_digest(edges, **wanted)
    try:
        graph, fresh = open_graph(edges.sparkSession, path, digest), False
    except StaleSnapshot:
        graph, fresh = Graph.from_edges(edges, **options), True
    if expected_vertices is not None and graph.num_vertices != expected_vertices:
        raise ValueError(f"the edges have {graph.num_vertices} vertices, not {expected_vertices}")
    if not fresh:
        return graph
    save_graph(graph, path, directions, digest)
    graph.unpersist()
    return open_graph(edges.sparkSession, path, digest)
