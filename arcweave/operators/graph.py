"""Immutable graph snapshots over DataFrames."""

from __future__ import annotations

from bisect import bisect_right
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from arcweave.functions.checks import MAX_INDEX, check_direction
from arcweave.operators.ids import dense_index, lookup
from arcweave.operators.joins import hub_threshold, join_value
from arcweave.plans.runtime import execution
from arcweave.plans.tables import discard, measured, partitions, stored

#: Largest finite and smallest normal single-precision numbers: bounds of a vertex's weight sum.
FLOAT_MAX, FLOAT_MIN = 3.4028234663852886e38, 1.1754943508222875e-38
#: Most rows of hubs that a step may broadcast.
HUB_ROWS = 1_000_000


class Adjacency:
    """Edges (at, to, edge_id, share) laid out for repeated expansion of vertex tables.

    Edges of ordinary vertices stay partitioned by `at`, so a step moves the vertex table, not the edges. A hub's edges
    would all lie in one partition; they are spread by `to` and meet the hubs' few rows by a broadcast whose size is
    bounded by the definition of a hub.
    """

    def __init__(self, edges: DataFrame, count: int):
        spark = edges.sparkSession
        n = partitions(spark)
        degrees = edges.groupBy("at").count()
        self.hubs, seen = measured(degrees.where(F.col("count") > hub_threshold(count, spark)).select("at"), "hubs", n=F.count(F.lit(1)))
        self.hub_count = seen["n"]
        if self.hub_count:
            hubs = F.broadcast(self.hubs)
            self.light = edges.join(hubs, "at", "left_anti").repartition(n, "at").sortWithinPartitions("at").persist()
            self.heavy = edges.join(hubs, "at", "left_semi").repartition(n, "to").persist()
        else:
            self.light, self.heavy = edges.repartition(n, "at").sortWithinPartitions("at").persist(), None
        self.dealt = n

    @classmethod
    def of_tables(cls, light: DataFrame, heavy: DataFrame | None, hubs: DataFrame | None, hub_count: int, buckets: int) -> Adjacency:
        """An adjacency that is stored in this layout already: light edges in `buckets` buckets by `at`."""
        self = object.__new__(cls)
        self.light, self.heavy = light.sortWithinPartitions("at").persist(), None if heavy is None else heavy.persist()
        self.hubs, self.hub_count, self.dealt = hubs, hub_count, buckets
        return self

    def expand(self, rows: DataFrame, times: int = 1) -> DataFrame:
        """Every edge from the vertices of `rows` (idx and more): rows' columns with idx as `at`, and to, edge_id, share.

        `times` is how often a vertex may occur in rows.
        """
        rows = rows.withColumnRenamed("idx", "at")
        if execution() == "distributed":
            rows = rows.hint("merge")
        # dealt as the edges are, so that they stay where they lie also if the session now asks for other partitions
        dealt = rows if self.dealt == partitions(rows.sparkSession) else rows.repartition(self.dealt, "at")
        out = self.light.join(dealt, "at")
        if self.heavy is None:
            return out
        mine = rows.join(F.broadcast(self.hubs), "at", "left_semi")
        if self.hub_count * times <= HUB_ROWS:  # in both modes, or a hub's edges would meet in one task
            mine = F.broadcast(mine)
        return out.unionByName(self.heavy.join(mine, "at"))

    def unpersist(self) -> None:
        self.light.unpersist()
        if self.heavy is not None:
            self.heavy.unpersist()


class Graph:
    """A snapshot: vertices with dense indices 0..V-1 in the order of their external ids, and edges over them.

    vertices   idx, ext_id, out_wsum, out_deg, in_deg, dangling
    edges      edge_id, src, dst, weight           as given, in indices
    stored     edge_id, src, dst, weight           undirected edges both ways, loops once

    Duplicate edges and loops are kept. A vertex dangles if the weights of its stored out-edges add up to 0.
    """

    #: Of a graph that was opened: the folders of its vertices and of the ranges of their files, and those once read.
    vertex_files: tuple[str, str] | None = None
    _ranges: list[tuple] | None = None

    def __init__(self):
        raise TypeError("use Graph.from_edges")

    @classmethod
    def from_edges(
        cls,
        edges: DataFrame,
        src: str = "src",
        dst: str = "dst",
        weight: str | None = None,
        edge_id: str | None = None,
        directed: bool = True,
        num_vertices: int | None = None,
        ids: str = "auto",
    ) -> Graph:
        """Build from a table of edges.

        With num_vertices, ids are indices already and vertices without edges exist; else the ids that occur, integers
        or strings, are the vertices. Without an edge_id column, edges are numbered from 0 in order of (src, dst,
        weight). Null endpoints, negative or non-finite weights and indices out of range raise ValueError.
        """
        if ids != "auto":
            raise ValueError('ids must be "auto"')
        for name in filter(None, (src, dst, weight, edge_id)):
            if name not in edges.columns:
                raise ValueError(f"the edges have no column {name!r}")
        kinds = [edges.schema[c].dataType for c in (src, dst)]
        strings = [isinstance(k, StringType) for k in kinds]
        if not all(s or isinstance(k, IntegralType) for s, k in zip(strings, kinds, strict=True)) or strings[0] != strings[1]:
            raise ValueError("src and dst must both be integers or both be strings")
        if num_vertices is not None and (not 0 <= num_vertices <= MAX_INDEX or strings[0]):
            raise ValueError(f"num_vertices must lie between 0 and {MAX_INDEX}, and ids must be integers with it")
        key = "string" if strings[0] else "bigint"
        rows = edges.select(
            (F.col(edge_id) if edge_id else F.lit(None)).cast("bigint").alias("edge_id"),
            F.col(src).cast(key).alias("src"),
            F.col(dst).cast(key).alias("dst"),
            (F.col(weight).cast("float").cast("double") if weight else F.lit(1.0)).alias("weight"),
        )
        wrong = F.col("weight").isNull() | F.isnan("weight") | (F.col("weight") < 0) | (F.col("weight") > FLOAT_MAX)
        ends = F.greatest("src", "dst"), F.least("src", "dst")
        rows, seen = measured(
            rows,
            "edges-in",
            n=F.count(F.lit(1)),
            bad=F.count_if(wrong),
            open_ends=F.count_if(F.col("src").isNull() | F.col("dst").isNull()),
            most=F.max(ends[0]),
            least=F.min(ends[1]),
            unnumbered=F.count_if(F.col("edge_id").isNull()),
        )
        n, bad, open_ends, most, least, unnumbered = (seen[k] for k in ("n", "bad", "open_ends", "most", "least", "unnumbered"))
        if bad:
            raise ValueError("weights must be finite and not negative")
        if open_ends:
            raise ValueError("edges must have both endpoints")
        if n > MAX_INDEX:
            raise ValueError("too many edges")
        if num_vertices is not None and n and (least < 0 or most >= num_vertices):
            raise ValueError("an endpoint lies outside of num_vertices")
        if edge_id and unnumbered:
            raise ValueError("edge ids must not be null")
        if not edge_id:
            given, rows = rows, _numbered(rows)
            discard(given)
        spark = edges.sparkSession
        if num_vertices is None:
            universe = rows.select(F.col("src").alias("ext_id")).union(rows.select("dst"))
            vertices = dense_index(universe, "ext_id", counted=True)
        else:
            vertices = spark.range(num_vertices).select(F.col("id").alias("ext_id"), F.col("id").alias("idx"), F.lit(0).cast("bigint").alias("occurs"))
        return cls._build(rows, vertices, directed, weight is not None, n, num_vertices is not None)

    @classmethod
    def from_universe(cls, edges: DataFrame, universe: DataFrame, directed: bool = True, weighted: bool = False) -> Graph:
        """Build over given vertices (ext_id): edges (edge_id, src, dst, weight) in external ids; isolated ones survive."""
        edges = stored(edges, "edges-in")
        ends = edges.select(F.explode(F.array("src", "dst")).alias("ext_id")).groupBy("ext_id").agg(F.count(F.lit(1)).alias("occurs"))
        known = dense_index(universe, "ext_id").join(ends, "ext_id", "left")
        return cls._build(edges, known.select("ext_id", "idx", F.coalesce("occurs", F.lit(0)).alias("occurs")), directed, weighted, edges.count(), False)

    @classmethod
    def _build(cls, rows: DataFrame, vertices: DataFrame, directed: bool, weighted: bool, n: int, identity: bool) -> Graph:
        self = object.__new__(cls)
        self.spark, self.directed, self.weighted, self.identity, self.num_edges = rows.sparkSession, directed, weighted, identity, n
        hub = F.col("occurs") > hub_threshold(n, self.spark)  # over both ends, so there may be twice as many as of one
        vertices, seen = measured(vertices, "ids", n=F.count(F.lit(1)), hubs=F.count_if(hub))  # removed below; `rows` as well, once replaced
        self.num_vertices = seen["n"]
        if self.num_vertices > MAX_INDEX:
            raise ValueError("too many vertices")
        if identity:
            self.edges = rows
        else:
            given = rows
            for end in ("src", "dst"):
                known = vertices.select(F.col("ext_id").alias(end), F.col("idx").alias(f"{end}_idx"), "occurs")
                rows = join_value(rows, known, end, f"{end}_idx", known.where(hub) if seen["hubs"] else None)
            self.edges = stored(rows.select("edge_id", F.col("src_idx").alias("src"), F.col("dst_idx").alias("dst"), "weight"), "edges")
            discard(given)
        self.stored = self.edges
        if not directed:
            self.stored = self.both_ways(self.edges)
        out = self.stored.groupBy("src").agg(F.sum("weight").alias("out_wsum"), F.count(F.lit(1)).alias("out_deg"))
        into = self.stored.groupBy("dst").agg(F.count(F.lit(1)).alias("in_deg"))
        joined = vertices.join(out, vertices["idx"] == out["src"], "left").join(into, vertices["idx"] == into["dst"], "left")
        total = F.when(F.col("out_wsum") < FLOAT_MIN, 0.0).otherwise(F.coalesce("out_wsum", F.lit(0.0)))
        zero = F.lit(0).cast("bigint")
        self.vertices, seen = measured(
            joined.select("idx", "ext_id", total.alias("out_wsum"), F.coalesce("out_deg", zero).alias("out_deg"), F.coalesce("in_deg", zero).alias("in_deg")).withColumn(
                "dangling", F.col("out_wsum") == 0
            ),
            "vertices",
            most=F.max("out_wsum"),
            stored=F.coalesce(F.sum("out_deg"), zero),
            dangling=F.count_if("dangling"),
            most_out=F.coalesce(F.max("out_deg"), zero),
        )
        discard(vertices)
        most, self.stored_count, self.dangling_count = seen["most"], seen["stored"], seen["dangling"]
        self.most_out = seen["most_out"]
        if most is not None and most > FLOAT_MAX:
            raise ValueError("a vertex's weights have no finite float32 sum")
        self._adjacency: dict[str, Adjacency] = {}
        return self

    @staticmethod
    def both_ways(edges: DataFrame) -> DataFrame:
        """Edges and their reverses, loops once."""
        back = edges.where("src <> dst").select("edge_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
        return edges.unionByName(back)

    def adjacency(self, direction: str) -> Adjacency:
        """Laid out on first use. share is the edge's part of its source's out-weight (0 if that is 0)."""
        direction = check_direction(direction)
        if not self.directed:
            direction = "out"
        if direction not in self._adjacency:
            weights = self.vertices.select(F.col("idx").alias("src"), "out_wsum", "out_deg")
            share = F.when(F.col("out_wsum") > 0, F.col("weight") / F.col("out_wsum")).otherwise(0.0)
            there = lambda: self.stored.select(F.col("src").alias("at"), F.col("dst").alias("to"), "edge_id")
            back = lambda: self.stored.select(F.col("dst").alias("at"), F.col("src").alias("to"), "edge_id")
            if direction == "out":
                n = self.stored_count
                least = hub_threshold(n, self.spark)
                hubs = weights.where(F.col("out_deg") > least) if self.most_out > least else None
                rows = join_value(self.stored, weights, "src", "out_wsum", hubs).select(F.col("src").alias("at"), F.col("dst").alias("to"), "edge_id", share.alias("share"))
            elif direction == "in":
                rows, n = back().withColumn("share", F.lit(0.0)), self.stored_count
            else:
                rows, n = there().unionByName(back()).withColumn("share", F.lit(0.0)), 2 * self.stored_count
            self._adjacency[direction] = Adjacency(rows, n)
        return self._adjacency[direction]

    def laid_out(self, direction: str) -> bool:
        """Whether an adjacency of this direction exists already, from an earlier step or a stored graph."""
        return (direction if self.directed else "out") in self._adjacency

    def transpose(self) -> DataFrame:
        """Stored edges with their ends swapped."""
        return self.stored.select("edge_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")

    @cached_property
    def most_out(self) -> int:
        """Largest out-degree; known from the build, or read from a graph that was opened."""
        return self.vertices.agg(F.max("out_deg")).first()[0] or 0

    @cached_property
    def external_ids(self) -> DataFrame:
        """(idx, ext_id) of all vertices."""
        return self.vertices.select("idx", "ext_id")

    def index_of(self, ids):
        """Indices of external ids: an int for one id, a list for a list, a table with idx for a table with ext_id."""
        if isinstance(ids, DataFrame):
            return lookup(ids, self.vertices)
        many = isinstance(ids, (list, tuple))
        wanted = list(ids) if many else [ids]
        kind = dict(self.vertices.dtypes)["ext_id"]
        if any(isinstance(x, bool) or not isinstance(x, str if kind == "string" else int) for x in wanted):
            raise ValueError(f"vertex ids are of type {kind}")
        if not wanted:
            return []
        known = {r.ext_id: r.idx for r in self.vertices_with(wanted).collect()}
        for x in wanted:
            if x not in known:
                raise ValueError(f"unknown vertex id {x!r}")
        return [known[x] for x in wanted] if many else known[wanted[0]]

    def vertices_with(self, ids: list) -> DataFrame:
        """(ext_id, idx) of those of `ids` that are vertices.

        The ids are a filter that reaches the files. A graph that was opened knows the range of ids in each file, a row
        a file, and reads only files whose range has one of them.
        """
        table = self.vertices
        if self.vertex_files is not None:
            folder, ranges = self.vertex_files
            if self._ranges is None:
                self._ranges = sorted((r.low, r.high, r.file) for r in self.spark.read.parquet(ranges).collect())
            lows = [low for low, _, _ in self._ranges]
            places = {bisect_right(lows, x) - 1 for x in ids}
            files = [self._ranges[i][2] for i in sorted(places) if i >= 0 and any(self._ranges[i][0] <= x <= self._ranges[i][1] for x in ids)]
            if not files:
                return table.where(F.lit(False)).select("ext_id", "idx")
            table = self.spark.read.schema(table.schema).parquet(*[f"{folder}/{f}" for f in files])
        return table.where(F.col("ext_id").isin(list(dict.fromkeys(ids)))).select("ext_id", "idx")

    def unpersist(self) -> None:
        for a in self._adjacency.values():
            a.unpersist()
        self._adjacency.clear()

    def __repr__(self) -> str:
        kind = "directed" if self.directed else "undirected"
        return f"Graph({self.num_vertices} vertices, {self.num_edges} edges, {kind}, {'weighted' if self.weighted else 'unweighted'})"


def _numbered(rows: DataFrame) -> DataFrame:
    """edge_id in order of (src, dst, weight); equal edges are interchangeable, and ranges may part them."""
    n = partitions(rows.sparkSession)
    rows = rows.select("src", "dst", "weight", F.monotonically_increasing_id().alias("salt"))
    ranged = rows.repartitionByRange(n, "src", "dst", "weight", "salt").drop("salt").withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "edge-ranges")
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    starts = sizes.selectExpr("part", "coalesce(sum(size) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start")
    place = F.row_number().over(Window.partitionBy("part").orderBy("src", "dst", "weight")) - 1
    placed = ranged.withColumn("place", place).join(F.broadcast(starts), "part")
    numbered = stored(placed.select((F.col("start") + F.col("place")).alias("edge_id"), "src", "dst", "weight"), "edges-numbered")
    discard(ranged)
    return numbered


def check_graph(graph) -> Graph:
    if not isinstance(graph, Graph):
        raise TypeError("expected a Graph")
    return graph
