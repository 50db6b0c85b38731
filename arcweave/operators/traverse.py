"""Breadth-first search and bounded neighbourhoods."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from arcweave.functions.checks import check_cap, check_direction, check_reserved
from arcweave.operators.graph import Graph, check_graph
from arcweave.operators.ids import dense_index
from arcweave.operators.selection import first_rows
from arcweave.plans.runtime import recorded
from arcweave.plans.tables import discard, fresh_path, remove, stored

#: Segments of a search that are merged at a time.
MERGE = 8
#: A level is found from the unvisited side if the frontier has more than so many times the edges that lead to unvisited
#: vertices: those edges are exchanged twice and do not combine, the frontier's once and combined.
BOTTOM_UP = 4
REVERSE = {"out": "in", "in": "out", "both": "both"}


def _sources(graph: Graph, sources) -> DataFrame:
    """Distinct vertex indices, from an int, a list or a table with idx."""
    if not isinstance(sources, DataFrame):
        many = sources if isinstance(sources, (list, tuple, set, range)) else [sources]
        if any(isinstance(x, bool) or not isinstance(x, int) for x in many):
            raise ValueError("vertex indices must be integers")
        sources = graph.spark.createDataFrame([(x,) for x in many], "idx bigint")
    rows = stored(sources.select(F.col("idx").cast("bigint").alias("idx")).distinct(), "sources")
    if not rows.where(F.col("idx").isNull() | (F.col("idx") < 0) | (F.col("idx") >= graph.num_vertices)).isEmpty():
        raise ValueError("a vertex index is out of range")
    return rows


class _Levels:
    """Levels of a search as stored segments below one path, read back as one table.

    MERGE neighbouring segments of a size class become one of the next class, so there are at most MERGE * log(depth)
    of them and a vertex is written log(depth) times.
    """

    SCHEMA = "idx bigint, dist bigint, parent bigint"

    def __init__(self, graph: Graph, start: DataFrame, direction: str):
        self.graph, self.path, self.depth, self.reached = graph, fresh_path(graph.spark, "levels"), 0, 0
        self.segments: list[tuple[int, str]] = []
        self.direction = direction if graph.directed else "out"
        ends = {"out": F.col("out_deg"), "in": F.col("in_deg"), "both": F.col("out_deg") + F.col("in_deg")}
        self.degrees = graph.vertices.select("idx", ends[self.direction].alias("ahead"), ends[REVERSE[self.direction]].alias("behind"))
        #: Edges from the frontier, and edges that lead to unvisited vertices; how each level was found and the edges it read.
        self.ahead, self.behind = 0, graph.stored_count * (2 if self.direction == "both" else 1)
        self.touched: list[tuple[str, int]] = []
        self.size = self.add(start.select("idx", F.lit(0).cast("bigint").alias("dist"), F.lit(-1).cast("bigint").alias("parent")))
        discard(start)

    def add(self, rows: DataFrame) -> int:
        seen = Observation()
        self.frontier = f"{self.path}/level={self.depth}"
        rows = rows.join(self.degrees, "idx").observe(seen, F.count(F.lit(1)).alias("n"), F.sum("ahead").alias("ahead"), F.sum("behind").alias("behind"))
        rows.select("idx", "dist", "parent").write.parquet(self.frontier)
        size = int(seen.get["n"])
        self.reached += size
        self.ahead = int(seen.get["ahead"] or 0)
        self.behind -= int(seen.get["behind"] or 0)
        self.segments.append((0, self.frontier))
        while len(self.segments) >= MERGE and len({c for c, _ in self.segments[-MERGE:]}) == 1:
            last = self.segments[-MERGE:]
            merged = stored(self._table([p for _, p in last]), "levels-merged")
            self.segments[-MERGE:] = [(last[0][0] + 1, merged.stored_at)]
            for _, p in last:
                if p != self.frontier:
                    remove(self.graph.spark, p)
        return size

    def _table(self, paths: list[str]) -> DataFrame:
        return self.graph.spark.read.schema(self.SCHEMA).parquet(*paths)

    def read(self) -> DataFrame:
        return self._table([p for _, p in self.segments])

    def first(self, cap: int | None) -> DataFrame:
        """The indices of the `cap` first vertices by level and index, stored: whole levels, and a part of the last.

        A search for `cap` vertices ends with the level that reaches it, so no other is cut.
        """
        if cap is None or self.reached <= cap:
            return stored(self.read().select("idx"), "reached")
        last = self._table([self.frontier]).select("idx")
        cut = first_rows(last, ["idx"], cap - (self.reached - self.size), "reached-last")
        found = stored(self.read().where(F.col("dist") < self.depth).select("idx").unionByName(cut), "reached")
        discard(cut)
        return found

    def remove(self) -> None:
        """Remove all segments, once nothing reads them."""
        remove(self.graph.spark, self.path)
        for _, p in self.segments:
            if not p.startswith(f"{self.path}/"):
                remove(self.graph.spark, p)

    def step(self) -> int:
        """Add the next level: unvisited neighbours, each with its smallest parent on the frontier.

        Found from the frontier's edges or, if far fewer edges lead to unvisited vertices and are laid out that way, from
        those. Both give the same rows.
        """
        self.depth += 1
        back = REVERSE[self.direction]
        upwards = self.graph.laid_out(back) and self.ahead > BOTTOM_UP * self.behind
        self.touched.append(("up", self.behind) if upwards else ("down", self.ahead))
        frontier = self._table([self.frontier]).select("idx")
        found = self._upwards(frontier) if upwards else self._downwards(frontier)
        self.size = self.add(found.select("idx", F.lit(self.depth).cast("bigint").alias("dist"), "parent"))
        return self.size

    def _downwards(self, frontier: DataFrame) -> DataFrame:
        """(idx, parent) of the next level, from the edges of the frontier."""
        found = self.graph.adjacency(self.direction).expand(frontier).groupBy(F.col("to").alias("idx")).agg(F.min("at").alias("parent"))
        return found.join(self.read().select("idx"), "idx", "left_anti")

    def _upwards(self, frontier: DataFrame) -> DataFrame:
        """(idx, parent) of the next level, from the edges that lead to unvisited vertices.

        Those that come from a hub would all meet in one task, so they are told by a broadcast of the hubs, as bounded as
        in an Adjacency, with whether each is on the frontier; they go into the exchange under keys of their own.
        """
        unvisited = self.degrees.where("behind > 0").select("idx").join(self.read().select("idx"), "idx", "left_anti")
        probes = self.graph.adjacency(REVERSE[self.direction]).expand(unvisited).select(F.col("at").alias("idx"), F.col("to").alias("parent"))
        ahead = self.graph.adjacency(self.direction) if self.graph.laid_out(self.direction) else None
        if ahead is None or not ahead.hub_count:
            met = probes.join(frontier.withColumnRenamed("idx", "parent"), "parent", "left_semi")
        else:
            on = frontier.select(F.col("idx").alias("at"), F.lit(True).alias("on"))
            hubs = ahead.hubs.join(on, "at", "left").select(F.col("at").alias("parent"), F.coalesce("on", F.lit(False)).alias("hub_on"))
            keyed = probes.join(F.broadcast(hubs), "parent", "left").withColumn("key", F.when(F.col("hub_on").isNull(), F.col("parent")).otherwise(-1 - F.col("idx")))
            met = keyed.join(frontier.select(F.col("idx").alias("key"), F.lit(True).alias("light_on")), "key", "left").where("hub_on OR light_on")
        return met.groupBy("idx").agg(F.min("parent").alias("parent"))


def bfs(graph: Graph, sources, direction: str = "out", output: str = "dense") -> DataFrame:
    """(idx, dist, parent): hops from the nearest source and the smallest vertex one hop nearer.

    direction follows edges out, in or both ways. Dense output has every vertex, -1 where none reaches; sparse output
    has the reached ones, in order. Sources have dist 0 and parent -1. A level is one expansion, one partial aggregate
    and one anti-join with what was visited; where the reverse direction is laid out, large levels are found from the
    edges of unvisited vertices.
    """
    check_graph(graph)
    direction = check_direction(direction)
    if output not in ("dense", "sparse"):
        raise ValueError('output must be "dense" or "sparse"')
    with recorded("bfs") as info:
        levels = _Levels(graph, _sources(graph, sources), direction)
        size = levels.size
        while size:
            info.iterations += 1
            size = levels.step()
        reached = levels.read()
        if output == "sparse":
            return reached.orderBy("idx")
        every = graph.vertices.select("idx").join(reached, "idx", "left")
        return every.select("idx", F.coalesce("dist", F.lit(-1)).cast("bigint").alias("dist"), F.coalesce("parent", F.lit(-1)).cast("bigint").alias("parent"))


@dataclass
class Neighborhood:
    """vertices: idx, in order. edges: edge_id, in order, of input edges with both ends among them. graph: if asked for."""

    vertices: DataFrame
    edges: DataFrame
    graph: Graph | None = None


def k_hop(
    graph: Graph,
    seeds,
    k: int = 2,
    direction: str = "both",
    max_vertices: int | None = None,
    max_edges: int | None = None,
    as_graph: bool = False,
    edge_types=None,
    time_range=None,
) -> Neighborhood:
    """Vertices within k hops of the seeds and the edges among them, whatever their direction.

    max_vertices counts seeds: levels are admitted whole until one would exceed it, which is cut by ascending index.
    max_edges keeps the smallest edge ids. Both cuts are by ranges, so no task sorts more than one of them. None and 0 are no cap. as_graph builds a graph over the external ids of the
    vertices, isolated ones included, with edges numbered anew in the order of their old ids.
    """
    check_graph(graph)
    check_reserved(edge_types=edge_types, time_range=time_range)
    direction = check_direction(direction)
    if isinstance(k, bool) or not isinstance(k, int) or k < 0:
        raise ValueError("k must not be negative")
    max_vertices, max_edges = check_cap("max_vertices", max_vertices), check_cap("max_edges", max_edges)
    with recorded("k_hop") as info:
        levels = _Levels(graph, _sources(graph, seeds), direction)
        size = levels.size
        while size and levels.depth < k and (max_vertices is None or levels.reached < max_vertices):
            info.iterations += 1
            size = levels.step()
        reached = levels.first(max_vertices)
        levels.remove()
        edges = graph.edges.join(reached.withColumnRenamed("idx", "src"), "src", "left_semi")
        edges = edges.join(reached.withColumnRenamed("idx", "dst"), "dst", "left_semi")
        edges = edges.select("edge_id", "src", "dst", "weight")
        edges = stored(edges, "induced") if max_edges is None else first_rows(edges, ["edge_id"], max_edges, "induced")
        result = Neighborhood(reached.orderBy("idx"), edges.select("edge_id").orderBy("edge_id"))
        if as_graph:
            result.graph = _subgraph(graph, reached, edges)
        return result


def _subgraph(graph: Graph, reached: DataFrame, edges: DataFrame) -> Graph:
    names = stored(graph.external_ids.join(reached, "idx", "left_semi"), "names")
    numbers = dense_index(edges, "edge_id").withColumnRenamed("idx", "number")
    rows = stored(edges.join(numbers, "edge_id").select(F.col("number").alias("edge_id"), "src", "dst", "weight"), "subgraph-edges")
    for end in ("src", "dst"):
        rows = stored(rows.join(names.select(F.col("idx").alias(end), F.col("ext_id").alias(f"{end}_id")), end), "subgraph-half")
    rows = rows.select("edge_id", F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "weight")
    return Graph.from_universe(rows, names.select("ext_id"), graph.directed, graph.weighted)
