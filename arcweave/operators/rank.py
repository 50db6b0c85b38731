"""PageRank and batched personalized PageRank with top-k."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcweave.functions.checks import check_rank_options, check_reserved
from arcweave.operators.graph import Graph, check_graph
from arcweave.operators.ids import dense_index
from arcweave.plans.runtime import recorded
from arcweave.plans.tables import discard, measured, stored

#: Convergence is tested every so many iterations, and at the last one.
AUDIT = 5
#: Queries of personalized PageRank that share a row, and the columns of their ranks.
LANES = 8
RANKS = [f"r{j}" for j in range(LANES)]
#: Digits of a score that decide ties.
TIE_DIGITS = 9


def _teleport(graph: Graph, personalization) -> DataFrame:
    """(idx, dangling, p): where a walk restarts. Uniform, or in proportion to a table (idx, weight) or {index: weight}."""
    base = graph.vertices.select("idx", "dangling")
    if personalization is None:
        return base.withColumn("p", F.lit(1.0 / graph.num_vertices))
    if isinstance(personalization, Mapping):
        personalization = graph.spark.createDataFrame([(int(i), float(w)) for i, w in personalization.items()], "idx bigint, weight double")
    given = stored(personalization.select(F.col("idx").cast("bigint"), F.col("weight").cast("double")), "personalization")
    total, n, distinct, wrong = given.agg(
        F.coalesce(F.sum("weight"), F.lit(0.0)),
        F.count(F.lit(1)),
        F.countDistinct("idx"),
        F.count_if(F.col("weight").isNull() | F.isnan("weight") | (F.col("weight") < 0) | (F.col("weight") == float("inf")) | F.col("idx").isNull() | (F.col("idx") < 0) | (F.col("idx") >= graph.num_vertices)),
    ).first()
    if wrong or n != distinct:
        raise ValueError("personalization needs one finite weight, 0 or more, for each vertex index")
    if total <= 0:
        raise ValueError("personalization must have a positive sum")
    scaled = given.select("idx", (F.col("weight") / total).alias("p"))
    return stored(base.join(scaled, "idx", "left").select("idx", "dangling", F.coalesce("p", F.lit(0.0)).alias("p")), "teleport")


def pagerank(graph: Graph, alpha: float = 0.85, tol: float = 1e-6, max_iter: int = 100, personalization=None) -> DataFrame:
    """(idx, rank) of every vertex; ranks add up to 1.

    A walk follows an out-edge by weight with probability alpha, else restarts at p; from a dangling vertex it restarts
    at p as well. Iteration ends when the L1 change at an audit is below V * tol, or after max_iter. The rank held by
    dangling vertices and the change are aggregates of the step's own write; a step moves the vertex table only.
    """
    check_graph(graph)
    check_rank_options(alpha, tol, max_iter)
    with recorded("pagerank") as info:
        if graph.num_vertices == 0:
            return graph.vertices.select("idx", F.lit(0.0).alias("rank"))
        start = _teleport(graph, personalization).withColumn("rank", F.col("p"))
        held = F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0))
        table, seen = measured(start, "rank", held=held)
        state = table
        adjacency = graph.adjacency("out")
        while info.iterations < max_iter:
            flow = adjacency.expand(state.select("idx", "rank")).groupBy(F.col("to").alias("idx")).agg(F.sum(F.col("rank") * F.col("share")).alias("flow"))
            fresh = (1 - alpha + alpha * F.lit(float(seen["held"]))) * F.col("p") + alpha * F.coalesce("flow", F.lit(0.0))
            step = state.join(flow, "idx", "left").select("idx", "dangling", "p", fresh.alias("rank"), F.abs(fresh - F.col("rank")).alias("change"))
            new, seen = measured(step, "rank", held=held, change=F.sum("change"))
            discard(table)
            table, state = new, new.drop("change")
            info.iterations += 1
            if info.iterations % AUDIT == 0 and seen["change"] < graph.num_vertices * tol:
                break
        return state.select("idx", "rank")


def _normalized_seeds(graph: Graph, seeds: DataFrame) -> tuple[DataFrame, int]:
    rows = stored(seeds.select(F.col("query_id").cast("bigint"), F.col("idx").cast("bigint"), F.col("weight").cast("double")), "seeds")
    wrong = F.col("weight").isNull() | F.isnan("weight") | (F.col("weight") < 0) | (F.col("weight") == float("inf"))
    outside = F.col("idx").isNull() | (F.col("idx") < 0) | (F.col("idx") >= graph.num_vertices) | F.col("query_id").isNull()
    bad, lost = rows.agg(F.count_if(wrong), F.count_if(outside)).first()
    if bad:
        raise ValueError("seed weights must be finite and not negative")
    if lost:
        raise ValueError("seeds must be vertex indices of numbered queries")
    merged = rows.groupBy("query_id", "idx").agg(F.sum("weight").alias("weight"))
    totals = merged.groupBy("query_id").agg(F.sum("weight").alias("total"))
    queries = stored(totals, "queries")
    if not queries.where("total <= 0").isEmpty():
        raise ValueError("a query's seed weights must have a positive sum")
    return stored(merged.join(queries, "query_id").select("query_id", "idx", (F.col("weight") / F.col("total")).alias("t")), "teleport"), queries.count()


def seeds_from_arrays(graph: Graph, seeds, seed_weights=None, seed_offsets=None) -> DataFrame:
    """(query_id, idx, weight) from packed queries: query q has seeds[seed_offsets[q] : seed_offsets[q + 1]]."""
    seeds = list(seeds)
    weights = [1.0] * len(seeds) if seed_weights is None else list(seed_weights)
    offsets = [0, len(seeds)] if seed_offsets is None else list(seed_offsets)
    if len(weights) != len(seeds):
        raise ValueError("seeds and seed_weights differ in length")
    if any(isinstance(x, bool) or not isinstance(x, int) for x in [*seeds, *offsets]):
        raise ValueError("seeds and seed_offsets must be integers")
    if not offsets or offsets[0] != 0 or offsets[-1] != len(seeds) or any(b < a for a, b in zip(offsets, offsets[1:], strict=False)):
        raise ValueError("seed_offsets must rise from 0 to the number of seeds")
    if any(b == a for a, b in zip(offsets, offsets[1:], strict=False)):
        raise ValueError("a query has no seeds")
    rows = [(q, seeds[i], float(weights[i])) for q, (a, b) in enumerate(zip(offsets, offsets[1:], strict=False)) for i in range(a, b)]
    return graph.spark.createDataFrame(rows, "query_id bigint, idx bigint, weight double")


def ppr_topk(
    graph: Graph, seeds: DataFrame, k: int = 64, alpha: float = 0.85, tol: float = 1e-6, max_iter: int = 50, edge_types=None, time_range=None
) -> DataFrame:
    """(query_id, rnk, idx, score): the k best vertices of each query's personalized PageRank.

    `seeds` (query_id, idx, weight): seeds that repeat add up, weights are normalised per query. All queries share one
    pass over the edges, LANES of them a row; only vertices with a score have rows. A query whose change falls below
    V * tol at an audit leaves its lane, and the lanes are filled up again. Scores tie at TIE_DIGITS digits, then the smaller index is first; vertices without score follow, and a
    graph with fewer than k vertices is padded with idx -1 and score 0. Ranks are cut before they move to their query.
    """
    check_graph(graph)
    check_reserved(edge_types=edge_types, time_range=time_range)
    check_rank_options(alpha, tol, max_iter)
    if k < 1:
        raise ValueError("k must be at least 1")
    with recorded("ppr_topk") as info:
        teleport, n_queries = _normalized_seeds(graph, seeds)
        adjacency = graph.adjacency("out")
        dangling = graph.vertices.where("dangling").select("idx")
        lanes = _Lanes(teleport.select("query_id", "idx", F.col("t").alias("rank")))
        state, table, finished = lanes.packed, None, []
        while info.iterations < max_iter and n_queries:
            restart = lanes.packed
            if graph.dangling_count:
                held = state.join(dangling, "idx", "left_semi").groupBy("lane").agg(*[F.sum(r).alias(f"held{j}") for j, r in enumerate(RANKS)])
                again = [(F.col(r) * (1 - alpha + alpha * F.coalesce(F.col(f"held{j}"), F.lit(0.0)))).alias(r) for j, r in enumerate(RANKS)]
                restart = restart.join(held, "lane", "left").select("lane", "idx", *again)
            else:
                restart = restart.select("lane", "idx", *[(F.col(r) * (1 - alpha)).alias(r) for r in RANKS])
            flow = adjacency.expand(state, times=lanes.count(n_queries))
            flow = flow.where("share > 0").select("lane", F.col("to").alias("idx"), *[(alpha * F.col(r) * F.col("share")).alias(r) for r in RANKS])
            new = flow.unionByName(restart).groupBy("lane", "idx").agg(*[F.sum(r).alias(r) for r in RANKS])
            new = stored(new, "ppr")
            info.iterations += 1
            if info.iterations % AUDIT == 0 and info.iterations < max_iter:
                old = state.select("lane", "idx", *[F.col(r).alias(f"old{j}") for j, r in enumerate(RANKS)])
                gaps = [F.sum(F.abs(F.coalesce(F.col(r), F.lit(0.0)) - F.coalesce(F.col(f"old{j}"), F.lit(0.0)))) for j, r in enumerate(RANKS)]
                change = new.join(old, ["lane", "idx"], "full").groupBy("lane").agg(F.array(*gaps).alias("change"))
                small = F.get("change", F.col("slot")) < graph.num_vertices * tol
                settled = stored(lanes.seats.join(change, "lane").where(small).select("query_id", "lane", "slot"), "settled")
                n_settled = settled.count()
                if n_settled:
                    finished.append(stored(lanes.unpacked(new, settled), "ppr"))
                    n_queries -= n_settled
                    left = lanes.seats.join(settled, "query_id", "left_anti")
                    ranks, seeded = lanes.unpacked(new, left), lanes.unpacked(lanes.packed, left)
                    refilled = _Lanes(seeded)
                    both, new = new, stored(refilled.pack(ranks), "ppr")
                    lanes.discard(), discard(both)
                    lanes = refilled
                discard(settled)
            if table is not None:
                discard(table)
            state = table = new
        unpacked = lanes.unpacked(state, lanes.seats)
        for part in finished:
            unpacked = unpacked.unionByName(part)
        found = top_k(graph, unpacked, k)
        lanes.discard()
        for part in [*finished, *([] if table is None else [table])]:
            discard(part)
        return found


class _Lanes:
    """Queries dealt to lanes of LANES each, and tables with a row per lane and vertex that hold a lane's queries in as many
    columns. So a step moves, joins and adds up a row where it would otherwise LANES of them.

    seats    query_id, lane, slot
    packed   lane, idx and RANKS: the ranks given at first (query_id, idx, rank)
    """

    def __init__(self, ranks: DataFrame):
        number = dense_index(ranks, "query_id")
        self.seats = stored(number.select("query_id", F.floor(F.col("idx") / LANES).alias("lane"), (F.col("idx") % LANES).cast("int").alias("slot")), "seats")
        self.packed = stored(self.pack(ranks), "lanes")

    def count(self, n_queries: int) -> int:
        return -(-n_queries // LANES)

    def pack(self, ranks: DataFrame) -> DataFrame:
        """(query_id, idx, rank) of seated queries to lanes; a query has a vertex once."""
        columns = [F.coalesce(F.sum(F.when(F.col("slot") == j, F.col("rank"))), F.lit(0.0)).alias(r) for j, r in enumerate(RANKS)]
        return ranks.join(self.seats, "query_id").groupBy("lane", "idx").agg(*columns)

    def unpacked(self, packed: DataFrame, seats: DataFrame) -> DataFrame:
        """(query_id, idx, rank) of the queries with these seats, where rank is not 0."""
        rows = packed.select("lane", "idx", F.posexplode(F.array(*RANKS)).alias("slot", "rank")).where("rank > 0")
        return rows.join(seats, ["lane", "slot"]).select("query_id", "idx", "rank")

    def discard(self) -> None:
        discard(self.seats)
        discard(self.packed)


def top_k(graph: Graph, ranks: DataFrame, k: int) -> DataFrame:
    """The k best (query_id, idx, rank) per query, filled up and padded to k rows."""
    ranks = stored(ranks.select("query_id", "idx", F.col("rank").alias("score")), "ranks")
    best = Window.partitionBy("query_id").orderBy(F.round("score", TIE_DIGITS).desc(), "idx")
    top = stored(ranks.withColumn("rnk", F.row_number().over(best)).where(F.col("rnk") <= k), "top")
    discard(ranks)
    short = top.groupBy("query_id").count().where(F.col("count") < k).select("query_id")
    # of the k smallest indices, as many as are missing have no score
    slots = short.select("query_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint"))).alias("id"))
    slots = slots.select("query_id", F.when(F.col("id") < graph.num_vertices, F.col("id")).otherwise(-1).alias("idx"), "id")
    blanks = slots.join(top.select("query_id", "idx"), ["query_id", "idx"], "left_anti").select("query_id", "idx", F.lit(0.0).alias("score"), "id")
    rows = top.select("query_id", "idx", "score", F.lit(0).cast("bigint").alias("id")).unionByName(blanks)
    order = Window.partitionBy("query_id").orderBy(F.round("score", TIE_DIGITS).desc(), F.col("idx") < 0, "idx", "id")
    return rows.withColumn("rnk", F.row_number().over(order).cast("bigint")).where(F.col("rnk") <= k).select("query_id", "rnk", "idx", "score")
