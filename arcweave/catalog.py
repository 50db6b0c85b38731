"""Queries of the graph operators over relational tables, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.functions.shipping import shipped
from arcweave.operators import degrees
from arcweave.operators.components import wcc
from arcweave.operators.graph import Graph
from arcweave.operators.rank import AUDIT, pagerank, ppr_topk, seeds_from_arrays
from arcweave.operators.traverse import bfs, k_hop
from arcweave.plans.tables import fresh_path
from arcweave.sources import relations as rel
from arcweave.sources.files import read_edge_text
from arcweave.sources.generate import power_law, rmat
from arcweave.sources.snapshots import cached_graph, load_edges, save_edges

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
#: Iterations of the rank queries; the tolerance is too small to end them earlier.
STEPS, TOL = 10, 1e-18

EDGES = {
    "sp": "SELECT l_suppkey AS src, l_partkey + 1000000 AS dst, CAST(CAST(sum(l_quantity) AS FLOAT) AS DOUBLE) AS weight FROM lineitem GROUP BY 1, 2",
    "cs": "SELECT o_custkey + 2000000 AS src, l_suppkey AS dst, CAST(CAST(round(sum(l_extendedprice), 2) AS FLOAT) AS DOUBLE) AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2",
    "cs_multi": "SELECT o_custkey + 2000000 AS src, l_suppkey AS dst, CAST(1 AS DOUBLE) AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "hier": "SELECT CAST(n_regionkey AS BIGINT) AS src, CAST(n_nationkey + 100 AS BIGINT) AS dst, CAST(1 AS DOUBLE) AS weight FROM nation UNION ALL SELECT CAST(c_nationkey + 100 AS BIGINT), c_custkey + 2000000, 1 FROM customer UNION ALL SELECT o_custkey + 2000000, o_orderkey + 10000000, 1 FROM orders",
    "evt": "SELECT * FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst, CAST(1 AS DOUBLE) AS weight FROM events) WHERE dst IS NOT NULL",
    "evchain": "SELECT * FROM (SELECT event_id AS src, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst, CAST(1 AS DOUBLE) AS weight FROM events) WHERE dst IS NOT NULL",
    "conv": "SELECT * FROM (SELECT conv_id * 1000 + turn AS src, lead(conv_id * 1000 + turn) OVER (PARTITION BY conv_id ORDER BY turn) AS dst, CAST(1 AS DOUBLE) AS weight FROM conversations) WHERE dst IS NOT NULL",
    "dup": "SELECT doc_id AS src, min(doc_id) OVER (PARTITION BY md5(text)) AS dst, CAST(1 AS DOUBLE) AS weight FROM documents",
    "web": "SELECT url AS src, regexp_extract(url, '//([^/]*)', 1) AS dst, CAST(1 AS DOUBLE) AS weight FROM pages",
}


def graph_of(spark: SparkSession, sf_dir: str, name: str, directed: bool = True, weighted: bool = False) -> Graph:
    """The graph that EDGES[name] describes, by the DataFrame way."""
    make = {
        "sp": rel.supplier_part,
        "cs": rel.customer_supplier,
        "cs_multi": lambda s, d: rel.customer_supplier(s, d, multi=True),
        "hier": rel.hierarchy,
        "evt": rel.event_transitions,
        "evchain": rel.event_chains,
        "conv": rel.conversation_turns,
        "dup": rel.equal_documents,
        "web": rel.page_hosts,
    }[name]
    return Graph.from_edges(make(spark, sf_dir), weight="weight" if weighted else None, directed=directed)


def reopened(edges: DataFrame, weighted: bool = False, **options) -> Graph:
    """The graph of these edges, stored and opened again."""
    path = fresh_path(edges.sparkSession, "graph")
    if weighted:
        options["weight"] = "weight"
    cached_graph(edges, path, **options)
    return cached_graph(edges, path, **options)


def _sql(name: str, tail: str, directed: bool = True, weighted: bool = False, ctes: str = "") -> str:
    """tail over v(ext_id, idx), g(edge_id, src, dst, weight), s (stored edges) and the given ones."""
    weight = "weight" if weighted else "CAST(1 AS DOUBLE) AS weight"
    both = "" if directed else " UNION ALL SELECT edge_id, dst, src, weight FROM g WHERE src <> dst"
    return f"""WITH RECURSIVE e AS (SELECT src, dst, {weight} FROM ({EDGES[name]})),
v AS (SELECT ext_id, row_number() OVER (ORDER BY ext_id) - 1 AS idx FROM (SELECT src AS ext_id FROM e UNION SELECT dst FROM e)),
g AS MATERIALIZED (SELECT row_number() OVER (ORDER BY e.src, e.dst, e.weight) - 1 AS edge_id, a.idx AS src, b.idx AS dst, e.weight FROM e JOIN v a ON a.ext_id = e.src JOIN v b ON b.ext_id = e.dst),
s AS MATERIALIZED (SELECT edge_id, src, dst, weight FROM g{both}){", " + ctes if ctes else ""}
{tail}"""


def _add(name: str, query: Query, oracle: str | None) -> None:
    _QUERIES[name] = shipped(query)
    if oracle:
        _ORACLES[name] = oracle


# building and identity

EDGE_COLUMNS = ["edge_id", "src", "dst", "weight"]
_add("build_edges_directed", lambda s, d: graph_of(s, d, "sp", weighted=True).stored.select(*EDGE_COLUMNS), _sql("sp", "SELECT edge_id, src, dst, weight FROM s", weighted=True))
_add(
    "build_edges_undirected",
    lambda s, d: graph_of(s, d, "sp", directed=False, weighted=True).stored.select(*EDGE_COLUMNS),
    _sql("sp", "SELECT edge_id, src, dst, weight FROM s", directed=False, weighted=True),
)
_add("build_edges_multigraph", lambda s, d: graph_of(s, d, "cs_multi").stored.select(*EDGE_COLUMNS), _sql("cs_multi", "SELECT edge_id, src, dst, weight FROM s"))
_add("factorize_int_ids", lambda s, d: graph_of(s, d, "cs").external_ids, _sql("cs", "SELECT idx, ext_id FROM v"))
_add("factorize_string_ids", lambda s, d: graph_of(s, d, "web").external_ids, _sql("web", "SELECT idx, ext_id FROM v"))


def _index_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = rel.page_hosts(spark, sf_dir).select(F.col("dst").alias("ext_id")).distinct()
    return graph_of(spark, sf_dir, "web").index_of(hosts).select("ext_id", "idx")


_add("index_of_lookup", _index_of, _sql("web", "SELECT ext_id, idx FROM v WHERE ext_id IN (SELECT dst FROM e)"))


def _identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_regionkey").alias("src"), F.col("n_nationkey").alias("dst"))
    tail = edges.agg(F.max("dst")).first()[0] + 16  # fifteen vertices without edges at the end
    return Graph.from_edges(edges, num_vertices=tail).vertices.select("idx", "ext_id", "out_deg", "in_deg", "dangling")


_add(
    "identity_vertices",
    _identity,
    """WITH v AS (SELECT unnest(range((SELECT max(n_nationkey) + 16 FROM nation))) AS idx), o AS (SELECT n_regionkey AS idx, count(*) AS n FROM nation GROUP BY 1), i AS (SELECT n_nationkey AS idx, count(*) AS n FROM nation GROUP BY 1)
SELECT v.idx, v.idx AS ext_id, coalesce(o.n, 0) AS out_deg, coalesce(i.n, 0) AS in_deg, o.n IS NULL AS dangling FROM v LEFT JOIN o USING (idx) LEFT JOIN i USING (idx)""",
)
_add("transpose_edges", lambda s, d: graph_of(s, d, "cs", weighted=True).transpose(), _sql("cs", "SELECT edge_id, dst AS src, src AS dst, weight FROM s", weighted=True))



def _index_of_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indices of a list of ids and of a single one."""
    graph, wanted = graph_of(spark, sf_dir, "evchain"), [5, 0, 17, 5]
    found = [*graph.index_of(wanted), graph.index_of(9)]
    return spark.createDataFrame(list(enumerate(found)), "place bigint, idx bigint")


_add("index_of_list", _index_of_list, _sql("evchain", "SELECT place, idx FROM (VALUES (0::BIGINT, 5), (1, 0), (2, 17), (3, 5), (4, 9)) x(place, ext_id) JOIN v USING (ext_id)"))



def _index_of_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indices of pages' URLs in a stored graph, looked up in the files that hold them, against a join with all of them."""
    graph = reopened(rel.page_hosts(spark, sf_dir))
    low, high = graph.vertices.agg(F.min("ext_id"), F.max("ext_id")).first()
    found = graph.index_of([low, high, low])
    return spark.createDataFrame(list(enumerate(found)), "place bigint, idx bigint")


_add(
    "index_of_reopened",
    _index_of_reopened,
    _sql("web", "SELECT place, idx FROM (SELECT unnest([0, 1, 2])::BIGINT AS place, unnest([lo, hi, lo]) AS ext_id FROM (SELECT min(ext_id) AS lo, max(ext_id) AS hi FROM v)) JOIN v USING (ext_id)"),
)

# sources


def _edge_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges written as lines of text between comments, compressed, and read again."""
    path = fresh_path(spark, "edge-text")
    lines = rel.supplier_part(spark, sf_dir).select(F.concat_ws("\t", "src", F.concat(F.lit(" "), "dst", F.lit(" "))).alias("value"))
    lines.union(spark.createDataFrame([("# a comment",), ("",), ("  # another",)], "value string")).write.option("compression", "gzip").text(path)
    return read_edge_text(spark, path)


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "snapshot")
    save_edges(rel.customer_supplier(spark, sf_dir), path)
    return load_edges(spark, path).select("src", "dst", F.round("weight", 2).alias("weight"))


def _generated(make) -> Query:
    """Bounds of a generated graph that is as large as a given table; make gives it and its number of vertices."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        edges, vertices = make(spark, spark.read.parquet(f"{sf_dir}/lineitem.parquet").count())
        outside = F.count_if((F.least("src", "dst") < 0) | (F.greatest("src", "dst") >= vertices))
        return edges.agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("edge_id").alias("ids"), outside.alias("outside"))

    return run


def _rmat_like(spark: SparkSession, lines: int) -> tuple[DataFrame, int]:
    """Eight edges a vertex, and at least half as many as there are lines."""
    scale = max(lines // 8, 1).bit_length() - 1
    return rmat(spark, scale, 8), 1 << scale


_add("edge_text_lines", _edge_text, _sql("sp", "SELECT DISTINCT e.src, e.dst FROM e"))
_add("snapshot_round_trip", _snapshot, "SELECT o_custkey + 2000000 AS src, l_suppkey AS dst, round(sum(l_extendedprice), 2) AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2")
_add("rmat_bounds", _generated(_rmat_like), "WITH n AS (SELECT 8 * (1::BIGINT << CAST(floor(log2(greatest(count(*) // 8, 1))) AS INT)) AS n FROM lineitem) SELECT n AS edges, n AS ids, 0 AS outside FROM n")
_add("power_law_bounds", _generated(lambda s, n: (power_law(s, n // 8 + 1, n), n // 8 + 1)), "SELECT count(*) AS edges, count(*) AS ids, 0 AS outside FROM lineitem")

# degrees

_add(
    "out_weight_sum",
    lambda s, d: graph_of(s, d, "sp", weighted=True).vertices.select("idx", "out_wsum"),
    _sql("sp", "SELECT v.idx, coalesce(sum(weight), 0) AS out_wsum FROM v LEFT JOIN s ON s.src = v.idx GROUP BY 1", weighted=True),
)
_add("dangling_vertices", lambda s, d: graph_of(s, d, "cs").vertices.where("dangling").select("idx", "ext_id"), _sql("cs", "SELECT idx, ext_id FROM v WHERE idx NOT IN (SELECT src FROM s)"))
_DEGREE = "deg AS (SELECT v.idx, count(s.{0}) AS d FROM v LEFT JOIN s ON s.{0} = v.idx GROUP BY 1)"
for _way, _end in (("out", "src"), ("in", "dst")):
    _add(
        f"degree_{_way}",
        lambda s, d, way=_way: degrees.degree_histogram(graph_of(s, d, "cs_multi"), way),
        _sql("cs_multi", "SELECT d AS degree, count(*) AS vertices FROM deg GROUP BY 1", ctes=_DEGREE.format(_end)),
    )
_add(
    "degree_bins",
    lambda s, d: degrees.degree_bins(graph_of(s, d, "sp", directed=False)),
    _sql(
        "sp",
        "SELECT CASE WHEN d >= 16384 THEN 'huge' WHEN d >= 1024 THEN 'high' WHEN d >= 32 THEN 'mid' WHEN d >= 1 THEN 'low' ELSE 'zero' END AS bin, count(*) AS vertices, CAST(sum(d) AS BIGINT) AS edges FROM deg GROUP BY 1",
        directed=False,
        ctes=_DEGREE.format("src"),
    ),
)

# ranks


def _rank_sql(name: str, directed: bool, weighted: bool, teleport: str = "SELECT idx, CAST(1 AS DOUBLE) / count(*) OVER () AS p FROM v", steps: int = STEPS, tol: float = TOL) -> str:
    ctes = f"""o AS (SELECT src, sum(weight) AS ows FROM s GROUP BY 1), a AS MATERIALIZED (SELECT s.src, s.dst, s.weight / o.ows AS p FROM s JOIN o USING (src) WHERE ows > 0),
dang AS MATERIALIZED (SELECT idx FROM v WHERE idx NOT IN (SELECT src FROM a)), t AS MATERIALIZED ({teleport}),
pr AS (SELECT 0 AS i, idx, p AS r FROM t UNION ALL
  SELECT k.i + 1, t.idx, (0.15 + 0.85 * d.m) * t.p + 0.85 * coalesce(f.acc, 0) FROM t CROSS JOIN (SELECT max(i) AS i FROM pr) k
  CROSS JOIN (SELECT coalesce(sum(r), 0) AS m FROM pr WHERE idx IN (SELECT idx FROM dang)) d
  LEFT JOIN (SELECT a.dst, sum(a.p * pr.r) AS acc FROM a JOIN pr ON a.src = pr.idx GROUP BY 1) f ON f.dst = t.idx WHERE k.i < {steps})"""
    last = f"i = {steps}"
    if tol > TOL:  # the first audit with a small change ends the iteration
        ctes += f""", gap AS (SELECT n.i, sum(abs(n.r - o.r)) AS change FROM pr n JOIN pr o ON o.idx = n.idx AND o.i = n.i - 1 GROUP BY 1),
stop AS (SELECT coalesce(min(i), {steps}) AS i FROM gap WHERE i % {AUDIT} = 0 AND change < (SELECT count(*) FROM v) * {tol!r})"""
        last = "i = (SELECT i FROM stop)"
    return _sql(name, f"SELECT idx, round(r, 9) AS rank FROM pr WHERE {last}", directed, weighted, ctes)


def _ranked(name: str, directed: bool, weighted: bool, personal=None, steps: int = STEPS, tol: float = TOL) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        graph = graph_of(spark, sf_dir, name, directed, weighted)
        given = personal(graph) if personal else None
        return pagerank(graph, tol=tol, max_iter=steps, personalization=given).select("idx", F.round("rank", 9).alias("rank"))

    return run


for _key, _args in {
    "pagerank_unweighted": ("sp", False, False),
    "pagerank_weighted": ("sp", False, True),
    "pagerank_undirected": ("cs", False, True),
    "pagerank_dangling": ("cs", True, True),
    "pagerank_multigraph": ("cs_multi", True, False),
    "pagerank_loops": ("evt", True, False),
}.items():
    _add(_key, _ranked(*_args), _rank_sql(*_args))
_add(
    "pagerank_personalized",
    _ranked("cs", True, True, lambda g: g.vertices.select("idx", (F.col("idx") % 5).cast("double").alias("weight"))),
    _rank_sql("cs", True, True, "SELECT idx, CAST(idx % 5 AS DOUBLE) / (SELECT sum(idx % 5) FROM v) AS p FROM v"),
)
_add(
    "pagerank_personalized_dict",
    _ranked("cs", False, True, lambda g: {3: 1.5, 11: 4.0, 42: 2.5}),
    _rank_sql("cs", False, True, "SELECT idx, (CASE idx WHEN 3 THEN 1.5 WHEN 11 THEN 4.0 WHEN 42 THEN 2.5 ELSE 0.0 END)::DOUBLE / 8 AS p FROM v"),
)

# ended by their tolerance, at an audit before the last step
for _key, _args, _tol in (("pagerank_converged", ("cs", False, True), 1e-5), ("pagerank_converged_loops", ("evt", True, False), 1e-6)):
    _add(_key, _ranked(*_args, steps=60, tol=_tol), _rank_sql(*_args, steps=60, tol=_tol))


_add(
    "pagerank_reopened",
    lambda s, d: pagerank(reopened(rel.customer_supplier(s, d), weighted=True, directed=False), tol=TOL, max_iter=STEPS).select("idx", F.round("rank", 9).alias("rank")),
    _rank_sql("cs", False, True),
)


def _ppr_sql(name: str, directed: bool, weighted: bool, seeds: str, k: int, steps: int = STEPS, tol: float = TOL) -> str:
    ctes = f"""o AS (SELECT src, sum(weight) AS ows FROM s GROUP BY 1), a AS MATERIALIZED (SELECT s.src, s.dst, s.weight / o.ows AS p FROM s JOIN o USING (src) WHERE ows > 0),
dang AS MATERIALIZED (SELECT idx FROM v WHERE idx NOT IN (SELECT src FROM a)), seeds AS ({seeds}),
n AS (SELECT query_id, idx, sum(weight) AS w FROM seeds GROUP BY 1, 2), q AS (SELECT query_id, sum(w) AS total FROM n GROUP BY 1),
t AS MATERIALIZED (SELECT q.query_id, v.idx, coalesce(n.w, 0) / q.total AS p FROM q CROSS JOIN v LEFT JOIN n ON n.query_id = q.query_id AND n.idx = v.idx),
pr AS (SELECT 0 AS i, query_id, idx, p AS r FROM t UNION ALL
  SELECT k.i + 1, t.query_id, t.idx, (0.15 + 0.85 * coalesce(d.m, 0)) * t.p + 0.85 * coalesce(f.acc, 0) FROM t CROSS JOIN (SELECT max(i) AS i FROM pr) k
  LEFT JOIN (SELECT query_id, sum(r) AS m FROM pr WHERE idx IN (SELECT idx FROM dang) GROUP BY 1) d ON d.query_id = t.query_id
  LEFT JOIN (SELECT query_id, a.dst, sum(a.p * pr.r) AS acc FROM a JOIN pr ON a.src = pr.idx GROUP BY 1, 2) f ON f.dst = t.idx AND f.query_id = t.query_id WHERE k.i < {steps}),
gap AS (SELECT n.i, n.query_id, sum(abs(n.r - o.r)) AS change FROM pr n JOIN pr o ON o.idx = n.idx AND o.query_id = n.query_id AND o.i = n.i - 1 GROUP BY 1, 2),
stop AS (SELECT query_id, coalesce(min(i) FILTER (i % {AUDIT} = 0 AND change < (SELECT count(*) FROM v) * {tol!r}::DOUBLE), {steps}) AS i FROM gap GROUP BY 1),
top AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(r, 9) DESC, idx) AS rnk, idx, round(r, 9) AS score FROM pr JOIN stop USING (query_id, i) QUALIFY rnk <= {k}),
pad AS (SELECT q.query_id, unnest(range((SELECT count(*) FROM v) + 1, {k} + 1)) AS rnk, CAST(-1 AS BIGINT) AS idx, CAST(0 AS DOUBLE) AS score FROM q)"""
    return _sql(name, "SELECT query_id, rnk, idx, score FROM top UNION ALL SELECT * FROM pad", directed, weighted, ctes)


def _ppr(name: str, directed: bool, weighted: bool, seeds, k: int, steps: int = STEPS, tol: float = TOL) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        graph = graph_of(spark, sf_dir, name, directed, weighted)
        found = ppr_topk(graph, seeds(graph), k=k, tol=tol, max_iter=steps)
        return found.select("query_id", "rnk", "idx", F.round("score", 9).alias("score"))

    return run


def _spread_seeds(graph: Graph) -> DataFrame:
    return graph.vertices.where("idx % 97 = 0").selectExpr("idx % 4 AS query_id", "idx", "CAST(1 + idx % 3 AS DOUBLE) AS weight")


def _repeated_seeds(graph: Graph) -> DataFrame:
    """Two packed queries; the first names a vertex three times."""
    return seeds_from_arrays(graph, [6, 17, 6, 6, 31], [0.5, 2.0, 1.25, 0.25, 3.0], [0, 4, 5])


_REPEATED = "SELECT * FROM (VALUES (0::BIGINT, 6::BIGINT, 0.5::DOUBLE), (0, 17, 2.0), (0, 6, 1.25), (0, 6, 0.25), (1, 31, 3.0)) x(query_id, idx, weight)"


def _few_seeds(graph: Graph) -> DataFrame:
    return graph.spark.createDataFrame([(0, 0, 1.0), (1, 2, 1.0), (1, 3, 3.0)], "query_id bigint, idx bigint, weight double")


_add("ppr_topk_batch", _ppr("sp", False, True, _spread_seeds, 64), _ppr_sql("sp", False, True, "SELECT idx % 4 AS query_id, idx, CAST(1 + idx % 3 AS DOUBLE) AS weight FROM v WHERE idx % 97 = 0", 64))
_add("ppr_topk_dup_seeds", _ppr("sp", False, True, _repeated_seeds, 10), _ppr_sql("sp", False, True, _REPEATED, 10))
_add("ppr_topk_dangling", _ppr("cs", True, True, _repeated_seeds, 30), _ppr_sql("cs", True, True, _REPEATED, 30))
_add("ppr_topk_pad", _ppr("evt", True, False, _few_seeds, 12), _ppr_sql("evt", True, False, "SELECT * FROM (VALUES (0::BIGINT, 0::BIGINT, 1.0::DOUBLE), (1, 2, 1.0), (1, 3, 3.0)) x(query_id, idx, weight)", 12))

# the first query is spread wide and set aside at an earlier audit than the second, which starts at one vertex
_add(
    "ppr_topk_frozen",
    _ppr("sp", False, True, lambda g: g.vertices.where("idx % 3 = 0").selectExpr("CAST(0 AS BIGINT) AS query_id", "idx", "CAST(1 AS DOUBLE) AS weight").union(g.vertices.where("idx = 1").selectExpr("CAST(1 AS BIGINT)", "idx", "CAST(1 AS DOUBLE)")), 20, 60, 5e-5),
    _ppr_sql("sp", False, True, "SELECT 0 AS query_id, idx, CAST(1 AS DOUBLE) AS weight FROM v WHERE idx % 3 = 0 UNION ALL SELECT 1, idx, 1 FROM v WHERE idx = 1", 20, 60, 5e-5),
)

# traversal


def _walk(direction: str, directed: bool = True) -> str:
    there, back = "SELECT src AS a, dst AS b FROM s", "SELECT dst AS a, src AS b FROM s"
    return there if direction == "out" or not directed else back if direction == "in" else f"{there} UNION ALL {back}"


def _bfs_ctes(sources: str, direction: str, directed: bool = True) -> str:
    return f"""w AS MATERIALIZED ({_walk(direction, directed)}), src0 AS ({sources}),
reach(x, d) USING KEY (x) AS (SELECT idx, CAST(0 AS BIGINT) FROM src0 UNION
  SELECT w.b, min(reach.d) + 1 FROM reach JOIN w ON w.a = reach.x WHERE NOT EXISTS (SELECT 1 FROM recurring.reach o WHERE o.x = w.b) GROUP BY w.b),
par AS (SELECT c.x, min(p.x) AS parent FROM reach c JOIN w ON w.b = c.x JOIN reach p ON p.x = w.a AND p.d = c.d - 1 GROUP BY 1)"""


_DENSE = "SELECT v.idx, coalesce(r.d, -1) AS dist, coalesce(par.parent, -1) AS parent FROM v LEFT JOIN reach r ON r.x = v.idx LEFT JOIN par ON par.x = v.idx"
_SPARSE = "SELECT r.x AS idx, r.d AS dist, coalesce(par.parent, -1) AS parent FROM reach r LEFT JOIN par ON par.x = r.x"


def _bfs(name: str, sources, direction: str, output: str = "dense", directed: bool = True) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        graph = graph_of(spark, sf_dir, name, directed)
        start = sources(graph) if callable(sources) else sources
        return bfs(graph, start, direction, output)

    return run


_FIRST = "SELECT CAST(0 AS BIGINT) AS idx"
for _key, (_name, _start, _from, _dir, _out, _directed) in {
    "bfs_out": ("hier", 0, _FIRST, "out", "dense", True),
    "bfs_in": ("hier", lambda g: g.vertices.where("idx % 1000 = 999").select("idx"), "SELECT idx FROM v WHERE idx % 1000 = 999", "in", "dense", True),
    "bfs_both": ("cs", 0, _FIRST, "both", "dense", True),
    "bfs_multi_source": ("conv", lambda g: g.vertices.where("idx % 10 IN (0, 5)").select("idx"), "SELECT idx FROM v WHERE idx % 10 IN (0, 5)", "out", "dense", True),
    "bfs_sparse": ("hier", [1, 3, 3], "SELECT CAST(unnest([1, 3]) AS BIGINT) AS idx", "out", "sparse", True),
    "bfs_undirected": ("cs", 0, _FIRST, "out", "dense", False),
    "bfs_undirected_sp": ("sp", 0, _FIRST, "out", "dense", False),
}.items():
    _add(_key, _bfs(_name, _start, _dir, _out, _directed), _sql(_name, _DENSE if _out == "dense" else _SPARSE, _directed, ctes=_bfs_ctes(_from, _dir, _directed)))
_add(
    "bfs_frontier_sizes",
    lambda s, d: bfs(graph_of(s, d, "hier"), 0, output="sparse").groupBy("dist").agg(F.count(F.lit(1)).alias("vertices")),
    _sql("hier", "SELECT d AS dist, count(*) AS vertices FROM reach GROUP BY 1", ctes=_bfs_ctes(_FIRST, "out")),
)


def _khop(name: str, part: str, directed: bool = True, **options) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(k_hop(graph_of(spark, sf_dir, name, directed), [0, 7], **options), part)

    return run


def _khop_sql(name: str, tail: str, k: int, direction: str = "both", directed: bool = True, cap: int | None = None) -> str:
    limit = f" ORDER BY d, x LIMIT {cap}" if cap else ""
    ctes = _bfs_ctes("SELECT CAST(unnest([0, 7]) AS BIGINT) AS idx", direction, directed) + f", r AS (SELECT x AS idx FROM reach WHERE d <= {k}{limit})"
    return _sql(name, tail, directed, ctes=ctes)


_INSIDE = "SELECT edge_id FROM g WHERE src IN (SELECT idx FROM r) AND dst IN (SELECT idx FROM r)"
_add("khop_vertices", _khop("hier", "vertices", k=2, direction="out"), _khop_sql("hier", "SELECT idx FROM r", 2, "out"))
_add("khop_k0", _khop("sp", "edges", k=0), _khop_sql("sp", _INSIDE, 0))


def _khop_subgraph(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sub = k_hop(graph_of(spark, sf_dir, name), [0, 7], k=1, as_graph=True).graph
        names = sub.external_ids
        ends = sub.edges.join(names.select(F.col("idx").alias("src"), F.col("ext_id").alias("src_id")), "src")
        return ends.join(names.select(F.col("idx").alias("dst"), F.col("ext_id").alias("dst_id")), "dst").select("edge_id", "src", "dst", "src_id", "dst_id")

    return run


for _name, _tag in (("cs", ""), ("sp", "_sp")):
    _add(f"khop_edges{_tag}", _khop(_name, "edges", directed=False, k=2), _khop_sql(_name, _INSIDE, 2, directed=False))
    _add(f"khop_capped_vertices{_tag}", _khop(_name, "vertices", k=3, max_vertices=25), _khop_sql(_name, "SELECT idx FROM r", 3, cap=25))
    _add(f"khop_capped_edges{_tag}", _khop(_name, "edges", k=3, max_edges=7), _khop_sql(_name, f"{_INSIDE} ORDER BY edge_id LIMIT 7", 3))
    _add(
        f"khop_subgraph{_tag}",
        _khop_subgraph(_name),
        _khop_sql(
            _name,
            """SELECT row_number() OVER (ORDER BY g.edge_id) - 1 AS edge_id, a.n AS src, b.n AS dst, a.ext_id AS src_id, b.ext_id AS dst_id FROM g
JOIN (SELECT v.idx, ext_id, row_number() OVER (ORDER BY ext_id) - 1 AS n FROM v JOIN r USING (idx)) a ON a.idx = g.src
JOIN (SELECT v.idx, ext_id, row_number() OVER (ORDER BY ext_id) - 1 AS n FROM v JOIN r USING (idx)) b ON b.idx = g.dst""",
            1,
        ),
    )

# components

_WCC = """y AS MATERIALIZED (SELECT src AS a, dst AS b FROM g UNION SELECT dst, src FROM g),
lab(x, l) USING KEY (x) AS (SELECT idx, idx FROM v UNION
  SELECT y.b, min(lab.l) FROM lab JOIN y ON y.a = lab.x JOIN recurring.lab o ON o.x = y.b WHERE lab.l < o.l GROUP BY y.b),
comp AS (SELECT x AS idx, dense_rank() OVER (ORDER BY l) - 1 AS comp FROM lab)"""
for _name in ("dup", "conv", "cs", "sp", "evchain"):
    _add(f"wcc_labels_{_name}", lambda s, d, name=_name: wcc(graph_of(s, d, name)), _sql(_name, "SELECT idx, comp FROM comp", ctes=_WCC))
_add(
    "wcc_sizes",
    lambda s, d: wcc(graph_of(s, d, "dup", directed=False)).groupBy("comp").agg(F.count(F.lit(1)).alias("vertices")),
    _sql("dup", "SELECT comp, count(*) AS vertices FROM comp GROUP BY 1", directed=False, ctes=_WCC),
)
_add("wcc_count", lambda s, d: wcc(graph_of(s, d, "conv")).agg(F.countDistinct("comp").alias("components")), _sql("conv", "SELECT count(DISTINCT comp) AS components FROM comp", ctes=_WCC))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
