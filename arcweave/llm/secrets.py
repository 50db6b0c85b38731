"""Secret scans with multipart credential linking, in DataFrame functions only.

Base patterns are always reported. Weak candidates - endpoints and blobs that could be anything - are reported only if
a complementary part lies within SCOPE characters: an access identifier for a blob, any base span for an endpoint. The
link is an interval semi-join: both sides are cut into buckets of SCOPE characters, so a text's spans meet only their
neighbourhood, and no pair is emitted.

Spans depend on the text alone, so texts meet by digest and copies are scanned for links once. Positions come from the
lengths of the pieces between matches, summed by a window over a text's matches. Kinds whose group is the whole match
look for matches of the least length at once, so short runs never become rows. Weak patterns are matched only in texts
with a base span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcweave.llm.store import stored, table

#: kind -> pattern, in the order of the report. A run of letters that is too short has no part that is long enough, so
#: access and hex ask for the least length themselves; an assignment may hide another one, so its length is tested later.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"(AKIA[A-Z0-9]{16,})",
    "hex": r"([0-9a-f]{24,})",
    "endpoint": r"(https?://[A-Za-z0-9.-]+(?::[0-9]+)?)",
    "blob": r"([A-Za-z0-9+/_-]{20,}={0,2})",
}
#: Least length of the pattern's group.
LEAST = {"assign": 6, "access": 20, "hex": 24, "endpoint": 11, "blob": 20}
BASE, WEAK = ("assign", "access", "hex"), ("endpoint", "blob")
#: No text without a match of it has a base span.
ANY = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
SCOPE = 256


def _matches(text: Column, kind: str) -> Column:
    """Per match: length of the piece before it, of the match, and of its group. The last piece has no match."""
    pattern = F.lit(PATTERNS[kind])
    before = F.transform(F.split(text, PATTERNS[kind], -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    group = whole if kind != "assign" else F.transform(F.regexp_extract_all(text, pattern, F.lit(1)), F.length)
    return F.arrays_zip(before.alias("before"), whole.alias("whole"), group.alias("group"))


def _spans(texts: DataFrame, kinds) -> DataFrame:
    """key, kind, first, last (exclusive, in code points) of the matches in texts (key, text)."""
    found = texts.select("key", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), _matches(F.col("text"), k).alias("ms")) for k in kinds])).alias("x"))
    rows = found.select("key", "x.kind", F.posexplode("x.ms").alias("i", "m")).where("m.whole IS NOT NULL")
    rows = rows.select("key", "kind", "i", "m.before", "m.whole", "m.group").dropDuplicates(["key", "kind", "i"])
    upto = Window.partitionBy("key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    last = F.sum(F.col("before") + F.col("whole")).over(upto)
    least = F.expr("CASE kind " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in LEAST.items()) + " END")
    placed = rows.withColumn("last", last).where(F.col("group") >= least)
    return placed.select("key", "kind", (F.col("last") - F.col("whole")).alias("first"), "last")


def _linked(base: DataFrame, weak: DataFrame) -> DataFrame:
    """The weak spans with a complementary base span within SCOPE, outside of all base spans."""
    bucket = lambda a, b: F.explode(F.sequence(F.floor(a / SCOPE), F.floor(b / SCOPE))).alias("bucket")
    anchors = base.select("key", F.col("kind").alias("b_kind"), F.col("first").alias("b_first"), F.col("last").alias("b_last"))
    near = anchors.select("*", bucket(F.greatest(F.col("b_first") - SCOPE, F.lit(0)), F.col("b_last") + SCOPE)).hint("merge")  # grows with the corpus
    cells = weak.select("*", bucket(F.col("first"), F.col("last")))
    same = [cells["key"] == near["key"], cells["bucket"] == near["bucket"]]
    inside = (near["b_first"] < cells["last"]) & (near["b_last"] > cells["first"])
    apart = F.greatest(near["b_first"] - cells["last"], cells["first"] - near["b_last"]) <= SCOPE
    fits = (cells["kind"] == "endpoint") | (near["b_kind"] == "access")
    linked = cells.join(near, [*same, apart & fits], "left_semi").select("key", "kind", "first", "last").distinct()
    cells = linked.select("*", bucket(F.col("first"), F.col("last")))
    same = [cells["key"] == near["key"], cells["bucket"] == near["bucket"]]
    inside = (near["b_first"] < cells["last"]) & (near["b_last"] > cells["first"])
    covered = cells.join(near, [*same, inside], "left_semi").select("key", "kind", "first", "last").distinct()
    return linked.join(covered.hint("merge"), ["key", "kind", "first", "last"], "left_anti")


def _listed(kinds) -> Column:
    """kind:first:last of the collected spans of these kinds, by first and the order of kinds, comma-joined."""
    order = F.expr("CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(PATTERNS)) + " END")
    spans = F.sort_array(F.collect_list(F.when(F.col("kind").isin(*kinds), F.struct("first", order.alias("o"), "kind", "last"))))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"], s["last"])), ",")


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of `docs`; other columns are not read.

    Matches are leftmost and do not overlap within a kind; those whose group is too short are dropped after matching.
    Positions are code points, ends exclusive. Null and empty texts have no spans (base_sha256 is that of the empty
    string, spans is empty). Rows that repeat are reported each. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    marked = rows.select("doc_id", F.when(F.col("text").rlike(ANY), F.unhex(F.sha2(F.col("text").cast("binary"), 256))).alias("key"), "text")
    scanned = stored(
        marked.select("doc_id", "key", F.when(F.col("key").isNotNull(), F.col("text")).alias("text")), "secret-texts"
    )
    hits = scanned.where("key IS NOT NULL")
    base = stored(_spans(hits.select("key", "text"), BASE), "secret-base")
    based = base.select("key").distinct().hint("merge")
    weak = stored(_spans(hits.select("key", "text").join(based, "key", "left_semi"), WEAK), "secret-weak")
    spans = base.unionByName(_linked(base, weak))
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE]
    listed = stored(
        spans.groupBy("key").agg(*counts, _listed(BASE).alias("base"), _listed(PATTERNS).alias("spans")), "secret-listed"
    )
    found = hits.select("doc_id", "key").join(listed.hint("merge"), "key", "left").drop("key")
    clean = scanned.where("key IS NULL").select("doc_id")
    every = found.unionByName(clean, allowMissingColumns=True)
    return every.select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("bigint").alias(f"n_{k}") for k in BASE],
        F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


#: As the report defines them: any length, dropped after matching.
_SQL_PATTERNS = PATTERNS | {"access": "(AKIA[A-Z0-9]+)", "hex": "([0-9a-f]+)"}


def _sql_matches(order: int, kind: str, table: str) -> str:
    pattern = _SQL_PATTERNS[kind].replace("'", "''")
    return (
        f"SELECT doc_id, '{kind}' AS kind, {order} AS o, {LEAST[kind]} AS least, regexp_extract_all(t, '{pattern}', 0) AS ms, "
        f"regexp_extract_all(t, '{pattern}', 1) AS gs, regexp_split_to_array(t, '{pattern}') AS ps FROM {table}"
    )


def _sql_spans(kinds, table: str) -> str:
    matches = " UNION ALL ".join(_sql_matches(list(PATTERNS).index(k), k, table) for k in kinds)
    return f"""SELECT doc_id, kind, o, b - n AS a, b FROM (SELECT doc_id, kind, o, least, length(ms[i]) AS n, length(gs[i]) AS g,
  CAST(list_sum(list_transform(ps[1:i], lambda z: length(z))) + list_sum(list_transform(ms[1:i], lambda z: length(z))) AS BIGINT) AS b
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM ({matches}))) WHERE g >= least"""


OP9_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS MATERIALIZED ({_sql_spans(BASE, 'd')}),
based AS (SELECT * FROM d WHERE doc_id IN (SELECT doc_id FROM base)),
weak AS MATERIALIZED ({_sql_spans(WEAK, 'based')}),
near AS (SELECT DISTINCT w.* FROM weak w JOIN base x ON x.doc_id = w.doc_id AND greatest(x.a - w.b, w.a - x.b) <= {SCOPE} AND (w.kind = 'endpoint' OR x.kind = 'access')),
every AS (SELECT * FROM base UNION ALL SELECT n.* FROM near n WHERE NOT EXISTS (SELECT 1 FROM base x WHERE x.doc_id = n.doc_id AND x.a < n.b AND x.b > n.a)),
s AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(concat(kind, ':', a, ':', b), ',' ORDER BY a, o) FILTER (o < 3) AS base, string_agg(concat(kind, ':', a, ':', b), ',' ORDER BY a, o) AS spans FROM every GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s USING (doc_id)
"""
