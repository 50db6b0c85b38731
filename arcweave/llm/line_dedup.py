"""Line dedup by distinct-site spread, in DataFrame functions only.

A line is boilerplate if at least MIN_SITES sites carry it. Sites are counted per line hash by HyperLogLog sketches,
which merge by partial aggregation, so a line in a third of all rows is one sketch per task before it moves. Lines whose
estimate lies within the sketch's error of the threshold are counted exactly. Boilerplate is then removed where it stands.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.llm.store import named, stored, table

MIN_SITES = 10
LG_K = 9
HASH = ["h1", "h2"]
#: White space of Unicode: what lines lose at their ends before they are compared.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def near_band(min_sites: int, lg_k: int = LG_K) -> tuple[float, float]:
    """Estimates in between need an exact count: five standard errors of the sketch, and one site."""
    off = 5 * 1.04 / math.sqrt(1 << lg_k) * min_sites + 1
    return min_sites - off, min_sites + off


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h1, h2 of the lines (h1, h2, site) that at least min_sites sites carry."""
    low, high = near_band(min_sites)
    spread = lines.groupBy(*HASH).agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"))
    spread = stored(spread.where(F.col("sites") >= low), "line-spread")
    near = spread.where(F.col("sites") <= high).select(*HASH)
    exact = lines.join(near, HASH, "left_semi").distinct().groupBy(*HASH).agg(F.count(F.lit(1)).alias("sites"))
    sure = spread.where(F.col("sites") > high).select(*HASH)
    return sure.unionByName(exact.where(F.col("sites") >= min_sites).select(*HASH))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """`docs` with text without its boilerplate lines, and n_lines, n_removed.

    Lines end with a line feed and are compared without Unicode white space (SPACES) at their ends; blank lines stay. Sites are
    values of `source`, null being one. Null text stays null (no lines); an empty text is one blank line. Lines that
    repeat within a document are removed together. Columns n_lines and n_removed of `docs` are replaced.
    """
    # the document is one column, so names of its columns meet none of ours
    held = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    row = F.struct(*[named(c).alias(c) for c in held]).alias("row")
    keyed = docs.select(row, F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key"))
    site = F.coalesce(F.concat(F.lit("="), F.col("row.source")), F.lit(""))
    line = F.btrim("line", F.lit(SPACES))
    rows = keyed.select("key", site.alias("site"), F.posexplode(F.split("row.text", "\n")).alias("at", "line")).where(line != "")
    rows = rows.select("key", "site", "at", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"))
    rows = stored(rows, "lines")
    marked = stored(boilerplate(rows.select(*HASH, "site"), min_sites), "line-boilerplate")
    removed = rows.select("key", "at", *HASH).join(marked, HASH, "left_semi").select("key", "at").distinct()
    removed = stored(removed.groupBy("key").agg(F.array_sort(F.collect_list("at")).alias("gone")), "line-removed")
    joined = keyed.join(removed, "key", "left").withColumn("lines", F.split("row.text", "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.array_join(F.transform(kept, lambda at: F.get("lines", at)), "\n")
    clean = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(text)
    return joined.select(
        *[(clean if c == "text" else F.col("row").getField(c)).alias(c) for c in held],
        F.when(F.col("row.text").isNull(), F.lit(0)).otherwise(F.size("lines")).cast("bigint").alias("n_lines"),
        F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("bigint").alias("n_removed"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = remove_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return clean.select("doc_id", "n_lines", "n_removed", digest.alias("text_sha256"))


OP8_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS site, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT *, trim(line, '{SPACES}') AS bare FROM (SELECT doc_id, site, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d)),
b AS (SELECT bare AS t FROM l WHERE bare <> '' GROUP BY 1 HAVING count(DISTINCT site) >= {MIN_SITES}),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n FROM l WHERE bare NOT IN (SELECT t FROM b) GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ls), 0) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.text, '')) AS text_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
