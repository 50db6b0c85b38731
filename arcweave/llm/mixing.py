"""Mixing sources to target weights by weighted fair queueing.

Every source is a flow. Its documents are served in a shuffled order, pass after pass, as packets: a document's pass is
one, unless it is longer than 1 / SLICES of its source's target, when it is served in packets of that size. A packet's
virtual finish time is the source's cumulative words, up to its end, divided by the source's target. All packets are
range-sorted by virtual finish (then source and place), and the sorted words are truncated at the total budget: a
prefix sum over the ranges' totals finds the range that the budget ends in, one over that range's packets the packet,
which is cut. That place is the whole decision: a document takes its packets before it. As finish times are relative to
the targets, each source ends within a packet of its target.

Cumulative words are a two-level prefix sum too. Rows are range-sorted by source and shuffled order, with the row's own
number last, so a source, an id or a row that makes up a third of the table is spread over as many ranges; only totals
by range and source are summed along a source. No window or task holds all sources.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcweave.llm.store import named, shuffle_partitions, stored, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
#: Packets that a source's target is served in, at least, where its documents are long.
SLICES = 1024
KEYS = ["no_source", "source_key"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _numbered_sources(sources: DataFrame) -> DataFrame:
    """`sources` with seat, from 1 in order of code points, without source last; by ranges, of which one row each meets."""
    n = shuffle_partitions(sources.sparkSession)
    ranged = stored(sources.repartitionByRange(n, *KEYS).withColumn("range", F.spark_partition_id()), "mix-sources")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*KEYS))
    return ranged.withColumn("place", place).join(F.broadcast(starts), "range").withColumn("seat", F.col("start") + F.col("place")).drop("range", "place", "start")


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """`sources` (no_source, source_key, source_size) with target: `share` of all words by weight, none above cap * size.

    Sources take `weights` in turn, in order of code points, without source last. The excess of capped sources is
    reshared by weight: a common level of words per weight is raised until all words are given out, and each source
    takes the lesser of its cap and level * weight. Each round takes the level as if the sources capped so far were all;
    it rises from round to round, and ends when no further source is capped. A round is one aggregate over the sources.
    """
    turn = F.expr(f"array({','.join(map(str, weights))})[(seat - 1) % {len(weights)}]").cast("bigint")
    seated = stored(_numbered_sources(sources).withColumn("weight", turn).withColumn("most", F.col("source_size") * cap), "mix-seats")
    total = seated.agg(F.sum("source_size")).first()[0] or 0
    level, capped = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("most") < F.lit(level) * F.col("weight")
        n, kept, weight = seated.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        if n == capped or not weight:
            break
        capped, level = n, (float(total) * share - kept) / weight
    most = F.col("most").cast("double")
    target = most if level is None else F.least(most, F.lit(level) * F.col("weight"))
    return seated.select(*KEYS, "source_size", target.alias("target"))


def served(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = "mix", slices: int = SLICES) -> tuple[DataFrame, int]:
    """`sized` (doc_id, source, size, digest and more) with no_source, source_key, source_size, target, packet (its
    words) and served_before, the source's words ahead of the row in the first pass; and the total budget.

    The shuffled order is that of MD5 over seed, doc_id and digest; rows that agree in all of them are interchangeable.
    Null sources are one source, null doc_ids one id.
    """
    n = shuffle_partitions(sized.sparkSession)
    ticket = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "digest").cast("binary"))
    rows = sized.withColumns(
        {"no_source": F.col("source").isNull(), "source_key": F.coalesce("source", F.lit("")), "ticket": ticket, "row": F.monotonically_increasing_id()}
    ).drop("digest")
    order = ["ticket", "size"]
    ranged = stored(rows.repartitionByRange(n, *KEYS, *order, "row").drop("row").withColumn("range", F.spark_partition_id()), "mix-ranges")
    sums = stored(ranged.groupBy(*KEYS, "range").agg(F.sum("size").alias("range_size")), "mix-sums")
    targets = source_targets(sums.groupBy(*KEYS).agg(F.sum("range_size").alias("source_size")), weights, share, cap)
    earlier = Window.partitionBy(*KEYS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("range_start", F.coalesce(F.sum("range_size").over(earlier), F.lit(0))).drop("range_size").join(targets, KEYS)
    starts = stored(starts, "mix-starts")  # as many as sources and ranges: never broadcast
    ahead = Window.partitionBy(*KEYS, "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("ahead", F.coalesce(F.sum("size").over(ahead), F.lit(0))).join(starts.hint("merge"), [*KEYS, "range"])
    packet = F.greatest(F.lit(1), F.ceil(F.col("target") / slices)).cast("bigint")
    total = sums.agg(F.sum("range_size")).first()[0] or 0
    return placed.withColumn("served_before", F.col("range_start") + F.col("ahead")).withColumn("packet", packet).drop("range", "range_start", "ahead", "ticket"), math.floor(total * min(share, cap))


def _pass_packets(cap: int) -> Column:
    """The packets of a row's passes: array of (finish, no_source, source_key, start, words), start being the source's
    words ahead of it; null for rows without words."""
    words = lambda at: F.least(F.col("packet"), F.col("size") - at)
    begin = lambda k, at: F.col("served_before") + F.col("source_size") * k + at
    packet = lambda k, at: F.struct(
        F.try_divide(begin(k, at) + words(at), F.col("target")).alias("finish"), *KEYS, begin(k, at).alias("start"), words(at).alias("words")
    )
    steps = F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.col("packet"))
    passes = F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda k: F.transform(steps, lambda at: packet(k, at)))
    return F.when(F.col("size") > 0, F.flatten(passes))


ORDER = ["finish", *KEYS, "start"]


def budget_cut(rows: DataFrame, budget: int, cap: int = CAP) -> tuple | None:
    """Where the packets of served() rows, sorted by virtual finish, reach the budget: the packet's finish, no_source,
    source_key and start, and the words that the budget has for it. None if there is room for all."""
    packets = rows.select(F.explode(_pass_packets(cap)).alias("p")).select("p.*")
    by_finish = packets.repartitionByRange(shuffle_partitions(rows.sparkSession), *ORDER)
    ranged = stored(by_finish.withColumn("range", F.spark_partition_id()), "mix-packets")
    sums = ranged.groupBy("range").agg(F.sum("words").alias("words"))  # a row per range
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    ends = sums.withColumn("upto", F.sum("words").over(upto)).where(F.col("upto") > budget).orderBy("range").first()
    if ends is None:
        return None
    running = F.sum("words").over(Window.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0))  # within one range
    inside = ranged.where(F.col("range") == ends["range"]).withColumn("upto", F.lit(ends["upto"] - ends["words"]) + running)
    room = F.lit(budget) - (F.col("upto") - F.col("words"))
    return tuple(inside.where(F.col("upto") > budget).orderBy(*ORDER).select(*ORDER, room.alias("room")).first())


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), digest.alias("digest"), *more)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = "mix", slices: int = SLICES) -> DataFrame:
    """The mix, a row per document: doc_id, size, source_size, target, taken, virtual_finish; in order of virtual finish.

    taken counts words with repeats: those of the document's packets, of passes 1 to cap, that the sorted packets have
    before the budget. Taken words add up to the budget, rounded down, and a source's to its target within two packets.
    virtual_finish is that of the whole first pass (null where the target is 0: such a source has no words). Null text
    has size 0 and null sources are one source. Rows that repeat are served one after another. Empty tables give none.
    """
    rows, budget = served(stored(_sized(docs), "mix-sizes"), weights, share, cap, seed, slices)
    cut = budget_cut(rows, budget, cap)
    if cut is None:
        taken = F.col("size") * cap
    else:
        kinds = ("double", "boolean", "string", "bigint")
        place = F.struct(*[F.lit(x).cast(k).alias(n) for x, k, n in zip(cut, kinds, ORDER, strict=False)])

        def words(p: Column) -> Column:
            at = F.struct(*[p[n].alias(n) for n in ORDER])
            return F.when(at < place, p["words"]).when(at == place, F.lit(cut[-1])).otherwise(F.lit(0)).cast("bigint")

        taken = F.coalesce(F.aggregate(_pass_packets(cap), F.lit(0).cast("bigint"), lambda sum_, p: sum_ + words(p)), F.lit(0))
    finish = F.try_divide(F.col("served_before") + F.col("size"), F.col("target"))
    return rows.select(
        "doc_id", "size", "source_size", "target", taken.cast("bigint").alias("taken"), finish.alias("virtual_finish")
    ).orderBy("virtual_finish", "doc_id")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = "mix", slices: int = SLICES) -> DataFrame:
    """`docs` repeated as the mix takes them, whole: a pass counts if the cut of mix() lies at or behind its middle word.

    So each source ends within half a document of its share. A document taken twice is two equal rows. Documents
    without words stay once if their place in the queue lies before the cut, or if their source has no words at all.
    The columns are those of `docs`, whatever their names; an empty table gives no rows.
    """
    names = docs.columns
    packed = F.struct(*[named(n).alias(n) for n in names]).alias("held")
    rows, budget = served(_sized(docs, packed), weights, share, cap, seed, slices)
    cut = budget_cut(rows.drop("held"), budget, cap)
    if cut is None:
        passes = F.lit(cap)
    else:
        middle = lambda k: F.try_divide(F.col("served_before") + F.col("source_size") * k + F.col("size") / 2, F.col("target"))
        passes = sum((F.coalesce(middle(k) <= cut[0], F.lit(True)).cast("int") for k in range(cap)), F.lit(0))
    passes = F.when(F.col("size") > 0, passes).otherwise(F.least(passes, F.lit(1)))
    repeated = rows.select("held", passes.alias("passes")).where("passes > 0").select("held", F.explode(F.sequence(F.lit(1), "passes")))
    return repeated.select(*[F.col("held").getField(n).alias(n) for n in names])


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP1_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, source IS NULL AS no_source, coalesce(source, '') AS source_key,
                  CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  md5(concat('mix:', coalesce(CAST(doc_id AS VARCHAR), 'null'), ':', md5(coalesce(text, '')))) AS ticket FROM documents),
s AS (SELECT no_source, source_key, sum(size) AS source_size, row_number() OVER (ORDER BY no_source, source_key) AS seat FROM d GROUP BY 1, 2),
w AS (SELECT *, [3, 1, 2][CAST((seat - 1) % 3 AS BIGINT) + 1] AS weight, source_size * 2 AS most FROM s),
l AS (SELECT *, most / weight AS ratio,
        ((SELECT sum(source_size) FROM w) * CAST(1.5 AS DOUBLE) - coalesce(sum(most) OVER (ORDER BY most / weight, seat ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER (ORDER BY most / weight, seat ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
c AS (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, seat LIMIT 1),
t AS (SELECT no_source, source_key, CAST(source_size AS BIGINT) AS source_size,
             coalesce(least(CAST(most AS DOUBLE), (SELECT level FROM c) * weight), CAST(most AS DOUBLE)) AS target FROM l),
q AS (SELECT d.rid, d.doc_id, d.size, t.no_source, t.source_key, t.source_size, t.target, CAST(greatest(1, ceil(t.target / {SLICES})) AS BIGINT) AS packet,
             CAST(coalesce(sum(d.size) OVER (PARTITION BY d.no_source, d.source_key ORDER BY d.ticket, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS served
      FROM d JOIN t USING (no_source, source_key)),
k AS (SELECT *, served + pass * source_size + off AS start, least(packet, size - off) AS words
      FROM (SELECT q.*, pass, unnest(range(0, size, packet)) AS off FROM q, (VALUES (0), (1)) p(pass))),
r AS (SELECT rid, words, sum(words) OVER (ORDER BY (start + words) / target, no_source, source_key, start ROWS UNBOUNDED PRECEDING) AS upto FROM k),
n AS (SELECT rid, sum(greatest(0, least(words, (SELECT floor(sum(size) * CAST(1.5 AS DOUBLE)) FROM d) - (upto - words)))) AS taken FROM r GROUP BY 1)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, CASE WHEN target > 0 THEN (served + size) / target END AS virtual_finish
FROM q LEFT JOIN n USING (rid)
"""
