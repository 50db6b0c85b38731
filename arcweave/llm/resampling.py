"""Importance resampling towards a target distribution, over a dictionary of distinct features.

1. Documents become shards of at most about `shard_words` words, and of distinct features of SHARD_BYTES: these features
   as strings with their totals, and the per-document counts as numbers of those features, in packed arrays.
2. The shards' totals add up to the dictionary: every distinct feature once, with its count in the whole corpus. Each is
   hashed there, once, and the dictionary is added up by bucket. The target's texts go the same way.
3. A bucket's gain follows from both counts. The dictionary takes the gains of its buckets, and is joined back to the
   shards' features by string, a row for each feature of a shard, so a word that every document has is a row a shard.
4. A shard's gains meet its per-document counts, without its strings, which give every document its weight.
5. A document's score adds Gumbel noise from a hash of its id, so the highest scores are a sample without replacement.
   Scores are sorted by ranges; only ranges' sizes meet in one place.

No table is broadcast but the gains, of which there are as many as buckets; a shard is the largest thing a task holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcweave.llm.decontaminate import words_of
from arcweave.llm.store import Scratch, from_planes, gives_back, named, planes, shuffle_partitions, table

RUN, BUCKETS, SALT, LEAST_WORDS, PERCENT = 1, 10_000, "2024", 20, 10
#: Words of a shard, about; a document is never cut.
SHARD_WORDS = 1_000_000
#: Bytes of a shard's distinct features, about, each with FEATURE_BYTES beside its text: long or rare words end a shard early.
SHARD_BYTES, FEATURE_BYTES = 16 << 20, 64
#: Parquet's writer looks at what it holds after 100 rows by default, and a reader decodes a whole group of so few rows.
ROW_GROUPS = {"parquet.block.row.count.limit": 4}
#: Most gains that are broadcast.
BROADCAST_GAINS = 1_000_000
_SHARD = "shard bigint, doc_ids array<bigint>, words array<bigint>, n_features array<bigint>, features array<string>, totals array<bigint>, distinct binary, codes binary, counts binary"
_NAMES = [x.split()[0] for x in _SHARD.split(", ")]
_COUNTS = [x for x in _NAMES if x not in {"features", "totals"}]


class _Numbers(dict):
    """Features by number, in the order of their first use; `held` is about their bytes."""

    held = 0

    def __missing__(self, feature: bytes) -> int:
        value = self[feature] = len(self)
        self.held += len(feature) + FEATURE_BYTES
        return value


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(planes(values), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return from_planes(pa.decompress(data, 4 * n, codec="zstd", asbytes=True))


def features_of(words: list[bytes], run: int) -> list[bytes]:
    """All runs of 1 to `run` consecutive words, joined by a blank."""
    found = list(words)
    for k in range(2, run + 1):
        found.extend(b" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
    return found


def _shard_row(shard: int, keys: list, n_words: list[int], sizes: list[int], codes: list[np.ndarray], numbers: _Numbers) -> pa.RecordBatch:
    """A shard; its features in order of their totals, so that most counts go by small numbers."""
    n, code = max(len(numbers), 1), np.concatenate(codes)
    totals = np.bincount(code, minlength=len(numbers)).astype(np.int64)
    order = np.argsort(-totals, kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    cell = np.repeat(np.arange(len(keys)) * n, sizes)
    cell += place[code]
    cell, counts = np.unique(cell, return_counts=True)
    distinct = np.bincount(cell // n, minlength=len(keys))
    words = list(numbers)
    names = pa.array([words[i].decode() for i in order.tolist()], pa.string())
    row = [
        pa.array([shard], pa.int64()),
        pa.array([keys], pa.list_(pa.int64())),
        pa.array([n_words], pa.list_(pa.int64())),
        pa.array([sizes], pa.list_(pa.int64())),
        pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names),
        pa.ListArray.from_arrays(pa.array([0, len(totals)], pa.int32()), pa.array(totals[order])),
        *[pa.array([_packed(x)], pa.binary()) for x in (distinct, cell % n, counts)],
    ]
    return pa.RecordBatch.from_arrays(row, _NAMES)


def _sharder(run: int, shard_words: int):
    """(doc_id, text) to shards."""

    @gives_back
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq = TaskContext.get().partitionId() << 32, 0
        keys, n_words, sizes, codes, numbers = [], [], [], [], _Numbers()
        held = 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py())
                found = features_of(words, run)
                keys.append(key), n_words.append(len(words)), sizes.append(len(found))
                codes.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                held += len(words) + 1
                if held >= shard_words or numbers.held >= SHARD_BYTES:
                    yield _shard_row(base + seq, keys, n_words, sizes, codes, numbers)
                    keys, n_words, sizes, codes, numbers, held, seq = [], [], [], [], _Numbers(), 0, seq + 1
        if keys:
            yield _shard_row(base + seq, keys, n_words, sizes, codes, numbers)

    return cut


def _weigh(key: tuple, shard: pa.Table, gains: pa.Table) -> pa.Table:
    """A shard and the gains of its features to a row per document."""
    row = shard.to_pylist()[0]
    gain = np.zeros(gains.num_rows, np.int64)
    gain[gains.column("place").to_numpy()] = gains.column("gain").to_numpy()
    distinct = _unpacked(row["distinct"], len(row["doc_ids"]))
    ends = np.cumsum(distinct, dtype=np.int64)
    codes, counts = (_unpacked(row[c], int(ends[-1])) for c in ("codes", "counts"))
    upto = np.r_[0, np.cumsum(gain[codes] * counts)]
    sums = upto[ends] - upto[ends - distinct]
    n = np.array(row["n_features"], np.int64)
    weight = np.where(n > 0, sums // np.maximum(n, 1), 0)
    return pa.table({"doc_id": pa.array(row["doc_ids"], pa.int64()), "words": pa.array(row["words"], pa.int64()), "n_features": n, "weight": weight})


def bucket_gains(dictionary: DataFrame, target: DataFrame, buckets: int, stored: Scratch) -> DataFrame:
    """(bucket, gain) of every bucket, from dictionaries (bucket, n) of the corpus and of the target."""
    every = dictionary.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    for name, side in (("s", dictionary), ("t", target)):
        every = every.join(side.groupBy("bucket").agg(F.sum("n").alias(name)), "bucket", "left")
    both = stored(every.na.fill(0, ["s", "t"]), "resample-buckets")
    total_s, total_t = both.agg(F.sum("s"), F.sum("t")).first()
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = (t + 1) * F.lit(float(total_s + buckets)) / ((s + 1) * F.lit(float(total_t + buckets)))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("bigint").alias("gain"))


def document_weights(docs: DataFrame, target: DataFrame, stored: Scratch, run: int = RUN, buckets: int = BUCKETS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, words, n_features, weight of every row of docs (doc_id, text)."""
    cut = _sharder(run, shard_words)

    def shards_of(rows: DataFrame) -> DataFrame:
        return stored(rows.mapInArrow(cut, _SHARD), "resample-shards", **ROW_GROUPS)

    def words_in(shards: DataFrame) -> DataFrame:
        return shards.select("shard", F.posexplode(F.arrays_zip("features", "totals")).alias("place", "x")).select("shard", "place", F.col("x.features").alias("feature"), F.col("x.totals").alias("n"))

    def dictionary_of(shards: DataFrame) -> DataFrame:
        distinct = words_in(shards).groupBy("feature").agg(F.sum("n").alias("n"))
        return distinct.withColumn("bucket", F.crc32(F.col("feature").cast("binary")) % buckets)

    shards = shards_of(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary")))
    dictionary = stored(dictionary_of(shards), "resample-dictionary")
    aim = target.select(F.lit(None).cast("bigint").alias("doc_id"), F.col("text").cast("binary"))
    gains = bucket_gains(dictionary, dictionary_of(shards_of(aim)), buckets, stored)
    named_gains = dictionary.join(F.broadcast(gains) if buckets <= BROADCAST_GAINS else gains, "bucket").select("feature", "gain")
    back = words_in(shards).select("shard", "place", "feature").join(named_gains.hint("merge"), "feature").select(F.col("shard").alias("of"), "place", "gain")
    schema = "doc_id bigint, words bigint, n_features bigint, weight bigint"
    return shards.select(_COUNTS).groupBy("shard").cogroup(back.groupBy("of")).applyInArrow(_weigh, schema)


def resampled(
    docs: DataFrame,
    target: DataFrame,
    run: int = RUN,
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    salt: str = SALT,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_features, weight, score, rank.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z, features the runs of 1 to `run` words with
    repeats. Of the N documents with at least `least_words` words, floor(percent * N / 100) are drawn by score; rank is
    null for the others. Ties go to the smaller doc_id. Null and empty texts have no features and weight 0. Rows without
    doc_id are hashed as if it were empty and follow those with one at equal scores; rows that repeat a doc_id are drawn
    on their own, in any order among equal ones. An empty table gives no rows, and an empty target favours rare buckets.
    Other columns of docs and target are not read.
    """
    stored, n = Scratch(), shuffle_partitions(docs.sparkSession)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")
    weights = document_weights(docs, target, stored, run, buckets, shard_words)
    scored = stored(weights.withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id()), "resample-scored")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    able = scored.where(F.col("words") >= least_words)
    drawn = able.count() * percent // 100
    ranged = stored(able.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "resample-ranges")
    sizes = ranged.groupBy("part").count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row per range
    starts = sizes.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    ranked = ranged.withColumn("place", place).join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + F.col("place"))
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).cast("bigint").alias("rank")
    rest = scored.where(F.col("words") < least_words)
    stored.discard_but(scored, ranged)
    return ranked.select("doc_id", "n_features", "weight", "score", rank).unionByName(rest.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("bigint").alias("rank")))


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that are drawn, with all their columns. Rows that repeat a drawn doc_id come with it; rows
    without doc_id have nothing to be drawn by and stay out."""
    ids = resampled(docs, target, **options).where("rank IS NOT NULL").select("doc_id")
    rows = docs.select(F.struct(*[named(c).alias(c) for c in docs.columns]).alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"))
    return rows.join(ids, "doc_id", "left_semi").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = rf"""
WITH RECURSIVE bits(k, i, x) AS (SELECT k, 0, k FROM range(256) r(k) UNION ALL SELECT k, i + 1, CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM bits WHERE i < 8),
crc AS (SELECT k, x FROM bits WHERE i = 8), tab AS MATERIALIZED (SELECT list(x ORDER BY k) AS xs FROM crc),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
f AS MATERIALIZED (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM d) GROUP BY 1, 2),
g AS (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM b) GROUP BY 1),
h AS MATERIALIZED (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(hx) // 2), lambda i: CAST(concat('0x', substring(hx, CAST(2 * i + 1 AS INT), 2)) AS BIGINT))),
  lambda c, y: xor(c >> 8, xs[CAST(xor(c & 255, y) AS INT) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT w, hex(encode(w)) AS hx FROM (SELECT w FROM f UNION SELECT w FROM g)), tab),
s AS (SELECT bucket, sum(n) AS s FROM f JOIN h USING (w) GROUP BY 1), t AS (SELECT bucket, sum(n) AS t FROM g JOIN h USING (w) GROUP BY 1),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(s), 0) FROM s)::DOUBLE + {BUCKETS}) / ((coalesce(s, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(t), 0) FROM t)::DOUBLE + {BUCKETS})))) AS BIGINT) AS gain
  FROM range({BUCKETS}) r(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
w AS (SELECT doc_id, CAST(sum(gain * n) AS BIGINT) AS total FROM f JOIN h USING (w) JOIN gain USING (bucket) GROUP BY 1),
x AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_features, CASE WHEN len(ws) = 0 THEN 0 ELSE (total - ((total % len(ws)) + len(ws)) % len(ws)) // len(ws) END AS weight,
  CAST(concat('0x', substring(sha256(concat('2024:', d.doc_id)), 1, 8)) AS BIGINT) AS h FROM d LEFT JOIN w USING (doc_id)),
y AS (SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM x),
z AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM y WHERE n_features >= {LEAST_WORDS} QUALIFY rank <= (SELECT {PERCENT} * count(*) // 100 FROM y WHERE n_features >= {LEAST_WORDS}))
SELECT y.doc_id, n_features, weight, score, rank FROM y LEFT JOIN z USING (doc_id)
"""
