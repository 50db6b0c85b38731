"""MinHash near-dedup with tensored banding.

A document is the set of its distinct word shingles (64-bit hashes; Jaccard similarities are computed on whole sets).

1. Documents with equal sets - known by a 128-bit digest - are one node, so groups of exact copies collapse by a partial
   aggregate. Nodes are numbered when they are written, so no two share a number.
2. Two collections of `m` short MinHash tuples (2 hashes each) give m * m tables keyed by a pair of tuples, one from
   each: 4 m hash functions where plain banding of the same selectivity needs 4 m * m. A pair at the threshold t misses
   all tables with probability below 2 (1 - t^2)^m, and m is chosen to make that at most MISS.
3. Table keys are combined inside a batch first - one row per key goes on, the rest become edges to it - and then meet
   by key, where every node points to the bucket's smallest node. So a key that a third of all documents have is a row
   per batch of them, and a bucket is read as a stream, never collected.
4. Components of those edges are families: nodes that could be linked. They are verified on whole sets, exactly: small
   ones many to a task; large ones in blocks of at most BLOCK nodes by set size (sizes further apart than the threshold
   allows never meet), first each block with itself and with one pivot block. What is linked is contracted. Loose hits
   chain into large families, so what is left of one is split by finer tables (4 hashes a tuple, of their own m), whose
   keys unlike texts rarely share and which join contracted parts only: a part that meets no other is done. What still
   meets is verified again, small groups many to a task, large ones by all block pairs that are not already inside one
   part. A task returns a spanning forest of the links it finds, not the pairs. The work on a group that stays large
   through the finer tables and still holds many unlinked texts is the square of their number in blocks, spread over
   tasks by block pair; nothing is capped.
5. Components of the verified links are the result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.llm.store import Scratch, gives_back, named, shuffle_partitions, table
from arcweave.operators.contraction import component_labels

BLOCK = 256
BLOCK_SHINGLES = 1_000_000
MISS = 1e-5
#: Hashes of a tuple: for all documents, and for those of large families.
COARSE, FINE = 2, 4
#: Table keys that a task holds at a time.
KEYS = 1_500_000
MEMO_WORDS = 400_000
_P1, _P2, _P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA24BAED4963EE407)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _P2
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes | None, k: int, memo: dict) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; of the whole sequence if it is shorter; empty without words."""
    words = text.lower().split() if text else []
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
    width = min(n, k)
    acc = h[: n - width + 1].copy()
    for j in range(1, width):
        acc = acc * _P1 + h[j : n - width + 1 + j]
    return np.unique(_mixed(acc + np.uint64(width)))


def collection_size(percent: int, width: int = COARSE) -> int:
    """m, so that a pair at the threshold escapes all tables of tuples of `width` with probability MISS at most."""
    return math.ceil(math.log(MISS / 2) / math.log(1 - (percent / 100) ** width))


def _multipliers(m: int, width: int) -> np.ndarray:
    return np.random.default_rng(20_240_611 + width).integers(1, 2**63, size=2 * width * m, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _tuples(shingles: np.ndarray, multipliers: np.ndarray, width: int) -> np.ndarray:
    """2 m tuples, each of `width` MinHash values."""
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 8192):
        np.minimum(least, (shingles[at : at + 8192, None] * multipliers).min(0), out=least)
    out = least[0::width]
    for j in range(1, width):
        out = out * _P1 + least[j::width]
    return _mixed(out)


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


_SIGNED = "doc_id bigint, text_hash bigint, n_shingles bigint, digest binary, tuples binary"


def _signer(k: int, m: int):
    """(doc_id, text_hash, text) to signed documents; digest and tuples are null without words."""

    @gives_back
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, multipliers = _WordHashes(), _multipliers(m, COARSE)
        for batch in batches:
            sizes, digests, tuples = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, k, memo)
                sizes.append(len(s))
                digests.append(set_digest(s) if len(s) else None)
                tuples.append(_tuples(s, multipliers, COARSE).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(tuples, pa.binary())],
                [x.split()[0] for x in _SIGNED.split(", ")],
            )

    return sign


def _fine_signer(m: int):
    """(node, shingles) to (node, tuples), nodes being parts that may have many sets."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = _multipliers(m, FINE)
        for batch in batches:
            tuples = [_tuples(np.frombuffer(x, np.uint64), multipliers, FINE).tobytes() for x in batch.column("shingles").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(tuples, pa.binary())], ["node", "tuples"])

    return sign


def _table_keys(m: int):
    @gives_back
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = (np.arange(m * m, dtype=np.uint64) * _P2).reshape(m, m)
        step = max(1, KEYS // (m * m))
        for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            node = batch.column("node").to_numpy(zero_copy_only=False).astype(np.int64)
            t = np.frombuffer(b"".join(batch.column("tuples").to_pylist()), np.uint64).reshape(-1, 2, m)
            key = _mixed(t[:, 0, :, None] * _P3 + _mixed(t[:, 1, None, :] + salt)).reshape(len(node), m * m)
            by_node = np.argsort(node, kind="stable")
            key, node = key[by_node].ravel(), np.repeat(node[by_node], m * m)
            order = np.argsort(key, kind="stable")  # so the first of a key is its smallest node
            key, node = key[order], node[order]
            first = np.r_[True, key[1:] != key[:-1]]
            head = node[np.flatnonzero(first)[np.cumsum(first) - 1]]
            edges = np.unique(np.stack([node[~first], head[~first]], 1), axis=0)
            edges = edges[edges[:, 0] != edges[:, 1]]
            n, e = int(first.sum()), len(edges)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[key[first].view(np.int64), edges[:, 0]]),
                    pa.array(np.r_[node[first], edges[:, 0]]),
                    pa.array(np.r_[np.zeros(n, np.int64), edges[:, 1]], mask=np.r_[np.ones(n, bool), np.zeros(e, bool)]),
                ],
                ["key", "node", "head"],
            )

    return keys


def _fine_table_keys(m: int):
    """(node, shingles) to table keys, in one worker a task."""
    sign, keys = _fine_signer(m), _table_keys(m)
    return lambda batches: keys(sign(batches))


def _candidates(rows: DataFrame, keys) -> DataFrame:
    """(src, dst): each node of `rows` and the smallest one that it shares a table key with; keys maps rows to table keys."""
    keyed = rows.mapInArrow(keys, "key bigint, node bigint, head bigint")
    smallest = F.expr("first(node) OVER (PARTITION BY key ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    return keyed.select(F.col("node").alias("src"), F.coalesce("head", smallest).alias("dst")).where("src <> dst").distinct()


def _set_reader(k: int):
    """(node, digest, text) to (node, shingles) of the texts whose set has this digest."""

    @gives_back
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _WordHashes()
        for batch in batches:
            nodes, sets = [], []
            for node, digest, text in zip(*[batch.column(c).to_pylist() for c in ("node", "digest", "text")], strict=True):
                s = shingle_set(text, k, memo)
                if set_digest(s) == digest:
                    nodes.append(node), sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "shingles"])

    return read


def _overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of every left with every right set (left with left if None), by matrix products."""
    sides = [left] if right is None else [left, right]
    values = [np.concatenate(s) for s in sides]
    if right is None:
        distinct, count = np.unique(values[0], return_counts=True)
        shared = distinct[count > 1]
    else:
        shared = np.intersect1d(*values)
    cells = []
    for sets, value in zip(sides, values, strict=True):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        column = np.searchsorted(shared, value)
        column[column == len(shared)] = 0
        hit = shared[column] == value if len(shared) else np.zeros(len(value), bool)
        row, column = row[hit], column[hit]
        order = np.argsort(column, kind="stable")
        cells.append((row[order], column[order], len(sets)))
    total = np.zeros((cells[0][2], cells[-1][2]), np.float32)
    for at in range(0, len(shared), 8192):
        parts = []
        for row, column, n in cells:
            a, b = np.searchsorted(column, [at, at + 8192])
            part = np.zeros((n, min(8192, len(shared) - at)), np.float32)
            part[row[a:b], column[a:b] - at] = 1
            parts.append(part)
        total += parts[0] @ parts[-1].T
    return total.astype(np.int64)


def _forest(linked: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the symmetric matrix `linked` connects: each node with the first of its component."""
    label = np.arange(len(nodes))
    while True:
        new = np.minimum(label, np.where(linked, label, len(nodes)).min(1, initial=len(nodes)))
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _verifier(percent: int):
    """For one task: rows of (part, side, node, shingles). Rows of a part with side 0 meet each other, or side 1 if any."""

    def verify(task):
        found = []
        for _, part in task.groupby("part", sort=False):
            part = part.drop_duplicates(["side", "node"]).sort_values(["side", "node"])
            sets = [np.frombuffer(x, np.uint64) for x in part["shingles"]]
            nodes, size = part["node"].to_numpy(), np.array([len(s) for s in sets])
            cut = int((part["side"] == 0).sum())
            if cut in (0, len(sets)):
                both = _overlaps(sets, None)
                linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
            else:
                both = _overlaps(sets[:cut], sets[cut:])
                across = 100 * both >= percent * (size[:cut, None] + size[None, cut:] - both)
                linked = np.zeros((len(sets), len(sets)), bool)
                linked[:cut, cut:], linked[cut:, :cut] = across, across.T
            if cut or len(sets) > 1:
                found.append(np.stack(_forest(linked, nodes), 1))
        out = np.concatenate(found) if found else np.empty((0, 2), np.int64)
        return task.iloc[:0].assign(src=0, dst=0)[["src", "dst"]].astype("int64") if not len(out) else type(task)({"src": out[:, 0], "dst": out[:, 1]})

    return verify


def _verified(rows: DataFrame, percent: int) -> DataFrame:
    return rows.select("task", "part", "side", "node", "shingles").groupBy("task").applyInPandas(_verifier(percent), "src bigint, dst bigint")


def _block_pairs(blocks: DataFrame, pivots_only: bool) -> DataFrame:
    """(task, block, side) of the pairs of blocks to verify. blocks: block, family, band, turn, whole (component or null)."""
    a = blocks.select(F.col("block").alias("a"), "family", "band", F.col("turn").alias("a_turn"), F.col("whole").alias("a_whole"))
    b = blocks.select(F.col("block").alias("b"), "family", F.col("band").alias("b_band"), F.col("turn").alias("b_turn"), F.col("whole").alias("b_whole"))
    near = a.join(b, "family").where("b_band = band AND a <= b OR b_band = band + 1")
    if pivots_only:
        near = near.where("a = b OR a_turn = 0 OR b_band = band AND b_turn = 0")
    else:
        near = near.where("NOT (a_whole IS NOT NULL AND b_whole IS NOT NULL AND a_whole = b_whole)")
    pair = near.withColumn("task", F.xxhash64("a", "b"))
    return pair.select("task", F.explode(F.expr("IF(a = b, array(struct(a AS block, 0 AS side)), array(struct(a AS block, 0 AS side), struct(b AS block, 1 AS side)))")).alias("x")).select("task", "x.*")


def _blocks(members: DataFrame, stored: Scratch) -> tuple[DataFrame, DataFrame]:
    """members (node, family, band, whole, n_shingles) with their block, and the table of blocks."""
    group = ["family", "band", "whole"]
    # whole is null in groups of mixed components; a null-safe key for grouping and joining
    keyed = members.withColumn("group", F.xxhash64("family", "band", F.coalesce("whole", F.lit(0)), F.col("whole").isNull()))
    wide = stored(
        keyed.groupBy("group", *group).agg(
            F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("bigint").alias("turns")
        ),
        "near-groups",
    )
    placed = stored(keyed, "near-members").join(wide.select("group", "turns"), "group")
    turn = F.pmod(F.xxhash64("node", F.lit(7)), F.col("turns"))
    placed = placed.withColumn("block", F.xxhash64("group", turn)).select("node", "block")
    blocks = wide.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("turns") - 1)))
    return placed, blocks.select(F.xxhash64("group", "turn").alias("block"), *group, "turn")


def _verified_blocks(members: DataFrame, sets: DataFrame, percent: int, pivots_only: bool, stored: Scratch) -> DataFrame:
    placed, blocks = _blocks(members, stored)
    pairs = stored(_block_pairs(stored(blocks, "near-blocks"), pivots_only), "near-pairs")
    rows = stored(placed, "near-placed").join(sets, "node")
    return stored(_verified(rows.join(pairs, "block").withColumn("part", F.lit(0)), percent), "near-links")


def set_classes(worded: DataFrame) -> DataFrame:
    """A row per digest of signed documents: node, its number; first_id; known_by, one of its rows; n_shingles, tuples."""
    found = worded.groupBy("digest").agg(
        F.min("doc_id").alias("first_id"),
        F.min(F.struct("doc_id", "text_hash")).alias("known_by"),
        F.min("n_shingles").alias("n_shingles"),
        F.first("tuples").alias("tuples"),
    )
    return found.withColumn("node", F.monotonically_increasing_id())


def _verified_families(sized: DataFrame, sets: DataFrame, percent: int, stored: Scratch) -> DataFrame:
    """Links in small families (node, family, n_shingles), many to a task."""
    weight = sized.agg(F.sum("n_shingles")).first()[0] or 0
    bins = max(2 * shuffle_partitions(sized.sparkSession), math.ceil(weight / BLOCK_SHINGLES))
    dealt = sized.select("node", F.col("family").alias("part"), F.pmod(F.xxhash64("family"), F.lit(bins)).alias("task"), F.lit(0).alias("side"))
    return stored(_verified(stored(dealt, "near-small").join(sets, "node"), percent), "near-links")


def _sized(members: DataFrame, stored: Scratch) -> DataFrame:
    """members (node, family, n_shingles and more) with family_size and the family's weight in shingles."""
    members = stored(members, "near-members")
    counted = stored(members.groupBy("family").agg(F.count(F.lit(1)).alias("family_size"), F.sum("n_shingles").alias("weight")), "near-counted")
    return stored(members.join(counted, "family"), "near-sized")


def near_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept.

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; documents with 100 * intersection >= percent * union of
    their shingle sets are linked, and component_id is the smallest doc_id reachable. kept marks the rows with
    doc_id = component_id. Rows without words or text have an empty set, are linked with nothing and kept. Rows without
    doc_id take part, get the component's smallest id (null if it has none), and are kept only without words. Rows
    that repeat the kept doc_id are all kept. An empty table gives no rows. Other columns of `docs` are not read.
    """
    spark, m, stored = docs.sparkSession, collection_size(percent), Scratch()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    signed = stored(texts.mapInArrow(_signer(k, m), _SIGNED), "near-signed")
    worded = signed.where("digest IS NOT NULL")
    classes = stored(set_classes(worded), "near-classes")

    families, _ = component_labels(_candidates(classes.select("node", "tuples"), _table_keys(m)), stored)
    members = stored(families.withColumnRenamed("label", "family").join(classes.select("node", "digest", "known_by", "n_shingles"), "node"), "near-families")

    # as many rows as the corpus has near copies: never broadcast
    wanted = members.select("node", "digest", F.col("known_by.doc_id").alias("by_id"), F.col("known_by.text_hash").alias("by_hash")).hint("merge")
    theirs = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["by_id"]) & (texts["text_hash"] == wanted["by_hash"])).select("node", "digest", "text")
    sets = theirs.mapInArrow(_set_reader(k), "node bigint, shingles binary")
    sets = stored(sets.dropDuplicates(["node"]), "near-sets", "none")

    sized = _sized(members.select("node", "family", "n_shingles"), stored)
    small_one = (F.col("family_size") <= BLOCK) & (F.col("weight") <= BLOCK_SHINGLES)
    links = _verified_families(sized.where(small_one), sets, percent, stored)

    band = F.floor(F.log("n_shingles") / math.log(100.01 / percent)).cast("bigint")
    large = stored(sized.where(~small_one).select("node", "family", band.alias("band"), "n_shingles"), "near-large")
    if not large.isEmpty():
        first = _verified_blocks(large.withColumn("whole", F.lit(None).cast("bigint")), sets, percent, pivots_only=True, stored=stored)
        so_far, _ = component_labels(first, stored)
        labelled = large.drop("family").join(so_far, "node", "left").withColumn("part", F.coalesce("label", "node"))
        labelled = stored(labelled, "near-labelled")
        fine = collection_size(percent, FINE)
        refined = sets.join(labelled.select("node", "part").hint("merge"), "node").select(F.col("part").alias("node"), "shingles")
        meeting, _ = component_labels(_candidates(refined, _fine_table_keys(fine)), stored)
        open_ = labelled.join(meeting.select(F.col("node").alias("part"), F.col("label").alias("family")), "part")
        again = _sized(open_.select("node", "family", "band", "n_shingles", "label"), stored)
        links = links.unionByName(first).unionByName(_verified_families(again.where(small_one), sets, percent, stored))
        left = stored(again.where(~small_one).select("node", "family", "band", "n_shingles", "label"), "near-left")
        if not left.isEmpty():
            sizes = left.where("label IS NOT NULL").groupBy("family", "band", "label").count().where(F.col("count") >= BLOCK)
            whole = stored(sizes.select("family", "band", "label", F.col("label").alias("whole")), "near-whole")
            rest = left.join(whole, ["family", "band", "label"], "left").drop("label")
            links = links.unionByName(_verified_blocks(rest, sets, percent, pivots_only=False, stored=stored))

    joined, _ = component_labels(links, stored)
    labels = stored(joined.join(classes.select("node", "first_id"), "node"), "near-joined")
    ids = stored(labels.groupBy("label").agg(F.min("first_id").alias("component_id")), "near-ids")
    linked = stored(labels.join(ids, "label").select("node", "component_id"), "near-linked")
    every = classes.select("node", "digest", "first_id").join(linked, "node", "left")
    every = stored(every.select("digest", F.coalesce("component_id", "first_id").alias("component_id")), "near-every")
    stored.discard_but(signed, every)
    result = worded.select("doc_id", "n_shingles", "digest").join(every, "digest").select("doc_id", "n_shingles", "component_id")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("n_shingles") == 0)
    wordless = signed.where("digest IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return result.unionByName(wordless).withColumn("kept", kept)


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """`docs` without those linked to a document with a smaller doc_id; wordless documents stay.

    Rows without doc_id are known by a hash of their text, so one text of theirs stays even if no row has an id. Rows
    that repeat a doc_id stay or go together.
    """
    surrogate = -1 - F.pmod(F.xxhash64("text"), F.lit(2**62))
    key = F.coalesce(F.col("doc_id").cast("bigint"), surrogate)
    kept = near_components(docs.select(key.alias("doc_id"), "text"), k, percent).where("kept").select("doc_id")
    rows = docs.select(F.struct(*[named(c).alias(c) for c in docs.columns]).alias("row"), key.alias("doc_id"))
    return rows.join(kept, "doc_id", "left_semi").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), k=2, percent=80)


OP2_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
        ELSE list_transform(range(1, len(ws)), lambda i: concat(ws[i], ' ', ws[i + 1])) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT p.x, p.y FROM p JOIN n a ON a.doc_id = p.x JOIN n b ON b.doc_id = p.y WHERE 100 * c >= 80 * (a.n + b.n - c)),
lab(v, l) USING KEY (v) AS (SELECT doc_id, doc_id FROM documents
  UNION SELECT e.y, min(x.l) FROM lab x JOIN e ON e.x = x.v JOIN recurring.lab y ON y.v = e.y WHERE x.l < y.l GROUP BY e.y)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, lab.l AS component_id, w.doc_id = lab.l AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN lab ON lab.v = w.doc_id
"""
