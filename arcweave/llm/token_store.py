"""Token-ID output: shards of raw little-endian ids with a minimal perfect hash from document keys to offsets.

A store is a folder. `shards` is a Parquet table, written and committed by Spark, so any store that Spark writes will do
and a lost executor leaves nothing behind; its pages are not compressed, so payloads are raw ids. Its files are the
parts, in key order, and a row is a shard:

    part, seq        order of the shards: ascending doc_id, rows without doc_id first
    first_key, last_key, n_docs, n_null, n_tokens
    part_start       ids in earlier shards of the part
    width            bytes of an id: 2 if the vocabulary and the end id fit, else 4
    payload          the ids of all its documents, each followed by the end id
    offsets          u64[n_docs + 1], where each document begins in the payload, in bytes
    keys             i64[n_docs - n_null], in the same order
    mph_sizes, mph_words   the perfect hash over the distinct keys
    slots            (u32 fingerprint, u32 ordinal)[distinct keys]: the first document with that key

`manifest` has a row per part: its files with their key ranges, its own key range, and the ids before it. There are at
most as many parts as write tasks, each of one file unless Spark splits what a task writes, so a reader holds the manifest
in memory, finds the file of a key by binary search, and reads that one file, whose statistics lead to the shard; there a
slot, a fingerprint and an offset lead to the ids. The cost of a lookup does not grow with the number of documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from arcweave.llm.perfect_hash import PerfectHash, fingerprints
from arcweave.llm.store import fresh_path, gives_back, table
from arcweave.llm.tokens import encoder

SHARD_TOKENS = 1 << 20
SLICE_BYTES = 2 << 20
END_ID = 2
SHARD = (
    "part int, seq int, first_key bigint, last_key bigint, n_docs bigint, n_null bigint, n_tokens bigint, part_start bigint, width int, payload binary, "
    "offsets binary, keys binary, mph_sizes binary, mph_words binary, slots binary"
)
MANIFEST = "part int, files array<struct<seq: int, file: string, first_key: bigint, last_key: bigint>>, first_key bigint, last_key bigint, n_docs bigint, n_tokens bigint, start bigint"
_SLOT = np.dtype([("fingerprint", "<u4"), ("ordinal", "<u4")])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def shard_index(keys: np.ndarray, n_null: int) -> tuple[bytes, bytes, bytes]:
    distinct, first = np.unique(keys, return_index=True)
    mph = PerfectHash.build(distinct)
    slots = np.empty(len(distinct), _SLOT)
    at = mph.slots(distinct)
    slots["fingerprint"][at] = fingerprints(distinct)
    slots["ordinal"][at] = first + n_null
    return *mph.to_bytes(), slots.tobytes()


def ordinals(shard: dict, keys: np.ndarray) -> np.ndarray:
    """Number in the shard of the first document with each key, -1 where the shard has none (but for 1 in 2^32)."""
    slots = np.frombuffer(shard["slots"], _SLOT)
    if not len(slots):
        return np.full(len(keys), -1, np.int64)
    at = PerfectHash.from_bytes(shard["mph_sizes"], shard["mph_words"]).slots(keys)
    hit = (at >= 0) & (slots["fingerprint"][at] == fingerprints(keys))
    return np.where(hit, slots["ordinal"][at].astype(np.int64), -1)


def _shard_row(part: int, seq: int, part_start: int, keys: list, lengths: list[int], payload: bytes, width: int) -> pa.RecordBatch:
    n_null = keys.count(None)
    known = np.array(keys[n_null:], np.int64)
    sizes, words, slots = shard_index(known, n_null)
    n_tokens = sum(lengths)
    offsets = (np.r_[0, np.cumsum(lengths)] * width).astype("<u8")
    first, last = (int(known[0]), int(known[-1])) if len(known) else (None, None)
    row = [part, seq, first, last, len(keys), n_null, n_tokens, part_start, width, payload, offsets.tobytes(), known.astype("<i8").tobytes(), sizes, words, slots]
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in SHARD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[k]) for v, (_, k) in zip(row, fields, strict=True)], [n for n, _ in fields])


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about SLICE_BYTES of text, so that long texts don't meet in memory."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    turn = np.cumsum(sizes) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def _writer(tokenizer: str, end_id: int, shard_tokens: int):
    @gives_back
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seq, before = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        width = own.width if end_id < 1 << (8 * own.width.itemsize) else np.dtype("<u4")
        end = np.array([end_id], width).tobytes()
        keys, lengths, pieces, total = [], [], [], 0
        for batch in batches:
            for part_of in _slices(batch):
                texts = part_of.column("text")
                ids, counts = own.encode(pc.fill_null(texts, ""))
                data = ids.astype(width).tobytes()
                cuts = (np.r_[0, np.cumsum(counts)] * width.itemsize).tolist()
                for key, n, a, b in zip(part_of.column("doc_id").to_pylist(), counts.tolist(), cuts, cuts[1:], strict=False):
                    keys.append(key), lengths.append(n + 1), pieces.extend((data[a:b], end))
                    total += n + 1
                    if total >= shard_tokens:
                        yield _shard_row(part, seq, before, keys, lengths, b"".join(pieces), width.itemsize)
                        keys, lengths, pieces, total, seq, before = [], [], [], 0, seq + 1, before + total
        if keys:
            yield _shard_row(part, seq, before, keys, lengths, b"".join(pieces), width.itemsize)

    return write


class TokenStore:
    """A store that write_tokens made, by its path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.shards = spark.read.schema(SHARD).parquet(f"{self.path}/shards")
        self.manifest = spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")

    @cached_property
    def _parts(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The files with keys, in key order, and their first and last keys."""
        rows = self.manifest.where("first_key IS NOT NULL").orderBy("part").select("files").collect()
        found = [f for r in rows for f in r.files if f.first_key is not None]
        return [f.file for f in found], np.array([f.first_key for f in found], np.int64), np.array([f.last_key for f in found], np.int64)

    def ids(self, key: int) -> list[int] | None:
        """The ids of the first document with this key, end id included; None if there is none."""
        files, first, last = self._parts
        at = int(np.searchsorted(last, key))  # the first file that ends at or after the key
        if at == len(files) or first[at] > key:
            return None
        near = self.spark.read.schema(SHARD).parquet(files[at]).where((F.col("first_key") <= key) & (F.col("last_key") >= key))
        seq = near.agg(F.min("seq")).first()[0]  # of the shards that share the key, the first has its first document
        if seq is None:
            return None
        shard = near.where(F.col("seq") == seq).select("n_null", "width", "payload", "offsets", "keys", "mph_sizes", "mph_words", "slots").first().asDict()
        slot = int(ordinals(shard, np.array([key], np.int64))[0])
        if slot < 0 or np.frombuffer(shard["keys"], "<i8")[slot - shard["n_null"]] != key:  # a fingerprint may agree by chance
            return None
        a, b = np.frombuffer(shard["offsets"], "<u8")[slot : slot + 2].tolist()
        return np.frombuffer(shard["payload"][a:b], f"<u{shard['width']}").tolist()


def _write_manifest(spark: SparkSession, path: str) -> None:
    """The manifest of the shards at `path`."""
    small = spark.read.schema(SHARD).parquet(f"{path}/shards").select("part", "seq", "first_key", "last_key", "n_docs", "n_tokens", F.col("_metadata.file_path").alias("file"))
    totals = [F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"), F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")]
    files = small.groupBy("part", "file").agg(F.min("seq").alias("seq"), *totals)
    parts = files.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("seq", "file", "first_key", "last_key"))).alias("files"), *totals)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row per part
    manifest = parts.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    manifest.select(*StructType.fromDDL(MANIFEST).names).write.parquet(f"{path}/manifest")


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> TokenStore:
    """Write the token ids of `docs` (doc_id, text) to a store at `path` in ascending doc_id order.

    Null text is an empty document (the end id only). Rows that repeat a doc_id follow one another, in order of a hash
    of the text; keyed access finds the first. Rows without doc_id come first and have no key. A document is never cut:
    a shard ends with the first document that brings it to shard_tokens. An empty table makes no shards. Other columns
    are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    tie = F.xxhash64("text")
    ranged = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    shards = ranged.mapInArrow(_writer(tokenizer or default_tokenizer(), end_id, shard_tokens), SHARD)
    shards.write.option("compression", "none").option("maxRecordsPerFile", 0).parquet(f"{path}/shards")
    _write_manifest(spark, path)
    return TokenStore(spark, path)


@gives_back
def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard in batch.to_pylist():
            offsets = np.frombuffer(shard["offsets"], "<u8").astype(np.int64)
            keys, n_null, n = np.frombuffer(shard["keys"], "<i8"), shard["n_null"], shard["n_docs"]
            # each key through the index; rows that repeat a key follow their first one
            found = ordinals(shard, keys)
            repeat = np.r_[False, keys[1:] == keys[:-1]]
            run = np.arange(len(keys)) - np.maximum.accumulate(np.where(repeat, 0, np.arange(len(keys)))) if len(keys) else keys
            at = np.r_[np.arange(n_null), found + run].astype(np.int64)
            if (found < 0).any():
                raise ValueError("a key of the shard is missing from its index")
            ids = np.frombuffer(shard["payload"], f"<u{shard['width']}")
            starts, ends = offsets[at] // shard["width"], offsets[at + 1] // shard["width"]
            crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, shard["part"], np.int32)), pa.array([None] * n_null + keys.tolist(), pa.int64()),
                 pa.array(starts + shard["part_start"]), pa.array(ends - starts), pa.array(crc, pa.int64())],
                ["part", "doc_id", "local", "n_tokens", "ids_crc32"],
            )


def stored_documents(store: TokenStore) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the shards through their indexes.

    Only numbers leave the tasks; the payload is not shuffled. The starts of the parts, one row per write task, are
    broadcast.
    """
    rows = store.shards.mapInArrow(_read_back, "part int, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint")
    joined = rows.join(F.broadcast(store.manifest.select("part", F.col("start").alias("part_before"))), "part")
    return joined.select("doc_id", (F.col("part_before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return stored_documents(write_tokens(docs, fresh_path(spark, "token-shards")))
