"""Benchmark decontamination: windows of normalised benchmark words, found in documents and verified word by word.

The benchmark is cut into pieces of at most PIECE_WORDS words (whose windows are the items' windows), and the pieces are
dealt to chunks of at most `chunk_words` words of up to UNIT_BYTES bytes (a longer one counts as several). A chunk's windows become a hash set in arrays - sorted 64-bit hashes, the
word each window begins at, a bit table that most other hashes miss, and the words themselves - of at most CHUNK_BYTES a
word, and are broadcast. Documents are scanned once for each chunk; a hash that is found is compared word by word. One
chunk, the usual case, is one map over the documents; several are as many maps, whose findings meet by text. So the
method is the same for any benchmark, and the driver and a worker never hold more than a chunk.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcweave.llm.store import by_place, gives_back, held_schema, stored, table

WINDOW = 10
CHUNK_WORDS = 5_000_000
PIECE_WORDS = 10_000
#: A longer word counts as several.
UNIT_BYTES = 32
#: Bytes of a broadcast chunk for each of its words, at most, for words of 32 bytes: a text, hashes and places.
CHUNK_BYTES = 80
SLICE_BYTES = 2 << 20
MEMO_WORDS = 100_000
#: Bytes of words (digits, letters, all of non-ASCII) map to themselves with A-Z lower-cased, the others to a space.
NORMAL = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c > 127 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_P = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(NORMAL).split() if text else []


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the windows of n words, by where they begin, from hashes of the words."""
    acc = hashes[: len(hashes) - n + 1].copy()
    for j in range(1, n):
        acc = (acc ^ (acc >> np.uint64(31))) * _P + hashes[j : len(hashes) - n + 1 + j]
    return acc ^ (acc >> np.uint64(29))


class WindowSet:
    """The windows of pieces (item_id or None, window length, words joined by blanks) as arrays."""

    def __init__(self, pieces: list[tuple[str | None, int, bytes]]):
        split = [(item, n, text.split()) for item, n, text in pieces]
        self.text = b"".join(w + b" " for _, _, words in split for w in words)
        length = np.fromiter((len(w) + 1 for _, _, words in split for w in words), np.int64)
        self.word_at = np.r_[0, np.cumsum(length)].astype(np.uint32 if len(self.text) < 1 << 32 else np.int64)
        self.names = sorted({item for item, _, _ in split if item is not None})
        place = {item: i for i, item in enumerate(self.names)}
        self.items = np.array([place.get(item, -1) for item, _, _ in split], np.int64)
        self.first = np.r_[0, np.cumsum([len(words) for _, _, words in split])].astype(np.int64)
        memo = _WordHashes()
        hashes = np.fromiter((memo[w] for _, _, words in split for w in words), np.uint64, len(length))
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for k, (_, n, words) in enumerate(split):
            if len(words) >= n > 0:
                h = window_hashes(hashes[self.first[k] : self.first[k + 1]], n)
                found.setdefault(n, []).append((h, self.first[k] + np.arange(len(h))))
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, parts in found.items():
            h, at = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(h, kind="stable")
            h, at = h[order], at[order].astype(np.uint32)
            bits = max(10, math.ceil(math.log2(16 * len(h))))
            table_ = np.zeros(1 << (bits - 3), np.uint8)
            low = h & np.uint64((1 << bits) - 1)
            np.bitwise_or.at(table_, (low >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (low & np.uint64(7)).astype(np.uint8)))
            self.by_length[n] = (h, at, table_)

    @property
    def nbytes(self) -> int:
        return len(self.text) + sum(map(len, self.names)) + self.word_at.nbytes + self.items.nbytes + self.first.nbytes + sum(x.nbytes for t in self.by_length.values() for x in t)

    def _ids(self, n: int, low: int, high: int, words: bytes) -> frozenset[str | None]:
        """Items whose windows low to high, of one hash, are these words; None for those without id."""
        at = self.by_length[n][1][low:high].astype(np.int64)
        same = [p for p in at.tolist() if self.text[self.word_at[p] : self.word_at[p + n]] == words]
        found = self.items[np.searchsorted(self.first, same, side="right") - 1].tolist()
        return frozenset(self.names[i] if i >= 0 else None for i in found)

    def hits(self, texts: list[list[bytes]], memo: dict) -> Iterator[tuple[int, int, int, frozenset[str | None]]]:
        """(text, first word, number of words, item ids) of every occurrence in texts, given as lists of words."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.r_[0, np.cumsum(sizes)]
        hashes = np.fromiter(map(memo.__getitem__, chain.from_iterable(texts)), np.uint64, int(starts[-1]))
        for n, (known, _, bits) in self.by_length.items():
            if len(hashes) < n:
                continue
            h = window_hashes(hashes, n)
            low = h & np.uint64(8 * len(bits) - 1)
            maybe = np.flatnonzero((bits[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & np.uint8(1))
            a, b = np.searchsorted(known, h[maybe], side="left"), np.searchsorted(known, h[maybe], side="right")
            owner = np.searchsorted(starts, maybe, side="right") - 1
            inside = (b > a) & (maybe + n <= starts[owner + 1])
            seen: dict[bytes, frozenset[int]] = {}
            for k, at, x, y in zip(owner[inside].tolist(), maybe[inside].tolist(), a[inside].tolist(), b[inside].tolist(), strict=True):
                first = at - int(starts[k])
                words = b" ".join(texts[k][first : first + n]) + b" "
                ids = seen.get(words)
                if ids is None:
                    ids = seen[words] = self._ids(n, x, y, words)
                if ids:
                    yield k, first, n, ids


def cleaned(text: bytes, hit: np.ndarray) -> bytes:
    """The text without its hit words and what stands between adjacent ones."""
    spans = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for i in np.flatnonzero(hit).tolist():
        start = spans[i][0]
        out.append(b"" if i and hit[i - 1] else text[at:start])
        at = spans[i][1]
    return b"".join(out) + text[at:]


_REPORT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, clean_text string"
_NAMES = [x.split()[0] for x in _REPORT.split(", ")]
_NONE = hashlib.sha256(b"").hexdigest()


def _report(text: bytes | None, n_words: int, hits: list) -> tuple:
    """hits: (first word, number of words, item ids)."""
    if not hits:
        return n_words, 0, 0, _NONE, False, None if text is None else text.decode()
    edge, items = np.zeros(n_words + 1, np.int64), set()
    for at, n, ids in hits:
        edge[at] += 1
        edge[at + n] -= 1
        items.update(ids)
    hit = np.cumsum(edge[:-1]) > 0
    joined = ",".join(sorted(i for i in items if i is not None))
    return n_words, int(hit.sum()), len(items), hashlib.sha256(joined.encode()).hexdigest(), True, None if text is None else cleaned(text, hit).decode()


def _report_batch(held: list[pa.Array], reports: list[tuple], with_text: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()]
    n = len(_NAMES) if with_text else len(_NAMES) - 1
    columns = list(zip(*reports, strict=True)) if reports else [[]] * len(_NAMES)
    arrays = held + [pa.array(columns[i], kinds[i]) for i in range(n)]
    return pa.RecordBatch.from_arrays(arrays, [f"c{i}" for i in range(len(arrays))])  # names may repeat; Spark reads by place


def _slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about SLICE_BYTES of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    turn = np.cumsum(sizes) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(edges, edges[1:], strict=False) if b > a)


def _scan(shared, with_text: bool):
    """Held columns and the text last, to held columns and report."""

    @gives_back
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, memo = shared.value, _WordHashes()
        for batch in batches:
            for part in _slices(batch, -1):
                texts = part.column(part.num_columns - 1).to_pylist()
                words = [words_of(t) for t in texts]
                found: list[list] = [[] for _ in texts]
                for k, at, n, ids in windows.hits(words, memo):
                    found[k].append((at, n, ids))
                reports = [_report(t if with_text else None, len(w), f) for t, w, f in zip(texts, words, found, strict=True)]
                yield _report_batch(part.columns[:-1], reports, with_text)

    return scan


_FOUND = "row_id binary, at bigint, n bigint, item_id string"


def _find(shared):
    """(row_id, text) to a row per occurrence and item."""

    @gives_back
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, memo = shared.value, _WordHashes()
        for batch in batches:
            for part in _slices(batch, -1):
                rows = part.column(0).to_pylist()
                for k, at, n, ids in windows.hits([words_of(t) for t in part.column(1).to_pylist()], memo):
                    items = list(ids)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([rows[k]] * len(items), pa.binary()), pa.array([at] * len(items)), pa.array([n] * len(items)), pa.array(items, pa.string())],
                        [x.split()[0] for x in _FOUND.split(", ")],
                    )

    return find


def _merge(with_text: bool):
    """Held columns, findings and the text last, to held columns and report."""

    @gives_back
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reports = []
            for text, found in zip(batch.column(batch.num_columns - 1).to_pylist(), batch.column(batch.num_columns - 2).to_pylist(), strict=True):
                hits = [(f["at"], f["n"], [x["item_id"] for x in f["items"]]) for f in found or []]
                reports.append(_report(text if with_text else None, len(words_of(text)), hits))
            yield _report_batch(batch.columns[:-2], reports, with_text)

    return merge


def _pieces(window: int):
    """Items to pieces: item_id, n (window length), units, words. Neighbours share the words of a window but one.

    A unit is a word of up to UNIT_BYTES bytes; a longer word is as many. A piece ends with the window that brings it to
    PIECE_WORDS units.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py())
                n = min(len(words), window)
                upto = np.r_[0, np.cumsum([-(-(len(w) + 1) // UNIT_BYTES) for w in words])].astype(np.int64)
                at, last = 0, len(words) - n + 1 if n else 0
                while at < last:
                    end = min(max(int(np.searchsorted(upto, upto[at] + PIECE_WORDS)), at + 1), last)
                    part = words[at : end + n - 1]
                    row = [item_id, n, int(upto[end + n - 1] - upto[at]), b" ".join(part)]
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, [pa.string(), pa.int64(), pa.int64(), pa.binary()], strict=True)], ["item_id", "n", "units", "words"])
                    at = end

    return cut


def window_chunks(benchmark: DataFrame, window: int, chunk_words: int) -> tuple[DataFrame, int]:
    """Pieces of the benchmark with their chunk, and the number of chunks. A chunk has at most chunk_words units and a piece."""
    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary"))
    pieces = items.mapInArrow(_pieces(window), "item_id string, n bigint, units bigint, words binary").distinct()
    pieces = stored(pieces.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "benchmark-pieces")
    # running totals inside a part, and over the parts, of which one row each meets
    ahead = F.coalesce(F.sum("units").over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.groupBy("part").agg(F.sum("units").alias("size")).select("part", F.coalesce(F.sum("size").over(upto), F.lit(0)).alias("start"))
    numbers = pieces.select("part", "place", "units").withColumn("ahead", ahead).join(F.broadcast(starts), "part")
    dealt = numbers.select("place", F.floor((F.col("start") + F.col("ahead")) / chunk_words).cast("int").alias("chunk"))
    chunked = stored(pieces.join(dealt, "place").select("item_id", "n", "words", "chunk"), "benchmark-chunks")
    last = chunked.agg(F.max("chunk")).first()[0]
    return chunked, 1 if last is None else last + 1


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, with_text: bool = False, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """One row per row of `docs`: its other columns, n_words, n_hit, n_items, items_sha256, contaminated (and clean_text).

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A word inside any occurrence of a benchmark
    window is hit; n_items counts the items whose windows occur, items_sha256 digests their ids, sorted as strings and
    comma-joined. clean_text is the text without hit words. Null text has no words and keeps null; items without words
    have no windows; items that repeat an id or a text count once per id. Ids are numbers or strings; all items without one
    count as one item, whose words are hit, and add nothing to the digest. Names of `docs`
    that clash with those above are replaced, all others stay. An empty table gives no rows.
    """
    spark = docs.sparkSession
    held = [c for c in docs.columns if c != "text" and c not in _NAMES]
    schema = held_schema(docs, held, ", ".join(_REPORT.split(", ")[: 6 if with_text else 5]))
    text = F.col("text").cast("binary")
    pieces, chunks = window_chunks(benchmark, window, chunk_words)

    def share(chunk: int):
        rows = pieces.where(F.col("chunk") == chunk).select("item_id", "n", "words").collect()  # chunk_words words and a piece, at most
        return spark.sparkContext.broadcast(WindowSet([(r.item_id, r.n, bytes(r.words)) for r in rows]))

    if chunks == 1:
        return docs.select(*by_place(held), text.alias("text")).mapInArrow(_scan(share(0), with_text), schema)
    # equal texts have equal findings, so a digest of the text is row enough
    row_id = F.unhex(F.sha2(F.coalesce(text, F.lit(b"")), 256))
    found = None
    for chunk in range(chunks):
        shared = share(chunk)
        part = stored(docs.select(row_id.alias("row_id"), text.alias("text")).mapInArrow(_find(shared), _FOUND).distinct(), "window-hits")
        shared.unpersist()
        found = part if found is None else found.unionByName(part)
    occurrences = found.groupBy("row_id", "at", "n").agg(F.collect_set(F.struct("item_id")).alias("items"))
    hits = stored(occurrences.groupBy("row_id").agg(F.collect_list(F.struct("at", "n", "items")).alias("found")), "window-texts")
    keyed = docs.select(*by_place(held), text.alias("text"), row_id.alias("row_id"))
    joined = keyed.join(hits.hint("merge"), "row_id", "left")
    return joined.select(*[f"c{i}" for i in range(len(held))], "found", "text").mapInArrow(_merge(with_text), schema)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, table(spark, sf_dir, "benchmark"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, unnest(list_transform(range(1, len(ws) - least(len(ws), 10) + 2), lambda i: array_to_string(ws[i:i + least(len(ws), 10) - 1], ' '))) AS w FROM b WHERE len(ws) > 0),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS i, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS w FROM d, ns WHERE len(ws) >= n),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.w = bw.w),
p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
