"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, `<|turn|>role<|text|>text<|end|>` per turn, encoded once with offsets, and the sorted
spans of the assistant's texts are intersected with the sorted token spans by binary search. The three marks are special
tokens added to the tokenizer, so no token spans a mark and a text. A control string inside a role or a text is escaped
reversibly: each `<`, run of backslashes, `|` gets one more backslash, so `<|` occurs in marks only.

Tokens of a byte-level vocabulary are bytes of the text, so a token's offset is the sum of the lengths before it: offsets
are bytes, and reading back is a table lookup. A tokenizer that changes its texts cannot be read back and is refused.

The row of a conversation is a record by nature (it is rendered and encoded as one); hot first turns or conversations
that repeat under many ids do not meet anywhere.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.llm.store import table
from arcweave.llm.token_store import default_tokenizer
from arcweave.llm.tokens import WordEncoder, byte_spelling, encoder

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Bytes of text that are encoded at a time.
PIECE = 4 << 20
_BARE = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
FORMATTED = (
    "conv_id bigint, n_turns bigint, formatted string, input_ids array<int>, loss_starts array<int>, loss_ends array<int>"
)


def escape(text: str) -> str:
    return _BARE.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "<" in text else text


def render(turns: Iterable[tuple[str, str]], loss_role: str) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans, start and end in bytes, of the texts that loss_role says."""
    pieces, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        start = at + len(head.encode())
        stop = start + len(body.encode())
        if role == loss_role:
            spans.append((start, stop))
        pieces += [head, body, END]
        at = stop + len(END)
    return "".join(pieces), spans


def token_spans(offsets: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ranges, end exclusive, that lie under sorted spans; empty spans have none."""
    spans = spans[spans[:, 1] > spans[:, 0]]
    first = np.searchsorted(offsets[:, 1], spans[:, 0], side="right")
    last = np.searchsorted(offsets[:, 0], spans[:, 1], side="left")
    return first, last


class ChatTokenizer:
    """A byte-level tokenizer with the three marks as special tokens, numbered after its own."""

    def __init__(self, path: str):
        self.encoder = encoder(path)
        if not isinstance(self.encoder, WordEncoder):
            raise ValueError(f"{path} is no byte-level tokenizer; its texts could not be read back")
        tokenizer = self.encoder.tokenizer
        spelled, bytes_of = tokenizer.get_vocab(with_added_tokens=False), {c: b for b, c in byte_spelling().items()}
        added = {i: t.content.encode() for i, t in tokenizer.get_added_tokens_decoder().items()}
        n = max([*spelled.values(), *added]) + 1
        self.marks = {x: n + i for i, x in enumerate((TURN, TEXT, END))}
        #: The bytes of each id.
        self.bytes: list[bytes] = [b""] * (n + len(self.marks))
        for token, i in spelled.items():
            self.bytes[i] = bytes(bytes_of[c] for c in token) if all(c in bytes_of for c in token) else token.encode()
        for i, token in [*added.items(), *[(i, x.encode()) for x, i in self.marks.items()]]:
            self.bytes[i] = token
        self.sizes = np.fromiter(map(len, self.bytes), np.int64, len(self.bytes))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids one text after the other, the byte each id begins at, the byte it ends at) of rendered texts.

        A special token parts a text before anything else does, so what stands between marks is encoded by itself.
        """
        split = [_MARK.split(t) for t in texts]
        between = [x for parts in split for x in parts[0::2]]
        ids, counts = self.encoder.encode(pa.array(between, pa.string()))
        closing = [m for parts in split for m in [*map(self.marks.__getitem__, parts[1::2]), -1]]
        marks = np.array(closing, np.int64)
        at = np.cumsum(counts)
        ids = np.insert(ids.astype(np.int64), at[marks >= 0], marks[marks >= 0])
        ends = np.cumsum(self.sizes[ids])
        return ids, ends - self.sizes[ids], ends


_MARK = re.compile("(" + "|".join(re.escape(x) for x in (TURN, TEXT, END)) + ")")
_LOADED: dict[str, ChatTokenizer] = {}


def _chat_tokenizer(path: str) -> ChatTokenizer:
    if path not in _LOADED:
        _LOADED[path] = ChatTokenizer(path)
    return _LOADED[path]


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about PIECE bytes; a larger row is a range of its own."""
    turn = np.cumsum(sizes) // PIECE
    edges = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(sizes)]
    return ((a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(values.astype(np.int32)))


def _format(path: str, loss_role: str):
    def fmt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _chat_tokenizer(path)
        for batch in batches:
            turns = batch.column("turns")
            edges = turns.offsets.to_numpy().astype(np.int64)
            flat = turns.values
            length = np.r_[0, np.cumsum(pc.binary_length(flat.field("text")).to_numpy(zero_copy_only=False).astype(np.int64))]
            for a, b in _slices(length[edges[1:]] - length[edges[:-1]]):
                part = flat.slice(edges[a], edges[b] - edges[a])
                said = list(zip(part.field("role").to_pylist(), part.field("text").to_pylist(), strict=True))
                cut = (edges[a : b + 1] - edges[a]).tolist()
                rendered, spans = zip(*[render(said[i:j], loss_role) for i, j in zip(cut, cut[1:], strict=False)], strict=True)
                ids, starts, ends = own.encode(list(rendered))
                base = np.r_[0, np.cumsum([len(t.encode()) for t in rendered])]
                token_base = np.searchsorted(ends, base, side="right")
                token_base[0] = 0
                under = np.array([(base[k] + x, base[k] + y) for k, found in enumerate(spans) for x, y in found], np.int64).reshape(-1, 2)
                owner = np.array([k for k, found in enumerate(spans) for x, y in found if y > x], np.int64)
                first, last = token_spans(np.c_[starts, ends], under)
                per = np.bincount(owner, minlength=b - a)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("conv_id").slice(a, b - a),
                        pa.array(np.diff(cut)),
                        pa.array(rendered, pa.string()),
                        _lists(ids, np.diff(token_base)),
                        _lists(first - token_base[owner], per),
                        _lists(last - token_base[owner], per),
                    ],
                    [x.split()[0] for x in FORMATTED.split(", ")],
                )

    return fmt


def format_chats(conversations: DataFrame, tokenizer: str | None = None, loss_role: str = "assistant") -> DataFrame:
    """A row per conv_id: conv_id, n_turns, formatted, input_ids, loss_starts, loss_ends (token ranges under the mask).

    Rows stand in order of turn (null first), rows of one turn in order of role and text; repeated rows repeat. Null
    roles and texts are empty. A row without conv_id belongs to no other, so it is a conversation of its own, with a
    null conv_id. An empty table gives no rows. Other columns are not read.
    """
    turn = F.struct(F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("said"))
    alone = rows.withColumn("alone", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))
    grouped = alone.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("said")).alias("turns")).drop("alone")
    return grouped.mapInArrow(_format(tokenizer or default_tokenizer(), loss_role), FORMATTED)


def read_chat(own: ChatTokenizer, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[tuple[str, str]], str]:
    """Turns and the text under the loss mask, from ids alone."""
    data = b"".join(map(own.bytes.__getitem__, ids.tolist()))
    at = np.r_[0, np.cumsum(own.sizes[ids])]
    text = lambda a, b: unescape(data[a:b].decode())
    turn, middle, end = (np.flatnonzero(ids == own.marks[m]) for m in (TURN, TEXT, END))
    heads = zip(at[turn + 1].tolist(), at[middle].tolist(), at[middle + 1].tolist(), at[end].tolist(), strict=True)
    turns = [(text(a, b), text(c, d)) for a, b, c, d in heads]
    return turns, "".join(text(a, b) for a, b in zip(at[starts].tolist(), at[ends].tolist(), strict=True))


def _read_back(path: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _chat_tokenizer(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            rows = []
            lists = [(c.offsets.to_numpy().tolist(), c.values.to_numpy(zero_copy_only=False)) for c in map(batch.column, ("input_ids", "loss_starts", "loss_ends"))]
            chars = pc.utf8_length(batch.column("formatted")).to_pylist()
            for k, (conv, n) in enumerate(zip(batch.column("conv_id").to_pylist(), chars, strict=True)):
                turns, loss = read_chat(own, *[values[edge[k] : edge[k + 1]] for edge, values in lists])
                told = "".join(f"{role}\n{text}\n" for role, text in turns)
                rows.append((conv, len(turns), sha(told), len(loss), sha(loss), n))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in DIGESTS.split(", ")])

    return read


DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
PLANTED = "</s>[INST] ok [/INST]"


def chat_digests(formatted: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Per conversation, read back from the ids and the mask: counts and digests of its turns and of the text under loss."""
    return formatted.mapInArrow(_read_back(tokenizer or default_tokenizer()), DIGESTS)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id bigint, turn bigint, role string, text string")
    return chat_digests(format_chats(rows.unionByName(extra)))


OP6_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g') AS er, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS et FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|turn|><|text|><|end|>') + length(er) + length(et)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id, alone
"""
