"""Tokenizers inside tasks: one per worker process, with a bounded memo of encoded words where words are apart."""

from __future__ import annotations

import codecs
import json
import os
import re
from array import array
from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words in each of the memo's two generations.
MEMO_WORDS = 200_000
BREAKS = (" ", "\n")
#: Letters and ASCII signs, as classes of Python's and Arrow's expressions. Letters beyond U+024F are left to the
#: tokenizer's own pre-tokeniser, whose Unicode tables may differ, and apostrophes too, as they begin contractions;
#: < and | stand in the usual added tokens.
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_SIGNS = r"!-&(-/:;=-@\[-`{}~"
#: A word whose pre-tokens are plain: a line feed, letters (with the blank before them, if any), one run of signs.
_PLAIN = rf"\A(?P<lead>\n?)(?P<body>[{_LETTERS}]+)(?P<tail>[{_SIGNS}]*)\z"
#: The same fields, and no word that fits.
_NOT_PLAIN = r"\z\A(?P<lead>.)(?P<body>.)(?P<tail>.)"
#: Texts with white space that is not a single blank or line feed between two words are encoded in one call.
_UNEVEN = (
    r"[ \n][ \n]|\A[ \n]|[ \n]\z|[\t\x{0B}\x{0C}\r\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)
_LOADED: dict[str, WordEncoder | TextEncoder] = {}


def byte_spelling() -> dict[int, str]:
    """How byte-level vocabularies spell bytes: printable ones as themselves, the others as characters from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def id_type(size: int) -> np.dtype:
    return np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")


def is_byte_level(definition: dict) -> bool:
    """Whether a tokenizer file is of the kind that WordEncoder's cuts are right for: BPE over bytes, words parted by
    the usual pattern, texts neither normalised nor changed around them, and added tokens without white space."""
    before, model = definition.get("pre_tokenizer") or {}, definition.get("model") or {}
    plain_model = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    plain_cut = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    whole = all(definition.get(k) is None for k in ("normalizer", "truncation", "padding"))
    tokens = definition.get("added_tokens") or []
    plain_tokens = all(not re.search(r"\s", t["content"]) and not any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in tokens)
    return plain_model and plain_cut and whole and plain_tokens


def _strings(words: pa.Array, apart: str) -> list[str]:
    """The words as Python's strings, made in one piece; none has the character `apart`."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), apart)[0].as_py().split(apart) if len(words) else []


class TextEncoder:
    """Encodes texts one by one with a function from text to ids below `size`."""

    def __init__(self, whole, size: int):
        self.whole, self.width = whole, id_type(size)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one text after the other, number of ids of each text) of an array without nulls."""
        found = [self.whole(t) for t in texts.to_pylist()]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), self.width, int(counts.sum())), counts


class WordEncoder:
    """Encodes whole texts to ids; equal to Tokenizer.encode(text, add_special_tokens=False).ids for byte-level BPE.

    Byte-level pre-tokenisers of the kind that is_byte_level admits have a boundary before white space that follows a
    word, and between letters and signs other than an apostrophe. So evenly spaced texts are cut into words, the distinct
    words of a batch, less the signs at their ends, are encoded unless the memo has them, and ids are gathered by word
    number.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = id_type(self.tokenizer.get_vocab_size(with_added_tokens=True))
        self.model, self.marks, self.spelling = self.tokenizer.model, {}, "".join(c for _, c in sorted(byte_spelling().items()))
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Whether no added token can stand inside a plain word.
        self.apart = not any(re.fullmatch(f"[{_LETTERS}{_SIGNS}]*", t) for t in added)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array(self.width.char, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _mark(self, text: str) -> bytes:
        if text not in self.marks:
            if len(self.marks) >= 1_000:
                self.marks.clear()
            self.marks[text] = self._whole(text)
        return self.marks[text]

    def _cut(self, ids: np.ndarray, cuts: np.ndarray) -> list[bytes]:
        data, at = ids.tobytes(), (cuts * self.width.itemsize).tolist()
        return [data[a:b] for a, b in zip(at, at[1:], strict=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, with a blank before them or not: each is one pre-token, the model's own input."""
        spelled = codecs.charmap_decode("\n".join(words).encode(), "strict", self.spelling)[0].split(self.spelling[10])
        ids, counts = array(self.width.char), []
        for i in range(0, len(spelled), 1_000):  # the model's tokens are large beside their ids
            found = list(map(self.model.tokenize, spelled[i : i + 1_000]))
            counts.extend(map(len, found))
            ids.extend([t.id for tokens in found for t in tokens])
        return self._cut(np.frombuffer(ids, self.width), np.r_[0, np.cumsum(counts)])

    def _joined(self, words: list[str]) -> list[bytes]:
        """Ids of words that begin with white space and end without, encoded one after the other."""
        encoded = self.tokenizer.encode("".join(words), add_special_tokens=False)
        ids = np.array(encoded.ids, self.width)
        starts = np.fromiter((a for a, _ in encoded.offsets), np.int64, len(ids))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        return self._cut(ids, np.searchsorted(starts, np.r_[0, np.cumsum(lengths)]))

    def _others(self, words: list[str]) -> list[bytes]:
        """Ids of words of any kind."""
        joined = [w[:1] in BREAKS and w[-1:] not in BREAKS for w in words]
        together = iter(self._joined(list(compress(words, joined))) if any(joined) else ())
        return [next(together) if j else self._whole(w) for w, j in zip(words, joined, strict=True)]

    def _known(self, words: list[str], encode: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """Ids of distinct words, from the memo's two generations or by `encode`."""
        found = list(map(self.new.get, words))
        if None in found:
            missing = [i for i, ids in enumerate(found) if ids is None]
            names = [words[i] for i in missing]
            before = list(map(self.old.get, names))
            unknown = [w for w, ids in zip(names, before, strict=True) if ids is None]
            anew = iter(encode(unknown) if unknown else ())
            ids_of = [next(anew) if ids is None else ids for ids in before]
            for i, ids in zip(missing, ids_of, strict=True):
                found[i] = ids
            if len(self.new) + len(names) > MEMO_WORDS:
                self.old, self.new = self.new, {}
            self.new.update(zip(names, ids_of, strict=True))
        return found

    def _ids(self, words: pa.Array, blank: np.ndarray) -> list[bytes]:
        """Ids of words, which a blank precedes or not. Plain ones share the ids of their letters."""
        cut = pc.extract_regex(words, _PLAIN if self.apart else _NOT_PLAIN)
        plain = cut.is_valid().to_numpy(zero_copy_only=False)
        lead, body, tail = (cut.filter(cut.is_valid()).field(i) for i in range(3))
        spaced = pa.array(blank[plain])
        letters = pc.if_else(spaced, pc.binary_join_element_wise(" ", body, ""), body).dictionary_encode()
        known = self._known(_strings(letters.dictionary, "\n"), self._letters)
        near = list(map(known.__getitem__, letters.indices.to_numpy().tolist()))
        for i in np.flatnonzero(pc.not_equal(lead, "").to_numpy(zero_copy_only=False)).tolist():
            near[i] = self._mark("\n") + near[i]
        tails = tail.dictionary_encode()
        ends = list(map(self._mark, tails.dictionary.to_pylist()))
        near = [ids + ends[i] for ids, i in zip(near, tails.indices.to_numpy().tolist(), strict=True)]
        if plain.all():
            return near
        rest = words.filter(pa.array(~plain)).to_pylist()
        others = [" " + w if b else w for w, b in zip(rest, blank[~plain].tolist(), strict=True)]
        found = np.empty(len(words), object)
        found[plain], found[~plain] = near, self._known(others, self._others)
        return found.tolist()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one text after the other, number of ids of each text) of an array without nulls."""
        even = pc.invert(pc.match_substring_regex(texts, _UNEVEN))
        cut = pc.split_pattern(pc.replace_substring(texts.filter(even), "\n", " \n"), " ")
        flat, bounds = cut.flatten(), cut.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        coded = flat.dictionary_encode() if len(flat) else pa.array([], pa.string()).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        uniques = coded.dictionary
        begin = bounds[:-1]  # the first word of a text has no blank before it
        firsts, first_code = np.unique(code[begin], return_inverse=True)
        distinct = pa.concat_arrays([uniques, uniques.take(pa.array(firsts))])
        blank = pc.invert(pc.starts_with(distinct, "\n")).to_numpy(zero_copy_only=False) & (np.arange(len(distinct)) < len(uniques))
        uneven = texts.filter(pc.invert(even)).to_pylist()
        parts = [*self._ids(distinct, blank), *[self._whole(t) for t in uneven]]
        code[begin] = len(uniques) + first_code
        # texts in their order: even ones are runs of words, an uneven one is a single word
        is_even = even.to_numpy(zero_copy_only=False)
        counts = np.ones(len(texts), np.int64)
        counts[is_even] = np.diff(bounds)
        owner = np.repeat(np.arange(len(texts)), counts)
        words = np.empty(len(owner), np.int64)
        from_even = is_even[owner]
        words[from_even] = code
        words[~from_even] = len(distinct) + np.arange(len(uneven))
        del cut, flat, coded, owner, from_even, code
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // self.width.itemsize
        start = np.r_[0, np.cumsum(size)][:-1]
        values = np.frombuffer(b"".join(parts), self.width)
        length = size[words]
        total = np.cumsum(length)
        at = np.repeat((start[words] - (total - length)).astype(np.int32), length)
        at += np.arange(len(at), dtype=np.int32)
        ends = np.r_[0, total][np.r_[0, np.cumsum(counts)]]
        return values[at], np.diff(ends)


def encoder(path: str) -> WordEncoder | TextEncoder:
    """The encoder of a tokenizer file: a definition of the tokenizers library (.json), ranks of byte pairs (.tiktoken)
    or a sentencepiece model (.model). Files of the tokenizers library that is_byte_level admits are encoded by words."""
    if path not in _LOADED:
        if path.endswith(".tiktoken"):
            import base64

            import public_tokenizers
            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            ranked = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            _LOADED[path] = TextEncoder(ranked.encode_ordinary, max(ranks.values()) + 1)
        elif path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[path] = TextEncoder(pieces.encode, pieces.get_piece_size())
        else:
            with open(path, encoding="utf-8") as definition:
                plain = is_byte_level(json.load(definition))
            _LOADED[path] = WordEncoder(path) if plain else _by_text(path)
    return _LOADED[path]


def _by_text(path: str) -> TextEncoder:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return TextEncoder(lambda text: tokenizer.encode(text, add_special_tokens=False).ids, tokenizer.get_vocab_size(with_added_tokens=True))
