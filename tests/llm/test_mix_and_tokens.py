import hashlib
import itertools
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from arcweave.llm import mixing, near_dedup, token_store, toxicity
from arcweave.llm.perfect_hash import PerfectHash
from arcweave.llm.store import fresh_path
from tests.llm.test_dedup import brute_components
from tests.llm.test_text import brute_contamination


def brute_targets(sizes, weights=(3, 1, 2)):
    """source -> exact target: caps are taken out one by one while any share exceeds its cap."""
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {x: weights[i % 3] for i, x in enumerate(order)}
    left, open_, target = Fraction(3, 2) * sum(sizes.values()), set(order), {}
    while True:
        level = left / sum(weight[x] for x in open_) if open_ else 0
        over = [x for x in open_ if level * weight[x] > 2 * sizes[x]]
        if not over:
            return target | {x: level * weight[x] for x in open_}
        for x in over:
            target[x] = Fraction(2 * sizes[x])
            left -= target[x]
            open_.remove(x)


def brute_mix(rows, slices):
    """(doc_id, size, source) -> words taken by equal rows together: all packets sorted by finish, cut at the budget."""
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    docs = [(s, md5(f"mix:{'null' if i is None else i}:{md5(t or '')}"), size(t), i) for i, t, s in rows]
    sizes = Counter()
    for s, _, n, _ in docs:
        sizes[s] += n
    targets, packets = brute_targets(sizes), []
    for source in sizes:
        at, step = 0, max(1, math.ceil(float(targets[source]) / slices))
        queue = sorted((d[1:] for d in docs if d[0] == source), key=lambda d: d[:2])
        for k in range(2):
            for _, n, i in queue:
                for off in range(0, n, step):
                    words = min(step, n - off)
                    packets.append(((at + off + words) / float(targets[source]), source is None, source or "", at + off, words, (i, n, source)))
                at += n
    left, taken = math.floor(sum(sizes.values()) * 1.5), Counter()
    for *_, words, key in sorted(packets, key=lambda p: p[:4]):
        taken[key] += min(words, left)
        left -= min(words, left)
    return taken, sizes, targets


MIXES = {
    "plain": [(i, "w " * (i % 7 + 1), ["a", "b", None, "c"][i % 4]) for i in range(200)],
    "caps bind in turn": [(i, "w " * (i % 5 + 1), "abcdefgh"[min(i // 9, 7)]) for i in range(200)] + [(900, "z " * 300, "d"), (901, "q", "zz")],
    "long documents": [(i, f"w{i} " * (1 if i % 9 else 900), ["a", "b", None][i % 3]) for i in range(60)],
    "nulls and copies": [(None, "x y", "a")] * 20 + [(7, "p q r", None)] * 15 + [(8, None, "a"), (9, "", "e"), (9, " ", None), (None, None, None)] + [(i, "k " * i, "a") for i in range(30)],
}


@pytest.mark.parametrize("name,slices", [*[(n, 16) for n in sorted(MIXES)], ("plain", mixing.SLICES)])
def test_mix_equals_brute_force(spark, docs_of, name, slices):
    """The cut of the sorted packets, water-filled targets, and how near each source comes."""
    rows = MIXES[name]
    expected, sizes, targets = brute_mix(rows, slices)
    found = mixing.mix(docs_of(rows), slices=slices).collect()
    assert len(found) == len(rows)
    source_of = {(i, len((t or "").split())): s for i, t, s in rows}
    taken, by_source = Counter(), Counter()
    for r in found:
        source = source_of[(r.doc_id, r.size)]
        assert not r.size or (r.source_size, r.target) == (sizes[source], pytest.approx(float(targets[source])))
        taken[(r.doc_id, r.size, source)] += r.taken
        by_source[source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    assert +taken == +expected
    assert sum(by_source.values()) == math.floor(1.5 * sum(sizes.values()))
    for s, target in targets.items():
        assert abs(by_source[s] - target) <= 2 * math.ceil(target / slices)
    finish = [r.virtual_finish for r in found if r.virtual_finish is not None]
    assert finish == sorted(finish)


def test_mix_of_nothing(spark, docs_of):
    assert mixing.mix(docs_of([])).count() == 0 and mixing.mixed_documents(docs_of([])).count() == 0
    assert [tuple(r)[:5] for r in mixing.mix(docs_of([(1, None, None)])).collect()] == [(1, 0, 0, 0.0, 0)]
    assert [r.doc_id for r in mixing.mixed_documents(docs_of([(1, None, None)])).collect()] == [1]


def test_a_hot_id_is_spread_over_ranges(spark, docs_of, monkeypatch):
    seen, real = {}, mixing.stored
    monkeypatch.setattr(mixing, "stored", lambda df, name, *a: seen.setdefault(name, real(df, name, *a)))
    mixing.mix(docs_of([(None, "same words", "a")] * 4000 + [(i, "w", "b") for i in range(100)])).count()
    largest = seen["mix-ranges"].groupBy("range").count().agg({"count": "max"}).first()[0]
    assert largest < 2500


def test_mixed_documents_are_whole(spark, docs_of):
    rows = [(i, "w " * (i % 7 + 1), ["a", "b", None][i % 3]) for i in range(300)]
    docs = docs_of(rows)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    times = Counter(r.doc_id for r in mixed.collect())
    assert set(times.values()) <= {1, 2}
    targets = {r.doc_id: (r.source_size, r.target) for r in mixing.mix(docs).collect()}
    taken = Counter()
    for i, n in times.items():
        taken[targets[i]] += n * (i % 7 + 1)
    assert all(abs(n - k[1]) <= 4 for k, n in taken.items())
    odd = docs.selectExpr("doc_id", "text", "source", "1 AS `a.b`", "2 AS size", "3 AS target", "4 AS packet")
    again = mixing.mixed_documents(odd)
    assert again.columns == odd.columns and {tuple(r)[3:] for r in again.collect()} == {(1, 2, 3, 4)}


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash_is_minimal(n):
    keys = np.unique(np.random.default_rng(n).integers(-(2**62), 2**62, n))
    mph = PerfectHash.from_bytes(*PerfectHash.build(keys).to_bytes())
    assert sorted(mph.slots(keys).tolist()) == list(range(len(keys)))


def test_token_store_equals_brute_force(spark, docs_of):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(i * 3 - 5, t, "s") for i, t in enumerate(["one two", "", None, "é\tü", "x " * 3000, "same", "a.b,c"])]
    rows += [(7, "later", "s"), (7, "later", "s"), (None, "no key", "s")]
    shards = token_store.write_tokens(docs_of(rows), fresh_path(spark, "tokens"), shard_tokens=50)
    assert shards.shards.count() > 1
    found = token_store.stored_documents(shards).orderBy("start").collect()
    assert len(found) == len(rows)
    at = 0
    expected = Counter()
    for i, t, _ in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        expected[(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == expected
    keys = [r.doc_id for r in found]
    assert keys[0] is None and keys[1:] == sorted(keys[1:])
    for r in found:
        assert r.start == at
        at += r.n_tokens
    again = token_store.TokenStore(spark, shards.path)
    assert again.ids(-5) == plain.encode("one two").ids + [2]
    assert again.ids(12345) is None and again.ids(-4) is None and again.ids(-(2**60)) is None
    assert again.ids(7) == plain.encode("x " * 3000).ids + [2] or again.ids(7) == plain.encode("later").ids + [2]
    assert token_store.stored_documents(token_store.write_tokens(docs_of([]), fresh_path(spark, "tokens"))).count() == 0


def test_wide_ids(spark, docs_of):
    shards = token_store.write_tokens(docs_of([(1, "a b", "s")]), fresh_path(spark, "tokens"), end_id=70_000)
    assert shards.ids(1)[-1] == 70_000


def test_token_ids_of_every_key_from_one_file(spark, docs_of):
    """Nulls, copies and long texts across shards; a lookup reads one file."""
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(i, f"text number {i}", "s") for i in range(300)] + [(None, f"no key {i}", "s") for i in range(40)]
    rows += [(77, "text number 77", "s")] * 60 + [(400, "long " * 300_000, "s"), (401, None, "s")]
    store = token_store.write_tokens(docs_of(rows), fresh_path(spark, "tokens"), shard_tokens=64)
    texts = {i: t for i, t, _ in rows if i is not None}
    found = token_store.stored_documents(store).collect()
    assert len(found) == len(rows) and sum(r.doc_id is None for r in found) == 40
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    for key in (0, 76, 77, 78, 150, 299, 400, 401):
        assert store.ids(key) == plain.encode(texts[key] or "").ids + [2]
    files, first, last = store._parts
    assert all(b <= a for a, b in zip(first[1:], last, strict=False))
    scanned = []
    reader = type(spark.read)
    real = reader.parquet
    try:
        reader.parquet = lambda self, *paths, **o: scanned.extend(paths) or real(self, *paths, **o)
        store.ids(150)
    finally:
        reader.parquet = real
    assert len(scanned) == 1 and scanned[0] in files
    shard = store.shards.select("payload", "offsets", "width").first()
    assert len(shard.payload) == int(np.frombuffer(shard.offsets, "<u8")[-1])


def test_op10_equals_brute_force(spark, sf_dir):
    from arcweave.llm import catalog

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = {r.doc_id: r for r in catalog.queries()["op10_token_output"](spark, sf_dir).collect()}
    at = 0
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect():
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [2]
        f = found.pop(r.doc_id)
        assert (f.start, f.n_tokens, f.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert not found


def reference_ids(name):
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        t = Tokenizer.from_file(path)
        return lambda x: t.encode(x, add_special_tokens=False).ids
    if name.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path).encode
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb").read().splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"])
def test_every_public_tokenizer(spark, docs_of, name):
    texts = ["It's plain.", "Two\nlines, UPPER  and é😀", "", "12,5 a_b", "word " * 500 + "end"]
    store = token_store.write_tokens(docs_of([(i, t, "s") for i, t in enumerate(texts)]), fresh_path(spark, "tokens"), public_tokenizers.path(name))
    ids = reference_ids(name)
    assert [store.ids(i) for i in range(len(texts))] == [ids(t) + [2] for t in texts]


def test_only_byte_level_definitions_are_cut_into_words():
    import json

    from arcweave.llm.tokens import TextEncoder, encoder, is_byte_level

    definition = json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))
    assert is_byte_level(definition)
    changes = [{"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": definition["pre_tokenizer"] | {"add_prefix_space": True}}, {"pre_tokenizer": None},
               {"model": definition["model"] | {"type": "WordPiece"}}, {"model": definition["model"] | {"end_of_word_suffix": "</w>"}}, {"added_tokens": [definition["added_tokens"][0] | {"lstrip": True}]}, {"truncation": {"max_length": 3}}]
    assert not any(is_byte_level(definition | c) for c in changes)
    assert isinstance(encoder(public_tokenizers.path("word_bpe_49k.json")), TextEncoder)


def test_pipeline_equals_brute_force(spark, sf_dir):
    """Each stage against a plain version of it, then the whole run against the stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    model = toxicity.fit_chain(docs, toxicity.labelled(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    memo = toxicity._WordFeatures()
    odds = model.odds([toxicity.features(t.encode(), memo) for _, t in rows])[:, -1]
    rows = [r for r, o in zip(rows, odds, strict=True) if o < model.thresholds[-1]]
    _, label = brute_components([t for _, t in rows], 5, 80)
    rows = [r for k, r in enumerate(rows) if label[k] == k]
    rows = [r for r in rows if not brute_contamination(r[1], bench)[-1]]
    out = corpus_pipeline.run(spark, sf_dir).collect()
    times = Counter(r.doc_id for r in out)
    texts = dict(rows)
    assert set(times) <= set(texts) and set(times.values()) <= {1, 2}
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in out:
        ids = plain.encode(texts[r.doc_id], add_special_tokens=False).ids + [2]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    ordered = sorted(out, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted(r.doc_id for r in out)
    kept = docs.where(docs.doc_id.isin(list(texts)))
    assert times == Counter(r.doc_id for r in mixing.mixed_documents(kept).collect())
    assert near_dedup.keep_one(kept).count() == len(rows)
    assert len(corpus_pipeline.STAGES) == 5


def test_a_store_bears_split_files_and_hot_keys(spark, docs_of):
    """With spark.sql.files.maxRecordsPerFile set, and with 600 rows of one doc_id over many shards."""
    rows = [(i, f"words of text {i} " * 3, "s") for i in range(200)] + [(77, f"copy {i} " * 5, "s") for i in range(600)]
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "2")
    try:
        store = token_store.write_tokens(docs_of(rows), fresh_path(spark, "tokens"), shard_tokens=64)
        found = token_store.stored_documents(store).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert len(found) == 800
    order = sorted(found, key=lambda r: r.start)
    assert [r.start for r in order] == [0, *itertools.accumulate(r.n_tokens for r in order)][:-1] and [r.doc_id for r in order] == sorted(r[0] for r in rows)
    first = min((r for r in found if r.doc_id == 77), key=lambda r: r.start)
    assert len(store.ids(77)) == first.n_tokens and store.ids(1000) is None and store.ids(-1) is None
    assert zlib.crc32(np.array(store.ids(77), "<u4").tobytes()) == first.ids_crc32


def test_a_lookup_in_split_files_reads_one(spark, docs_of, monkeypatch):
    """A store whose parts have a file per shard, with rows of no key and of one key over several files."""
    rows = [(i, f"words of text {i} " * 3, "s") for i in range(100)] + [(50, "copy " * 9, "s")] * 40 + [(None, "no key " * 9, "s")] * 30
    whole, path = token_store.write_tokens(docs_of(rows), fresh_path(spark, "tokens"), shard_tokens=16), fresh_path(spark, "tokens")
    whole.shards.coalesce(1).sortWithinPartitions("part", "seq").write.option("maxRecordsPerFile", 1).parquet(f"{path}/shards")
    token_store._write_manifest(spark, path)
    store = token_store.TokenStore(spark, path)
    parts = store.manifest.collect()
    assert len({r.part for r in parts}) == len(parts) and max(len(r.files) for r in parts) > 1
    assert sum(r.n_docs for r in parts) == len(rows)
    first = min((r for r in token_store.stored_documents(store).collect() if r.doc_id == 50), key=lambda r: r.start)
    scanned, reader = [], type(spark.read)
    real = reader.parquet
    monkeypatch.setattr(reader, "parquet", lambda self, *paths, **o: scanned.extend(paths) or real(self, *paths, **o))
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    keys = (0, 49, 51, 99)
    assert store._parts and not scanned
    assert [store.ids(i) for i in keys] == [plain.encode(rows[i][1]).ids + [2] for i in keys]
    assert zlib.crc32(np.array(store.ids(50), "<u4").tobytes()) == first.ids_crc32
    assert len(scanned) == len(keys) + 1 and store.ids(100) is None


def test_an_absent_key_with_a_known_fingerprint_is_absent(spark, docs_of, monkeypatch):
    store = token_store.write_tokens(docs_of([(i, "a b", "s") for i in range(0, 100, 2)]), fresh_path(spark, "tokens"))
    monkeypatch.setattr(token_store, "ordinals", lambda shard, keys: np.zeros(len(keys), np.int64))  # as if fingerprints agreed
    assert store.ids(51) is None and store.ids(0) is not None
