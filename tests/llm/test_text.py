import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arcweave.llm import chat, decontaminate, secrets, toxicity, urls
from arcweave.llm.tokens import encoder


def brute_contamination(text, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words, hit, ids = word.findall(low(text)), set(), set()
    for i, t in items:
        ws = word.findall(low(t))
        n = min(len(ws), window)
        for a in range(len(ws) - n + 1 if n else 0):
            for b in range(len(words) - n + 1):
                if words[b : b + n] == ws[a : a + n]:
                    hit |= set(range(b, b + n))
                    ids.add(i)
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(str(i) for i in ids if i is not None)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("chunk_words", [10**9, 30])
def test_contamination_in_one_chunk_and_many(spark, docs_of, chunk_words):
    rng = random.Random(3)
    w = [f"W{i}é" for i in range(30)]
    items = [(i, " ".join(rng.choice(w) for _ in range(rng.choice([1, 3, 9, 10, 14])))) for i in range(8)] + [(8, None), (9, " .. "), (0, "again W1é"), (None, "W2é")]
    texts = [None, "", "!!"] + [", ".join(rng.choice(w) for _ in range(40)) for _ in range(6)] + ["x " + t.upper() + "-y " + t for _, t in items[:8]]
    docs = docs_of([(i, t, "s") for i, t in enumerate(texts)])
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = {r.doc_id: r for r in decontaminate.contamination(docs, bench, with_text=True, chunk_words=chunk_words).collect()}
    for i, t in enumerate(texts):
        r = found[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute_contamination(t, items), t
        assert (r.clean_text is None) == (t is None)
        if t and not r.n_hit:
            assert r.clean_text == t
    assert decontaminate.contamination(docs_of([]), bench, chunk_words=chunk_words).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(docs, bench.limit(0), chunk_words=chunk_words).collect()} == {0}


def test_contamination_columns_that_clash_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 50)
    rng = random.Random(8)
    names = ["a.b", "hits", "found", "held", "row_id", "at", "text_bytes", "c0", "n_hit"]
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(400))
    bench = spark.createDataFrame([(1, passage), (2, passage), (3, "alone")], "item_id bigint, text string")
    texts = ["x " * 200_000 + passage + " y" * 200_000, "Alone!", None, " ".join(passage.split()[195:205]), " ".join(passage.split()[196:205])]
    docs = spark.createDataFrame([(i, t, *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)], "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in names))
    for chunk_words in (10**6, 100):
        found = decontaminate.contamination(docs, bench, chunk_words=chunk_words)
        assert found.columns == ["doc_id", *names[:-1], "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
        rows = {r.doc_id: tuple(r) for r in found.collect()}
        assert all(rows[i][1 : len(names)] == tuple(f"{n}{i}" for n in names[:-1]) for i in range(5))
        assert [rows[i][len(names) : len(names) + 3] for i in range(5)] == [(400_400, 400, 2), (1, 1, 1), (0, 0, 0), (10, 10, 2), (9, 0, 0)]


def test_window_set_memory_and_chunk_sizes(spark):
    rng = random.Random(9)
    pieces = [(i, 10, b" ".join(b"%032d" % rng.randrange(10**9) for _ in range(200))) for i in map(str, range(200))]
    windows = decontaminate.WindowSet(pieces)
    assert windows.nbytes <= decontaminate.CHUNK_BYTES * 200 * 200
    bench = spark.createDataFrame([(i, "word " * (i * 37 % 900)) for i in range(60)], "item_id bigint, text string")
    chunked, n = decontaminate.window_chunks(bench, 10, 2_000)
    sizes = chunked.groupBy("chunk").agg(F.sum(F.size(F.split(F.col("words").cast("string"), " ")))).collect()
    assert len(sizes) == n > 5 and max(r[1] for r in sizes) <= 2_000 + 900


def test_contamination_by_items_with_string_ids_or_none(spark, docs_of):
    items = [("gsm8k/1", "one two three"), (None, "four five"), (None, "six"), ("10", "seven"), ("9", "seven")]
    texts = ["Four five!", "seven", "one two three six", "one two", None]
    bench = spark.createDataFrame(items, "item_id string, text string")
    for chunk_words in (10**9, 3):
        found = {r.doc_id: r for r in decontaminate.contamination(docs_of([(i, t, "s") for i, t in enumerate(texts)]), bench, chunk_words=chunk_words).collect()}
        for i, t in enumerate(texts):
            r = found[i]
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute_contamination(t, items), t


def test_chunks_of_long_words_are_bounded_in_bytes(spark, docs_of):
    """Words of 10 kB: a chunk holds as many bytes as one of short words."""
    word = [f"{i:05d}" + "x" * 10_000 for i in range(200)]
    bench = spark.createDataFrame([(i, " ".join(word[i : i + 20])) for i in range(0, 200, 20)], "item_id bigint, text string")
    units = 40_000
    chunked, n = decontaminate.window_chunks(bench, 10, units)
    sizes = [r[1] for r in chunked.groupBy("chunk").agg(F.sum(F.length("words"))).collect()]
    assert n > 1 and max(sizes) <= (units + decontaminate.PIECE_WORDS) * decontaminate.UNIT_BYTES + 10 * 10_010
    docs = docs_of([(1, " ".join(word[55:65]), "s"), (2, " ".join(word[25:35]), "s"), (3, " ".join(word[25:34]), "s")])
    found = {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.contamination(docs, bench, chunk_words=units).collect()}
    assert found == {1: (0, 0), 2: (10, 1), 3: (0, 0)}


def test_equal_hashes_are_told_apart_by_words(monkeypatch):
    """Windows whose words all hash alike."""
    monkeypatch.setattr(decontaminate._WordHashes, "__missing__", lambda self, word: 7)
    windows = decontaminate.WindowSet([("1", 2, b"a b c"), ("2", 2, b"b c")])
    assert list(windows.hits([[b"b", b"c"], [b"c", b"a"], [b"a", b"b"]], decontaminate._WordHashes())) == [(0, 0, 2, {"1", "2"}), (2, 0, 2, {"1"})]


def test_cleaned_text_loses_the_hit_words():
    text = "Keep this. one TWO three, four! and that".encode()
    hit = np.array([False, False, True, True, True, True, False, False])
    assert decontaminate.cleaned(text, hit) == b"Keep this. ! and that"


BASE = {"assign": r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": r"(AKIA[A-Z0-9]+)", "hex": r"([0-9a-f]+)"}


def brute_base(text):
    spans = []
    for o, (kind, least) in enumerate((("assign", 6), ("access", 20), ("hex", 24))):
        for m in re.finditer(BASE[kind], text or "", re.I if kind == "assign" else 0):
            if len(m[1]) >= least:
                spans.append((m.start(), o, kind, m.end()))
    return sorted(spans)


def test_base_spans_equal_brute_force(spark, docs_of):
    rng = random.Random(5)
    bits = ["password=abc", "Token: 'abcdefgh'", "api_key = ", "secret:token:abcdef", "AKIA" + "B7" * 9, "AKIAAKIA" + "C" * 12, "deadbeef" * 4, "0" * 24, "é😀", " ", "\n", "passwd=token:abcdefg", "x" * 30, "https://h.example/x"]
    texts = [None, "", "plain"] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    texts += texts[10:13]
    found = {r.doc_id: r for r in secrets.secret_spans(docs_of([(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        spans = brute_base(t)
        listed = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
        assert found[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), t
        assert [found[i].n_assign, found[i].n_access, found[i].n_hex] == [sum(s[2] == k for s in spans) for k in BASE]
        assert set(listed.split(",")) - {""} <= set(found[i].spans.split(","))
    assert secrets.secret_spans(docs_of([])).count() == 0


def test_weak_candidates_need_a_complement(spark, docs_of):
    key, blob, url = "AKIA" + "X" * 16, "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzzzzzzzz00", "https://s3.example.com"
    pad = " word" * 100
    texts = [f"{key} {blob} {url}", f"{blob} {url}", f"{key}{pad} {blob}", f"{key}{pad} {url}", f"token=abcdefgh {url} {blob}"]
    kinds = {r.doc_id: [s.split(":")[0] for s in r.spans.split(",") if s] for r in secrets.secret_spans(docs_of([(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert kinds == {0: ["access", "blob", "endpoint"], 1: [], 2: ["access"], 3: ["access"], 4: ["assign", "endpoint"]}


def brute_spans(text):
    """All spans: base ones, and weak ones near a complement and outside of base spans."""
    base, weak = brute_base(text), []
    for o, kind in ((3, "endpoint"), (4, "blob")):
        for m in re.finditer(secrets.PATTERNS[kind], text or ""):
            a, b = m.span()
            near = [k for x, _, k, y in base if max(x - b, a - y) <= secrets.SCOPE]
            if (near if kind == "endpoint" else "access" in near) and not any(x < b and y > a for x, _, _, y in base):
                weak.append((a, o, kind, b))
    return sorted(base + weak)


def test_linked_spans_equal_brute_force(spark, docs_of):
    rng = random.Random(11)
    bits = ["AKIA" + "Q" * 16, "wJalrXUtnFEMI/K7MDENG/bPxRfiCY", "https://s3.example.com:90", "token=abcdefgh", "f0" * 14, " pad" * 50, " word" * 30, " é ", "\n", "/" * 24 + "=="]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(120)]
    texts.append(" plain words" * 60_000 + " token=abcdefgh http://x.example" + " more" * 60_000)
    found = {r.doc_id: r.spans for r in secrets.secret_spans(docs_of([(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        assert found[i] == ",".join(f"{k}:{a}:{b}" for a, _, k, b in brute_spans(t)), t[:400]
    assert sum("endpoint" in s for s in found.values()) > 20 and sum("blob" in s for s in found.values()) > 20


def test_rules_hosts_and_paths(spark):
    cases = {
        "http://a.net/x": ("a.net", "/x", "net/", "block"),
        "http://Example.NET/en/?q": ("example.net", "/en/", "example.net/en/", "allow"),
        "http://www.example.net/EN/": ("www.example.net", "/EN/", "net/", "block"),
        "http://badexample.com/de/": ("badexample.com", "/de/", None, None),
        "https://x.example.com/de/a#f": ("x.example.com", "/de/a", "example.com/de/", "block"),
        "http://y.org/fr/://z": ("y.org", "/fr/://z", "org/fr/", "allow"),
        "http://a.net": ("a.net", "", None, None),
        "nothing": ("", "", None, None),
        None: ("", "", None, None),
        "": ("", "", None, None),
    }
    frame = spark.createDataFrame([(u, "clash") for u in cases], "url string, verdict string")
    model = urls.fit_urls(spark.createDataFrame([], "url string, block int"))
    for r in urls.judge(frame, model).collect():
        host, path, rule, verdict = cases[r.url]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow"), r
    assert urls.judge(frame.limit(0), model).count() == 0


def test_trees_learn_lexical_labels(spark):
    rng = random.Random(1)
    rows = [(f"http://{'cheap-' * (b * 2)}{rng.choice('abc')}{i}.{rng.choice(['com', 'org'])}/p/{i}{'?a=1&b=2' * b}", b) for i in range(400) for b in [rng.randint(0, 1)]]
    model = urls.fit_urls(spark.createDataFrame(rows[:300], "url string, block int"))
    held = {u: ("block" if b else "allow") for u, b in rows[300:]}
    found = urls.judge(spark.createDataFrame(rows[300:], "url string, block int"), model, rules=()).collect()
    assert sum(r.verdict == held[r.url] for r in found) >= 98


def test_url_columns_that_clash_stay(spark):
    names = ["features", "probability", "prediction", "length", "labels", "suffix", "suffix_rate", "row", "chosen", "a.b", "fold"]
    rows = [(f"http://{'x' * (1 + 30 * b)}{i}.com/p", b, *[f"{n}{i}" for n in names]) for i in range(40) for b in (0, 1)]
    schema = "url string, block int, " + ", ".join(f"`{n}` string" for n in names)
    frame = spark.createDataFrame(rows, schema)
    model = urls.fit_urls(frame)
    assert model.trees is not None
    found = urls.judge(frame, model, rules=())
    assert found.columns == ["url", "block", *names, "host", "path", "rule", "verdict", "block_probability"]
    assert sorted(tuple(r)[:13] for r in found.collect()) == sorted(rows)
    assert all(r.verdict == ("block" if r.block else "allow") for r in found.collect())
    long = spark.createDataFrame([("http://h.org/" + "a/" * 200_000,)], "url string")
    assert [r.verdict in ("allow", "block") and len(r.path) for r in urls.judge(long, model).collect()] == [400_001]


def test_url_suffix_rates_are_out_of_fold(spark):
    """A label that nothing but the suffix's own row could tell is not learned."""
    rows = [(f"http://w.s{i:03}.com/", i * 7919 % 2) for i in range(200)]
    assert 0.3 < urls.held_out_auc(spark.createDataFrame(rows, "url string, block int")) < 0.7


def test_op4_equals_plain_rules_over_all_pages(spark, sf_dir):
    from arcweave.llm import catalog

    def plain(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = ("", "") if m is None else (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2])
        fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, *(max(fits)[1:] if fits else (None, None))

    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    found = catalog.queries()["op4_url_filter"](spark, sf_dir).collect()
    assert len(found) == len(pages)
    for r in found:
        host, path, rule, verdict = plain(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.block_probability >= 0.5 else "allow"))


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", None), (1, 1, "user", "</s> <|end|> <\\|x<|turn|>"), (1, 2, "assistant", "a<|text|>b <|endoftext|>\n"), (1, 3, "assistant", " é😀"), (1, 4, "user", "x"),
            (2, None, None, "t"), (2, 0, "assistant", ""), (None, 0, "assistant", "y"), (3, 0, "assistant", "z"), (3, 0, "assistant", "z"), (4, 0, "user", "long é " * 300_000)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")
    out = chat.format_chats(frame)
    found = {r.conv_id: r for r in chat.chat_digests(out).collect()}
    for c, r in found.items():
        turns = sorted(((t if t is not None else -1, o or "", x or "") for i, t, o, x in rows if i == c))
        told = "".join(f"{o}\n{x}\n" for _, o, x in turns)
        loss = "".join(x for _, o, x in turns if o == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(told.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len(found) == 5
    assert chat.format_chats(frame.limit(0)).count() == 0


def test_rows_without_conversation_stand_alone(spark):
    frame = spark.createDataFrame([(None, i, "assistant", f"t{i}") for i in range(50)] + [(1, 0, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    found = chat.chat_digests(chat.format_chats(frame)).collect()
    assert sorted((r.n_turns, r.loss_chars > 0, r.conv_id or 0) for r in found) == [(1, False, 1)] + [(1, True, 0)] * 50
    assert len({r.loss_sha256 for r in found}) == 51


def test_chat_encoding_equals_the_tokenizer_with_special_marks():
    import public_tokenizers
    from tokenizers import AddedToken, Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, own = Tokenizer.from_file(path), chat.ChatTokenizer(path)
    plain.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (chat.TURN, chat.TEXT, chat.END)])
    rng = random.Random(6)
    bits = list("ab1.,' \n_)é-$中́　 \t|<\\") + ["<|endoftext|>", "word ", " text", chat.TURN]
    talks = [[(rng.choice(["user", "assistant", "", "é"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 20)))) for _ in range(rng.randint(0, 4))] for _ in range(300)]
    rendered = [chat.render(t, "assistant")[0] for t in talks]
    ids, starts, ends = own.encode(rendered)
    expected = [plain.encode(t, add_special_tokens=False).ids for t in rendered]
    assert ids.tolist() == [i for e in expected for i in e]
    data = "".join(rendered).encode()
    assert all(data[a:b] == own.bytes[i] for i, a, b in zip(ids.tolist(), starts.tolist(), ends.tolist(), strict=True))
    with pytest.raises(ValueError):
        chat.ChatTokenizer(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("text", ["<|", "<\\|", "<\\\\|", "a<|b|>", "<<|", "<\\", "|>", ""])
def test_escape_is_reversible(text):
    assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text


def test_token_spans_by_binary_search():
    offsets = np.array([[0, 2], [2, 5], [5, 5], [5, 9]])
    first, last = chat.token_spans(offsets, np.array([[2, 5], [5, 5], [6, 8]]))
    assert [list(range(a, b)) for a, b in zip(first, last, strict=True)] == [[1], [3]]


def test_word_encoder_equals_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, own = Tokenizer.from_file(path), encoder(path)
    rng = random.Random(2)
    letters = list("ab1.,' \n_)é-$中́　 \t<|endoftext|>")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += ["word another.\nLine two, it's. (x). 3.14, a_.b", "", " ", "\n", "<|endoftext|>"]
    ids, counts = own.encode(pa.array(texts))
    cuts = np.r_[0, np.cumsum(counts)]
    assert all(ids[a:b].tolist() == plain.encode(t, add_special_tokens=False).ids for t, a, b in zip(texts, cuts, cuts[1:], strict=False))


def test_words_that_differ_by_signs_are_encoded_once():
    """Such words, and those that begin a line or a text, share the ids of their letters."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from arcweave.llm.tokens import WordEncoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, own, seen = Tokenizer.from_file(path), WordEncoder(path), []

    class Seen:
        def tokenize(self, word):
            seen.append(word)
            return plain.model.tokenize(word)

    own.model = Seen()
    words = [f"{a}{b}" for a in ("Ka", "lö", "mi", "ñe") for b in ("ra", "ti", "\u024f")]
    texts = [f"{w} {w} {w}. {w}, {w}### {w}!!\n{w}\n{w}&&&\nx" for w in words] + ["", "it's <b> 中. a|b 3. é😀,", "中"]
    for _ in range(2):
        ids, counts = own.encode(pa.array(texts))
        cuts = np.r_[0, np.cumsum(counts)]
        assert all(ids[a:b].tolist() == plain.encode(t, add_special_tokens=False).ids for t, a, b in zip(texts, cuts, cuts[1:], strict=False))
    assert len(seen) == len(set(seen)) and len(seen) <= 2 * len(words) + 6


@pytest.mark.parametrize("token", ["and", "##", "n.", "é", "<|x|>", "a1"])
def test_added_tokens_inside_words(tmp_path, token):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    definition = json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))
    definition["added_tokens"].append(definition["added_tokens"][0] | {"id": 50257, "content": token})
    (tmp_path / "own.json").write_text(json.dumps(definition), encoding="utf-8")
    plain, own = Tokenizer.from_file(str(tmp_path / "own.json")), encoder(str(tmp_path / "own.json"))
    texts = ["band andand.\nand sand###", "in. n.n éa caféé, <|x|>y a1b a<|x|>.", ""]
    ids, counts = own.encode(pa.array(texts))
    cuts = np.r_[0, np.cumsum(counts)]
    assert [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_chain_learns_and_handles_edges(spark, docs_of):
    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "su", "ta") for b in ("ra", "ti", "do", "pe", "vu", "xo", "zy")]
    junk, bad = ["qqjunk", "zzspam"], ["vileone", "viletwo", "nasty"]
    rows, labels = [], []
    for i in range(600):
        low, toxic = rng.random() < 0.2, rng.random() < 0.2
        words = [rng.choice(vocabulary) for _ in range(rng.randint(10, 80))] + [rng.choice(junk)] * low + [rng.choice(bad)] * toxic
        rng.shuffle(words)
        rows.append((i, " ".join(words), "s")), labels.append((i, int(not low), int(toxic)))
    docs = docs_of(rows)
    known = toxicity.labelled(spark.createDataFrame([(i, q, t) for i, q, t in labels[:400]] + [(None, 1, 1), (1, None, 0)], "doc_id bigint, quality int, toxic int"))
    model = toxicity.fit_chain(docs, known)
    found = {r.doc_id: r for r in toxicity.toxicity(docs, model).collect()}
    right = sum(found[i].toxic == bool(t) for i, _, t in labels[400:])
    assert right >= 195 and found[0].text == rows[0][1]
    edge = toxicity.toxicity(docs_of([(1, None, None), (2, "", "s"), (None, "vileone " * 50_000, "s")]), model).collect()
    assert [r.toxic for r in sorted(edge, key=lambda r: r.doc_id or 9)] == [False, False, True]
    nothing = toxicity.fit_chain(docs.limit(0), known)
    assert {r.toxic for r in toxicity.toxicity(docs.limit(3), nothing).collect()} == {False}


def plain_features(text):
    """Slots of a text's distinct words (letters, or any character beyond ASCII) and of their first 4 and 5 letters."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c if "a" <= c <= "z" or ord(c) > 127 else " " for c in text or "")
    names = set()
    for word in set(low.split(" ")) - {""}:
        names |= {word, "4" + word[:4], "5" + word[:5]}
    return {zlib.crc32(n.encode()) >> (32 - toxicity.BITS) for n in names}


def test_op5_equals_a_plain_chain(spark, sf_dir):
    """Scores of the query over all documents from the models' weights alone, one document and one category at a time."""
    from arcweave.llm import catalog

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit_chain(docs, toxicity.labelled(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    found = {r.doc_id: r for r in catalog.queries()["op5_toxicity"](spark, sf_dir).collect()}
    assert len(found) == docs.count()
    for r in docs.collect():
        at, chain = sorted(plain_features(r.text)), []
        for m in model.models:
            odds = sum(float(m.weights[i]) for i in at) + m.bias + sum(float(w) * c for w, c in zip(m.chain, chain, strict=True))
            chain.append(min(max(odds, -9.0), 9.0))
        p = [1 / (1 + np.exp(-c)) for c in chain]
        assert [found[r.doc_id].p_low_quality, found[r.doc_id].p_toxic] == pytest.approx(p, abs=1e-6)
        assert found[r.doc_id].toxic == (chain[-1] >= model.thresholds[-1])


def test_chain_on_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = toxicity.labelled(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = "pmod(hash(doc_id), 4) = 0"
    model = toxicity.fit_chain(docs, labels.where(f"NOT {held}"))
    rows = toxicity.toxicity(docs.drop("toxic"), model).select("doc_id", "toxic").join(labels.where(held).selectExpr("doc_id", "toxic AS truth"), "doc_id").collect()
    hits = sum(r.toxic and r.truth == 1 for r in rows)
    flagged, wanted = sum(r.toxic for r in rows), sum(r.truth for r in rows)
    print("held-out", len(rows), "precision", hits / max(flagged, 1), "recall", hits / wanted)
    assert hits >= 0.85 * flagged and hits >= 0.7 * wanted


def test_chain_does_not_depend_on_which_copy_comes_first(spark, docs_of):
    rows = [(i % 40, f"word{i % 5} text{i % 7} more{i}", "s") for i in range(120)]
    known = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(40)], "doc_id bigint, low_quality int, toxic int")
    one, two = toxicity.fit_chain(docs_of(rows), known), toxicity.fit_chain(docs_of(rows[::-1]), known)
    assert all((a.weights == b.weights).all() and a.bias == b.bias for a, b in zip(one.models, two.models, strict=True))
    clash = docs_of(rows).selectExpr("doc_id", "text", "1 AS `a.b`", "2 AS p_toxic", "3 AS c0")
    assert toxicity.toxicity(clash, one).columns == ["doc_id", "text", "a.b", "c0", "p_low_quality", "p_toxic", "toxic"]
    assert {(r["a.b"], r.c0) for r in toxicity.toxicity(clash, one, keep_text=False).collect()} == {(1, 3)}
    few = toxicity.fit_chain(docs_of(rows), known, sample_features=10)
    assert len(few.models) == 2


def test_only_features_meet_in_one_task(spark, docs_of, monkeypatch):
    docs = docs_of([(i, f"word{i % 5} text", "s") for i in range(30)])
    known = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(30)], "doc_id bigint, low_quality int, toxic int")
    seen, whole = [], type(docs).repartition
    monkeypatch.setattr(type(docs), "repartition", lambda self, n, *c: seen.append((n, set(self.columns))) or whole(self, n, *c))
    toxicity.fit_chain(docs, known)
    assert seen == [(1, {"labels", "o", "doc_id", "features"})]
