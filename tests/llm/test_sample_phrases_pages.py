"""Importance resampling, collocations and page text against brute force."""

import hashlib
import itertools
import math
import pathlib
import random
import re
import zlib
from collections import Counter
from html import unescape

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from arcweave.llm import collocations as co
from arcweave.llm import html_text as ht
from arcweave.llm import resampling as rs
from tests.llm.conftest import rows_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# importance resampling


def brute_resample(docs, target, run, buckets, percent, least):
    def feats(text):
        ws = WORD.findall((text or "").translate(LOWER))
        return len(ws), [" ".join(ws[i : i + k]) for k in range(1, run + 1) for i in range(len(ws) - k + 1)]

    def hashed(f):
        return zlib.crc32(f.encode()) % buckets

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(hashed, feats(text)[1]))
    for text in target:
        t.update(map(hashed, feats(text)[1]))
    total_s, total_t, out = sum(s.values()), sum(t.values()), []
    for key, text in docs:
        n, fs = feats(text)
        gain = sum(math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in map(hashed, fs))
        weight = gain // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): i for i, r in enumerate(able[: len(able) * percent // 100], 1)}
    return sorted(((*r[:4], ranks.get(id(r))) for r in out), key=repr)


@pytest.mark.parametrize("run,buckets,shard", [(1, 10_000, 40), (2, 97, 1_000_000), (3, 50, 1)])
def test_resampling_equals_brute_force(spark, docs_of, run, buckets, shard):
    rng = random.Random(run)
    vocabulary = ["Ab", "b", "cé", "d4", "E", "f", "the", "日本", "x" * 300]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 25, 60])))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, " .,;\n"), (None, "ab b " * 12), (503, "the " * 30_000), (504, "z" * 100_000)]
    target = ["the b the", None, "", "ab cé -- D4"]
    table = docs_of([(i, t, "s") for i, t in docs])
    bench = spark.createDataFrame([(None, t, i) for i, t in enumerate(target)], "item_id string, text string, weight int")
    found = rs.resampled(table, bench, run=run, buckets=buckets, percent=30, least_words=3, shard_words=shard)
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    assert found.columns == names
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_resample(docs, target, run, buckets, 30, 3)
    drawn = rs.drawn_documents(table, bench, run=run, buckets=buckets, percent=30, least_words=3)
    kept = {r[0] for r in brute_resample(docs, target, run, buckets, 30, 3) if r[4] is not None and r[0] is not None}
    assert drawn.columns == table.columns and {r.doc_id for r in drawn.collect()} == kept


def test_resampling_of_copies_and_empty_tables(spark, docs_of):
    """A third of the rows are one row; an empty target; an empty corpus."""
    docs = [(7, "same words all over again " * 5)] * 50 + [(i, f"other words number {i} " * 6) for i in range(100)]
    table, nothing = docs_of([(i, t, "s") for i, t in docs]), spark.createDataFrame([], "text string")
    found = sorted((tuple(r) for r in rs.resampled(table, nothing, percent=40).collect()), key=repr)
    assert [r[:4] for r in found] == [r[:4] for r in brute_resample(docs, [], 1, 10_000, 40, 20)]
    assert sorted(r[4] for r in found if r[4]) == list(range(1, 61))
    assert rs.resampled(docs_of([]), table).count() == 0


def test_resampling_shards_are_bounded_by_bytes(spark):
    """A million words may be gigabytes: 2,400 documents of ten distinct words of 2,560 bytes, in one task."""
    text = F.concat_ws(" ", *[F.repeat(F.sha2(F.concat_ws(":", F.col("id"), F.lit(j)), 256), 40) for j in range(10)])
    docs = spark.range(0, 2400, 1, 1).select(F.col("id").alias("doc_id"), text.cast("binary").alias("text"))
    shards = docs.mapInArrow(rs._sharder(1, rs.SHARD_WORDS), rs._SHARD)
    size = F.aggregate("features", F.lit(0), lambda n, x: n + F.length(x))
    found = shards.select(size.alias("bytes"), F.size("doc_ids").alias("docs")).collect()
    assert sum(r.docs for r in found) == 2400 and sum(r.bytes for r in found) == 2400 * 25_600
    assert max(r.bytes for r in found) <= rs.SHARD_BYTES + 25_600


def test_resampling_weighs_few_shards_at_once(spark, docs_of, tmp_path, monkeypatch):
    """Stored shards stand in small row groups, and their strings stay out of the exchange that weighs documents."""
    read, weights = [], []
    monkeypatch.setattr(rs.Scratch, "discard_but", lambda self, *held: read.extend(self.tables))
    inner = rs.document_weights
    monkeypatch.setattr(rs, "document_weights", lambda *args: weights.append(inner(*args)) or weights[-1])
    docs = docs_of([(i, f"w{i} of many words {i % 7} " * 8, "s") for i in range(300)]).coalesce(1)
    assert rs.resampled(docs, docs.limit(0), shard_words=40).count() == 300
    files = [f for f in pathlib.Path(read[0].stored_at).glob("*.parquet")]
    groups = [m.row_group(i).num_rows for f in files for m in [pq.ParquetFile(f).metadata] for i in range(m.num_row_groups)]
    assert sum(groups) == read[0].count() >= 150 and max(groups) <= 4
    plan = weights[0]._jdf.queryExecution().optimizedPlan().toString()
    grouped = next(x for x in plan.splitlines() if "FlatMapCoGroupsInArrow" in x)
    assert "codes" in grouped and "features#" not in grouped.replace("n_features#", "") and "totals#" not in grouped


# collocations


def brute_phrases(docs, least, most, cover, top):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, most + 1):
                f.update((lang, tuple(ws[i : i + k])) for i in range(len(ws) - k + 1))
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in found.items():
        if any(q != p and lang == other and 100 * b >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (other, q), b in found.items()):
            continue
        score, _, l, r = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, l, r, n[lang], score))
    ranked = []
    for _, group in itertools.groupby(sorted(out, key=lambda x: (x[0], -x[6], -x[2], x[1].encode())), key=lambda x: x[0]):
        ranked += [(x[0], i, *x[1:]) for i, x in enumerate(group, 1)][:top]
    return sorted(ranked)


PHRASE_COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("most,shard", [(3, 6 << 20), (4, 300), (2, 1)])
def test_collocations_equal_brute_force(spark, docs_of, most, shard):
    rng = random.Random(most)
    words = ["a", "A", "bé", "c-d", "e", "日", "a", "«x»", "f\x1cg", "\xa0"]
    docs = [(rng.choice(["en", "de", None, "und"]), rng.choice([" ", "\t", "  "]).join(rng.choices(words, k=rng.choice([0, 2, 9, 40]))) + rng.choice(["", ".", "!\n", " ,; "])) for _ in range(150)]
    docs += [("en", None), ("en", ""), ("fr", "..."), (None, "a a a a a"), ("xx", "once only"), ("en", "a bé " * 9_000), ("long", "q" * 200_000)]
    table = spark.createDataFrame([(lang, t, 1, "k") for lang, t in docs], "lang string, text string, rank int, phrase string")
    found = co.collocations(table, least=3, max_words=most, cover=50, top=25, shard_bytes=shard)
    assert found.columns == PHRASE_COLUMNS
    assert sorted(tuple(r) for r in found.collect()) == brute_phrases(docs, 3, most, 50, 25)


def test_collocations_count_exactly_beyond_64_bits(spark, docs_of):
    """10**6 a a passes 64 bits from about 3 million on; ties go by bytes; all phrases without a top."""
    text = "x y " * 40_000
    table = spark.createDataFrame([("en", text) for _ in range(80)] + [("en", "b c. " * 10 + "b d. " * 10)], "lang string, text string")
    found = sorted(tuple(r) for r in co.collocations(table, max_words=2, top=None).collect())
    assert found == brute_phrases([("en", text)] * 80 + [("en", "b c. " * 10 + "b d. " * 10)], 10, 2, 50, None)
    assert co.collocations(table.limit(0)).count() == 0


def test_a_crowded_sketch_only_adds_candidates(spark, monkeypatch):
    """With cells that many phrases share, bounds are loose and counts still exact."""
    monkeypatch.setattr(co, "LOAD", 1e-9)
    rng = random.Random(5)
    docs = [("en", " ".join(rng.choices([f"w{i}" for i in range(300)], k=300))) for _ in range(60)]
    table = spark.createDataFrame(docs, "lang string, text string")
    assert sorted(tuple(r) for r in co.collocations(table, least=4).collect()) == brute_phrases(docs, 4, 3, 50, 2000)


# pages

ARTICLE = ["A quiet harbour town", "The first boats left before dawn, and nobody on the quay said a word about it.", "By noon they were back: empty nets, long faces, one torn sail.", "Short end."]
BODY = f"<h1>{ARTICLE[0]}</h1><p>{ARTICLE[1]}</p><p>{ARTICLE[2]}</p><p>{ARTICLE[3]}</p>"


@pytest.fixture(scope="module")
def weights(spark, sf_dir):
    return ht.fit_blocks(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>t</title></head><body><article>{BODY}</article></body></html>",
        f"<body class='has-sidebar'><header><a href=/>Site</a><p>Since 1900, every day.</p></header><main>{BODY}</main><aside><p>Read this as well, it is a long sentence.</p></aside>",
        f"<div id=wrap><div class=cookie-notice>We use cookies, as you know, for all sorts of things.</div><div class='post-content'>{BODY}</div><form><label>Name</label><input><p>Sign up now!</p></form></div>",
        f"<article>{BODY}<section id=comments><h3>2 comments</h3><article class=comment><p>I was there, and it was not like that at all, sorry.</p></article></section></article><footer><p>All rights reserved.</p>",
        f"<form action=/><div role=main>{BODY}</div><ul class='relatedPosts'><li><a href=a>Another story from here</a></ul></form>",
        f"<article><header><h1>{ARTICLE[0]}</h1><p class=byline>By A. Writer, on Monday.</p></header>" + BODY.split("</h1>")[1] + "<div style='display: none'>Never seen.</div><noscript>Turn it on.</noscript></article>",
        f"<nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav><div>{BODY}</div><div class='share-buttons'>Share this with your friends.</div>",
    ],
)
def test_templates(page, weights):
    assert ht.main_text(page, np.array(weights)).split("\n\n") == ARTICLE


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("<p></p><br>", ""),
        ("<article><p>a &amp; b&nbsp;c &lt;p&gt; &#233;&eacute; &amp &am <br> d\n\te</p></article>", "a & b c <p> éé & &am d e"),
        ("<article><p>one<p>two<b>three</b><div>four</article>", "one\n\ntwothree\n\nfour"),
        ("<article><script>var t='</p><p>no';</script><!-- <p>no</p> --><p title='a > b'>yes</p><p class=\"open>after it", "yes\n\nafter it"),
        ("<article><p>x < y and y > z</p></article>", "x < y and y > z"),
    ],
)
def test_blocks(page, text):
    assert ht.main_text(page, np.zeros(ht.FEATURES)) == text


def test_min_cut_is_minimal():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 9))
        unary = rng.normal(0, 1, n).round(2)
        edges = [(int(a), int(b), float(abs(rng.normal(0, 0.7)))) for a, b in rng.integers(0, n, (int(rng.integers(0, 14)), 2))]

        def cost(side):
            return sum(max(-x, 0) if side[i] else max(x, 0) for i, x in enumerate(unary)) + sum(c for a, b, c in edges if side[a] != side[b])

        assert cost(ht.min_cut(unary, edges)) == pytest.approx(min(map(cost, itertools.product((0, 1), repeat=n))))


def test_pages_equal_brute_force_and_without_hints(spark, sf_dir, weights):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = {r.page_id: r.text for r in ht.extract_main_text(pages, weights).collect()}
    bare = []
    for r in pages.collect():
        inside = re.search(r"<article>(.*)</article>", r.html, re.S).group(1)
        parts = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", inside)]
        assert found[r.page_id] == "\n\n".join(x for x in parts if x)
        plain = re.sub(r"<(/?)(nav|footer|article)>", r"<\1div>", r.html).replace(' class="ad"', "")
        bare.append(ht.main_text(plain, np.array(weights)) == found[r.page_id])
    assert sum(bare) >= 0.95 * len(bare)


def test_pages_keep_columns_and_take_any_table(spark):
    schema = "`page.id` long, html string, n_chars string, c0 string, url string"
    rows = [(1, "<article><p>" + "long " * 200_000 + "</p></article>", "x", "y", None), (1, None, "x", "y", "u"), (None, "<nav>" * 20_000, "x", "y", "u"), (2, "<p>" * 5_000 + "deep", "x", "y", "u")]
    found = ht.extract_main_text(spark.createDataFrame(rows, schema), sample_pages=10)
    assert found.columns == ["page.id", "c0", "url", "text", "n_chars"]
    assert rows_of(found, ["n_chars", "c0"])[0] == ("y", 0) and max(r.n_chars for r in found.collect()) == 999_999
    assert ht.extract_main_text(spark.createDataFrame([], schema)).count() == 0
