import random

import pytest

from arcweave.llm import exact_dedup, line_dedup, near_dedup
from arcweave.llm.store import fresh_path, stored
from tests.llm.conftest import rows_of


def index_of(spark):
    return exact_dedup.DigestIndex(spark, fresh_path(spark, "digest-index"), 4)


def test_exact_dedup_of_nulls_ties_and_case(spark, docs_of):
    docs = docs_of([(1, "Ab", "a"), (2, "aB", "b"), (3, None, None), (4, "", "a"), (None, "ab", "a"), (5, "É", "a"), (6, "é", "a"), (2, "aB", "b")])
    found = {(r.doc_id, r.text_sha256[:6]): (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs, index_of(spark)).collect()}
    by_id = {i: v for (i, _), v in found.items()}
    assert by_id[1] == (2, 4, False) and by_id[2] == (2, 4, True) and by_id[None] == (2, 4, False)
    assert by_id[3] == (4, 2, False) and by_id[4] == (4, 2, True)
    assert by_id[5] == (5, 1, True) and by_id[6] == (6, 1, True)
    assert exact_dedup.exact_dedup(docs, index_of(spark)).count() == 8


def test_exact_dedup_index_persists(spark, docs_of):
    index = index_of(spark)
    exact_dedup.exact_dedup(docs_of([(1, "a", "s"), (2, "b", "s")]), index)
    again = exact_dedup.DigestIndex(spark, index.path, 4)
    found = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.exact_dedup(docs_of([(9, "A", "s"), (8, "c", "s")]), again).collect()}
    assert found == {9: (1, False), 8: (8, True)}
    assert again.rows().count() == 3


def test_exact_dedup_index_reopens_in_another_session(spark, docs_of):
    """With another number of shuffle partitions, and a catalogue that does not know the table."""
    docs = docs_of([(i, f"text {i % 150}", "s") for i in range(200)])
    index = exact_dedup.DigestIndex(spark, fresh_path(spark, "digest-index"))
    exact_dedup.exact_dedup(docs, index)
    spark.sql(f"DROP TABLE {index.name}")
    other = spark.newSession()
    other.conf.set("spark.sql.shuffle.partitions", "3")
    again = exact_dedup.DigestIndex(other, index.path)
    assert again.buckets == index.buckets != 3
    with pytest.raises(ValueError, match="buckets"):
        exact_dedup.DigestIndex(other, index.path, index.buckets + 1)
    more = other.createDataFrame([(1000 + i, f"TEXT {i}") for i in range(160)], "doc_id bigint, text string")
    found = exact_dedup.exact_dedup(more, again).collect()
    assert sorted(r.doc_id for r in found if r.kept) == list(range(1150, 1160)) and len(found) == 160
    assert again.rows().count() == 160
    again.compact(5)
    assert (exact_dedup.DigestIndex(spark, index.path).buckets, again.rows().count()) == (5, 160)
    assert exact_dedup.exact_dedup(more, exact_dedup.DigestIndex(spark, index.path)).where("kept").count() == 10


def test_exact_dedup_does_not_shuffle_the_index_and_bears_racing_writers(spark, docs_of):
    index = index_of(spark)
    delivery = stored(exact_dedup.digests(docs_of([(i, f"t{i}", "s") for i in range(20)])), "delivery")
    index.ingest(delivery)
    index._append(delivery.selectExpr("digest", "doc_id + 100 AS keep_id"), index.folder, index.buckets)  # as another writer would have
    assert index.rows().count() == 40
    keys = delivery.groupBy("digest").count()
    found = index.known(keys)
    assert sorted(r.keep_id for r in found.collect()) == list(range(100, 120))
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = plan.split("SortMergeJoin")[-1].split("REPARTITION_BY_NUM")[0]
    assert "Bucketed: true" in scan and scan.count("Exchange") == 1  # the one of the keys
    index.compact()
    assert index.rows().count() == 20


def _known(spark, path, marks):
    return exact_dedup.DigestIndex(spark, path).known(marks.groupBy("digest").count()).count()


def test_writers_that_meet_lose_no_digest(spark, docs_of, monkeypatch):
    """An index opened before a compaction, a compaction that fails, a writer while it runs, and two first openers."""
    path = fresh_path(spark, "digest-index")
    halves = [stored(exact_dedup.digests(docs_of([(i, f"t{i}", "s") for i in range(a, a + 50)])), "delivery") for a in (0, 50, 100, 150)]
    every = halves[0].unionByName(halves[1]).unionByName(halves[2]).unionByName(halves[3])
    first, early = exact_dedup.DigestIndex(spark, path), exact_dedup.DigestIndex(spark, path)
    assert first.folder == early.folder
    first.ingest(halves[0])
    first.compact()
    early.ingest(halves[1])  # was opened before
    assert _known(spark, path, every) == 100 and early.generation == 1
    real = exact_dedup.DigestIndex._append

    def fails(self, *a):
        raise OSError("disk")

    monkeypatch.setattr(exact_dedup.DigestIndex, "_append", fails)
    with pytest.raises(OSError):
        first.compact()
    monkeypatch.setattr(exact_dedup.DigestIndex, "_append", real)
    first.ingest(halves[2])
    assert _known(spark, path, every) == 150

    publish = exact_dedup.DigestIndex._publish

    def while_it_runs(self, *a):
        monkeypatch.setattr(exact_dedup.DigestIndex, "_publish", publish)
        early.ingest(halves[3])
        return publish(self, *a)

    monkeypatch.setattr(exact_dedup.DigestIndex, "_publish", while_it_runs)
    first.compact()
    assert _known(spark, path, every) == 200 and exact_dedup.DigestIndex(spark, path).rows().count() == 200


def test_two_first_openers_share_a_generation(spark, monkeypatch):
    path, real = fresh_path(spark, "digest-index"), exact_dedup.DigestIndex._refresh
    blind = []

    def sees_nothing_at_first(self):
        if id(self) not in blind:
            blind.append(id(self))
            return False
        return real(self)

    monkeypatch.setattr(exact_dedup.DigestIndex, "_refresh", sees_nothing_at_first)
    a, b = exact_dedup.DigestIndex(spark, path), exact_dedup.DigestIndex(spark, path)
    assert a.folder == b.folder and a.buckets == b.buckets


def test_exact_dedup_needs_numbers(spark):
    with pytest.raises(TypeError):
        exact_dedup.exact_dedup(spark.createDataFrame([("a", "b")], "doc_id string, text string"), None)


def test_exact_dedup_of_a_very_long_text(spark, docs_of):
    long = "Word " * 400_000
    found = exact_dedup.exact_dedup(docs_of([(1, long, "s"), (2, long.lower(), "s"), (3, long + "x", "s")]), index_of(spark)).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in found} == {(1, 2, False), (2, 2, True), (3, 3, True)}


def test_exact_dedup_only_ids_missing_and_empty(spark, docs_of):
    assert [tuple(r)[:4] for r in exact_dedup.exact_dedup(docs_of([(None, "a", "s")]), index_of(spark)).collect()] == [(None, None, 1, False)]
    assert exact_dedup.exact_dedup(docs_of([]), index_of(spark)).count() == 0


def brute_components(texts, k, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + min(k, len(w))]) for i in range(len(w) - min(k, len(w)) + 1)} if w else set())
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return [len(s) for s in sets], label


@pytest.mark.parametrize("k,block", [(2, 256), (5, 8)])
def test_near_components_equal_brute_force(spark, docs_of, monkeypatch, k, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(k)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(3, 60))]
        for _ in range(rng.randint(1, 14)):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    base = [rng.choice(words) for _ in range(120)]
    for _ in range(60):  # a family of several blocks, with strays
        t = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 9, 14])):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    texts += ["", None, "one", "One", "a b", "A  B\n", " \t\n", texts[0], texts[0].upper()]
    sizes, label = brute_components(texts, k, 80)
    found = {r.doc_id: r for r in near_dedup.near_components(docs_of([(i, t, "s") for i, t in enumerate(texts)]), k, 80).collect()}
    assert [found[i].n_shingles for i in range(len(texts))] == sizes
    assert [found[i].component_id for i in range(len(texts))] == label
    assert all(found[i].kept == (label[i] == i) for i in range(len(texts)))


def test_near_components_without_ids_or_rows(spark, docs_of):
    found = near_dedup.near_components(docs_of([(None, "a b c d e f", "s"), (7, "A b c d e f", "s"), (None, "x y", "s"), (None, None, "s")]))
    assert rows_of(found, ["doc_id", "component_id", "kept"]) == sorted([(7, None, False), (7, 7, True), (None, None, False), (None, None, True)], key=repr)
    assert near_dedup.near_components(docs_of([])).count() == 0
    kept = near_dedup.keep_one(docs_of([(None, "a b c d e f", "s"), (7, "A b c d e f", "s"), (8, "q r", "s"), (9, "q r", "s"), (10, None, "s")]))
    assert {8, 10} <= {r.doc_id for r in kept.collect()} and kept.count() == 3


def test_sets_that_share_half_a_digest_stay_apart(spark):
    """Nodes are the digests' whole 128 bits, and their numbers never clash."""
    same = b"8 bytes!"
    rows = [(i, i, 3, same + bytes([i % 4]) * 8, b"t") for i in range(40)] + [(99, 99, 3, bytes([7]) * 8 + same, b"t")]
    signed = spark.createDataFrame(rows, near_dedup._SIGNED).repartition(8)
    found = near_dedup.set_classes(signed).collect()
    assert len(found) == 5 and len({r.node for r in found}) == 5
    assert {r.first_id for r in found} == {0, 1, 2, 3, 99}


def test_near_components_of_repeated_ids_and_long_texts(spark, docs_of):
    long = " ".join(f"w{i}" for i in range(30_000))
    near = " ".join(f"w{i}" for i in range(1_000, 31_000))
    far = " ".join(f"v{i}" for i in range(30_000))
    rows = [(1, long, "s"), (1, far, "s"), (1, "short text of five words", "s"), (2, near, "s"), (3, far + " end", "s"), (None, near, "s"), (None, far, "s")]
    found = rows_of(near_dedup.near_components(docs_of(rows)), ["component_id", "n_shingles"])
    sizes = {len(set(zip(*[t.split()[j:] for j in range(5)], strict=False))) for _, t, _ in rows}
    assert {n for _, n in found} == sizes and {c for c, _ in found} == {1}
    clash = docs_of(rows).selectExpr("doc_id", "text", "1 AS row", "2 AS `a.b`", "3 AS __id")
    kept = near_dedup.keep_one(clash)
    assert kept.columns == clash.columns and {tuple(r)[2:] for r in kept.collect()} == {(1, 2, 3)}
    assert [r.doc_id for r in kept.collect()].count(1) == 3


def test_loose_chains_are_split_before_blocks_meet(spark, docs_of, monkeypatch):
    """Neighbours of a chain share half their shingles, so coarse tables join them all; no two are linked."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(12)
    words = [f"u{rng.randrange(10**9)}" for _ in range(30 * 500 + 100)]
    texts = [" ".join(words[30 * i : 30 * i + 100]) for i in range(500)]
    sizes, blocks, sized, blocked = [], [], near_dedup._sized, near_dedup._verified_blocks
    monkeypatch.setattr(near_dedup, "_sized", lambda m, s: (sizes.append(m.count()), sized(m, s))[1])
    monkeypatch.setattr(near_dedup, "_verified_blocks", lambda members, *a, **k: (blocks.append(members.count()), blocked(members, *a, **k))[1])
    found = near_dedup.near_components(docs_of([(i, t, "s") for i, t in enumerate(texts + texts[:40])]), k=1)
    assert [r.component_id for r in found.orderBy("doc_id").collect()] == [*range(500), *range(40)]
    # all meet a pivot block once; then nearly all are alone or in small groups
    assert len(sizes) == 2 and sizes[0] > 400 and sum(blocks[1:]) < 100


def test_line_dedup_of_nulls_and_edges(spark, docs_of):
    rows = [(i, f"own {i}\n shared \n\nshared", f"s{i}") for i in range(4)]
    rows += [(10, None, None), (11, "", None), (12, "shared", None), (13, "shared\nshared", "s0"), (14, "x\nx", None)]
    found = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.remove_boilerplate(docs_of(rows), 5).collect()}
    assert found[0] == ("own 0\n", 4, 2)
    assert found[10] == (None, 0, 0) and found[11] == ("", 1, 0)
    assert found[12] == ("", 1, 1) and found[13] == ("", 2, 2) and found[14] == ("x\nx", 2, 0)
    assert {r.n_removed for r in line_dedup.remove_boilerplate(docs_of(rows), 6).collect()} == {0}
    assert line_dedup.remove_boilerplate(docs_of([]), 2).count() == 0


def test_line_dedup_counts_near_lines_exactly(spark, docs_of):
    low, high = line_dedup.near_band(40)
    assert low < 39 and high > 41
    docs = docs_of([(i, "common", f"s{i}") for i in range(39)] + [(99, "common", "s0")])
    assert {r.n_removed for r in line_dedup.remove_boilerplate(docs, 40).collect()} == {0}
    docs = docs_of([(i, "common", f"s{i}") for i in range(40)])
    assert {r.n_removed for r in line_dedup.remove_boilerplate(docs, 40).collect()} == {1}


def test_line_dedup_ignores_all_white_space_at_ends(spark, docs_of):
    ends = ["", "\r", "\t", " \r", "\x0b", "\u00a0"]
    docs = docs_of([(i, f"own {i}\r\n\r\n{e}sha red{e}", f"s{i}") for i, e in enumerate(ends)])
    found = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.remove_boilerplate(docs, 6).collect()}
    assert found == {i: (f"own {i}\r\n\r", 1) for i in range(6)}


def test_line_dedup_columns_that_clash_and_long_texts(spark):
    names = ["key", "at", "lines", "gone", "row", "site", "line", "__key", "a.b"]
    rows = [(i, "all\nsites\n" + f"own {i}\n" * (200_000 if i == 0 else 1), f"s{i}", *[f"{n}{i}" for n in names]) for i in range(6)]
    rows += [(None, None, None, *[None] * len(names))] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    found = line_dedup.remove_boilerplate(docs, 6)
    assert found.columns == [*docs.columns, "n_lines", "n_removed"]
    by_id = {r.doc_id: tuple(r) for r in found.collect()}
    for i in range(6):
        assert by_id[i][3:-2] == rows[i][3:] and by_id[i][-1] == 2
    assert len(by_id[0][1]) == 200_000 * len("own 0\n") and by_id[0][-2] == 200_003
    assert found.count() == 9 and by_id[None][-2:] == (0, 0)
