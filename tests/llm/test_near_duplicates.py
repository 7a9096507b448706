import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from splitfold.llm import chunkdedup, embed_dedup, linededup, minhash
from splitfold.llm.components import components


def connected(ids, links):
    top = {i: i for i in ids}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        p, q = sorted((root(a), root(b)))
        top[q] = p
    return {i: root(i) for i in ids}


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 440)] + [(5, 5)] + [(600, k) for k in range(601, 660)]
    want = connected({x for e in edges if e[0] != e[1] for x in e}, edges)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_copies(text_of, seed, n, edits):
    rnd, words = random.Random(seed), text_of(seed, n).split()
    for k in range(edits):
        words[rnd.randrange(n)] = f"edit{seed}x{k}"
    return " ".join(words)


def corpus(text_of, awkward):
    texts = list(awkward) + [text_of(k, 60) for k in range(20)]
    rnd = random.Random(3)
    for k in range(60):  # copies of few bases, at all similarities around the limit
        words = text_of(100 + k % 4, 80).split()
        for _ in range(rnd.randrange(9)):
            words[rnd.randrange(80)] = f"w{rnd.randrange(10**6)}"
        texts.append(" ".join(words))
    return texts + texts[-5:]


def shingles(text, ngram):
    words = (text or "").encode().lower().split()
    return set(zip(*[words[k:] for k in range(ngram)])) if len(words) >= ngram else {tuple(words)} if words else set()


@pytest.mark.parametrize("ngram", [2, 5])
def test_minhash_against_all_pairs(make, text_of, awkward, ngram):
    texts = corpus(text_of, awkward)
    sets = [shingles(t, ngram) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = connected(range(len(texts)), links)
    rows = minhash.near_duplicates(make(texts), ngram=ngram).collect()
    assert len(rows) == len(texts)
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (want[r["doc_id"]] == r["doc_id"]) for r in rows)


def test_shingles_follow_the_word_rule():
    texts = ["A b c\x0bD", "A", " \n", "É", "a b c d a b c", None, "a b c\x0bd", "é", "a\x0bb c d a b c"]
    for n in (1, 2, 3):
        sets = minhash.shingle_sets(pa.array(texts), n)
        assert [len(x) for x in sets] == [len(shingles(t, n)) for t in texts]
        assert sets[0].tolist() == sets[6].tolist() and sets[3].tolist() != sets[7].tolist() and sets[4].tolist() == sets[8].tolist()  # only A-Z are lowered


def test_minhash_of_null_and_repeated_ids(spark, text_of):
    x, y = text_of(1, 80), text_of(2, 80)
    near = lambda t: t.rpartition(" ")[0] + " changed"
    rows = [(1, x), (1, y), (2, near(x)), (3, near(y)), (None, near(x)), (None, text_of(3, 30)), (4, None), (4, " "), (3, near(y))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in minhash.near_duplicates(docs, 2).collect())
    assert got == [(0, 0, True), (0, 1, False), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (3, 1, False), (4, 4, True), (4, 4, True)]
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in minhash.deduplicated(docs, 2).collect())
    assert kept == sorted([(0, text_of(3, 30)), (1, x), (1, y), (4, ""), (4, " ")])
    assert minhash.deduplicated(docs.limit(0)).count() == 0


def test_minhash_of_nothing(make):
    assert minhash.near_duplicates(make(["x"]).limit(0)).count() == 0


def test_minhash_blocks_lose_no_link(make, text_of, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    test_minhash_against_all_pairs(make, text_of, [None, ""], 2)


def line_brute(texts):
    seen, gone = [], Counter()
    for i, t in enumerate(texts):
        for line in (t or "").split("\n"):
            words = set(line.encode().lower().split())
            if words:
                gone[i] += any(100 * len(words & s) >= 80 * len(words | s) for s in seen)
                seen.append(words)
    return gone


@pytest.mark.parametrize(("crowd", "block"), [(16384, 16384), (2, 3)])
def test_lines_against_all_pairs(make, text_of, awkward, monkeypatch, crowd, block):
    monkeypatch.setattr(linededup, "CROWD", crowd)
    monkeypatch.setattr(linededup, "BLOCK", block)
    rnd, texts = random.Random(8), list(awkward)
    for _ in range(40):
        lines = []
        for _ in range(rnd.randrange(1, 6)):
            words = text_of(rnd.randrange(6), rnd.choice([5, 12, 40, 100, 200, 400])).split()
            for _ in range(rnd.randrange(4)):
                words[rnd.randrange(len(words))] = f"w{rnd.randrange(10**6)}"
            lines.append(" ".join(words))
        texts.append("\n".join(lines))
    want = line_brute(texts)
    got = {r["doc_id"]: r["n_removed"] for r in linededup.summary(make(texts)).collect()}
    assert got == {i: want[i] for i in range(len(texts))}


@pytest.mark.parametrize(("crowd", "block"), [(16384, 16384), (2, 3)])
def test_copies_around_a_near_copy_keep_the_first(make, text_of, monkeypatch, crowd, block):
    monkeypatch.setattr(linededup, "CROWD", crowd)
    monkeypatch.setattr(linededup, "BLOCK", block)
    lines = [text_of(k, 20) for k in range(8)]
    near = [" ".join([*x.split()[:-1], f"new{k}"]) for k, x in enumerate(lines)]
    texts = [f"{x}\n{text_of(90, 15)}" for turn in (lines, near, lines, near, lines) for x in turn]
    want = line_brute(texts)
    got = {r["doc_id"]: r["n_removed"] for r in linededup.summary(make(texts, parts=16)).collect()}
    assert got == {i: want[i] for i in range(len(texts))} and [got[i] for i in range(8)] == [0] + [1] * 7


def test_short_lines_take_part(make):
    texts = ["All rights reserved\none two three four\na\n\n \t", "all RIGHTS reserved\nfive one two three four\nA a a a a a\n\n", "rights reserved\none two three five\nb\na b", None, ""]
    out = {r["doc_id"]: r for r in linededup.summary(make(texts)).collect()}
    assert {i: (r["n_lines"], r["n_removed"]) for i, r in out.items()} == {0: (3, 0), 1: (3, 3), 2: (4, 1), 3: (0, 0), 4: (0, 0)}


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_lines_do_not_depend_on_partitions(make, text_of, parts):
    a, b, c = text_of(1, 30), text_of(2, 12), text_of(3, 9)
    near = " ".join([*a.split()[:-1], "new"])
    texts = [a, f"{near}\n{b}", f"{a}\n{c}", f"{near}\n{c}\n{b}"]
    assert {r["doc_id"]: r["n_removed"] for r in linededup.summary(make(texts, parts=parts)).collect()} == {0: 0, 1: 1, 2: 1, 3: 3}


def test_lines_of_null_and_repeated_ids(spark):
    a, b = "one two three four five six", "some other line that stays"
    rows = [(None, a), (None, a), (None, b), (1, f"{a}\n{b}"), (2, b), (2, f"{b}\n{a}"), (3, "x"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in linededup.deduplicated(docs).collect())
    assert got == [(0, ""), (0, a), (0, a), (0, b), (3, "x")]
    assert sorted(r["n_removed"] for r in linededup.summary(docs).collect()) == [0, 0, 0, 0, 0, 1, 2, 2]
    empty = docs.limit(0)
    assert linededup.summary(empty).collect() == [] and linededup.deduplicated(empty).collect() == []


def test_deduplicated_documents(make):
    a, b = "one two three four five six", "some other line that stays whole"
    out = {r["doc_id"]: r for r in linededup.deduplicated(make([a, f"{a}\n{b}\nshort", a, None, ""])).collect()}
    assert sorted(out) == [0, 1, 3, 4]  # document 2 had words and keeps none
    assert out[1]["text"] == f"{b}\nshort" and out[1]["n_chars"] == len(out[1]["text"]) and out[1]["token"] == "x" and out[3]["text"] is None


def test_chunks_catch_repeated_passages(make, text_of, awkward):
    passage = text_of(77, 60)
    clean = [text_of(200 + k, 120) for k in range(10)]
    texts = [*awkward, *clean, f"{clean[0][:50]} {passage} {text_of(301, 40)}", f"{text_of(302, 33)}, {passage} {text_of(303, 20)}"]
    rows = {r["doc_id"]: r for r in chunkdedup.passages(make(texts), ["doc_id"]).collect()}
    last = rows[len(texts) - 1]
    start = texts[-1].index(passage)
    assert len(last["spans"]) == 1
    span = last["spans"][0]
    assert start - 40 <= span["start"] and span["end"] <= start + len(passage) + 40 and span["end"] - span["start"] > 0.4 * len(passage)
    assert last["kept_text"] == texts[-1][: span["start"]] + texts[-1][span["end"] :]
    for i in range(len(awkward), len(awkward) + 10):
        assert not rows[i]["spans"] and rows[i]["kept_text"] == texts[i]
    assert rows[0]["kept_text"] is None and rows[1]["kept_text"] == "" and len(rows) == len(texts)


def test_chunks_seen_apart_are_no_passage(make, text_of):
    base = text_of(5, 400)
    ends = chunkdedup.chunk_ends(np.frombuffer(base.encode(), np.uint8)).tolist()
    chunks = [base[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    apart = "".join(random.Random(1).sample(chunks, len(chunks)))
    rows = {r["doc_id"]: r for r in chunkdedup.passages(make([base, apart, base, f"new words {base[200:900]}"]), ["doc_id"]).collect()}
    assert not rows[0]["spans"] and not rows[1]["spans"] and rows[1]["kept_text"] == apart
    assert rows[2]["kept_text"] == "" and len(rows[3]["spans"]) == 1 and len(rows[3]["kept_text"]) < 150


def repeats_by_definition(texts):
    """Spans of repeated passages: chunks of windows that an earlier place holds, for texts of ASCII."""
    windows = []
    for doc, text in enumerate(texts):
        raw = (text or "").encode()
        ends, h = [], 0
        for i, b in enumerate(raw):
            h = (2 * h + int(chunkdedup.GEAR[b])) % (1 << chunkdedup.BITS)
            last = ends[-1] if ends else 0
            if h == 0 or i + 1 == len(raw) or i + 1 - last == chunkdedup.MAX_CHUNK:
                ends.append(i + 1)
        starts = [0, *ends[:-1]]
        for i in range(len(ends)):
            after = [j for j in range(i, len(ends)) if ends[j] - starts[i] >= chunkdedup.MIN_CHARS][:1]
            before = [j for j in range(i + 1) if ends[i] - starts[j] >= chunkdedup.MIN_CHARS][-1:]
            windows += [(doc, i, j, starts[i], ends[j], raw[starts[i] : ends[j]]) for j in after] + [(doc, j, i, starts[j], ends[i], raw[starts[j] : ends[i]]) for j in before]
    first, gone = {}, {}
    for doc, i, j, a, b, raw in sorted(windows):
        if first.setdefault(raw, (doc, i, j)) != (doc, i, j):
            gone.setdefault(doc, set()).update(range(a, b))
    spans = {}
    for doc, at in gone.items():
        edge = sorted(x for x in at if x - 1 not in at)
        spans[doc] = [(a, next(x for x in range(a, len(texts[doc]) + 1) if x not in at)) for a in edge]
    return spans


def test_chunks_against_the_definition(make, text_of):
    rnd, passages = random.Random(3), [text_of(k, 70) for k in range(4)]
    texts = [None, "", "short"]
    for k in range(40):
        parts = [text_of(1000 + 3 * k + i, rnd.randrange(5, 60)) for i in range(3)]
        texts.append(" ".join([parts[0], rnd.choice(passages), parts[1], rnd.choice(passages)[rnd.randrange(200) :], parts[2]]))
    texts += [texts[5], texts[5], "q" * 9000, "x" + "q" * 9000]
    want = repeats_by_definition(texts)
    rows = chunkdedup.passages(make(texts, parts=5), ["doc_id"]).collect()
    assert len(want) > 30 and {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in rows if r["spans"]} == want


def test_chunks_of_repeated_ids_and_empty_tables(spark, text_of):
    x = text_of(1, 90)
    docs = spark.createDataFrame([(1, x), (1, x), (2, x), (None, x), (None, None)], "doc_id long, text string").repartition(3)
    rows = chunkdedup.dedup_summary(docs).collect()
    assert len(rows) == 5 and sum(r["removed_chars"] == 0 for r in rows) >= 1
    assert chunkdedup.dedup_summary(docs.limit(0)).count() == 0


def test_chunk_ends_move_little():
    rnd = np.random.default_rng(4)
    data = rnd.integers(97, 123, 5000).astype(np.uint8)
    moved = np.concatenate([data[:1000], [120, 121], data[1000:]]).astype(np.uint8)
    a, b = set(chunkdedup.chunk_ends(data).tolist()), set((chunkdedup.chunk_ends(moved) - 2).tolist())
    assert len(a ^ b) < 80 and {x for x in a if x > 1100} == {x for x in b if x > 1100}
    assert max(np.diff(chunkdedup.chunk_ends(np.full(9000, 97, np.uint8)), prepend=0)) <= chunkdedup.MAX_CHUNK


@pytest.mark.parametrize("block", [1024, 7])
def test_embeddings_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    rnd = np.random.default_rng(6)
    base = rnd.normal(size=(30, 24))
    vectors = [base[k % 30] + rnd.normal(size=24) * rnd.choice([0, 0.02, 0.1, 0.18]) for k in range(200)]
    rows = [(i, [float(np.float32(x)) for x in v], i % 2) for i, v in enumerate(vectors)]
    rows += [(200, None, 0), (201, [0.0] * 24, 0), (202, [float("nan")] * 24, 1), (203, rows[0][1], None), (204, [None] * 24, 0), (205, [1.0, 2.0], 0), (206, [2.0, 4.0], 0), (207, [], 1)]
    got = {r["vec_id"]: r for r in embed_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1))).collect()}
    links = []
    for i, v, label in rows:
        for j, w, other in rows[:i]:
            if label is not None and label == other and v and w and len(v) == len(w) and None not in v and None not in w:
                p, q = np.array(v, np.float64), np.array(w, np.float64)
                d = np.sqrt(p @ p) * np.sqrt(q @ q)
                if np.isfinite(d) and d and p @ q / d >= 0.98:
                    links.append((i, j))
    want, n = connected([r[0] for r in rows], links), Counter(x for e in links for x in e)
    assert len(links) > 100
    assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == {i: (n[i], want[i]) for i in want}
    assert embed_dedup.link(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 64)
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=32) + 0.14 * rnd.normal(size=(500, 32))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98).sum(1) - 1
    rows = {r["vec_id"]: r for r in embed_dedup.link(spark.createDataFrame([(i, v.tolist(), "z") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label string")).collect()}
    got = np.array([rows[i]["n_links"] for i in range(500)])
    assert 0 < near.sum() < 500 * 499 and np.all(got <= near) and got.sum() >= 0.999 * near.sum()


def test_embeddings_of_null_and_repeated_ids(spark):
    v = [[1.0, 0.01 * k, 0.0, 0.0] for k in range(3)] + [[0.0, 0.0, 1.0, 0.0]]
    rows = [(1, v[0]), (1, v[1]), (2, v[2]), (None, v[0]), (None, v[3]), (7, None)]
    found = embed_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))).collect()
    got = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in found))
    assert got == [(0, 0, 0, True), (0, 3, 1, False), (1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (7, 0, 7, True)]


def test_codes_of_long_lines_take_little_memory():
    codes = np.random.default_rng(3).integers(0, 1 << 61, 800_000, dtype=np.uint64)
    n = np.full(1000, 800)
    column = pa.array([codes[k : k + 800].tobytes() for k in range(0, len(codes), 800)], pa.binary())
    tracemalloc.start()
    found, offsets = linededup.decoded(column, n)
    maps = linededup.bitmaps(found, offsets, n, (0, 0, linededup.LONG, linededup.LONGEST))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (found == codes).all() and [len(columns) for _, columns in maps] == [1, 1, 8]
    assert peak < 5 * codes.nbytes


def test_words_are_numbered_by_one_sort():
    words = np.random.default_rng(4).integers(0, 1 << 62, 500, dtype=np.uint64)[np.random.default_rng(5).integers(0, 500, 20_000)]
    alike = np.array([1 << 40, (1 << 40) + 1, 1 << 40, (1 << 40) + 2], np.uint64)  # differ in bits that hold places
    for each in (words, alike, np.zeros(0, np.uint64)):
        known, place = linededup.numbered(each)
        assert (known[place] == each).all() and len(set(known.tolist())) == len(known)


def test_lists_are_counted_only_for_words_that_may_crowd_them(make, monkeypatch):
    monkeypatch.setattr(linededup, "CROWD", 5)
    docs = make([f"often word{k % 4} own{k}" for k in range(12)])
    frequent, least = linededup.frequent_words(docs)
    assert len(frequent) == 17 and least == linededup.RANK + 16
    monkeypatch.setattr(linededup, "RANKED", 0)
    assert linededup.frequent_words(docs)[1] == 0
