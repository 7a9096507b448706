import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from splitfold.llm import langid, mixing, packing, pii, quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_quality_measures(make, text_of, awkward):
    copied = " ".join(text_of(5, 12).split() * 3)
    texts = [*awkward, copied, f"{text_of(6, 30)}\n#x\n#x\n{text_of(7, 30)}", text_of(8, 25)]
    rows = {r["doc_id"]: r for r in quality.assess(make(texts)).collect()}
    for i, t in enumerate(texts):
        w, r = WORD.findall(t or ""), rows[i]
        count = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {j for k in range(len(w) - 7) if count[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert r["kept"] == (not r["base_failed"])
    assert len(rows) == len(texts)


def test_frequent_lines_deplete(make, text_of):
    line = text_of(1, 30)
    texts = [f"{line}\n{text_of(50 + k, 5)}" for k in range(6)] + [f"{line.upper()}\n{text_of(99, 100)}", text_of(98, 40)]
    rows = {r["doc_id"]: r for r in quality.assess(make(texts, sources=["a"] * 5 + [None] + ["a", "a"]), max_docs=4).collect()}
    assert [rows[i]["kept"] for i in range(8)] == [False] * 5 + [True, True, True]
    assert rows[0]["n_removed_words"] == 30 and rows[6]["n_removed_words"] == 30 and rows[5]["n_removed_words"] == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "card":
        return 12 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for k, c in enumerate(reversed(d))) % 10 == 0
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.split(".")), "phone": 9 <= len(d) <= 15}[kind]


def base_spans(text):
    found = sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(BASE.items()) for m in re.finditer(p, text) if passes(kind, m.group()))
    return [f"{kind}:{a}:{b}" for a, _, b, kind in found]


def test_pii_base_spans(make, awkward):
    tricky = [
        "mail a.b+c@x-y.example.com, \U0001f600 +1 (202) 555-0147 and 10.0.0.255 or 300.1.1.1.2.3",
        "a@b.com_x@y.org a@b@c.de @x.y me@host a..b@c..d e@f.g.",
        "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111  5500 0000 0000 0004-",
        "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 +49.30.1234567) +4930( 12",
        "1.2.3.4.5.6.7.8 001.002.003.004 1.2.3.4444444444444444444 0.0.0.0",
        "1 2 3 4 5 6 " * 4000 + "x" * 60_000 + "@ a@b.c",
        "- 4111 - 1111 -1111- 1111 0000000000000000",
        "a@b" + ".c" * 20_000,
    ]
    texts = [*awkward, *tricky]
    rows = {r["doc_id"]: r for r in pii.summary(make(texts)).collect()}
    for i, t in enumerate(texts):
        spans = base_spans(t or "")
        assert rows[i]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest(), texts[i]
        assert [rows[i][f"n_{k}"] for k in BASE] == [sum(s.startswith(k) for s in spans) for k in BASE]
        assert set(spans) <= set(rows[i]["spans"].split(",")) | {""} and len(rows) == len(texts)


def test_pii_adds_secrets(make, text_of):
    secret = hashlib.sha1(b"x").hexdigest()
    texts = [f'{text_of(k, 20)} token = "{hashlib.sha1(str(k).encode()).hexdigest()}" {text_of(k + 50, 9)}' for k in range(30)] + [f"see {secret[:18]}-x {text_of(3, 9)}", text_of(4, 40)]
    rows = {r["doc_id"]: r["spans"] for r in pii.summary(make(texts)).collect()}
    assert all(rows[k].startswith("secret:") for k in range(30)) and rows[31] == ""
    assert pii.summary(make(["x"]).limit(0)).count() == 0


def test_pii_classifier_looks_at_features(make, text_of):
    key = lambda k: hashlib.sha256(str(k).encode()).hexdigest()[:40]
    texts = [f'{text_of(k, 20)} token = "{key(k)}" {text_of(k + 50, 9)}' for k in range(40)] + [f"{text_of(k, 20)} version {'12345678' * 3}a {text_of(k + 9, 9)}" for k in range(40)]
    rows = {r["doc_id"]: r for r in pii.summary(make(texts)).collect()}
    assert all(rows[k]["n_secret"] == 1 and rows[k]["n_found"] >= 1 for k in range(40)) and sum(rows[40 + k]["n_secret"] for k in range(40)) == 0
    docs = make(["mail a@b.com", None, "+1 (202) 555-0147"])
    assert [(r["n_email"], r["n_phone"]) for r in pii.base_summary(docs).orderBy("doc_id").collect()] == [(1, 0), (0, 0), (0, 1)]


def test_em_finds_the_good_labeler():
    rnd = np.random.default_rng(2)
    truth = rnd.random(4000) < 0.4
    votes = np.stack([np.where(rnd.random(4000) < p, truth, ~truth).astype(int) for p in (0.95, 0.8, 0.75, 0.55)], axis=1)
    rows = Counter(map(tuple, votes.tolist()))
    prior, table = pii.reliabilities(list(rows.items()))
    right = [table[k, 1, 1] for k in range(4)]
    assert abs(prior - 0.4) < 0.05 and right == sorted(right, reverse=True) and abs(right[0] - 0.95) < 0.04


def test_mixing(spark, make, text_of, awkward):
    texts = [text_of(k, 20 + 37 * (k % 9)) for k in range(120)] + list(awkward)
    sources = [["b", "a", "c", None][k % 7 % 4] for k in range(120)] + ["b"] * len(awkward)
    docs = make(texts, sources=sources)
    rows = {r["doc_id"]: r for r in mixing.taken_words(docs).collect()}
    sizes = [len(WORD.findall(t or "")) for t in texts]
    totals = Counter()
    for s, n in zip(sources, sizes):
        totals[s] += n
    weights, target, open_ = {"a": 1, "b": 2, "c": 3, None: 1}, {}, {"a", "b", "c", None}
    while True:  # share, stop at three times the size, share the excess again
        left = sum(totals.values()) - sum(target.values())
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * totals[s]}
        if not over:
            target |= share
            break
        target |= {s: 3 * totals[s] for s in over}
        open_ -= over
    taken = Counter()
    for i, r in rows.items():
        assert r["size"] == sizes[i] and r["source_size"] == totals[sources[i]] and r["target"] == pytest.approx(target[sources[i]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[sources[i]] += r["taken"]
    assert len(rows) == len(texts) and all(abs(taken[s] - target[s]) <= mixing.BLOCK for s in target)
    again = {r["doc_id"]: r["taken"] for r in mixing.taken_words(docs.repartition(5)).collect()}
    assert again == {i: r["taken"] for i, r in rows.items()}
    mixed = {r["doc_id"]: r for r in mixing.mixed(docs).collect()}
    assert {i: len(WORD.findall(r["text"])) for i, r in mixed.items()} == {i: r["taken"] for i, r in rows.items() if r["taken"]}
    assert all(r["token"] == "x" and r["n_chars"] == len(r["text"]) and set(WORD.findall(r["text"])) <= set(WORD.findall(texts[i])) for i, r in mixed.items())
    assert mixing.taken_words(docs.limit(0)).count() == 0


def test_slots_are_permutations(spark):
    rows = [("k", e, b, n) for e in (0, 1) for n in (1, 2, 7, 100) for b in range(n)]
    df = spark.createDataFrame(rows, "key string, epoch int, block long, n_blocks long").withColumn("slot", F.col("block"))
    got = {}
    for r in mixing.permuted(df, "slot", "n_blocks", ["key", "epoch"]).collect():
        got.setdefault((r["epoch"], r["n_blocks"]), {})[r["block"]] = r["slot"]
    for (_, n), slots in got.items():
        assert sorted(slots.values()) == list(range(n)) and sorted(slots) == list(range(n))
    assert got[0, 100] != got[1, 100] and sum(b == s for b, s in got[0, 100].items()) < 10


def test_shards_draw_their_sources(make, text_of, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 50)
    monkeypatch.setattr(mixing, "BLOCK", 8)
    monkeypatch.setattr(mixing, "EXPLODED", 64)
    docs = make([text_of(k, 10 + k % 60) for k in range(600)], sources=["abc"[k % 5 % 3] for k in range(600)])
    rows = docs.select("doc_id", "source", mixing.n_words("text").alias("size"), F.lit(0).alias("tie")).withColumn("row", F.monotonically_increasing_id())
    places, sources = mixing.placed(mixing.sized(rows))
    of = {r["key"]: r for r in sources.collect()}
    drawn, held, shards = {}, {}, {}
    for r in mixing.shards(places, sources).collect():
        drawn.setdefault((r["shard"], r["place"]), set()).add((r["key"], r["epoch"], r["block"]))
        held[r["key"], r["epoch"], r["block"]] = held.get((r["key"], r["epoch"], r["block"]), 0) + r["words"]
    total = sum(r["n_slots"] for r in of.values())
    assert sorted(drawn) == [(k // 50, k % 50) for k in range(total)] and all(len(x) == 1 for x in drawn.values())
    assert all(n == min(8, of[k]["source_size"] - 8 * b) for (k, _, b), n in held.items())
    for k, r in of.items():  # each epoch holds each block once, the last epoch some of them
        epochs = Counter(e for x, e, _ in held if x == k)
        assert sum(epochs.values()) == r["n_slots"] and all(n == r["n_blocks"] for e, n in epochs.items() if e < max(epochs))
    for (shard, _), ((key, _, _),) in ((x, tuple(y)) for x, y in drawn.items()):
        shards.setdefault(shard, Counter())[key] += 1
    whole = [c for n, c in shards.items() if n < total // 50]
    chi = sum((c[k] - 50 * r["n_slots"] / total) ** 2 / (50 * r["n_slots"] / total) for c in whole for k, r in of.items())
    freedom = len(whole) * (len(of) - 1)
    assert len(whole) > 20 and abs(chi - freedom) < 4 * (2 * freedom) ** 0.5


def test_mixing_of_null_and_repeated_ids(spark, text_of):
    text = text_of(1, 200)
    docs = spark.createDataFrame([(None, text, "a"), (None, text, "a"), (1, text, "a"), (1, text, "a"), (1, text_of(2, 150), "b"), (2, None, None)], "doc_id long, text string, source string")
    rows = mixing.taken_words(docs).collect()
    assert len(rows) == 6 and all(r["taken"] <= 3 * r["size"] for r in rows)
    for source, size in (("a", 800), ("b", 150)):
        taken = sum(r["taken"] for r in rows if r["source_size"] == size)
        assert abs(taken - next(r["target"] for r in rows if r["source_size"] == size)) <= mixing.BLOCK, source
    assert sum(len(WORD.findall(r["text"])) for r in mixing.mixed(docs).collect()) == sum(r["taken"] for r in rows)


def test_packing_round_trip(make, text_of, awkward):
    import public_tokenizers
    from tokenizers import Tokenizer

    odd = ["İstanbul é  x y\x1cz", "<|endoftext|> don't we'll 3.14 \U0001f600!?", "AΣ ẞ"]
    texts = [*awkward, *odd, *[text_of(k, 50 * (k % 20)) for k in range(60)]]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for x in texts]
    rows = packing.pack(make(texts)).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        assert zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    for i, x in enumerate(ids):
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == len(x)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at & (at - 1) == 0 and at <= packing.WINDOW
    assert packing.pack(make(["x"]).limit(0)).count() == 0


def test_near_copies_lie_in_one_shard(make, text_of, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 3000)
    rnd, texts = np.random.default_rng(3), [" ".join(f"{w}{k % 7}" for w in text_of(k, 100).split()) + f" code {k * 7919} {k * 104729}" for k in range(60)]
    for t in texts[:60]:
        words = t.split()
        words[rnd.integers(len(words) - 3)] = "changed"
        texts.append(" ".join(words))
    texts += ["the same text in many documents"] * 900
    shard, tokens = {}, Counter()
    for r in packing.pack(make(texts)).collect():
        shard.setdefault(r["doc_id"], r["sequence_id"] >> 32)
        assert shard[r["doc_id"]] == r["sequence_id"] >> 32
        tokens[shard[r["doc_id"]]] += r["length"]
    assert len(shard) == len(texts) and len(tokens) >= 8 and max(tokens.values()) <= 2 * 3000
    assert sum(shard[k] == shard[60 + k] for k in range(60)) >= 50


def test_terms_of_many_documents_are_searched(make):
    texts = [" ".join([("north wind", "south rain", "east snow")[k % 3]] * 750) for k in range(12)]
    by_seq = {}
    for r in packing.pack(make(texts)).collect():
        by_seq.setdefault(r["sequence_id"], set()).add(r["doc_id"])
    assert set().union(*by_seq.values()) == set(range(12))
    assert len(by_seq[0]) > 1 and len({d % 3 for d in by_seq[0]}) == 1


def test_index_scores_rare_and_common_terms(text_of):
    rnd = np.random.default_rng(6)
    docs = [np.append(rnd.integers(10, 400, rnd.integers(5, 60)), [2] * (1 + k % 3) + [3] * (k % 2)) for k in range(50)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=1 << 16)
    idf = np.log1p((50 - df + 0.5) / (df + 0.5))
    mean = sum(map(len, docs)) / 50
    index = packing.Index(docs, idf, mean)
    weight = lambda t, d: idf[t] * (d == t).sum() * 2.2 / ((d == t).sum() + 1.2 * (0.25 + 0.75 * len(d) / mean))
    for seed in (0, 7, 31):
        scores = np.array([sum(weight(t, d) for t in np.unique(docs[seed])) for d in docs])
        assert np.all(np.diff(scores[index.neighbours(seed)]) <= 1e-9)


def test_neighbours_are_bm25(text_of):
    docs = [np.array([1, 2, 3, 4]), np.array([9, 9, 8, 7]), np.array([3, 4, 5, 6]), np.array([1, 2, 3, 9])]
    df = np.zeros(1 << 16)
    for d in docs:
        df[np.unique(d)] += 1
    idf = np.log1p((4 - df + 0.5) / (df + 0.5))
    got = packing.Index(docs, idf, 4.0).neighbours(0)

    def score(q, d):
        return sum(idf[t] * (d == t).sum() * 2.2 / ((d == t).sum() + 1.2 * (0.25 + 0.75 * len(d) / 4)) for t in np.unique(q))

    assert got.tolist() == sorted(range(4), key=lambda i: (-score(docs[0], docs[i]), i))


def ruzzo_brute(s):
    """Maximal-scoring subsequences by the definition: the best segment, then those left and right of it."""
    best = max(((sum(s[i:j]), -(j - i), i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    _, _, i, j = best
    return [x for x in ruzzo_brute(s[:i])] + [(i, j)] + [(a + j, b + j) for a, b in ruzzo_brute(s[j:])]


def test_segments_are_the_maximal_ones():
    rnd = np.random.default_rng(3)
    for _ in range(60):
        s = [float(x) for x in rnd.integers(-50, 60, rnd.integers(1, 25)) + rnd.random()]
        scan, total = toxicity.Segments(), 0.0
        for i, x in enumerate(s):
            if x > 0:
                scan.add(total, total + x, i, i + 1)
            total += x
        assert [(a, b) for _, _, a, b in scan.found] == ruzzo_brute(s)


def test_segments_do_not_depend_on_slices(monkeypatch, text_of):
    text = f"{text_of(1, 300)} bad worse bad {text_of(2, 300)} İ bad bad {text_of(3, 50)}"
    whole = toxicity.segments(text, {"bad": 3.0, "worse": 2.0}, -1.0)
    monkeypatch.setattr(toxicity, "SLICE", 37)
    n, found = toxicity.segments(text, {"bad": 3.0, "worse": 2.0}, -1.0)
    assert n == whole[0] and [(a, b, round(s, 6)) for a, b, s in found] == [(a, b, round(s, 6)) for a, b, s in whole[1]]
    assert [text[a:b] for a, b, _ in found] == ["bad worse bad", "bad bad"]


def test_toxicity_on_held_out_rows(spark, make, text_of, awkward):
    toxic = [k % 5 == 0 for k in range(400)]
    texts = [f"{text_of(k, 40)} {'vile scum ' * 2 if x else ''}{text_of(k + 500, 40)}" for k, x in enumerate(toxic)] + list(awkward)
    docs = make(texts)
    labels = spark.createDataFrame([(i, int(x)) for i, x in enumerate(toxic)], "doc_id long, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs, labels), ["doc_id"]).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 50 and all((rows[i]["score"] >= 0.5) == toxic[i] for i in held)
    assert all(not rows[400 + k]["passages"] and rows[400 + k]["score"] < 0.5 for k in range(len(awkward)))
    p = rows[held[[toxic[i] for i in held].index(True)]]
    assert [texts[p["doc_id"]][x["start"] : x["end"]] for x in p["passages"]] == ["vile scum vile scum"]
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None
    assert {r["score"] for r in toxicity.score(docs, None, ["doc_id"]).collect()} == {0.0}


def test_every_word_has_its_own_log_odds(spark):
    rows = [("vile day", 1)] * 30 + [("fine day", 0)] * 60 + [("rare", 0), ("odd", 1)]
    scores, of_score = toxicity.word_scores(spark.createDataFrame(rows, "text string, label int"))
    assert scores["vile"] > 0 > -toxicity.DRIFT > scores["fine"] and "rare" not in scores and "odd" not in scores
    assert sum(of_score.values()) == 121 and of_score[scores["fine"]] == 60 and of_score[scores["vile"]] == 0
    counts = {-1.0: 900, 0.5: 50, 1.5: 30, -2.5: 20}
    lam = toxicity.decay(counts)
    assert lam > 0 and sum(n * np.exp(lam * x) for x, n in counts.items()) == pytest.approx(1000, rel=1e-6)


def ppm_bits(training, data, order=3, least=1, every=()):
    """Code length by the definition; contexts of three bytes that all training texts have fewer than least times don't count."""
    counts, seen = {}, Counter()
    for t in [langid.PAD + t for t in every]:
        seen.update(t[i - 3 : i] for i in range(3, len(t)))
    for t in training:
        t = langid.PAD + t
        for i in range(3, len(t)):
            for k in range(order + 1):
                counts.setdefault(t[i - k : i], Counter())[t[i]] += 1
    bits, data = 0.0, langid.PAD + data
    for i in range(3, len(data)):
        p = 1.0
        for k in range(order, -1, -1):
            c = counts.get(data[i - k : i])
            if c is None or k == 3 and seen[data[i - k : i]] < least and every:
                continue
            n, d = sum(c.values()), len(c)
            if data[i] in c:
                p *= c[data[i]] / (n + d)
                break
            p *= d / (n + d)
        else:
            p /= 256
        bits -= np.log2(p)
    return bits


@pytest.mark.parametrize("least", [1, 2, 4])
def test_code_lengths_are_exact(monkeypatch, least):
    training = {"x": [b"abracadabra", b"abba", b"abracadabra abra"], "y": [b"xyzzy", b"quux abra"]}
    every = [t for texts in training.values() for t in texts]
    counts = []
    for lang, texts in training.items():
        grams = Counter()
        for t in texts:
            t = langid.PAD + t
            grams.update(int.from_bytes(t[i - 3 : i + 1], "big") for i in range(3, len(t)))
        counts += [(lang, g, n) for g, n in grams.items()]
    trees = langid.build_trees(counts, deep_min=least)
    for data in (b"abra", b"zzz", b"\xff\x00 abra xyzzy q", b"a" * 50):
        want = [ppm_bits(training[k], data, least=least, every=every) for k in ("x", "y")]
        assert trees.code_lengths(data) == pytest.approx(want, rel=1e-4)
        monkeypatch.setattr(langid, "SLICE", 3)
        assert trees.code_lengths(data) == pytest.approx(want, rel=1e-4)
        monkeypatch.undo()


def test_language_on_held_out_rows(make, awkward):
    words = {"en": "the of and to in is that with for was".split(), "de": "der die und das ist nicht mit ein auf sich".split()}
    rnd = np.random.default_rng(1)
    langs = {k: ("en", "de")[k % 2] for k in range(200)}
    texts = [" ".join(rnd.choice(words[langs[k]], 30)) for k in range(200)] + list(awkward)
    docs = make(texts, langs=langs | {200 + k: None for k in range(len(awkward))})
    trees = langid.fit(docs)
    rows = {r["doc_id"]: r for r in langid.identify(docs, trees, ["doc_id"]).collect()}
    assert all(rows[k]["lang_pred"] == langs[k] and 0.5 <= rows[k]["score"] <= 1 for k in range(200))
    odd = make(["½ 12", "² Ⅷ", "ª", "x"])
    assert [r["lang_pred"] == "und" for r in langid.identify(odd, trees, ["doc_id"]).orderBy("doc_id").collect()] == [True, True, False, False]
    letterless = [200 + k for k, t in enumerate(awkward) if not any(c.isalpha() for c in t or "")]
    assert all(rows[k]["lang_pred"] == "und" and rows[k]["score"] == 0 for k in letterless)
    kept = langid.accepted(docs, trees)
    assert kept.columns == docs.columns and set(range(200)) <= {r["doc_id"] for r in kept.collect()} and not {r["doc_id"] for r in kept.collect()} & set(letterless)
    assert {r["lang_pred"] for r in langid.identify(docs, langid.fit(docs.limit(0)), ["doc_id"]).collect()} == {"und"}


def test_pipeline_stages(spark, make, text_of, awkward):
    import corpus_pipeline

    texts = [text_of(k, 60) for k in range(40)] + [text_of(0, 60) + " more"] + list(awkward)
    docs = make(texts)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        seen[name] = docs.collect()
        if name != "packing":
            docs = spark.createDataFrame(seen[name], docs.schema)
    ids = {name: {r["doc_id"] for r in rows} for name, rows in seen.items()}
    assert set(range(40)) <= ids["language_id"] and set(range(40)) <= ids["minhash_dedup"]
    assert 40 not in ids["minhash_dedup"] and ids["packing"] == ids["mixing"] <= ids["minhash_dedup"] <= ids["line_dedup"] <= ids["language_id"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "minhash_dedup", "mixing", "packing"]


def test_empty_tables_and_repeated_ids(spark, text_of):
    docs = spark.createDataFrame([(1, text_of(1, 50), "en", "a"), (1, text_of(2, 50), "en", "a"), (None, None, None, None), (None, "x", "en", "b")], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "doc_id long, toxic int")
    none, model = docs.limit(0), toxicity.fit(docs, labels)
    assert quality.assess(none).count() == 0 and quality.assess(docs).count() == 4
    assert toxicity.score(none, model, ["doc_id"]).count() == 0 and toxicity.score(docs, model, ["doc_id"]).count() == 4
    assert toxicity.fit(none, labels) is None and langid.fit(none) is None
    assert langid.identify(docs, langid.fit(docs), ["doc_id"]).count() == 4 and langid.accepted(none, None).count() == 0
    assert pii.summary(docs).count() == 4 and packing.pack(docs).select("doc_id").distinct().count() == 2


def test_pipeline_of_nothing(spark, make):
    import corpus_pipeline

    docs = make(["x"]).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_pipeline_of_null_and_repeated_ids(spark, text_of):
    import corpus_pipeline

    rows = [(None, text_of(1, 80), "en", "a"), (None, text_of(1, 80), "en", "a"), (1, text_of(2, 80), "en", "a"), (1, text_of(3, 80), None, None), (2, None, "en", "b"), (3, "", "en", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        if name == "minhash_dedup":
            assert sorted((r["doc_id"] or 0, r["text"]) for r in docs.collect()) == sorted([(0, text_of(1, 80)), (1, text_of(2, 80)), (1, text_of(3, 80))])
    assert docs.count() >= 2
