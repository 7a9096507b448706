"""MinHash near-duplicates by a signature-coordinate inverted join.

A document's set holds its distinct runs of ``ngram`` words. Equal sets are one representative (the least id) from the
start, so exact copies never meet. A signature has COORDINATES minima; a token is a (coordinate, value) pair. Two sets
of Jaccard similarity 0.8 agree in 25.6 of 32 coordinates on average and in fewer than MATCHES with a probability of
about 1e-7, so only pairs that agree in MATCHES or more are candidates.

Such pairs share a token among the COORDINATES - MATCHES + 1 rarest of either (prefix), so a document is posted under
those alone and the frequent tokens' lists are never merged; they only count when a pair is checked (skip). Tokens of a
single document are gone before. Then

1. star: each posting list's least document meets the others of fitting size; collisions are counted over all tokens,
   candidates are confirmed on the full sets, and components of the confirmed links label the documents;
2. rest: lists that still hold two labels are cut into blocks of at most ``BLOCK`` documents on either side, and
   documents of different labels meet inside a block. Blocks give only documents with a candidate, then, with the texts
   at hand, only links that join what the block hadn't joined yet.

So a group of near copies costs a row for each document and list, not one for each pair, and no list lies in one task.
Links are the same as of all candidate pairs, as a pair is left out only where its two sides are joined already.

Defined results: null, empty and all-space texts have an empty set and link with nothing; texts with fewer than ``ngram``
words have their whole sequence as the one element; ids that repeat with different texts are texts of their own, each
linked by its own set; a component's id is the least id in it that isn't null, and null if there is none; rows that repeat
are one text; long texts are used whole; an empty table gives no rows; columns with clashing names are ignored or pass
through ``deduplicated``. Sets are compared by 64-bit hashes of their elements.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitfold.llm.common import NON_SPACE_CLASS, dropped, written
from splitfold.llm.components import components
from splitfold.llm.wordhash import LOWER, slices, word_hashes, word_spans

COORDINATES, MATCHES, BLOCK, PERCENT = 32, 14, 512, 80
_random = np.random.default_rng(20240502)
FACTORS = _random.integers(0, 1 << 64, COORDINATES, dtype=np.uint64) | np.uint64(1)
OFFSETS = _random.integers(0, 1 << 64, COORDINATES, dtype=np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15)
PART = 2048


def shingled(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, from the words' hashes."""
    x = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        x = (x ^ (x >> np.uint64(29))) * MIX + h[k : len(h) - n + 1 + k]
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: pa.Array, ngram: int) -> list[np.ndarray]:
    """The set of each text, as sorted hashes of its elements."""
    out = []
    for _, _, data, offsets in slices(texts):
        data = LOWER[data]
        starts, ends = word_spans(data, offsets)
        h = word_hashes(data, starts, ends)
        every = shingled(h, ngram) if len(h) >= ngram else h
        at = np.searchsorted(starts, offsets).tolist()
        for i, j in zip(at, at[1:], strict=False):
            out.append(np.unique(every[i : j - ngram + 1]) if j - i >= ngram else shingled(h[i:j], j - i) if j > i else every[:0])
    return out


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def signature(x: np.ndarray) -> np.ndarray:
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(x), PART):
        np.minimum(least, (FACTORS[:, None] * x[None, at : at + PART] + OFFSETS[:, None]).min(1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


#: Two hashes that name a row's id and text; rows with the same ones are copies of a row, as far as this goes.
def keyed() -> tuple:
    return F.xxhash64("doc_id", "text").alias("k1"), F.hash("text", "doc_id").alias("k2")


def signatures(docs: DataFrame, ngram: int) -> DataFrame:
    """(doc_id, k1, k2, n_shingles, digest, sig); digest and sig are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(3), ngram)
            digest = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
            sig = [signature(x) if len(x) else None for x in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(x) for x in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.list_(pa.int32()))], names=["doc_id", "k1", "k2", "n_shingles", "digest", "sig"])

    rows = docs.select(F.col("doc_id").cast("long"), *keyed(), "text")
    return rows.mapInArrow(run, "doc_id long, k1 long, k2 int, n_shingles long, digest binary, sig array<int>")


def candidates(reps: DataFrame) -> DataFrame:
    """(rep, n, tokens, n_posted): tokens that others have too, rarest first, of each document with MATCHES or more."""
    tokens = reps.select("rep", "n", F.posexplode("sig").alias("at", "value")).select("rep", "n", (F.shiftleft(F.col("at").cast("long"), 32) + F.col("value") + (1 << 31)).alias("token"))
    shared = written(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "minhash-df")
    held = tokens.join(shared, "token").groupBy("rep").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    return held.where(F.size("t") >= MATCHES).select("rep", "n", F.col("t.token").alias("tokens"), (F.size("t") - MATCHES + 1).alias("n_posted"))


def fitting(a: str, b: str, percent: int):
    return (100 * F.col(a) >= percent * F.col(b)) & (100 * F.col(b) >= percent * F.col(a))


def star_pairs(posts: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b) of a list's least document and another, of fitting size, that agree in MATCHES coordinates."""
    first = written(posts.groupBy("token").agg(F.min(F.struct("rep", "n")).alias("first"), F.count("*").alias("size")).where("size > 1").select("token", F.col("first.rep").alias("a"), F.col("first.n").alias("na")), "minhash-firsts")
    pairs = posts.join(first, "token").where((F.col("rep") != F.col("a")) & fitting("n", "na", percent)).select("a", F.col("rep").alias("b")).distinct()
    one, two = (docs.select(F.col("rep").alias(x), F.col("tokens").alias(f"t{x}")) for x in "ab")
    return written(pairs, "minhash-star").join(one, "a").join(two, "b").where(F.size(F.array_intersect("ta", "tb")) >= MATCHES).select("a", "b")


def confirmed(pairs: DataFrame, texts: DataFrame, ngram: int, percent: int) -> DataFrame:
    """The pairs whose full sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (shingle_sets(batch.column(k), ngram) for k in (2, 3))
            keep = [similar(x, y, percent) for x, y in zip(one, two, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one = texts.select(F.col("rep").alias("a"), F.col("text").alias("x"))
    two = texts.select(F.col("rep").alias("b"), F.col("text").alias("y"))
    return written(pairs, "minhash-pairs").join(two, "b").join(one, "a").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def blocked(posts: DataFrame) -> DataFrame:
    """The lists with two labels in blocks: key, rep, and whether the row stands on the open side.

    Documents whose label is not the list's least are open; each block has at most about BLOCK open documents and about
    BLOCK of all, and each open document meets all others of the list in some block.
    """
    lists = posts.groupBy("token").agg(F.min("label").alias("main"), F.max("label").alias("most"), F.count("*").alias("size"))
    mixed = written(lists.where("main != most").drop("most"), "minhash-mixed")
    rows = written(posts.join(mixed, "token"), "minhash-mixed-rows")
    opened = written(rows.where("label != main").groupBy("token").agg(F.count("*").alias("opened")), "minhash-opened")
    rows = rows.join(opened, "token")
    n_open, n_all = F.ceil(F.col("opened") / BLOCK).cast("int"), F.ceil(F.col("size") / BLOCK).cast("int")
    part = lambda n, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), n).cast("int")
    left = rows.where("label != main").select("token", part(n_open, 1).alias("i"), F.explode(F.sequence(F.lit(0), n_all - 1)).alias("j"), "rep", F.lit(True).alias("open"))
    right = rows.select("token", F.explode(F.sequence(F.lit(0), n_open - 1)).alias("i"), part(n_all, 2).alias("j"), "rep", F.lit(False).alias("open"))
    return left.unionAll(right)


def by_block(rows: DataFrame, columns: list[str], body, schema: str) -> DataFrame:
    """body(table of one block) for each block; a block's rows lie together and sorted in one task."""
    names = ["token", "i", "j", *columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
            cuts = np.flatnonzero((np.diff(key, axis=1) != 0).any(0)) + 1
            if held and any(held[-1].column(k)[-1].as_py() != key[k, 0] for k in range(3)):
                yield from body(pa.Table.from_batches(held))
                held = []
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                held.append(batch.slice(int(a), int(b - a)))
                if b < batch.num_rows:
                    yield from body(pa.Table.from_batches(held))
                    held = []
        if held:
            yield from body(pa.Table.from_batches(held))

    return rows.select(*names).repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(run, schema)


def crossing(label: np.ndarray, n: np.ndarray, tokens: list[np.ndarray], opened: np.ndarray, token: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of candidate pairs in a block, open side first: other label, fitting size, MATCHES collisions.

    Of the lists that both are in, a pair is a candidate in that of the rarest token they share, and in no other.
    """
    sig = np.full((len(label), COORDINATES), -1, np.int64)
    sig[:, :] = -1 - np.arange(len(label))[:, None]  # tokens of one document alone match nothing
    place = np.full((len(label), COORDINATES), COORDINATES)
    for r, t in enumerate(tokens):
        sig[r, t >> 32] = t
        place[r, t >> 32] = np.arange(len(t))
    left, right = np.flatnonzero(opened), np.flatnonzero(~opened)
    a, b = [], []
    for x in left:
        fit = (label[right] != label[x]) & (100 * n[right] >= percent * n[x]) & (100 * n[x] >= percent * n[right])
        near = right[fit]
        same = sig[near] == sig[x]
        near = near[(same.sum(1) >= MATCHES) & (np.where(same, place[x], COORDINATES).argmin(1) == token >> 32)]
        a.append(np.full(len(near), x))
        b.append(near)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def rest_links(posts: DataFrame, docs: DataFrame, texts: DataFrame, ngram: int, percent: int) -> DataFrame:
    """Links between documents of different labels, from blocks; posts: (token, rep, label)."""
    blocks = written(blocked(posts), "minhash-blocks")
    labels = posts.select("rep", "label").distinct()
    described = written(docs.join(labels, "rep").select("rep", "label", "n", "tokens"), "minhash-described")

    def arrays(t: pa.Table) -> tuple:
        tokens = [np.array(x, np.int64) for x in t.column("tokens").to_pylist()]
        return t.column("label").to_numpy(), t.column("n").to_numpy(), tokens, t.column("open").to_numpy(), t.column("token")[0].as_py(), percent

    def with_candidate(t: pa.Table) -> Iterator[pa.RecordBatch]:
        a, b = crossing(*arrays(t))
        if len(a):
            rows = np.unique(np.concatenate([a, b]))
            yield from t.select(["token", "i", "j", "rep", "open"]).take(pa.array(rows)).to_batches()

    def linked(t: pa.Table) -> Iterator[pa.RecordBatch]:
        a, b = crossing(*arrays(t))
        rep, label = t.column("rep").to_pylist(), t.column("label").to_pylist()
        texts, sets = t.column("text").combine_chunks(), {}
        top = {x: x for x in label}
        out = []

        def root(x: int) -> int:
            while top[x] != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = root(label[x]), root(label[y])
            if p != q:
                for k in (x, y):
                    if k not in sets:
                        sets[k] = shingle_sets(texts.slice(k, 1), ngram)[0]
                if similar(sets[x], sets[y], percent):
                    top[max(p, q)] = min(p, q)
                    out.append((rep[x], rep[y]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    columns = ["rep", "open", "label", "n", "tokens"]
    meeting = written(by_block(blocks.join(described, "rep"), columns, with_candidate, "token long, i int, j int, rep long, open boolean"), "minhash-meeting")
    whole = meeting.join(described, "rep").join(texts, "rep")
    return by_block(whole, [*columns, "text"], linked, "a long, b long")


def linked(docs: DataFrame, ngram: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """All rows (doc_id, k1, k2, n_shingles, digest), and for each digest the id of its component (root) and the component's
    least doc_id (component_id)."""
    sigs = written(signatures(docs, ngram), "minhash-signatures")
    one = [F.min(F.struct("doc_id", "k1", "k2")).alias("row"), F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")]
    reps = written(sigs.where("digest is not null").groupBy("digest").agg(*one).withColumn("rep", F.monotonically_increasing_id()), "minhash-reps")
    held = written(candidates(reps), "minhash-candidates")
    posts = written(held.select("rep", "n", F.explode(F.slice("tokens", F.lit(1), F.col("n_posted"))).alias("token")), "minhash-postings")
    wanted = held.select("rep").join(reps.select("rep", "row.k1", "row.k2"), "rep")
    texts = written(docs.select(*keyed(), "text").join(wanted, ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("rep").alias("rep"), F.first("text").alias("text")).drop("k1", "k2"), "minhash-texts")
    star = written(confirmed(star_pairs(posts, held, percent), texts, ngram, percent), "minhash-star-links")
    labels = written(components(star).select(F.col("id").alias("rep"), "component"), "minhash-labels")
    labelled = written(posts.join(labels, "rep", "left").select("token", "rep", F.coalesce("component", "rep").alias("label")), "minhash-labelled")
    rest = written(rest_links(labelled, held, texts, ngram, percent), "minhash-rest-links")
    dropped(held, posts, texts, star, labelled)
    final = components(labels.select(F.col("rep").alias("a"), F.col("component").alias("b")).unionAll(rest)).withColumnRenamed("id", "rep")
    roots = written(reps.select("digest", "rep", "least").join(final, "rep", "left").select("digest", "least", F.coalesce("component", "rep").alias("root")), "minhash-roots")
    dropped(reps, labels, rest)
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    return sigs.drop("sig"), written(roots.select("digest", "root").join(least, "root"), "minhash-components")


def near_duplicates(docs: DataFrame, ngram: int = 5, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row."""
    sigs, named = linked(docs, ngram, percent)
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    found = sigs.join(named.select("digest", "component_id"), "digest", "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, ngram: int = 5, percent: int = PERCENT) -> DataFrame:
    """One row of each component, that with the least id (then the least hash; null ids last); rows without words stay."""
    sigs, named = linked(docs, ngram, percent)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("first")
    chosen = written(sigs.join(named, "digest").groupBy("root").agg(first).select("first.k1", "first.k2"), "minhash-chosen")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), *keyed(), F.coalesce(F.col("text").rlike(NON_SPACE_CLASS), F.lit(False)).alias("worded"))
    # copies of a row are one from here on, before rows move
    own = rows.where("worded").groupBy("k1", "k2").agg(F.first("doc").alias("doc")).join(chosen, ["k1", "k2"], "left_semi")
    return own.select("doc.*").unionAll(rows.where("not worded").select("doc.*"))
