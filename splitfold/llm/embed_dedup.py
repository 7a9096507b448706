"""Embedding near-duplicates by cross-polytope hashing.

Vectors of one label are compared by cosine. Equal vectors are one row with a multiplicity from here on. Each table flips
signs and applies the fast Hadamard transform three times (a pseudorandom rotation in d log d steps), and takes the nearest
vertex of the cross polytope, which is the largest coordinate and its sign; some rotations of them make a bucket. Each
vector stands in its own bucket and probes the next likely ones, in each of which one rotation's vertex is replaced by its
runner-up. Two vectors of a label that meet in a bucket, which is one of them's own, are a candidate pair.

At a cosine of 0.98 in 64 dimensions a pair meets in one table of two rotations with probability of about 0.9, so that six
tables miss next to none. The number of rotations follows the logarithm of the largest label's vectors, so that buckets
stay small, and the number of tables follows that of rotations, so that recall stays.

Buckets of more than ``BLOCK`` vectors are cut into blocks whose pairs are tasks of their own. A pair of blocks is one
product of matrices in double precision, which verifies all its candidates at once; pairs never become rows. A pair counts
in the first bucket in which it meets and in no other. What leaves a block is a row for each vector that has a link there:
how many vectors it links to, and the least vector that it reaches inside the block, from which components follow.

Defined results: a vector that is null, empty, zero, or holds null or non-finite components, or has a null label, links
with nothing; vectors of different lengths link with nothing; rows with a null or repeated id each count as a vector of
their own and give a row each, and a component's id is the least id that isn't null (a row of no other id is its own
component, null for a null id); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from splitfold.llm.common import by_keys, dropped, written
from splitfold.llm.components import components
from splitfold.llm.wordhash import mixed

COSINE, SEED, BLOCK, IN_BUCKET, PAIRS = 0.98, 11, 1024, 16, 1 << 17
#: Rows of small lists multiplied at a time, and rows of whole lists taken up at a time.
SMALL, HELD = 256, 8192
#: Cosines this near to the limit are computed once more, pair by pair.
CLOSE = 1e-12


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the rows' length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def vertices(x: np.ndarray, table: int, rotation: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest and the second nearest vertex of each rotated row."""
    signs = np.random.default_rng([SEED, table, rotation, x.shape[1]]).choice([-1.0, 1.0], (3, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    size = np.abs(x)
    top = np.argpartition(-size, 1, axis=1)[:, :2]
    rows = np.arange(len(x))[:, None]
    top = np.take_along_axis(top, np.argsort(-size[rows, top], axis=1), axis=1)
    code = 2 * top + (x[rows, top] > 0)
    return code[:, 0], code[:, 1]


def width_of(size: int) -> int:
    return 1 << max(1, math.ceil(math.log2(max(size, 2))))


def rotations_for(n: int, size: int) -> int:
    """So many that a label's n vectors of a length would fill each bucket with about IN_BUCKET of them; two at least."""
    return max(2, math.ceil(math.log(max(n / IN_BUCKET, 1)) / math.log(2 * width_of(size))))


def buckets(x: np.ndarray, rotations: int) -> np.ndarray:
    """[rows, tables, 1 + rotations]: own bucket and further probes of unit vectors."""
    width = width_of(x.shape[1])
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    every = []
    for t in range(2 * rotations + 2):
        first, second = zip(*[vertices(x, t, r) for r in range(rotations)], strict=True)
        place = [(2 * width) ** r for r in range(rotations)]
        code = sum(f * p for f, p in zip(first, place, strict=True))
        every.append(np.stack([code, *[code + (s - f) * p for f, s, p in zip(first, second, place, strict=True)]], axis=1))
    return np.stack(every, axis=1)


def vectors_of(column: pa.Array) -> list[np.ndarray]:
    """The rows in double precision, null components as NaN, null rows empty."""
    at = np.append(0, np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return [flat[i:j] for i, j in zip(at.tolist(), at[1:].tolist(), strict=False)]


def usable(v: np.ndarray) -> bool:
    return bool(len(v) and np.isfinite(v).all() and (v != 0).any() and 0 < (v * v).sum() < np.inf)


def usable_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, label, digest, embedding): digest is null where the vector links with nothing."""
    schema = rows.select("vec_id", "label").schema.add("digest", "binary").add(rows.schema["embedding"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(1).is_valid().to_pylist()
            digest = [xxhash.xxh3_128_digest((v + 0.0).tobytes()) if k and usable(v) else None for v, k in zip(vectors_of(batch.column(2)), known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digest, pa.binary()), batch.column(2)], names=schema.names)

    return rows.select("vec_id", "label", "embedding").mapInArrow(run, schema)


def coded(vectors: DataFrame, rotations: dict[int, int]) -> DataFrame:
    """(rep, label, copies, embedding, codes): codes has the vector's own bucket and its probes for each table."""
    schema = StructType([*vectors.schema.fields, StructField("codes", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = vectors_of(batch.column(3))
            codes: list = [None] * len(vecs)
            for size in sorted({len(v) for v in vecs}):
                rows = [i for i, v in enumerate(vecs) if len(v) == size]
                x = np.array([vecs[i] for i in rows])
                for i, c in zip(rows, buckets(x / np.linalg.norm(x, axis=1, keepdims=True), rotations[size]), strict=True):
                    codes[i] = c.ravel()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.list_(pa.int64()))], names=schema.names)

    return vectors.mapInArrow(run, schema)


def linked_in(x: np.ndarray, codes: np.ndarray, lists: np.ndarray, table: np.ndarray, bucket: np.ndarray, part: np.ndarray, copies: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row: how many vectors it links to in its list's bucket and in none before, and the least row it reaches there."""
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    near = unit @ unit.T
    linked = near >= cosine
    for i, j in zip(*np.nonzero(np.triu(np.abs(near - cosine) < CLOSE, 1)), strict=True):
        linked[i, j] = linked[j, i] = x[i] @ x[j] / (np.sqrt(x[i] @ x[i]) * np.sqrt(x[j] @ x[j])) >= cosine
    np.fill_diagonal(linked, False)
    own = codes[np.arange(len(x)), table, 0] == bucket
    linked &= (own[:, None] | own[None, :]) & (lists[:, None] == lists[None, :])
    if (part >= 0).any():
        linked &= (part[:, None] != part[None, :]) | (part[:, None] < 0)
    count = np.zeros(len(x), np.int64)
    left, right = np.nonzero(np.triu(linked))
    none = np.iinfo(np.int64).max
    for at in range(0, len(left), PAIRS):
        a, b = left[at : at + PAIRS], right[at : at + PAIRS]
        first, where = np.full(len(a), none), np.full(len(a), -1)
        for t in range(int(table[a].max()) + 1):
            open_ = np.flatnonzero(where < 0)
            p, q = codes[a[open_], t], codes[b[open_], t]
            met = np.minimum(np.where((q == p[:, :1]).any(axis=1), p[:, 0], none), np.where((p == q[:, :1]).any(axis=1), q[:, 0], none))
            found = met < none
            first[open_[found]], where[open_[found]] = met[found], t
        counts = (where == table[a]) & (first == bucket[a])
        count += np.bincount(a[counts], copies[b[counts]], len(x)).astype(np.int64) + np.bincount(b[counts], copies[a[counts]], len(x)).astype(np.int64)
    least, todo = np.arange(len(x)), linked.any(axis=1)
    for i in np.flatnonzero(todo).tolist():
        if todo[i]:
            todo[i], reached = False, np.array([i])
            while len(reached):
                reached = np.flatnonzero(linked[reached].any(axis=0) & todo)
                todo[reached], least[reached] = False, i
    return count, least


def runs(lists: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of whole lists with at most so many rows, or of one list."""
    edges = [0, *(np.flatnonzero(np.diff(lists)) + 1).tolist(), len(lists)]
    first = 0
    for at, to in zip(edges, edges[1:], strict=False):
        if to - first > most and at > first:
            yield first, at
            first = at
    if first < len(lists):
        yield first, len(lists)


def block_links(rows: DataFrame, cosine: float) -> DataFrame:
    """(rep, root, near) of the vectors with a link in a pair of blocks. Small lists are multiplied several at a time."""

    def body(t: pa.Table) -> Iterator[pa.RecordBatch]:
        size = t.column("embedding").combine_chunks().value_lengths().to_numpy()
        lists, group, table, bucket, part, rep, copies = (t.column(c).to_numpy() for c in ("list", "group", "table", "bucket", "part", "rep", "copies"))
        vecs, codes = vectors_of(t.column("embedding").combine_chunks()), t.column("codes").combine_chunks()
        at, flat = codes.offsets.to_numpy(), codes.values.to_numpy()
        probes = t.column("probes").to_numpy()
        out: list[list[np.ndarray]] = [[], [], []]
        for d in np.unique(size).tolist():
            rows = np.flatnonzero(size == d)
            # lists whose hashes are equal are told apart by what was hashed
            kind = lists[rows] ^ mixed((group[rows] ^ bucket[rows] * 64 ^ table[rows]).view(np.uint64)).view(np.int64)
            rows = rows[np.lexsort((rep[rows], kind, lists[rows]))]
            kind = lists[rows] ^ mixed((group[rows] ^ bucket[rows] * 64 ^ table[rows]).view(np.uint64)).view(np.int64)
            for i, j in runs(kind, SMALL):
                own = rows[i:j]
                tables = np.array([flat[at[k] : at[k + 1]] for k in own]).reshape(len(own), -1, int(probes[own[0]]))
                near, least = linked_in(np.array([vecs[k] for k in own]), tables, kind[i:j], table[own], bucket[own], part[own], copies[own], cosine)
                held = np.flatnonzero((near > 0) | (least < np.arange(len(own))))
                for column, values in zip(out, (rep[own[held]], rep[own[least[held]]], near[held]), strict=True):
                    column.append(values)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in out], names=["rep", "root", "near"])

    columns = ["group", "table", "bucket", "part", "rep", "copies", "probes", "embedding", "codes"]
    return by_keys(rows, "list", columns, body, "rep long, root long, near long", HELD)


def link(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row."""
    base = written(usable_vectors(rows.select(F.col("vec_id").cast("long"), "label", "embedding")), "embed-rows")
    equal = base.where("digest is not null").groupBy("label", "digest").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    vectors = written(equal.withColumn("rep", F.monotonically_increasing_id()), "embed-vectors")
    sizes = vectors.groupBy("label", F.size("embedding").alias("size")).count().groupBy("size").agg(F.max("count")).collect()
    rotations = {r[0]: rotations_for(r[1], r[0]) for r in sizes}
    full = written(coded(vectors.select("rep", "label", "copies", "embedding"), rotations), "embed-codes")
    probes = F.create_map(*[F.lit(x) for k, r in rotations.items() for x in (k, r + 1)])[F.size("embedding")] if rotations else F.lit(1)
    full = full.withColumns({"group": F.xxhash64("label", F.size("embedding")), "probes": probes})
    posted = full.select("rep", "group", "probes", F.posexplode("codes").alias("at", "bucket"))
    posted = posted.select("rep", "group", F.floor(F.col("at") / F.col("probes")).cast("int").alias("table"), "bucket", (F.col("at") % F.col("probes") == 0).alias("own"))
    key = ["group", "table", "bucket"]
    # a vector's runner-up can't be its first choice, so it stands in a bucket once
    met = written(posted.groupBy(*key).agg(F.count("*").alias("n"), F.max("own").alias("owned")).where("owned and n > 1").select(*key, F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")), "embed-buckets")
    placed = posted.select("rep", *key).join(met, key).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pair = F.least("mine", "other") * F.col("parts").cast("long") + F.greatest("mine", "other")
    placed = placed.select("rep", "table", "bucket", F.xxhash64(*key, pair).alias("list"), F.when(F.col("mine") == F.col("other"), -1).otherwise(F.col("mine")).alias("part"))
    found = written(block_links(placed.join(full, "rep"), cosine), "embed-links")
    near = found.groupBy("rep").agg(F.sum("near").alias("near"))
    reached = components(found.where("rep != root").select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "rep")
    groups = written(vectors.drop("embedding").join(near, "rep", "left").join(reached, "rep", "left").withColumn("root", F.coalesce("component", "rep")), "embed-groups")
    dropped(vectors, full, met, found)
    least = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    named = groups.join(least, "root").select("label", "digest", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), "component_id")
    out = base.select("vec_id", "label", "digest").join(named, ["label", "digest"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), component.isNull()).alias("kept"))
