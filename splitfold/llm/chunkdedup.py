"""Substring deduplication by content-defined chunking.

A gear hash rolls over a text's bytes, h = 2 h + gear[byte]; its low BITS bits depend on the last BITS bytes alone, and
where they are all 0 a chunk ends. So chunks average 2^BITS bytes, and an insertion moves only the ends near it. What
is compared over the whole corpus, by a 64-bit digest, are windows of consecutive chunks that cover ``MIN_CHARS``
characters: from each chunk the shortest one that begins there, and to each chunk the shortest one that ends there. The
first place of a digest, by (doc_id, first chunk, last chunk), stays and later ones are repeats. The chunks of repeats
that overlap or adjoin are a repeated passage and are removed. So a chunk goes only as part of a sequence that an
earlier place holds as it is, and each sequence of chunks that repeats and has ``MIN_CHARS`` characters goes whole;
shorter ones, which any two texts may share, stay.

The digests are counted by partial aggregation, so a passage that a third of all documents hold is one row from each
task, and go back to the windows by a join that splits large partitions. Only windows whose digest was seen twice get a
first place, by the same two steps.

Digests of 64 bits tell windows apart: among 10^12 of them some thousands would be taken for one another.

Defined results: null and empty texts have no chunk and nothing removed; of repeated rows one keeps its text, unless an
id itself is repeated, whose rows are one place; text without a chunk end is one chunk, ended after ``MAX_CHUNK`` bytes
wherever that is; columns with clashing names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from splitfold.llm.common import dropped, written

BITS, MAX_CHUNK, MIN_CHARS, TEXTS = 5, 1024, 100, 500
#: One pseudorandom number for each byte value, from a rule.
GEAR = np.random.default_rng(20240501).integers(0, 1 << BITS, 256, dtype=np.uint8)


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """Where chunks end (exclusive) in an array of bytes; the text's end included."""
    g, h = GEAR[data], np.zeros(len(data), np.uint8)
    for k in range(BITS):
        h[k:] += g[: max(len(g) - k, 0)] << k
    ends = np.flatnonzero((h & ((1 << BITS) - 1)) == 0) + 1
    ends = np.unique(np.append(ends, len(data)))
    long = np.flatnonzero(np.diff(ends, prepend=0) > MAX_CHUNK)
    if len(long):
        starts = np.append(0, ends)[long]
        ends = np.unique(np.concatenate([ends, *[np.arange(s + MAX_CHUNK, e, MAX_CHUNK) for s, e in zip(starts, ends[long], strict=True)]]))
    return ends


def window_digests(raw: bytes) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """First chunk, last chunk and digest of a text's windows. Characters are counted by their first bytes."""
    data = np.frombuffer(raw, np.uint8)
    ends = chunk_ends(data)
    starts, at = np.append(0, ends[:-1]), np.append(0, np.cumsum((data & 0xC0) != 0x80))
    n, every, s, e = len(ends), np.arange(len(ends)), at[starts], at[ends]
    to, since = np.searchsorted(e, s + MIN_CHARS), np.searchsorted(s, e - MIN_CHARS, "right") - 1
    both = np.unique(np.append((every * n + to)[to < n], (since * n + every)[since >= 0]))
    first, last = both // n, both % n
    return first, last, [xxhash.xxh3_64_intdigest(raw[a:b]) - (1 << 63) for a, b in zip(starts[first].tolist(), ends[last].tolist(), strict=True)]


def chunk_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, first, last, digest) of all windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch, row, first, last, digest = whole.slice(at, TEXTS), [], [], [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    if raw := (text or "").encode("utf-8", "replace"):
                        f, t, d = window_digests(raw)
                        row.append(np.full(len(f), i))
                        first.append(f)
                        last.append(t)
                        digest += d
                row, first, last = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (row, first, last))
                columns = [batch.column(0).take(pa.array(row)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(digest, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "first", "last", "digest"])

    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id").schema.add("first", "integer").add("last", "integer").add("digest", "long"))


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, repeated): for each document with any, first and last chunk of its windows that an earlier place holds."""
    windows = written(chunk_windows(docs), "chunks")
    twice = written(windows.groupBy("digest").count().where("count > 1").select("digest"), "chunk-digests")
    again = written(windows.join(twice, "digest"), "chunk-repeats")
    dropped(windows, twice)
    place = F.struct("doc_id", "first", "last")
    # written, so that the join below has no aggregate in its stage and Spark splits the partition of a hot digest
    firsts = written(again.groupBy("digest").agg(F.min(place).alias("least")), "chunk-firsts")
    later = again.join(firsts, "digest").where(place > F.col("least"))
    return later.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("repeated"))


def passages(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, n_chunks, n_repeated (chunks in repeated windows), spans [start, end) in characters of the repeated passages, and the text without them."""
    found = repeats(docs)
    schema = docs.select(*keep).schema
    schema = schema.add("n_chunks", "long").add("n_repeated", "long").add("spans", ArrayType(StructType().add("start", "integer").add("end", "integer"))).add("kept_text", "string")
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [cut(t, r) for t, r in zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist(), strict=True)]
            new = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], spans_type), pa.array([r[3] for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + new, names=schema.names)

    joined = docs.join(found.withColumnRenamed("doc_id", "__id").withColumnRenamed("repeated", "__repeated"), F.col("doc_id") == F.col("__id"), "left")
    return joined.select(*keep, F.col("text").alias("__text"), "__repeated").mapInArrow(run, schema)


def cut(text: str | None, repeated: list[dict] | None) -> tuple[int, int, list[dict], str | None]:
    raw = (text or "").encode("utf-8", "replace")
    ends = chunk_ends(np.frombuffer(raw, np.uint8)) if raw else np.zeros(0, np.int64)
    if not repeated:
        return len(ends), 0, [], text
    edge = np.zeros(len(ends) + 1, np.int64)
    for w in repeated:
        if w["last"] < len(ends):
            edge[w["first"]] += 1
            edge[w["last"] + 1] -= 1
    own = np.flatnonzero(np.cumsum(edge[:-1]))
    if not len(own):
        return len(ends), 0, [], text
    starts = np.append(0, ends[:-1])
    gaps = np.flatnonzero(np.diff(own) > 1) + 1
    spans = []
    for run in np.split(own, gaps):
        a, b = (len(raw[: int(x)].decode("utf-8", "ignore")) for x in (starts[run[0]], ends[run[-1]]))
        if b - a >= MIN_CHARS:
            spans.append({"start": a, "end": b})
    at, kept = 0, []
    for s in spans:
        kept.append(text[at : s["start"]])
        at = s["end"]
    return len(ends), len(own), spans, "".join(kept) + text[at:]


def dedup_summary(docs: DataFrame) -> DataFrame:
    """doc_id, n_chunks, n_repeated, n_spans, removed_chars and the spans as start:end, comma-joined."""
    found = passages(docs, ["doc_id"])
    return found.select(
        "doc_id",
        "n_chunks",
        "n_repeated",
        F.size("spans").cast("long").alias("n_spans"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("removed_chars"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"),
    )
