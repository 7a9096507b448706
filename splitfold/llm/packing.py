"""Lexical retrieval packing into fixed windows.

Every text is tokenized once, whole. Its parts (runs of letters, digits, runs of other characters, by the tokenizer's own
rule) are found and hashed as arrays where a word is plain (ASCII and the letters of Latin-1); words with other characters
are taken whole. Only parts
and words that a task hasn't met yet go to the tokenizer, which is exact as this tokenizer never joins across them; 64 bits
of hash, their length and the bytes at either end tell them apart. Texts are kept as 16-bit ids with an end id.

Documents are dealt by lexical affinity to shards of about ``SHARD_TOKENS`` tokens, so the number of shards follows the
corpus and a shard always fits a task: they are ordered by their three rarest ids that another document holds too (rarest
first, over the whole corpus), then by a hash of the row, and this order is cut by tokens; a run of equal keys that is
larger than a shard is dealt to several by the hash. So near copies and documents that share rare terms lie together,
however large the corpus; neighbours are searched inside a shard, and one that shares none of the rarest terms can lie in
another. A shard has a BM25 inverted index over token ids, with document frequencies and mean length of the whole corpus
(one number for each entry of the vocabulary). A window starts with a seed, the rest of the document cut last or else the
first unused one, asks the index for the seed's unused neighbours and takes them by score until it is full; the last is
cut and its rest is the next seed. So only the shard's last window can be short, and that one is cut into powers of two,
which need no padding.

Defined results: null and empty texts are one end id; every row is packed, repeated rows and rows with a null or repeated
id each; an empty table gives no pieces; documents longer than a window fill as many as they need; ties in score go to the
earlier document; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import functools
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.taskcontext import TaskContext

from splitfold.llm.common import dropped, written
from splitfold.llm.wordhash import LOWER, distinct, mixed, slices, word_hashes, word_spans

WINDOW, END, SHARD_TOKENS, NO_RANK = 4096, 2, 1_000_000, (1 << 16) - 1
K1, B = 1.2, 0.75
#: Terms in more of a shard's documents than this share have a row of weights for all of them instead of a posting list;
#: so the rows hold at most 1 / COMMON numbers for each posting. No term is left out of retrieval.
COMMON = 1 / 8
#: Entries of either cache, the longest part in it, and ids looked at in a time.
CACHE, CACHE_LENGTH, IDS = 1_000_000, 64, 1 << 21
#: Fixed value: how the tokenizer's file splits text.
PART = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
BLANK = np.isin(np.arange(256), [9, 10, 32])
#: Bytes that make a word go to the tokenizer's pattern whole: beyond Latin-1, not printable, or part of a contraction or special token.
OTHER = ~np.isin(np.arange(256), [9, 10, *range(32, 127)]) | np.isin(np.arange(256), [ord("'"), ord("|")])
#: 1 for letters, 2 for digits, 0 for others.
KIND = np.array([2 if chr(b) in "0123456789" else 1 if chr(b).isalpha() and b < 128 else 0 for b in range(256)], np.uint8)
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def lowered(word: str) -> str:
    """As the tokenizer does it: letter by letter, whatever stands beside them."""
    return word.lower() if word.isascii() else "".join(map(str.lower, unicodedata.normalize("NFC", word)))


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (size[0] numbers), begin[1], ... and so on."""
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


class Encoder:
    """Texts to their 16-bit ids.

    The ids of words between blanks lie end to end in ``pool``; a word's number is found by its hash, and ``check`` has its
    length and the bytes at either end. Words have parts (the pattern by which the tokenizer itself splits), which are kept too. New parts are
    encoded in one call; each ends with the one id that ends a word. Words with special tokens or characters that aren't
    printable go to the tokenizer as they are.
    """

    def __init__(self, file: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.parts: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError("ids have to fit 16 bits")
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[i for s, i in vocabulary.items() if s.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.number: dict[int, int] = {}
        self.pool, self.check = np.zeros(0, np.uint16), np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint16)

    def encode_parts(self, parts: list[str]) -> dict[str, bytes]:
        ids = self.ids(" ".join(parts))
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(parts):
            return {p: self.ids(p).tobytes() for p in parts}
        raw, cuts = ids.tobytes(), [0, *(2 * cuts).tolist()]
        return {p: raw[i:j] for p, i, j in zip(parts, cuts, cuts[1:], strict=False)}

    def encode_words(self, words: list[str]) -> list[bytes]:
        split = [PART.findall(lowered(w)) if w.isprintable() and "<|" not in w else None for w in words]
        wanted = {*chain.from_iterable(x for x in split if x)}
        fresh = self.encode_parts([p for p in wanted if p not in self.parts])
        known = {p: self.parts[p] if p in self.parts else fresh[p] for p in wanted}
        if len(self.parts) < CACHE:
            self.parts.update((p, x) for p, x in fresh.items() if len(p) <= CACHE_LENGTH)
        return [self.ids(w).tobytes() if x is None else b"".join([known[p] for p in x]) for w, x in zip(words, split, strict=True)]

    def added(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Puts parts (plain) and words into the pool and returns their numbers."""
        number = np.empty(len(starts), np.int64)
        for own, encode in ((np.flatnonzero(plain), self.encode_plain), (np.flatnonzero(~plain), self.encode_others)):
            if len(own):
                ids, size = encode(data, starts[own], ends[own])
                number[own] = len(self.size) + np.arange(len(own))
                self.begin = np.append(self.begin, len(self.pool) + np.cumsum(size) - size)
                self.pool = np.append(self.pool, ids)
                self.size, self.check = np.append(self.size, size), np.append(self.check, check[own])
        return number

    def encode_plain(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts' ids, end to end, and how many each has."""
        size = ends - starts
        line = np.full(int(size.sum()) + len(size), 32, np.uint8)
        line[ranges(np.cumsum(size + 1) - size - 1, size)] = data[ranges(starts, size)]
        ids = self.ids(line.tobytes().decode("utf-8", "replace"))
        cuts = np.flatnonzero(self.ends[ids]) + 1
        return (ids, np.diff(cuts, prepend=0)) if len(cuts) == len(size) else self.encode_others(data, starts, ends)

    def encode_others(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = self.encode_words([data[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(starts.tolist(), ends.tolist(), strict=True)])
        return np.frombuffer(b"".join(ids), np.uint16), np.array([len(x) // 2 for x in ids], np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, and where the texts begin and end in them."""
        if len(self.size) > CACHE:
            self.clear()
        starts, ends, plain, data = units(data, offsets)
        add = lambda i: self.added(data, starts[i], ends[i], plain[i], check[i])
        check = ((ends - starts) << 16 | data[starts].astype(np.int64) << 8 | data[ends - 1]).view(np.uint64)
        known, first, at = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        number = np.array([self.number.get(x, -1) for x in known.tolist()], np.int64)
        if len(new := np.flatnonzero(number < 0)):
            number[new] = add(first[new])
            self.number.update(zip(known[new].tolist(), number[new].tolist(), strict=True))
        which = number[at]
        if len(other := np.flatnonzero(self.check[which] != check)):  # another one with the same hash
            which[other] = add(other)
        size = self.size[which]
        ids = self.pool[ranges(self.begin[which], size)]
        texts = np.arange(len(offsets))
        to = np.append(0, np.cumsum(size))[np.searchsorted(starts, offsets)]
        out = np.full(len(ids) + len(offsets) - 1, END, np.uint16)
        out[np.arange(len(ids)) + np.repeat(texts[:-1], np.diff(to))] = ids
        return out, to + texts


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the parts of plain words, in lower case, and of other words; which are parts; and the bytes so far
    in lower case."""
    starts, ends = word_spans(data, offsets, BLANK)
    # the letters of Latin-1 are the byte C3 and one of 80 to BF, of which 97 and B7 are signs and 80 to 9E upper case
    second = np.append(False, data[:-1] == 0xC3) & (data >= 0x80) & (data < 0xC0) & (data != 0x97) & (data != 0xB7)
    letter = second | np.append(second[1:], False)
    plain = np.ones(len(starts), bool)
    plain[np.searchsorted(starts, np.flatnonzero(OTHER[data] & ~letter), "right") - 1] = False
    inside = ~BLANK[data]
    inside[ranges(starts[~plain], (ends - starts)[~plain])] = False
    kind = KIND[data]
    kind[letter] = 1
    begin = inside.copy()
    begin[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    begin[starts[plain]] = True
    last = inside.copy()
    last[:-1] &= ~inside[1:] | begin[1:]
    a, b = np.append(np.flatnonzero(begin), starts[~plain]), np.append(np.flatnonzero(last) + 1, ends[~plain])
    order = np.argsort(a, kind="stable")
    return a[order], b[order], order < len(a) - int((~plain).sum()), np.where(inside, np.where(second & (data < 0x9F), data + 32, LOWER[data]), data)


@functools.lru_cache(1)
def encoder_of(file: str) -> Encoder:
    """One encoder for all tasks of a Python worker, so that its caches last."""
    return Encoder(file)


def tokenized(docs: DataFrame, file: str) -> DataFrame:
    """(doc_id, n, ids, row): the ids, with the end id, as little-endian 16-bit bytes, and a pseudorandom number of the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = encoder_of(file), TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, last, data, offsets in slices(batch.column(1)):
                ids, at = encoder.encode(data, offsets)
                row = mixed(np.arange(seen, seen := seen + last - first, dtype=np.uint64)).view(np.int64)
                binary = pa.Array.from_buffers(pa.binary(), last - first, [None, pa.py_buffer((2 * at).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(np.diff(at)), binary, pa.array(row)], names=["doc_id", "n", "ids", "row"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, ids binary, row long")


def id_runs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row (exclusive), ids and lengths of runs of rows with about IDS ids."""
    if not len(column):
        return
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 2
    ids, first = np.frombuffer(column.buffers()[2], np.uint16), 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + IDS, "right")) - 1)
        yield first, last, ids[at[first] : at[last]], np.diff(at[first : last + 1])
        first = last


def row_values(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """row * 2^16 + value of the distinct values of each row, in order."""
    row = np.repeat(np.arange(len(size), dtype=np.uint32 if len(size) < 1 << 16 else np.int64), size)
    return distinct((row << 16) | values)


def document_frequencies(tokens: DataFrame) -> np.ndarray:
    """How many documents hold each id: one array of the vocabulary's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for _, _, ids, size in id_runs(batch.column(0)):
                df += np.bincount(row_values(ids, size) & 0xFFFF, minlength=1 << 16)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(df[held])], names=["id", "df"])

    df = np.zeros(1 << 16, np.int64)
    for i, n in tokens.select("ids").mapInArrow(run, "id long, df long").groupBy("id").agg(F.sum("df")).collect():
        df[i] = n
    return df


def affinity_ranks(df: np.ndarray) -> np.ndarray:
    """A rank for each id that two documents or more hold, 0 for the rarest; NO_RANK for the others."""
    rank, shared = np.full(1 << 16, NO_RANK, np.uint16), np.flatnonzero(df > 1)
    rank[shared[np.argsort(df[shared], kind="stable")]] = np.minimum(np.arange(len(shared)), NO_RANK)
    return rank


def affinity_keys(texts: pa.Array, row: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The three least ranks of each text's ids and 16 bits of the row's number as one signed number, in the order of all four."""
    digits = np.full((len(texts), 4), NO_RANK, np.uint64)
    for first, last, ids, size in id_runs(texts):
        found = row_values(rank[ids], size).astype(np.int64)
        start = np.searchsorted(found >> 16, np.arange(last - first + 1))
        for k in range(3):
            own = np.flatnonzero(start[:-1] + k < start[1:])
            digits[first + own, k] = found[start[own] + k] & 0xFFFF
    digits[:, 3] = row & 0xFFFF
    key = (digits << np.array([48, 32, 16, 0], np.uint64)).sum(axis=1, dtype=np.uint64)
    return (key ^ np.uint64(1 << 63)).view(np.int64)


def shard_starts(keys: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The least keys of shards of about size tokens, in order, from (key, n), and the shards' numbers. Where numbers are
    missing the keys before them hold more than a shard.

    Tokens are summed by the first 16 bits of the key, and by 16 more where a sum is above a quarter of a shard. Only
    the vocabulary's sums and a few numbers for each shard come to the driver.
    """
    sums = keys.groupBy(F.shiftright("key", 48).alias("part")).agg(F.sum("n").alias("n")).collect()
    part, n = np.array(sorted((r["part"], r["n"]) for r in sums), np.int64).reshape(-1, 2).T
    start = np.cumsum(n) - n
    least: dict[int, int] = {}
    for p, at in zip(part.tolist(), start.tolist(), strict=True):
        least.setdefault(at // size, p << 48)
    above = [(p, at) for p, at, k in zip(part.tolist(), start.tolist(), n.tolist(), strict=True) if 4 * k > size]
    for bits in (32, 16, 0):
        if not above:
            break
        parents = F.broadcast(keys.sparkSession.createDataFrame(above, "parent long, base long"))
        rows = keys.select(F.shiftright("key", bits).alias("part"), F.shiftright("key", bits + 16).alias("parent"), "n")
        rows = rows.join(parents, "parent").groupBy("parent", "base", "part").agg(F.sum("n").alias("n"))
        before = F.sum("n").over(W.partitionBy("parent").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
        level = written(rows.select("part", "n", (F.col("base") + F.coalesce(before, F.lit(0))).alias("start")), "packing-level")
        for r in level.groupBy(F.floor(F.col("start") / size).alias("shard")).agg(F.min("part").alias("part")).collect():
            least[r["shard"]] = min(r["part"] << bits, least.get(r["shard"], r["part"] << bits))
        above = [(r["part"], r["start"]) for r in level.where(4 * F.col("n") > size).select("part", "start").collect()]
        dropped(level)
    numbers = np.array(sorted(least), np.int64)
    return np.array([least[x] for x in numbers.tolist()], np.int64), numbers


def dealt(tokens: DataFrame, df: np.ndarray, total: int) -> DataFrame:
    """The tokens with the number of their shard."""
    ranks = tokens.sparkSession.sparkContext.broadcast(affinity_ranks(df))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = affinity_keys(batch.column(1), batch.column(2).to_numpy(), ranks.value)
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0)], names=["key", "n"])

    keys = written(tokens.select("n", "ids", "row").mapInArrow(keyed, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "packing-keys")
    starts, numbers = shard_starts(keys, SHARD_TOKENS)
    dropped(keys)
    held = np.diff(np.append(numbers, max(-(-total // SHARD_TOKENS), *numbers + 1) if len(numbers) else []))
    shared = tokens.sparkSession.sparkContext.broadcast((starts, numbers, held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, numbers, held = shared.value
        for batch in batches:
            row = batch.column(3).to_numpy()
            at = np.searchsorted(starts, affinity_keys(batch.column(2), row, ranks.value), "right") - 1
            shard = numbers[at] + (row.view(np.uint64) >> np.uint64(16)).astype(np.int64) % held[at]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard, pa.int64())], names=["doc_id", "n", "ids", "row", "shard"])

    return tokens.select("doc_id", "n", "ids", "row").mapInArrow(run, "doc_id long, n long, ids binary, row long, shard long")


class Index:
    """BM25 over a shard's documents."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        self.n, size = len(docs), np.array([len(d) for d in docs])
        every = np.sort(np.repeat(np.arange(self.n), size) << 16 | np.concatenate(docs).astype(np.int64))
        first = np.flatnonzero(np.append(True, np.diff(every) != 0))
        found, tf = every[first], np.diff(np.append(first, len(every)))
        doc, self.term = found >> 16, found & 0xFFFF
        self.of = np.searchsorted(doc, np.arange(self.n + 1))
        weight = idf[self.term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / mean))
        order = np.argsort(self.term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.starts = np.searchsorted(self.term[order], np.arange((1 << 16) + 1))
        self.size = np.diff(self.starts)
        common = np.flatnonzero(self.size > COMMON * self.n)
        self.row, self.rows = np.full(1 << 16, -1), np.zeros((len(common), self.n))
        self.row[common] = np.arange(len(common))
        for k, t in enumerate(common.tolist()):
            span = slice(self.starts[t], self.starts[t + 1])
            self.rows[k, self.doc[span]] = self.weight[span]

    def neighbours(self, seed: int) -> np.ndarray:
        """Documents by falling score for the seed's terms."""
        terms = self.term[self.of[seed] : self.of[seed + 1]]
        row = self.row[terms]
        scores, rare = self.rows[row[row >= 0]].sum(axis=0), terms[row < 0]
        at = ranges(self.starts[rare], self.size[rare])
        scores += np.bincount(self.doc[at], self.weight[at], self.n)
        return np.argsort(-scores, kind="stable")


def windows(docs: list[np.ndarray], index: Index) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (document, start, length) that fill windows, the last one perhaps in part."""
    unused, first, rest = np.ones(len(docs), bool), 0, None
    while True:
        if rest is None:
            while first < len(docs) and not unused[first]:
                first += 1
            if first == len(docs):
                return
            rest, unused[first] = (first, 0), False
        seed, room, window, ranked = rest[0], WINDOW, [], None
        while room and rest is not None:
            d, start = rest
            length = min(room, len(docs[d]) - start)
            window.append((d, start, length))
            room -= length
            rest = (d, start + length) if start + length < len(docs[d]) else None
            if room:
                if ranked is None:
                    ranked = iter(index.neighbours(seed).tolist())
                found = next((x for x in ranked if unused[x]), None)
                if found is not None:
                    rest, unused[found] = (found, 0), False
        yield window


def sequences(window: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """The window, or, if it is short, sequences with powers of two as lengths."""
    total = sum(n for _, _, n in window)
    if total == WINDOW:
        yield window
        return
    pieces = list(window)
    while total:
        room, out = 1 << (total.bit_length() - 1), []
        total -= room
        while room:
            d, start, n = pieces.pop(0)
            out.append((d, start, min(n, room)))
            if n > room:
                pieces.insert(0, (d, start + room, n - room))
            room -= out[-1][2]
        yield out


def pack(docs: DataFrame, file: str | None = None) -> DataFrame:
    """One row for each piece: see PIECES. sequence_id is the shard's number times 2^32 plus a count."""
    if file is None:
        import public_tokenizers

        file = public_tokenizers.path("word_bpe_49k.json")
    tokens = written(tokenized(docs, file), "packing-tokens")
    count, total = tokens.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = document_frequencies(tokens)
    idf = np.log1p((count - df + 0.5) / (df + 0.5)).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((idf, total / max(count, 1)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("row", "ascending")])
        ids = [np.frombuffer(x.as_buffer(), np.uint16) for x in table.column("ids")]
        doc_id, shard = table.column("doc_id").to_pylist(), table.column("shard")[0].as_py()
        rows, k = [], 0
        for window in windows(ids, Index(ids, *shared.value)):
            for sequence in sequences(window):
                at = 0
                for d, start, n in sequence:
                    rows.append((doc_id[d], start, n, zlib.crc32(ids[d][start : start + n].astype("<u4").tobytes()), len(ids[d]), (shard << 32) + k, at))
                    at += n
                k += 1
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return dealt(tokens, df, total).groupBy("shard").applyInArrow(run, PIECES)
