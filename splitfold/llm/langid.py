"""Language identification by prediction by partial matching (PPM).

For each language, counts of bytes after contexts of three, two, one and no bytes are taken from a bounded sample of
labelled documents and then frozen. A document's code length in a language is the sum over all its bytes of
-log2 p(byte | longest context seen in that language), where a byte that the context has not seen pays the escape
probability d / (n + d) (n occurrences, d distinct bytes: method C) and goes on to the next shorter context; below
order 0 all 256 bytes are equally likely. The shortest code wins.

The frozen trees of all languages are laid over each other: ``second`` takes the last two bytes to a node, ``third``
takes a node and the byte before to a deeper node, and ``bits`` has the exact code length of each byte class at each
node, one column for each language. Scoring a text is three array lookups a byte, whatever its length.

Contexts of three bytes that the sample has fewer than ``deep_min`` times in all languages together are left to those of
two, which bounds the tables; code lengths are exact under the counts that are kept.

Defined results: null text, empty text and text without a letter (Unicode category L) give ``und`` with score 0; repeated rows give
repeated results, and so do repeated or null ids; an empty training set gives ``und`` everywhere; ties go to the first language by code point; columns
other than the id, the text and the label are ignored. Long texts are scored whole, in slices that overlap by a context.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitfold.llm.common import bounded_sample, fold

LETTER = regex.compile(r"\p{L}")
PAD = b"\0\0\0"
SLICE = 1 << 20


@dataclass
class Trees:
    """Frozen context trees of all languages; see the module's text."""

    languages: list[str]
    classes: np.ndarray  # uint8[256]: byte -> class
    second: np.ndarray  # int32[classes * classes]: last byte, byte before it -> node
    third: np.ndarray  # int32[nodes of order <= 2, classes]: node, third last byte -> node
    bits: np.ndarray  # float32[nodes, classes, languages]

    def code_lengths(self, data: bytes) -> np.ndarray:
        """Bits of the whole text in each language."""
        total, width = np.zeros(len(self.languages)), self.third.shape[1]
        for at in range(0, len(data), SLICE):
            before = (PAD + data[max(0, at - 3) : at])[-3:]
            x = self.classes[np.frombuffer(before + data[at : at + SLICE], np.uint8)].astype(np.int32)
            node = self.second[x[2:-1] * width + x[1:-2]]
            node = self.third.ravel()[node * width + x[:-3]]
            total += self.bits.reshape(-1, len(self.languages))[node * width + x[3:]].sum(axis=0, dtype=np.float64)
        return total


def as_bytes(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def gram_counts(sample: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n): how often each run of four bytes occurs, texts padded with three zero bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for t, one in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if t:
                    by_lang.setdefault(one, []).append(as_bytes(t))
            for one, texts in by_lang.items():
                parts = []
                for t in texts:
                    x = np.frombuffer(PAD + t, np.uint8).astype(np.int64)
                    parts.append(x[:-3] << 24 | x[1:-2] << 16 | x[2:-1] << 8 | x[3:])
                grams, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([one] * len(grams)), pa.array(grams), pa.array(n)], names=["lang", "gram", "n"])

    return sample.select(text, lang).mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def build_trees(counts: list[tuple[str, int, int]], deep_min: int = 4) -> Trees | None:
    """Trees from (lang, gram, n). Contexts of three bytes seen fewer than deep_min times in all are left to shorter ones."""
    languages = sorted({c[0] for c in counts})
    if not languages:
        return None
    seen = np.unique([b for _, g, _ in counts for b in (g >> 24, g >> 16 & 255, g >> 8 & 255, g & 255)])
    if len(seen) == 256:
        classes, width = np.arange(256, dtype=np.uint8), 256
    else:  # all bytes never seen share the last class; each costs what one of them costs
        classes, width = np.full(256, len(seen), np.uint8), len(seen) + 1
        classes[seen] = np.arange(len(seen))
    lang = np.array([languages.index(c[0]) for c in counts])
    gram = np.array([c[1] for c in counts], np.int64)
    n = np.array([c[2] for c in counts], np.float64)
    x3, x2, x1, x0 = (classes[(gram >> s) & 255].astype(np.int64) for s in (24, 16, 8, 0))

    pairs = np.unique(x1 * width + x2)
    second = np.repeat(np.arange(width, dtype=np.int32), width)
    second[pairs] = width + np.arange(len(pairs), dtype=np.int32)
    shallow = width + len(pairs)
    triple = (second[x1 * width + x2].astype(np.int64)) * width + x3
    keys, inverse = np.unique(triple, return_inverse=True)
    keys = keys[np.bincount(inverse, weights=n) >= deep_min]
    third = np.repeat(np.arange(shallow, dtype=np.int32), width)
    third[keys] = shallow + np.arange(len(keys), dtype=np.int32)
    nodes = shallow + len(keys)

    def coded(context: np.ndarray, size: int, which: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """Probabilities [size, width] of order k from the counts there and the probabilities of order k - 1 at each node."""
        c = np.bincount(context[which] * width + x0[which], weights=n[which], minlength=size * width).reshape(size, width)
        total, distinct = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
        own = c / np.maximum(total + distinct, 1)
        escape = np.where(total > 0, distinct / np.maximum(total + distinct, 1), 1.0)
        return np.where(c > 0, own, escape * parent)

    bits = np.empty((nodes, width, len(languages)), np.float32)
    deep = np.searchsorted(keys, triple)
    deep_ok = (deep < len(keys)) & (keys[np.minimum(deep, max(len(keys) - 1, 0))] == triple) if len(keys) else np.zeros(len(triple), bool)
    for k in range(len(languages)):
        own = lang == k
        zero = coded(np.zeros_like(x0), 1, own, np.full((1, width), 1 / 256))
        one = coded(x1, width, own, zero)
        two = coded(np.searchsorted(pairs, x1 * width + x2), len(pairs), own, one[pairs // width])
        both = np.vstack([one, two])
        three = coded(deep, len(keys), own & deep_ok, both[keys // width]) if len(keys) else both[:0]
        bits[:, :, k] = -np.log2(np.vstack([both, three]))
    return Trees(languages, classes, second, third.reshape(shallow, width), bits)


def fit(docs: DataFrame, per_lang: int = 300) -> Trees | None:
    """Trees from about per_lang whole documents of each language, none of them held out."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 0)).select("doc_id", "text", "lang")
    return build_trees([tuple(r) for r in gram_counts(bounded_sample(rows, "doc_id", "lang", per_lang), "text", "lang").collect()])


def identify(docs: DataFrame, trees: Trees | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with lang_pred, score and bits_per_byte, in one pass that shuffles nothing.

    score is the posterior probability of the language found, all languages being equally likely before.
    """
    model = docs.sparkSession.sparkContext.broadcast(trees)
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = model.value
        for batch in batches:
            names, scores, rates = [], [], []
            for text in batch.column(len(keep)).to_pylist():
                if t is None or not text or not LETTER.search(text):
                    names.append("und"), scores.append(0.0), rates.append(None)
                    continue
                data = as_bytes(text)
                bits = t.code_lengths(data)
                best = int(bits.argmin())
                names.append(t.languages[best])
                scores.append(float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum()))
                rates.append(float(bits[best] / len(data)))
            new = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + new, names=schema.names)

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(score, schema)


def accepted(docs: DataFrame, trees: Trees | None, max_bits_per_byte: float = 6.0) -> DataFrame:
    """The documents, all columns as they are, that are in one of the languages: a language was found, and its code
    takes at most max_bits_per_byte, which running text never needs and text of no known language exceeds."""
    found = identify(docs.select(F.struct(*docs.columns).alias("__row"), "text"), trees, ["__row"])
    return found.where((F.col("lang_pred") != "und") & (F.col("bits_per_byte") <= max_bits_per_byte)).select("__row.*")
