"""Toxicity by maximum-scoring segment search.

A word's score is its log odds of standing in toxic against other documents (document frequencies under a Dirichlet
prior with the pooled frequencies as its mean), drawn towards 0 by Z standard errors, less DRIFT, so that running
text scores below 0. Every word that the sample holds has its own log odds, above or below 0; for rare ones Z standard
errors leave nothing of them, as for words that the sample doesn't hold. In a document the Ruzzo-Tompa scan finds every
maximal-scoring segment in one pass. A segment's score S among n words has the extreme-value calibration
E = K n exp(-lambda S), with lambda the positive root of E[exp(lambda s)] = 1 over the words s of documents of label 0, and
K the maximum-likelihood value over those documents. A segment is significant if E < 1; it then holds ln(1 / E) nats. A
document's probability is a logistic function of its strongest segment's nats and of the sum over all its significant
segments.

Everything is fitted on about ``per_class`` whole labelled documents of each class that are not held out (a bounded
sample; the classes' true counts weigh it), and frozen.

Defined results: null and empty texts and texts without a word have no segment and get the score of such documents;
without two classes to learn from every score is 0; repeated rows and rows with null or repeated ids give repeated
results; columns other than the id and the text are ignored. Long texts are scanned whole: the scan's state goes on from
one slice to the next.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from splitfold.llm.common import bounded_sample, fold, logistic

#: The same rule twice: letters, and numbers that aren't decimal digits.
WORD, JVM_WORD = re.compile(r"[^\W\d_]+"), r"([\p{L}\p{Nl}\p{No}]+)"
Z, DRIFT, PRIOR = 1.64, 1.0, 50.0
SLICE = 1 << 20


def segment_type(value: str) -> ArrayType:
    return ArrayType(StructType().add("start", "integer").add("end", "integer").add(value, "double"))


def slices(text: str) -> Iterator[tuple[int, str]]:
    """The text in slices of about SLICE characters that cut no word in two."""
    at = 0
    while at < len(text):
        end = min(len(text), at + SLICE)
        while end < len(text) and WORD.match(text, end) and WORD.match(text, end - 1):
            end += 1
        yield at, text[at:end]
        at = end


class Segments:
    """Ruzzo-Tompa: the maximal-scoring segments of a sequence whose positive scores arrive in order.

    Of each segment it keeps the total before it and at its end, and its first and last position.
    """

    def __init__(self) -> None:
        self.found: list[tuple[float, float, int, int]] = []

    def add(self, before: float, after: float, first: int, last: int) -> None:
        found = self.found
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= before:
                j -= 1
            if j < 0 or found[j][1] >= after:
                found.append((before, after, first, last))
                return
            before, first = found[j][0], found[j][2]
            del found[j:]


def segments(text: str | None, scores: dict[str, float], other: float) -> tuple[int, list[tuple[int, int, float]]]:
    """Words in the text, and (start, end, score) in characters of every maximal-scoring segment."""
    n, total, scan = 0, 0.0, Segments()
    for base, part in slices(text or ""):
        low = part.lower()
        if len(low) != len(part):  # some letters have a longer lower case; positions have to stay
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in part)
        words = WORD.findall(low)
        s = np.fromiter(map(scores.get, words, repeat(other)), np.float64, len(words))
        hits = np.flatnonzero(s > 0)
        if len(hits):
            sums = np.cumsum(s) + total
            spans = [m.span() for m in WORD.finditer(low)]
            for i in hits.tolist():
                scan.add(float(sums[i] - s[i]), float(sums[i]), base + spans[i][0], base + spans[i][1])
        n, total = n + len(words), total + float(s.sum())
    return n, [(a, b, after - before) for before, after, a, b in scan.found]


def nats(n: int, found: list[tuple[int, int, float]], calibration: tuple[float, float]) -> list[tuple[int, int, float]]:
    """The significant segments with ln(1 / E)."""
    lam, k = calibration
    shift = math.log(k * max(n, 1))
    return [(a, b, lam * s - shift) for a, b, s in found if lam * s > shift]


def word_scores(sample: DataFrame) -> tuple[dict[str, float], dict[float, int]]:
    """Scores of the words whose log odds are surely not 0, every other word having -DRIFT; and how many words of the documents
    of label 0 have each score."""
    rows = sample.withColumn("row", F.monotonically_increasing_id())  # before the words are rows of their own
    words = rows.select("label", "row", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(JVM_WORD), 1)).alias("word"))
    each = words.groupBy("row", "label", "word").count()
    counts = each.groupBy("word").agg(F.sum("label").alias("one"), F.sum(1 - F.col("label")).alias("zero"), F.sum((1 - F.col("label")) * F.col("count")).alias("seen"))
    docs = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    n1, n0 = docs.get(1, 0), docs.get(0, 0)
    prior = PRIOR * (F.col("one") + F.col("zero") + 1) / (n1 + n0 + 2)
    odds = counts.withColumns({"y1": F.col("one") + prior, "y0": F.col("zero") + prior})
    delta = F.log(F.col("y1") / (n1 + PRIOR - F.col("y1") + 1)) - F.log(F.col("y0") / (n0 + PRIOR - F.col("y0") + 1))
    sure = F.abs("delta") - Z * F.sqrt(1 / F.col("y1") + 1 / F.col("y0"))
    scored = odds.withColumn("delta", delta).withColumn("score", F.signum("delta") * F.greatest(sure, F.lit(0.0)) - DRIFT)
    scores: dict[str, float] = {}
    of_score: dict[float, int] = {}
    for word, score, seen in scored.where(F.col("score") != -DRIFT).select("word", "score", "seen").collect():
        scores[word] = score
        of_score[score] = of_score.get(score, 0) + seen
    of_score[-DRIFT] = of_score.get(-DRIFT, 0) + (scored.where(F.col("score") == -DRIFT).agg(F.sum("seen")).first()[0] or 0)
    return scores, of_score


def decay(of_score: dict[float, int]) -> float:
    """lambda: the positive root of E[exp(lambda s)] = 1 over scores and their counts."""
    s, n = np.array(list(of_score)), np.array(list(of_score.values()), float)
    low, high = 1e-3, 5.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (n * np.expm1(np.minimum(mid * s, 50))).sum() < 0 else (low, mid)
    return low


def scan(docs: DataFrame, keep: list[str], scores: dict[str, float]) -> DataFrame:
    """keep, n (words) and all maximal-scoring segments (start, end, score) of each document."""
    model = docs.sparkSession.sparkContext.broadcast(scores)
    schema = docs.select(*keep).schema.add("n", "long").add("found", segment_type("score"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [segments(t, model.value, -DRIFT) for t in batch.column(len(keep)).to_pylist()]
            new = [pa.array([r[0] for r in rows], pa.int64()), pa.array([[{"start": a, "end": b, "score": s} for a, b, s in r[1]] for r in rows], kind)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + new, names=schema.names)

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000) -> dict | None:
    """Word scores, calibration and weights; None if the training rows hold fewer than two classes."""
    known = labels.where(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return None
    # the sample's ids are about 2 * per_class at most, so they can go to every task instead of all texts to the labels
    chosen = F.broadcast(bounded_sample(known, "doc_id", "label", per_class))
    sample = docs.select("doc_id", "text").join(chosen, "doc_id").select("label", "text").cache()
    scores, of_score = word_scores(sample)
    seen = [(r[0], r[1], [(x[0], x[1], x[2]) for x in r[2]]) for r in scan(sample, ["label"], scores).collect()]
    sample.unpersist()
    clean = [(n, [s for _, _, s in f]) for y, n, f in seen if y == 0 and n]
    lam = decay(of_score)
    calibration = (lam, max(len(clean), 1) / max(sum(n * math.exp(-lam * max(f, default=0)) for n, f in clean), 1e-9))
    x = np.array([features(nats(n, f, calibration)) for _, n, f in seen])
    y = np.array([r[0] for r in seen], float)
    taken = {k: max((y == k).sum(), 1) for k in (0, 1)}
    weights = logistic(x, y, np.where(y == 1, counts[1] / taken[1], counts[0] / taken[0]))
    return {"scores": scores, "calibration": calibration, "weights": weights.tolist()}


def features(found: list[tuple[int, int, float]]) -> tuple[float, float]:
    return math.log1p(max((s for _, _, s in found), default=0.0)), math.log1p(sum(s for _, _, s in found))


def score(docs: DataFrame, model: dict | None, keep: list[str]) -> DataFrame:
    """keep, score, and every significant passage; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add("score", "double").add("passages", segment_type("nats"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("nats", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            scores, passages = [], []
            for text in batch.column(len(keep)).to_pylist():
                if m is None:
                    scores.append(0.0), passages.append([])
                    continue
                found = nats(*segments(text, m["scores"], -DRIFT), m["calibration"])
                most, total = features(found)
                b = m["weights"]
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, b[0] + b[1] * most + b[2] * total)))))
                passages.append([{"start": a, "end": e, "nats": s} for a, e, s in found])
            new = [pa.array(scores, pa.float64()), pa.array(passages, kind)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + new, names=schema.names)

    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)
