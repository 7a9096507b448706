"""Personal data by weak supervision, in DataFrame functions only.

Four base kinds (email, ip, card, phone) are exact patterns with checks; their spans always stay. Further candidates are
long runs of key characters (``secret``) and number groups that no base span covers (``number``). Four labelers vote on
each candidate, 1 for, 0 against, 2 for no opinion: a pattern, a gazetteer of words in four languages among those before
it, the punctuation around it, and its make-up of digits and letters. Beside the votes a candidate has features of its own,
which no labeler looks at in this form: its length, the kinds of its characters, how many of them are distinct, its
separators, and hashes of the word before it and of its first two characters' shape.

The texts are matched once; each document's spans and its candidates with votes and features are written, without texts.
The candidates are aggregated to the counts of each combination of votes and features (all of them classes, so at most
2 * 3^4 * 4 * 4 * 4 * 3 * 16 combinations). On those counts expectation-maximisation estimates how reliable each labeler is
for each kind (Dawid and Skene's model), and its posteriors train a logistic classifier over the features alone, which
decides on the spans. Its weights go back into the query as literals.

A text is matched where it lies, without a shuffle. The patterns are written so that a match needs no nested repetition:
Java's engine recurses on those, and long runs of digits would overflow its stack. Places come from the lengths of the
pieces between matches, in code points.

Defined results: null and empty texts have no spans; repeated rows and rows with a null or repeated id give results of
their own; an empty table trains nothing and adds nothing; other columns are ignored; texts of any length are matched whole.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitfold.llm.common import logistic, written

# A match can only begin where a run of its first characters begins, or where the match before it ended (\G). Starting
# nowhere else changes no match and keeps long runs linear.
LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{LOCAL})|\G){LOCAL}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
# In a text whose separators that don't stand between two digits are masked, a card is digits and separators.
LOOSE_SEPARATOR = r"(?<![0-9])[\x20-]|[\x20-](?![0-9])"
CARD = r"[0-9][\x20\-0-9]*[0-9]"
MASK = "x"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"^0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})$"
KINDS = ["email", "ip", "card", "phone", "secret", "number"]

SECRET = r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{16,}={0,2}"
NUMBER = r"\+?[0-9(][0-9().\x20/-]{5,}[0-9]"
#: Words that stand before personal data, and words that stand before other numbers and keys.
GAZETTEER = (
    "token secret password passwd pwd apikey key auth bearer credential credentials login phone telephone tel call fax mobile cell card visa mastercard account iban ssn passport "
    "passwort kennwort schlüssel telefon handy konto karte ausweis mot passe clé téléphone portable compte carte clave contraseña teléfono móvil cuenta tarjeta pasaporte"
).split()
NEUTRAL = (
    "version isbn issn page order invoice copyright id uuid sha commit http https www doi build release seite bestellung rechnung fassung commande facture página pedido factura versión"
).split()
CONTEXT = 40
LABELERS, HASHES = 4, 16
FEATURES = {"size": 4, "shape": 4, "variety": 4, "separators": 3, "before": HASHES}


def spans(text: Column, pattern: str, kind: str) -> Column:
    """array<struct<start, rank, end, match>> of the non-overlapping matches, leftmost first."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,match:string>>)")
    gaps = F.split(text, pattern, -1)

    def place(m: Column, g: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.char_length(F.get(g, i))
            end = start + F.char_length(F.get(m, i))
            one = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), F.get(m, i).alias("match"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(m) - 1), F.struct(F.lit(0).alias("at"), empty.alias("out")), step)["out"]

    placed = F.element_at(F.transform(F.array(F.struct(matches.alias("m"), gaps.alias("g"))), lambda x: place(x["m"], x["g"])), 1)
    return F.when(text.rlike(pattern), placed).otherwise(empty)


def luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:  # i counts from the right, from 0
        d = F.substring(digits, F.char_length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d < 5, 2 * d).otherwise(2 * d - 9))

    total = F.aggregate(F.sequence(F.lit(0), F.char_length(digits) - 1), F.lit(0), lambda n, i: n + value(i))
    return F.when(F.char_length(digits).between(12, 19), total % 10 == 0).otherwise(False)


def base_spans(text: Column) -> Column:
    """The base kinds' spans by start, then kind."""
    email = F.when(F.contains(text, F.lit("@")), spans(text, EMAIL, "email"))
    ip = F.filter(spans(text, IP, "ip"), lambda s: F.forall(F.split(s["match"], r"\."), lambda p: p.rlike(BYTE)))
    masked = F.regexp_replace(text, LOOSE_SEPARATOR, MASK)
    card = F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), F.filter(spans(masked, CARD, "card"), lambda s: luhn(F.translate(s["match"], " -", ""))))
    phone = F.filter(spans(text, PHONE, "phone"), lambda s: F.char_length(F.regexp_replace(s["match"], "[^0-9]", "")).between(9, 15))
    none = F.expr("cast(array() as array<struct<start:int,rank:int,end:int,match:string>>)")
    return F.array_sort(F.concat(*[F.coalesce(x, none) for x in (email, ip, card, phone)]))


def candidates(text: Column, base: Column) -> Column:
    """Candidate spans that no base span covers, even in part."""
    secret = F.filter(spans(text, SECRET, "secret"), lambda s: s["match"].rlike("[0-9]") & s["match"].rlike("[A-Za-z]"))
    number = F.filter(spans(text, NUMBER, "number"), lambda s: F.char_length(F.regexp_replace(s["match"], "[^0-9]", "")) >= 7)
    clear = lambda s, others: ~F.exists(others, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return F.filter(F.concat(secret, number), lambda s: clear(s, base))


def voted(text: Column, found: Column) -> Column:
    """Each candidate with its votes v0..v3 and its features."""

    def vote(s: Column) -> Column:
        m = s["match"]
        secret = s["rank"] == KINDS.index("secret")
        before = F.substring(text, F.greatest(F.lit(1), s["start"] + 1 - CONTEXT), F.least(s["start"], F.lit(CONTEXT)))
        after = F.substring(text, s["end"] + 1, F.lit(1))
        digits = F.char_length(F.regexp_replace(m, "[^0-9]", ""))
        yes, no, none = F.lit(1), F.lit(0), F.lit(2)
        pattern = F.when(secret, F.when(m.rlike(r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|[A-Za-z0-9+/]{32,}={0,2})$"), yes).otherwise(no))
        pattern = pattern.otherwise(F.when(m.rlike(r"^\+|^\([0-9]{2,4}\)|^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^(?:[0-9]{4}[\x20-]?){3,4}[0-9]{0,4}$"), yes).otherwise(none))
        near = F.split(F.lower(before), r"[^\p{L}]+")
        named = lambda words: F.arrays_overlap(near, F.array(*[F.lit(w) for w in words]))
        cue = F.when(named(GAZETTEER), yes).when(named(NEUTRAL), no).otherwise(none)
        around = F.when(before.rlike(r"[=:]\x20?[\"']?$"), yes).when(after.isin('"', "'"), yes).when(before.rlike(r"[\p{L}/]$"), no).otherwise(none)
        share = digits / F.char_length(m)
        made = F.when(secret, F.when(share.between(0.25, 0.9), yes).otherwise(no)).otherwise(F.when(digits.between(9, 19), yes).otherwise(no))
        size = F.least(F.lit(3), F.floor(F.char_length(m) / 12))
        shape = F.when(~m.rlike(r"[A-Za-z]"), 0).when(~m.rlike("[A-Z]"), 1).when(~m.rlike("[a-z]"), 2).otherwise(3)
        variety = F.least(F.lit(3), F.floor(4 * F.size(F.array_distinct(F.split(m, ""))) / F.least(F.char_length(m), F.lit(24))))
        separators = F.least(F.lit(2), F.char_length(F.regexp_replace(m, "[A-Za-z0-9]", "")))
        word = F.regexp_extract(F.lower(before), r"([\p{L}]+)[^\p{L}]*$", 1)
        features = [F.coalesce(x, F.lit(0)).cast("int").alias(k) for k, x in zip(FEATURES, (size, shape, variety, separators, F.pmod(F.xxhash64(word), F.lit(HASHES))), strict=True)]
        return F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), pattern.alias("v0"), cue.alias("v1"), around.alias("v2"), made.alias("v3"), *features)

    return F.transform(found, vote)


VOTES = [f"v{i}" for i in range(LABELERS)]


def reliabilities(rows: list[tuple[tuple[int, ...], float]], rounds: int = 60) -> tuple[float, np.ndarray]:
    """EM on (votes, count): the share of true candidates and P(vote | truth) as [labeler, truth, vote]."""
    votes, n = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    right = ((votes == 1).sum(1) + 0.5) / ((votes < 2).sum(1) + 1)
    for _ in range(rounds):
        prior = float((right * n).sum() + 1) / (n.sum() + 2)
        table = np.ones((votes.shape[1], 2, 3))
        for k in range(votes.shape[1]):
            for v in range(3):
                hit = votes[:, k] == v
                table[k, 1, v] += (right * n)[hit].sum()
                table[k, 0, v] += ((1 - right) * n)[hit].sum()
        table /= table.sum(2, keepdims=True)
        right = posterior(votes, prior, table)
    return prior, table


def posterior(votes: np.ndarray, prior: float, table: np.ndarray) -> np.ndarray:
    log = [math.log(1 - prior), math.log(prior)]
    odds = log[1] - log[0] + sum(np.log(table[k, 1, votes[:, k]]) - np.log(table[k, 0, votes[:, k]]) for k in range(votes.shape[1]))
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def encoded(features: np.ndarray) -> np.ndarray:
    """A column for each value of each feature but the first."""
    return np.column_stack([(features[:, k] == v).astype(float) for k, n in enumerate(FEATURES.values()) for v in range(1, n)])


def train(counts: list[tuple]) -> dict[int, tuple[float, list[list[float]]]]:
    """Per kind: intercept and a weight for each value of each feature, from (rank, v0..v3, features, n)."""
    models = {}
    for rank in sorted({r[0] for r in counts}):
        own = np.array([r[1:] for r in counts if r[0] == rank], np.int64)
        votes, features, n = own[:, :LABELERS], own[:, LABELERS:-1], own[:, -1].astype(float)
        prior, table = reliabilities([(tuple(v), c) for v, c in zip(votes.tolist(), n, strict=True)])
        b = logistic(encoded(features), posterior(votes, prior, table), n, ridge=1.0)
        weights, at = [], 1
        for size in FEATURES.values():
            weights.append([0.0, *b[at : at + size - 1].tolist()])
            at += size - 1
        models[rank] = (float(b[0]), weights)
    return models


def accepted(s: Column, models: dict) -> Column:
    """Whether the trained classifier takes a candidate."""
    out = F.lit(False)
    for rank, (b, weights) in models.items():
        z = F.lit(b)
        for name, by_value in zip(FEATURES, weights, strict=True):
            z = z + F.get(F.array(*[F.lit(x) for x in by_value]), s[name])
        out = F.when(s["rank"] == rank, z >= 0).otherwise(out)
    return out


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, base and added: arrays of struct(start, rank, end)."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    based = text.select("doc_id", "t", base_spans(F.col("t")).alias("base"))
    plain = lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))
    each = based.select("doc_id", "t", "base", candidates(F.col("t"), F.col("base")).alias("c"))
    found = written(each.select("doc_id", F.transform("base", plain).alias("base"), voted(F.col("t"), F.col("c")).alias("voted")), "pii-candidates")
    counts = found.select(F.explode("voted").alias("s")).select("s.rank", *[f"s.{v}" for v in VOTES], *[f"s.{f}" for f in FEATURES]).groupBy("rank", *VOTES, *FEATURES).count()
    models = train([tuple(r) for r in counts.collect()])
    return found.select("doc_id", "base", F.transform(F.filter("voted", lambda s: accepted(s, models)), plain).alias("added"))


def joined(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_counts() -> list[Column]:
    """n_email, n_ip, n_card, n_phone and base_sha256 from the column base."""
    number = lambda k: F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return [*[number(k) for k in KINDS[:4]], F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256")]


def base_summary(docs: DataFrame) -> DataFrame:
    """The base kinds alone."""
    found = docs.select("doc_id", base_spans(F.coalesce("text", F.lit(""))).alias("base"))
    return found.select("doc_id", *base_counts())


def summary(docs: DataFrame) -> DataFrame:
    found = detect(docs)
    added = lambda k: F.size(F.filter("added", lambda s: s["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    every = F.size("base") + F.size("added")
    return found.select("doc_id", *base_counts(), joined(F.concat("base", "added")).alias("spans"), *[added(k) for k in KINDS[4:]], every.cast("long").alias("n_found"))
