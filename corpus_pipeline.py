"""A training corpus from raw documents in five stages; each works on all that the one before it kept.

language_id  documents in no language that the corpus has (or without a letter) go
line_dedup   lines that are near copies of an earlier line go, and documents that had words and keep none
minhash      of near-duplicate documents (five-word shingles, similarity 0.8) the one with the least id stays
mixing       texts become the words that the mix to target weights takes of them
packing      pieces of the documents in windows of 4096 tokens

Every stage but the last returns the columns of documents. Stages are written as Parquet to the shared folder and read
again, so a lost executor costs tasks of one stage at most; a table goes when the next stage is written.

Defined results: null, empty and blank texts have no letter, so they go with the language; a document without a language
label is judged like others; rows with a null or repeated id are documents of their own, and of rows that repeat an id and
a text one stays after minhash; ties are broken by the least id; long texts are used whole; an empty table gives an empty
result of each stage; further columns, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from splitfold.llm import langid, linededup, minhash, mixing, packing
from splitfold.llm.common import documents, dropped, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs, langid.fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.deduplicated(docs)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("minhash_dedup", minhash_dedup), ("mixing", mix), ("packing", pack)]

#: Byte models, hashes and retrieval can't be said in SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
