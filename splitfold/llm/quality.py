"""Quality rules with cross-document line frequency, in DataFrame functions only.

Per text: words, their characters, symbols, repeated lines, and words in repeated windows of eight. Across texts: every
line with a word is normalised (lower case, digits to 0, other runs than letters and digits to a space) and hashed; for
each host (``source``) the distinct documents that hold it are counted; lines in more than ``max_docs`` documents of
a host are removed there; a document that keeps less than ``min_kept`` of its words is rejected as depleted.

The count is a partial aggregation on (host, line hash), so a line that every document has arrives as one row of each
task. Counts go back to the documents by a join on the same two columns that splits large partitions; only lines above
the limit take part in it.

Defined results: a null text has no words and fails the base rules; a text with no line to compare keeps everything;
null hosts form one host; rows that repeat an id are one document, depleted or not by all its lines; columns with
clashing names are ignored. Windows are compared by a 64-bit hash of 64-bit word hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitfold.llm.common import NON_SPACE_CLASS, SPACE_CLASS, written

SYMBOLS = "#*$%&|<>"
WINDOW = 8


def let(value: Column, body) -> Column:
    """body(value), with value computed once: a lambda's argument isn't computed again where the lambda uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE_CLASS}+"), "")


def repeated_window_words(all_words: Column) -> Column:
    """How many words stand in a window of eight that the text holds twice or more."""

    def covered(starts: Column) -> Column:  # starts of such windows, ascending
        step = F.aggregate(
            starts,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
            lambda acc, s: F.struct((acc["n"] + F.least(F.lit(WINDOW), s - acc["last"])).alias("n"), s.alias("last")),
        )
        return step["n"]

    def starts(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twin = lambda p, x, i: F.coalesce(F.get(p, i)["h"] == x["h"], F.lit(False))
        same = let(placed, lambda p: F.filter(p, lambda x, i: twin(p, x, i - 1) | twin(p, x, i + 1)))
        return F.sort_array(F.transform(same, lambda x: x["i"]))

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))

    found = let(F.transform(all_words, lambda w: F.xxhash64(w)), windows)
    count = let(found, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(starts(h))))
    return F.when(F.size(all_words) <= WINDOW, F.lit(0).cast("long")).otherwise(count)


def base_columns(docs: DataFrame) -> DataFrame:
    """doc_id, source and the base measures of each row."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NON_SPACE_CLASS))
    split = docs.select("doc_id", "source", text.alias("t"), words(text).alias("w"), lines.alias("lines"))
    return split.select(
        "doc_id",
        "source",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("w")).alias("n_repeat_words"),
    )


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"\p{N}", "0"), r"[^\p{L}0]+", " "))


def hashed_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, source, line, n_words): one row for each distinct normalised line of a document, with all its words there."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(NON_SPACE_CLASS))
    rows = docs.select("doc_id", "source", F.explode(lines).alias("raw"))
    one = rows.select("doc_id", "source", F.xxhash64(normalised(F.col("raw"))).alias("line"), F.size(words(F.col("raw"))).cast("long").alias("words"))
    return one.groupBy("doc_id", "source", "line").agg(F.sum("words").alias("n_words"))


def frequent_lines(lines: DataFrame, max_docs: int) -> DataFrame:
    """(source, line, n_docs) of the lines that more than max_docs documents of a host hold."""
    return lines.groupBy("source", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > max_docs)


def assess(docs: DataFrame, max_docs: int = 100, min_kept: float = 0.5) -> DataFrame:
    """The base measures, n_removed_words (in lines above the limit), base_failed and kept for each row."""
    lines = written(hashed_lines(docs), "quality-lines")
    over = written(frequent_lines(lines, max_docs), "quality-frequent")
    same = [lines["line"] == over["line"], lines["source"].eqNullSafe(over["source"])]
    marked = lines.join(over, same, "left").select(lines["doc_id"], "n_words", F.when(F.col("n_docs").isNotNull(), F.col("n_words")).otherwise(0).alias("over"))
    removed = marked.groupBy("doc_id").agg(F.sum("n_words").alias("line_words"), F.sum("over").alias("n_removed_words"))
    base = base_columns(docs).join(removed, "doc_id", "left").fillna(0, ["line_words", "n_removed_words"])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    depleted = F.col("n_removed_words") > (1 - min_kept) * F.col("line_words")
    return base.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted).drop("line_words")
