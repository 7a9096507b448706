"""Mixing sources to target weights, in DataFrame functions only.

Targets: sources in code-point order (null last) weigh 1, 2, 3, 1, ... and share all words in that proportion; a
source's target stops at ``CAP`` times its size and the excess goes to the others by weight until none is above, which
is the level at which sum(min(CAP * size, level * weight)) is the whole.

Blocks: a source's documents, laid end to end in a fixed order, are cut every ``BLOCK`` words. A source with n blocks
has round(target / size * n) of the output's slots; slot k of a source holds its block P(k mod n) of epoch k div n, where
P is a pseudorandom permutation of 0..n-1 for each source and epoch (rounds of swap-or-not, which work for any n and need
no table).

Draw: the output is cut into shards of ``SHARD_SLOTS`` slots. Which source fills a place of a shard is drawn by one more
such permutation over all slots of all sources, so a shard's counts of the sources are a multinomial draw, given that
over all shards each source has the slots that its target asks for. (Free draws for each shard would miss small sources'
targets by the root of their slots and break the cap.)

Slots and the pieces of documents that lie in the blocks are joined by (source, block); a block has at most ``CAP`` slots,
so no key of this join is hot. ``taken_words`` and ``mixed`` are aggregates of the joined rows.

Positions come from sums over hash chunks of each source and running sums inside a chunk. There are CHUNKS of them or
one for every CHUNK_ROWS rows of the table, so that a source with a third of all rows is spread over as many tasks.

Defined results: null and empty texts have size 0 and take nothing; null is a source; each row has a number of its own, so
that rows with null or repeated ids and repeated rows are laid and taken one by one; an empty table gives an empty mix;
columns with clashing names pass through ``mixed`` as they are. Long texts span as many blocks as they need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from splitfold.llm.common import NON_SPACE_CLASS, SPACE_CLASS, dropped, written

BLOCK, CAP, ROUNDS, SHARD_SLOTS = 64, 3, 12, 4096
CHUNKS, CHUNK_ROWS, EXPLODED = 1024, 100_000, 4096


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"{NON_SPACE_CLASS}+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(key, source_size, target, n_blocks, n_slots) of each source; one row for each source all along."""
    every = W.partitionBy()
    sources = sizes.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    weighed = sources.withColumn("weight", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    order = W.orderBy(F.col("source_size") / F.col("weight"), "key").rowsBetween(W.unboundedPreceding, -1)
    capped_before = F.coalesce(F.sum(CAP * F.col("source_size")).over(order), F.lit(0))
    weight_before = F.coalesce(F.sum("weight").over(order), F.lit(0))
    level = (F.sum("source_size").over(every) - capped_before) / (F.sum("weight").over(every) - weight_before)
    free = weighed.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= CAP * F.col("source_size"))
    first_free = F.min(F.when(F.col("free"), F.struct(F.col("source_size") / F.col("weight"), "key", "level"))).over(every)["level"]
    target = F.when(F.col("free"), first_free * F.col("weight")).otherwise((CAP * F.col("source_size")).cast("double"))
    blocks = F.ceil(F.col("source_size") / BLOCK)
    slots = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * F.col("n_blocks"))).otherwise(0).cast("long")
    return free.withColumn("target", target).withColumn("n_blocks", blocks).withColumn("n_slots", F.least(slots, CAP * F.col("n_blocks"))).select("key", "source_size", "target", "n_blocks", "n_slots")


def sized(docs: DataFrame) -> DataFrame:
    """(row, doc_id, source, key, size), row being a number of each row's own."""
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    return docs.select("row", "doc_id", "source", key.alias("key"), "size", F.xxhash64("doc_id", "tie").alias("hash"), "tie")


def placed(sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, key, size, start, source_size, target) where in its source each row begins; and the sources."""
    chunks = max(CHUNKS, -(-sizes.count() // CHUNK_ROWS))
    rows = sizes.withColumn("chunk", F.pmod("hash", F.lit(chunks)))
    sums = written(rows.groupBy("key", "chunk").agg(F.first("source").alias("source"), F.sum("size").alias("size")), "mixing-chunks")
    sources = written(source_targets(sums), "mixing-sources")
    before = W.partitionBy("key").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select("key", "chunk", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base")).join(sources, "key")
    inside = W.partitionBy("key", "chunk").orderBy("hash", "doc_id", "tie", "row").rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("size").over(inside), F.lit(0))
    found = rows.withColumn("offset", offset).join(bases, ["key", "chunk"])
    places = written(found.select("row", "doc_id", "key", "size", (F.col("base") + F.col("offset")).alias("start"), "source_size", "target"), "mixing-places")
    dropped(sums)
    return places, sources


def permuted(rows: DataFrame, column: str, n: str, seed: list[str]) -> DataFrame:
    """``column``, a number below ``n``, goes to its place in the pseudorandom permutation of 0..n-1 that the columns of seed name.

    Each of ROUNDS rounds of swap-or-not pairs x with (k - x) mod n for a key k of the round, and swaps the two or not by a
    hash of the pair.
    """
    named = F.xxhash64(*seed)

    def one(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(named, r), F.col(n)) - x, F.col(n))
        return F.when(F.xxhash64(named, r + ROUNDS, F.greatest(x, partner)).bitwiseAND(1) == 1, partner).otherwise(x)

    # a fold and not a column for each round, whose expressions Catalyst would write into one another
    rounds = F.array(*[F.lit(r) for r in range(ROUNDS)])
    return rows.withColumn(column, F.aggregate(rounds, F.col(column).cast("long"), one))


def slots(sources: DataFrame) -> DataFrame:
    """(shard, place, key, epoch, block): what fills each place of the output."""
    before = F.coalesce(F.sum("n_slots").over(W.orderBy("key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n_slots").over(W.partitionBy())
    own = sources.select("key", "n_blocks", "n_slots", before.alias("base"), total.alias("total")).where("n_slots > 0")
    # a source's slots come in pieces of EXPLODED, so that a large source is dealt to many tasks
    parts = own.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_slots") - 1) / EXPLODED)))).repartition("key", "part")
    first = F.col("part") * EXPLODED
    each = parts.withColumn("slot", F.explode(F.sequence(first, F.least(first + EXPLODED, F.col("n_slots")) - 1)))
    each = each.select("key", "n_blocks", "total", (F.col("base") + F.col("slot")).alias("at"), F.floor(F.col("slot") / F.col("n_blocks")).alias("epoch"), (F.col("slot") % F.col("n_blocks")).alias("block"), F.lit("draw").alias("draw"))
    each = permuted(permuted(each, "block", "n_blocks", ["key", "epoch"]), "at", "total", ["draw"])
    return each.select(F.floor(F.col("at") / SHARD_SLOTS).alias("shard"), (F.col("at") % SHARD_SLOTS).alias("place"), "key", "epoch", "block")


def pieces(places: DataFrame) -> DataFrame:
    """(key, block, row, from, words): the part of each document in each block of its source."""
    end = F.col("start") + F.col("size")
    blocks = places.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((end - 1) / BLOCK))))
    low, high = F.greatest("start", F.col("block") * BLOCK), F.least(end, (F.col("block") + 1) * BLOCK)
    return blocks.select("key", "block", "row", (low - F.col("start")).alias("from"), (high - low).alias("words"))


def shards(places: DataFrame, sources: DataFrame) -> DataFrame:
    """(shard, place, key, epoch, block, row, from, words): the output, a row for each document's piece in each place."""
    # a source's row holds the number of its slots, so Spark takes their table for as small as the sources' and would send it to all
    return slots(sources).hint("merge").join(pieces(places), ["key", "block"])


def taken_words(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row."""
    rows = docs.select("doc_id", "source", n_words("text").alias("size"), F.xxhash64("text").alias("tie")).withColumn("row", F.monotonically_increasing_id())
    places, sources = placed(written(sized(rows), "mixing-sizes"))
    taken = shards(places, sources).groupBy("row").agg(F.sum("words").alias("taken"))
    return places.join(taken, "row", "left").select("doc_id", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("taken", F.lit(0)).alias("taken"))


def targets(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size and target for each row."""
    rows = docs.select("doc_id", "source", n_words("text").alias("size"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"))
    found = rows.drop("source").join(source_targets(rows), "key")
    return found.select("doc_id", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents with the words that the mix takes as their text; documents of which it takes none are gone.

    A document that an epoch takes whole keeps its text there; the parts of a document that is taken in part are joined
    by a space, epochs by a line break. Texts are moved once, to the parts of their row.
    """
    own = written(docs.select(F.struct(*docs.columns).alias("doc"), n_words("text").alias("size")).where("size > 0").withColumn("row", F.monotonically_increasing_id()), "mixing-rows")
    rows = sized(own.select("row", "doc.doc_id", "doc.source", "size", F.xxhash64("doc.text").alias("tie")))
    places, sources = placed(written(rows, "mixing-sizes"))
    parts = shards(places, sources).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("epoch", "from", "words"))).alias("parts"))
    joined = own.join(parts, "row")
    all_words = F.array_remove(F.split("doc.text", f"{SPACE_CLASS}+"), "")

    def epoch_text(words: Column, e: int) -> Column:
        of = F.filter("parts", lambda p: p["epoch"] == e)
        whole = F.aggregate(of, F.lit(0).cast("long"), lambda n, p: n + p["words"]) == F.col("size")
        cut = F.array_join(F.flatten(F.transform(of, lambda p: F.slice(words, (p["from"] + 1).cast("int"), p["words"].cast("int")))), " ")
        return F.when(F.size(of) > 0, F.when(whole, F.col("doc.text")).otherwise(cut))

    text = F.element_at(F.transform(F.array(all_words), lambda w: F.array_join(F.array(*[epoch_text(w, e) for e in range(CAP)]), "\n")), 1)
    out = joined.withColumn("text", text)
    values = {c: F.col("doc")[c] for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.char_length("text").cast("long")
    return out.select(*[v.alias(c) for c, v in values.items()])
