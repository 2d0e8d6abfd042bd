"""Mixing sources to target weights, with DataFrame operations only.

1. Size of a text: its words. All sources share ``budget`` times all words by weight; a target
   stops at ``most`` times its source's size and the excess is shared again. The fixed point is
   found at once: with the sources sorted by cap over weight, targets are ``min(cap, level *
   weight)``, and running sums give the level.
2. The words of a source, its documents one after the other in a hashed order, are packed into
   blocks of ``block_words``. Places of documents are running sums in two steps, so that no
   source is in one task.
3. Each output shard draws its source counts from the multinomial distribution of the targets
   (``drawn_counts``), and running sums number each source's slots over the shards. What a source
   was drawn beyond its target, at places that a permutation of its slots chooses, goes to the
   sources that were drawn too seldom, so that all shards together meet the targets: given those
   totals, the counts still have the multinomial law.
4. The n-th slot of a source takes block ``permutation(n)``, with another permutation for each
   epoch over its blocks. So no block is taken more than ``ceil(target / size)`` times. Slots
   and blocks are joined by (source, block).

Windows over all sources hold one row per source, or one per source and 4,096 shards.

Permutations are swap-or-not networks over exactly the numbers 0 to n - 1, made of hashes of
columns, so reruns and recomputed tasks agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.shared import METHOD_LIMIT, SPACE, keep, release, table, text_of

BLOCK_WORDS, SLOTS_PER_SHARD, ROUNDS, SEED = 64, 4096, 12, 20240229
WEIGHTS, BUDGET, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
ROWS_PER_CHUNK, RANGE_STEPS = 4096, 8192
#: A permutation's rounds in one generated method are more bytecode than the JVM compiles; each
#: round gets a method of its own instead.
BY_ROUND = {METHOD_LIMIT: "8000"}


def words_in(text: str | Column) -> Column:
    """Number of words; 0 for null."""
    return F.regexp_count(text_of(text), F.lit(f"[^{SPACE}]+")).cast("long")


def permuted(df: DataFrame, x: str, n: str, keys: list[Column], salt: int, rounds: int = ROUNDS) -> DataFrame:
    """Replaces column ``x``, of numbers 0 to ``n`` - 1, by its image under the permutation that
    ``keys`` and ``salt`` choose: each round pairs x with key - x and swaps a pair by a coin."""
    value, size = F.col(x), F.col(n)
    for i in range(rounds):
        seed = F.lit(salt * 1000 + i).cast("long")
        other = F.pmod(F.pmod(F.xxhash64(seed, *keys), size) - value, size)
        df = df.withColumn("__other", other)
        coin = F.xxhash64(seed, F.greatest(value, F.col("__other")), *keys).bitwiseAND(F.lit(1))
        df = df.withColumn(x, F.when(coin == 1, F.col("__other")).otherwise(value))
    return df.drop("__other")


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """source, source_no, source_size, weight and target of rows (source, size). Sources are
    numbered by code point, null last; weights repeat over them. One small row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("source_no", F.row_number().over(by_name).cast("long") - 1)
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(pattern, (F.pmod(F.col("source_no"), F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "source_no")
    before, here_on, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing), by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * F.lit(float(budget)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(here_on)
    per = per.withColumn("level", level).withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_no", "level"))).over(everything)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return per.select("source", "source_no", "source_size", "weight", target.alias("target"))


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_in("text").alias("size"), F.xxhash64(text_of("text")).alias("text_key"))


def _targets(sized: DataFrame, weights, budget: float, most: float, block_words: int) -> DataFrame:
    """With each source's number of blocks and slots, and the number of slots before its own."""
    targets = source_targets(sized, weights, budget, most).withColumn("blocks", F.ceil(F.col("source_size") / block_words))
    slots = F.least(F.round(F.try_divide(F.col("target") * F.col("blocks"), F.col("source_size"))).cast("long"), F.floor(F.col("blocks") * F.lit(float(most))))
    before = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return targets.withColumn("slots", F.when(F.col("source_size") > 0, slots).otherwise(F.lit(0).cast("long"))).withColumn("slots_before", F.coalesce(F.sum("slots").over(before), F.lit(0))).withColumn("all_slots", F.sum("slots").over(every))


def _placed(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Each document's first word in its source's row of words."""
    chunks = max(64, math.ceil(sized.count() / ROWS_PER_CHUNK))
    numbered = sized.join(targets.select(F.col("source").alias("of_source"), "source_no", "source_size", "target"), F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    numbered = numbered.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text_key", F.lit(SEED).cast("long")), F.lit(chunks)))
    sums = numbered.groupBy("source_no", "chunk").agg(F.sum("size").alias("chunk_size"))
    before = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source_no").alias("s"), F.col("chunk").alias("c"), F.coalesce(F.sum("chunk_size").over(before), F.lit(0)).alias("chunk_first"))
    inside = Window.partitionBy("source_no", "chunk").orderBy("doc_id", "text_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (
        numbered.join(sums, (F.col("source_no") == F.col("s")) & (F.col("chunk") == F.col("c")))
        .withColumn("first", F.col("chunk_first") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .drop("s", "c", "chunk", "chunk_first")
    )


def _owners(rows: DataFrame, value: str, ranges: DataFrame, total: int) -> DataFrame:
    """Adds to each row the columns of the range [lo, lo + length) that holds its ``value``; the
    ranges cover 0 to ``total`` - 1. Both are joined by steps of that line."""
    step = total // RANGE_STEPS + 1
    cut = ranges.filter("length > 0").withColumn("__step", F.explode(F.sequence(F.expr(f"lo div {step}"), F.expr(f"(lo + length - 1) div {step}"))))
    return rows.withColumn("__step", F.expr(f"{value} div {step}")).join(cut, "__step").filter((F.col(value) >= F.col("lo")) & (F.col(value) < F.col("lo") + F.col("length"))).drop("__step", "length")


def drawn_counts(targets: DataFrame, slots_per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """shard, source_no, n: each shard's multinomial draw of ``slots_per_shard`` sources (the last
    shard's of what is left) with the sources' slots as weights. ``targets`` has a few rows."""
    spark = targets.sparkSession
    total = targets.agg(F.max("all_slots")).first()[0] or 0
    parts = max(1, total >> 20, min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // SLOTS_PER_SHARD))
    draws = spark.range(0, total, 1, parts).select(F.expr(f"id div {slots_per_shard}").alias("shard"), F.pmod(F.xxhash64(F.lit(SEED + 1).cast("long"), "id"), F.lit(max(1, total))).alias("draw"))
    ranges = targets.select("source_no", F.col("slots_before").alias("lo"), F.col("slots").alias("length"))
    return _owners(draws, "draw", ranges, total).groupBy("shard", "source_no").agg(F.count(F.lit(1)).alias("n"))


def _numbered(counts: DataFrame) -> DataFrame:
    """With ``first``, the source's slots in the shards before, and ``base``, the shard's slots of
    the sources before."""
    counts = counts.withColumn("span", F.expr(f"shard div {ROWS_PER_CHUNK}"))
    before = Window.partitionBy("source_no").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = counts.groupBy("source_no", "span").agg(F.sum("n").alias("m")).withColumn("span_first", F.coalesce(F.sum("m").over(before), F.lit(0))).drop("m")
    inside = Window.partitionBy("source_no", "span").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    in_shard = Window.partitionBy("shard").orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    out = counts.join(spans, ["source_no", "span"]).withColumn("first", F.col("span_first") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    whole = Window.partitionBy("shard")
    return out.select("shard", "source_no", "n", "first", F.coalesce(F.sum("n").over(in_shard), F.lit(0)).alias("base"), F.sum("n").over(whole).alias("shard_slots"))


def _slots(targets: DataFrame, slots_per_shard: int) -> DataFrame:
    """One row per slot: shard, slot, source_no, epoch, block."""
    counts = keep(drawn_counts(targets, slots_per_shard), "counts")
    every = Window.orderBy("source_no")
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    totals = targets.join(counts.groupBy("source_no").agg(F.sum("n").alias("drawn")), "source_no", "left").select("source_no", "blocks", "slots", F.coalesce("drawn", F.lit(0)).alias("drawn"))
    over, lack = F.greatest(F.col("drawn") - F.col("slots"), F.lit(0)), F.greatest(F.col("slots") - F.col("drawn"), F.lit(0))
    totals = totals.withColumn("over", over).withColumn("lack", lack).withColumn("over_before", F.coalesce(F.sum("over").over(before), F.lit(0))).withColumn("lack_before", F.coalesce(F.sum("lack").over(before), F.lit(0)))
    totals = keep(totals, "totals")  # one row per source
    excess = totals.agg(F.sum("over")).first()[0] or 0

    rows = _numbered(counts).join(totals.select("source_no", "blocks", "slots", "drawn", "over_before"), "source_no")
    # dealt out first: the counts are few bytes, of which Spark makes few tasks, their slots many
    width = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(width, "shard", "source_no").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    rows = rows.withColumn("slot", F.col("base") + F.col("i")).withColumn("rank", F.col("first") + F.col("i"))
    rows = permuted(rows, "slot", "shard_slots", [F.col("shard")], SEED + 2)
    rows = permuted(rows, "rank", "drawn", [F.col("source_no")], SEED + 3)
    # tables, as a filter or join right above would push its conditions down through, and multiply them by, all rounds
    drawn = keep(rows.select("shard", "slot", "source_no", "rank", "blocks", "slots", "over_before"), "drawn", BY_ROUND)
    fits = drawn.filter("rank < slots").select("shard", "slot", "source_no", "rank", "blocks")
    moved = drawn.filter("rank >= slots").select("shard", "slot", (F.col("over_before") + F.col("rank") - F.col("slots")).alias("e"), F.lit(max(1, excess)).cast("long").alias("excess"))
    moved = keep(permuted(moved, "e", "excess", [], SEED + 4), "moved", BY_ROUND)
    lacking = totals.select("source_no", "blocks", "drawn", F.col("lack_before").alias("lo"), F.col("lack").alias("length"))
    moved_to = _owners(moved, "e", lacking, excess).select("shard", "slot", "source_no", (F.col("drawn") + F.col("e") - F.col("lo")).alias("rank"), "blocks")

    rows = fits.unionByName(moved_to).withColumn("epoch", F.expr("rank div blocks")).withColumn("block", F.pmod("rank", "blocks"))
    rows = permuted(rows, "block", "blocks", [F.col("source_no"), F.col("epoch")], SEED)
    out = keep(rows.select("shard", "slot", "source_no", "epoch", "block"), "slots", BY_ROUND)
    release(counts, totals, drawn, moved)
    return out


def _mixed(placed: DataFrame, targets: DataFrame, block_words: int, slots_per_shard: int) -> DataFrame:
    b = block_words
    pieces = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"first div {b}"), F.expr(f"(first + size - 1) div {b}"))))
    start, stop = F.greatest(F.col("first"), F.col("block") * b), F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * b)
    pieces = pieces.select("source_no", "block", "doc_id", "source", "text_key", "size", "first", (start - F.col("first")).alias("first_word"), (stop - start).alias("n_words"))
    return _slots(targets, slots_per_shard).join(pieces, ["source_no", "block"])


def mix(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST, block_words: int = BLOCK_WORDS, slots_per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """The mix as spans: shard, slot, source, block, epoch, doc_id, first_word, n_words, one row
    per document that has words in the slot's block. See ``mix_counts`` for the edge cases."""
    sized = keep(_sized(docs), "sizes")
    targets = keep(_targets(sized, weights, budget, most, block_words), "targets")
    return _mixed(_placed(sized, targets), targets, block_words, slots_per_shard).select("shard", "slot", "source", "block", "epoch", "doc_id", "first_word", "n_words")


def shard_counts(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST, block_words: int = BLOCK_WORDS, slots_per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """The slots that each output shard has of each source: shard, source, n_slots."""
    targets = keep(_targets(keep(_sized(docs), "sizes"), weights, budget, most, block_words), "targets")
    counts = _slots(targets, slots_per_shard).groupBy("shard", "source_no").agg(F.count(F.lit(1)).alias("n_slots"))
    return counts.join(targets.select("source_no", "source"), "source_no").select("shard", "source", "n_slots")


def mix_counts(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST, block_words: int = BLOCK_WORDS, slots_per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken (words in the mix).

    A null source is a source of its own, last in order; null text has size 0 and is taken 0
    times; null ids are an id like any other; repeated rows are documents of their own. A
    source's taken words are within one block of its target. No rows give none.
    """
    sized = keep(_sized(docs), "sizes")
    targets = keep(_targets(sized, weights, budget, most, block_words), "targets")
    placed = keep(_placed(sized, targets), "places")
    taken = _mixed(placed, targets, block_words, slots_per_shard).groupBy(F.col("source_no").alias("s"), F.col("first").alias("f")).agg(F.sum("n_words").alias("taken"))
    joined = placed.join(taken, (F.col("source_no") == F.col("s")) & (F.col("first") == F.col("f")) & (F.col("size") > 0), "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST, block_words: int = BLOCK_WORDS, slots_per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: for each epoch one row per document
    that has words in it. A row whose words are all taken keeps its text; of others the taken
    words stay, joined by spaces, and n_chars, where there is such a column, follows. Documents
    without words stay as they are."""
    sized = keep(_sized(docs), "sizes")
    targets = keep(_targets(sized, weights, budget, most, block_words), "targets")
    placed = keep(_placed(sized, targets), "places")
    spans = _mixed(placed, targets, block_words, slots_per_shard).groupBy("source_no", "first", "epoch", "doc_id", "source", "text_key", "size").agg(
        F.sum("n_words").alias("__taken"), F.sort_array(F.collect_list(F.struct("first_word", "n_words"))).alias("__spans")
    )  # a document's own blocks: no more than its text has
    spans = spans.unionByName(placed.filter("size = 0").select("source_no", "first", F.lit(0).cast("long").alias("epoch"), "doc_id", "source", "text_key", "size"), allowMissingColumns=True)
    spans = spans.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("text_key").alias("__key"), F.col("size").alias("__size"), "__taken", "__spans")
    once = docs.dropDuplicates(["doc_id", "source", "text"])
    joined = once.join(spans, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.xxhash64(text_of("text")) == F.col("__key")))
    words = F.regexp_extract_all(F.col("text"), F.lit(f"[^{SPACE}]+"), F.lit(0))
    cut = F.array_join(F.flatten(F.transform("__spans", lambda s: F.slice(F.col("__words"), (s["first_word"] + 1).cast("int"), s["n_words"].cast("int")))), " ")
    whole = F.col("__spans").isNull() | (F.col("__taken") == F.col("__size"))
    out = joined.withColumn("__words", F.when(~whole, words)).withColumn("text", F.when(whole, F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op4_query(spark, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents"))
