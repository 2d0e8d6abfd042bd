"""What each quality filter removes in every order of five filters, alone and beside the others.

1. Each text is judged once: its failures are bits of a mask. Copies are found by a digest of the
   whole text, pre-aggregated, so a text that a third of the rows share is one row per task.
2. Documents become cells: how many of a part have a mask, and how many of these are labelled good
   or toxic. There are at most 32 cells a part, however many documents.
3. Cells are unpivoted against the steps of all orders. A running bit-or over the steps of an order
   tells what an earlier filter has removed; conditional sums over cells give each step's figures,
   and a window over a filter's steps in all orders its total.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.shared import keep, table, text_of

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3


def bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def failure_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) per row: a bit for each filter that the whole text fails. E is failed by
    a row whose text a smaller doc_id has too; a row without id has no smaller one and never does."""
    words = F.array_remove(F.split(F.regexp_replace("text", r"[\x09-\x0D]", " "), " "), "")
    judged = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), text_of("text").alias("text"))
        .withColumn("words", words)
        .select(
            "doc_id", "part", F.sha2("text", 256).alias("digest"), F.size("words").cast("long").alias("n"), F.size(F.array_distinct("words")).cast("long").alias("distinct"),
            F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("capitals"), F.length("text").cast("long").alias("points"), F.col("text").rlike("[#$%&*|]").alias("marked"),
        )
    )
    fails = {"A": F.col("n") < LEAST_WORDS, "B": 100 * F.col("distinct") < LEAST_DISTINCT * F.col("n"), "C": 100 * F.col("capitals") > MOST_CAPITALS * F.col("points"), "D": F.col("marked")}
    mask = sum((F.when(c, bit(f)).otherwise(0) for f, c in fails.items()), F.lit(0))
    rows = keep(judged.select("doc_id", "part", "digest", mask.alias("mask")), "masks")
    # only texts that several rows share, as a table of its own: Spark splits a text with many rows
    shared = keep(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(F.col("digest").alias("of"), "first"), "copies")
    copied = F.when(F.col("doc_id") > F.col("first"), bit("E")).otherwise(0)
    return rows.join(shared, F.col("digest") == F.col("of"), "left").select("doc_id", "part", (F.col("mask") + copied).alias("mask"))


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, docs, good, toxic): how many rows of a part have a mask, and how many of them a
    label of that kind; of labels that repeat an id any one counts."""
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    known = labels.filter((good | toxic) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("of"))
    known = keep(known.agg(F.max(F.when(good, 1).otherwise(0)).alias("good"), F.max(F.when(toxic, 1).otherwise(0)).alias("toxic")), "labelled")
    masks = failure_masks(docs)
    labelled = masks.filter("doc_id is not null").join(known, F.col("doc_id") == F.col("of"), "left").select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    rows = labelled.unionByName(masks.filter("doc_id is null").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic")))
    return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("docs"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part (lang, null as empty string), filter_order and step 1 to 5: kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley.

    A null text counts as empty. A row without doc_id has no labels and is nobody's copy; rows that
    repeat a doc_id count each, and aren't copies of one another. Other columns of either table
    aren't looked at, null labels count as 0. No documents give no rows; a part's steps are all
    there once it has a row.
    """
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])).alias("filter_order")
    cells = keep(mask_cells(docs, labels), "cells")
    long = cells.select("*", orders).select("*", F.posexplode(F.split("filter_order", "")).alias("place", "filter"))
    bits = F.create_map(*[F.lit(x) for f in FILTERS for x in (f, bit(f))])
    long = long.withColumn("step", F.col("place") + 1).withColumn("own", F.col("mask").bitwiseAND(bits[F.col("filter")]))
    before = Window.partitionBy("part", "filter_order", "mask").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.bit_or("own").over(before), F.lit(0)))
    fails, gone = F.col("own") != 0, F.col("earlier") != 0
    count = lambda when, what="docs": F.sum(F.when(when, F.col(what)).otherwise(0))
    steps = long.groupBy("part", "filter_order", "step", "filter").agg(
        count(~fails & ~gone).alias("kept"), count(fails & ~gone).alias("removed"), count(fails & gone).alias("redundant"),
        count(F.col("mask") == bits[F.col("filter")]).alias("unique_fails"), count(fails & ~gone, "good").alias("good_lost"), count(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    total = F.sum("removed").over(Window.partitionBy("part", "filter"))
    return steps.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", total.alias("shapley"))


def op12_query(spark, sf_dir: str) -> DataFrame:
    return filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (
  SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
    regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails FROM d
), l AS (SELECT doc_id, max(coalesce(quality, 0) = 1) AS good, max(coalesce(toxic, 0) = 1) AS toxic FROM labels GROUP BY doc_id),
r AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, fails),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM f a, f b, f c, f d, f e WHERE a.f NOT IN (b.f, c.f, d.f, e.f) AND b.f NOT IN (c.f, d.f, e.f) AND c.f NOT IN (d.f, e.f) AND d.f <> e.f),
s AS (
  SELECT part, o AS filter_order, step, n, good, toxic, o[step] AS f, fails[ord(o[step]) - 64] AS fail,
    len(list_filter(range(1, step), lambda i: fails[ord(o[i]) - 64])) > 0 AS gone, list_count(list_filter(fails, lambda x: x)) = 1 AS alone
  FROM r, o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), t AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT fail AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fail AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (fail AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fail AND alone), 0) AS unique_fails,
    coalesce(sum(good) FILTER (fail AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (fail AND NOT gone), 0) AS toxic_lost
  FROM s GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM t
"""
