"""Near-duplicate documents by MinHash with tensored banding, verified on whole shingle sets.

1. Each text's set of ``SHINGLE_WORDS``-word shingles gets two small collections of ``HALVES``
   half keys, each half key of ``ROWS`` minimum hashes. A table's key is a pair of half keys, one of
   either collection: ``HALVES`` squared tables of 2 * ``ROWS`` minima, from 2 * ``HALVES`` * ``ROWS``
   hashes instead of ``HALVES`` times as many. Texts with equal sets are one class, of which one row goes on.
2. A half key that only one class has can't be part of a shared table key, so only the others are
   paired. Tables' buckets with exactly the same rows are one bucket.
3. Each row meets its buckets' pivot, and pairs are compared on whole sets. Components of these
   links; buckets that still hold several components go on as in the Jaccard join, until every pair
   of rows of different components that a bucket holds has been ruled out or compared.

Two sets of similarity J share a table unless one collection has no equal half key: they are missed
with a probability of 2 * (1 - J ** ROWS) ** HALVES at most, 7 in a million at J = 0.8 and 2 in ten
billion at 0.9. Every link that is returned is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.components import connected_components
from tessella.llm.jaccard_join import _BASE, AT_ONCE, WHOLE, _verify, alike_buckets, joined_in_buckets, named_rows, shingle_sets
from tessella.llm.shared import arrow_map, keep, mixed, release, slices, table

SHINGLE_WORDS, PART = 4, 80
HALVES, ROWS = 24, 4
#: Bits of the bitmaps that rule pairs out.
BITS_PER_SHINGLE = 16

_SEEDS = np.random.default_rng(20_080).integers(1, 1 << 63, (2, 2 * HALVES * ROWS), dtype=np.uint64)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The smallest value of each hash function over each set (none empty), a row for each set."""
    values = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), _SEEDS.shape[1]), np.uint64)
    for i, (flip, odd) in enumerate(zip(_SEEDS[0], _SEEDS[1] | np.uint64(1))):
        out[:, i] = np.minimum.reduceat((values ^ flip) * odd, starts)
    return out


def half_keys(sets: list[np.ndarray]) -> np.ndarray:
    """2 * ``HALVES`` half keys of each set, the first collection's first."""
    low = minima(sets).reshape(len(sets), 2 * HALVES, ROWS)
    key = np.broadcast_to(np.arange(1, 2 * HALVES + 1, dtype=np.uint64), low.shape[:2]).copy()
    for r in range(ROWS):
        key = mixed(key * _BASE + low[:, :, r])
    return key.view(np.int64)


def _summaries(docs: DataFrame) -> DataFrame:
    """(doc_id, n, key1, key2, halves) per row; the two keys stand for the set."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = batch["text"].to_pylist()
        for lo, hi in slices(texts, AT_ONCE):
            sets = shingle_sets(texts[lo:hi], SHINGLE_WORDS)
            key = [(np.bitwise_xor.reduce(mixed(s)).view(np.int64), np.add.reduce(mixed(s ^ _BASE)).view(np.int64)) if len(s) else (0, 0) for s in sets]
            full = [s for s in sets if len(s)]
            halves = iter(half_keys(full) if full else ())
            yield {
                "doc_id": batch["doc_id"][lo:hi], "n": [len(s) for s in sets], "key1": [int(k[0]) for k in key], "key2": [int(k[1]) for k in key],
                "halves": [next(halves) if len(s) else [] for s in sets],
            }

    return arrow_map(docs, run, "doc_id long, n long, key1 long, key2 long, halves array<long>")


def _with_halves(own: DataFrame) -> DataFrame:
    """(doc_id, text, halves): half keys as 32 bits each, which tell the first table that two texts share."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = batch["text"].to_pylist()
        for lo, hi in slices(texts, AT_ONCE):
            sets = shingle_sets(texts[lo:hi], SHINGLE_WORDS)
            full = [s for s in sets if len(s)]
            halves = iter(half_keys(full).astype(np.uint32) if full else ())
            yield {"doc_id": batch["doc_id"][lo:hi], "text": texts[lo:hi], "halves": [next(halves).tobytes() if len(s) else bytes(8 * HALVES) for s in sets]}

    return arrow_map(own, run, "doc_id long, text string, halves binary")


def table_keys(classes: DataFrame) -> DataFrame:
    """(rep, n, h, slot) for classes (rep, n, halves): a row for each table whose key may be shared,
    and the table's number."""
    halves = classes.select("rep", "n", F.posexplode("halves").alias("at", "half"))
    shared = keep(halves.groupBy("half").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(F.col("half").alias("of")), "halves")
    left = halves.join(shared, F.col("half") == F.col("of"), "left_semi").groupBy("rep", "n")
    sides = left.agg(*[F.collect_list(F.when(c, F.struct("half", "at"))).alias(a) for a, c in (("first", F.col("at") < HALVES), ("second", F.col("at") >= HALVES))])
    pairs = F.flatten(F.transform("first", lambda a: F.transform("second", lambda b: F.struct(F.xxhash64(a["half"], b["half"]).alias("h"), (a["at"] * HALVES + b["at"] - HALVES).alias("slot")))))
    return sides.select("rep", "n", F.explode(pairs).alias("key")).select("rep", "n", "key.h", "key.slot")


def pivot_pairs(buckets: DataFrame) -> DataFrame:
    """(a, b): each row with the pivot that it shares most buckets with, if their sizes allow a link.
    A bucket's pivot is its smallest row by a hash, so that most rows of a group have the same one."""
    pivots = keep(buckets.groupBy("h").agg(F.min(F.struct(F.xxhash64("rep").alias("x"), "rep", "n")).alias("pivot")).select(F.col("h").alias("of"), F.col("pivot.rep").alias("pivot"), F.col("pivot.n").alias("m")), "pivots")
    fits = (F.col("rep") != F.col("pivot")) & (WHOLE * F.col("n") >= PART * F.col("m")) & (WHOLE * F.col("m") >= PART * F.col("n"))
    met = buckets.join(pivots, F.col("h") == F.col("of")).filter(fits).groupBy("rep", "pivot").agg(F.count(F.lit(1)).alias("shared"))
    best = met.groupBy("rep").agg(F.max(F.struct("shared", "pivot"))["pivot"].alias("pivot"))
    return best.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()


def minhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links of a
    Jaccard similarity of 0.8 or more, its own included), kept (doc_id = component_id).

    Null and empty texts have an empty set, linked with nothing, not even each other. Rows with a
    null doc_id are scored but neither link nor name a component (component_id null) and are kept.
    Rows that repeat a doc_id count as one document if their texts' sets are equal; else each row
    links by its own text under that id. Other columns are ignored; no rows give none.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = keep(_summaries(own), "signatures")
    classes = keep(rows.filter("n > 0 and doc_id is not null").groupBy("key1", "key2", "n").agg(F.min("doc_id").alias("rep"), F.min_by("halves", "doc_id").alias("halves")), "classes")
    keys = keep(table_keys(classes), "tables")
    buckets = keep(alike_buckets(keys), "buckets")
    release(keys)
    pairs = keep(pivot_pairs(buckets), "pairs")
    # from here on only texts that share a table with another one
    met = buckets.select(F.col("rep").alias("met")).distinct()
    own = keep(_with_halves(own.join(met, F.col("doc_id") == F.col("met"), "left_semi")), "texts")
    links = _verify(own, pairs, SHINGLE_WORDS, PART)
    release(pairs)
    components = joined_in_buckets(own, buckets, keep(connected_components(links), "components"), SHINGLE_WORDS, PART, BITS_PER_SHINGLE)
    return named_rows(rows, classes, components).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents that stay, one row for each id and text."""
    kept = minhash_components(docs).filter("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id")).distinct()
    own = docs.select("doc_id", "text")
    return own.join(kept, F.col("doc_id") == F.col("kept_id"), "left_semi").distinct().unionByName(own.filter("doc_id is null"))


def op11_query(spark, sf_dir: str) -> DataFrame:
    return minhash_components(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(c) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
"""
