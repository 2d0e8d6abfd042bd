"""Nearest vectors by blocks against the expression over all pairs."""

import numpy as np
from pyspark.sql import functions as F

from tessella.functions.similarity import cosine01
from tessella.operators.matching import top_k
from tessella.operators.vectors import nearest_vectors


def test_nearest_vectors_equal_all_pairs(spark):
    """With copies, vectors that differ by little, of other lengths, of zeros, with null and null ones."""
    rng = np.random.default_rng(2)
    rows = [[float(x) for x in np.float32(r)] for r in rng.normal(size=(150, 6))]
    rows += rows[:40] + [[x + 1e-7 for x in r] for r in rows[:30]] + [r[:4] for r in rows[:10]] + [[0.0] * 6, None, [], [1.0, None, 2.0, 0.0, 0.0, 1.0]] + [[float("nan")] * 6] + [rows[3]] * 30
    vectors = spark.createDataFrame(list(enumerate(rows)), "id long, v array<double>")
    asked = vectors.filter("id % 4 = 0 or id > 228")
    left = asked.select(F.col("id").alias("qid"), F.col("v").alias("q"))
    pairs = left.crossJoin(vectors).filter("qid <> id").select("qid", F.col("id").alias("pos"), cosine01(F.col("q"), F.col("v")).alias("sim"))
    got = nearest_vectors(asked, vectors, 5, 90)
    assert "ArrowCoGroups" in got._jdf.queryExecution().toString() or "FlatMapCoGroups" in got._jdf.queryExecution().toString()
    shown = lambda df: sorted((r["qid"], r["rank"], r["pos"], r["sim"]) for r in df.collect())
    assert shown(got) == shown(top_k(pairs, 5, score="sim"))
