"""Distributed connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import keep, release

LINKS_PER_TASK = 100_000


def _star(links: DataFrame, tasks: int, large: bool) -> DataFrame:
    """``links`` has rows (a, low), a > low. Large star: each a is linked to the smallest node that
    its ``low`` is linked to, or to ``low``. Small star: all lows of an a, and a, are linked to
    the smallest of them. The minima are a table of their own, so that both sides of the join are
    plain shuffles, which Spark splits at a node with many links."""
    lows = keep(links.groupBy(F.col("a").alias("at")).agg(F.min("low").alias("least")).coalesce(tasks), "lows")
    if large:
        out = links.join(lows, F.col("low") == F.col("at"), "left").select("a", F.coalesce("least", "low").alias("low"))
    else:
        met = links.join(lows, F.col("a") == F.col("at")).select(F.col("low").alias("a"), F.col("least").alias("low")).filter("a <> low")
        out = met.unionByName(lows.select(F.col("at").alias("a"), F.col("least").alias("low"))).distinct()
    out = keep(out.coalesce(tasks), "links")
    release(lows)
    return out


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of the nodes of links (a, b), longs without null; the component is its
    smallest node. A node's neighbours are pre-aggregated and joined, never gathered, so a hub
    may have any number of them. Raises RuntimeError if ``rounds`` don't do."""
    now = keep(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("low")).distinct(), "links")
    state = None
    for _ in range(rounds):
        new = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "low")).alias("x")).first()
        if (new["n"], new["x"]) == state or not new["n"]:
            return now.select(F.col("a").alias("node"), F.col("low").alias("component")).unionByName(now.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())
        state = (new["n"], new["x"])
        tasks = new["n"] // LINKS_PER_TASK + 1
        far = _star(now, tasks, True)
        near = _star(far, tasks, False)
        release(now, far)
        now = near
    raise RuntimeError(f"the components need more than {rounds} rounds")


def joined_components(components: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` (node, component) after more links (a, b): components of components."""
    at = lambda c: components.select(F.col("node").alias(f"at_{c}"), F.col("component").alias(f"of_{c}"))
    whole = links.join(at("a"), F.col("a") == F.col("at_a"), "left").join(at("b"), F.col("b") == F.col("at_b"), "left")
    whole = keep(whole.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")), "contracted")
    above = keep(connected_components(whole).withColumnsRenamed({"node": "below", "component": "above"}), "above")
    moved = components.join(above, F.col("component") == F.col("below"), "left").select("node", F.coalesce("above", "component").alias("component"))
    fresh = above.join(components, F.col("below") == F.col("node"), "left_anti").select(F.col("below").alias("node"), F.col("above").alias("component"))
    return moved.unionByName(fresh)
