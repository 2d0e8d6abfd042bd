"""Gradient-boosted trees with l2 on binned inputs, fitted from one aggregation.

With squared error, rows that agree in all bins get the same prediction from every tree, so their
number and the sum of their targets is all that fitting needs. Rows are summed by cell; there are
at most (``bins`` + 1) to the number of inputs of these, however many rows. Trees are grown on the cells'
sums, and what they add up to is again a value per cell, which predicts by lookup.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessella.functions.stats import bin_of, quantile_table

#: Cells that the driver fits on at most: 3 inputs of 99 bins, or 4 of 30.
CELLS = 1_000_000


@dataclass
class BoostedTrees:
    """``edges`` of each input's bins, and the prediction of each cell. A value on an edge belongs to the
    bin below it; nulls have the last bin of their own."""

    inputs: tuple[str, ...]
    edges: list[np.ndarray]
    table: np.ndarray

    def predict(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        return self.table[tuple(np.where(np.isnan(x), size - 1, np.clip(np.searchsorted(e, x, "left") - 1, 0, size - 2)) for x, e, size in zip(columns, self.edges, self.table.shape))]


def grown(bins: np.ndarray, sizes: Sequence[int], n: np.ndarray, g: np.ndarray, depth: int, leaves: int, least: int, l2: float) -> np.ndarray:
    """A tree's value of each cell. ``bins`` has a column per input, ``n`` the cells' rows, ``g`` their
    sums of residuals. The leaf whose split gains most is split next; of equal gains the first input
    and the lowest bin. A split sends bins up to its own left, nulls are in the last bin."""
    score = lambda s, c: s * s / (c + l2)

    def best(cells: np.ndarray, level: int):
        whole, count, found = g[cells].sum(), n[cells].sum(), None
        if level < depth:
            for f, size in enumerate(sizes):
                left = np.cumsum(np.bincount(bins[cells, f], g[cells], size))[:-1]
                below = np.cumsum(np.bincount(bins[cells, f], n[cells], size))[:-1]
                gain = np.where((below >= least) & (count - below >= least), score(left, below) + score(whole - left, count - below) - score(whole, count), -np.inf)
                at = int(np.argmax(gain))
                if gain[at] > 1e-9 * max(1.0, abs(score(whole, count))) and (found is None or gain[at] > found[0]):
                    found = (float(gain[at]), f, at)
        return found

    out, heap, made = np.zeros(len(n)), [], 0

    def offer(cells: np.ndarray, level: int) -> None:
        nonlocal made
        out[cells] = g[cells].sum() / (n[cells].sum() + l2)
        found = best(cells, level)
        if found:
            heapq.heappush(heap, (-found[0], made, cells, level, found))
        made += 1

    offer(np.arange(len(n)), 0)
    count = 1
    while heap and count < leaves:
        _, _, cells, level, (_, f, at) = heapq.heappop(heap)
        low = bins[cells, f] <= at
        offer(cells[low], level + 1)
        offer(cells[~low], level + 1)
        count += 1
    return out


def boosted(bins: np.ndarray, sizes: Sequence[int], n: np.ndarray, total: np.ndarray, rounds: int = 200, rate: float = 0.05, depth: int = 6, leaves: int = 31, least: int = 20, l2: float = 1.0) -> tuple[float, np.ndarray]:
    """(the mean, the prediction of each cell)."""
    base = float(total.sum() / n.sum())
    now = np.full(len(n), base)
    for _ in range(rounds):
        now += rate * grown(bins, sizes, n, total - n * now, depth, leaves, least, l2)
    return base, now


def with_bins(df: DataFrame, inputs: Sequence[str], edges: Sequence[np.ndarray]) -> DataFrame:
    """Adds __b0, __b1, ...: the inputs' bins."""
    own = lambda c, e: F.least(bin_of(F.col(c), F.array(*[F.lit(float(x)) for x in e])), F.lit(max(0, len(e) - 2)))
    numbers = {f"__b{i}": F.when(F.col(c).isNull(), max(1, len(e) - 1)).otherwise(own(c, e)) for i, (c, e) in enumerate(zip(inputs, edges))}
    return df.withColumns(numbers)


def fit_boosted(df: DataFrame, inputs: Sequence[str], target: str, fold: str | None = None, bins: int = 32, **how) -> dict[int | None, BoostedTrees]:
    """The model of all rows with a target, under None; with ``fold``, also under each fold's number (0 or
    more) that of all other rows. NaN counts as null. Raises ValueError without rows, or if there
    could be more than ``CELLS`` cells."""
    if (bins + 1) ** len(inputs) > CELLS:
        raise ValueError(f"{len(inputs)} inputs of {bins} bins have more than {CELLS} cells")
    clean = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c)
    rows = df.select(*[clean(c) for c in inputs], clean(target).alias("__y"), (F.col(fold) if fold else F.lit(-1)).cast("int").alias("__fold")).filter("__y is not null")
    found = quantile_table(rows, {c: [i / bins for i in range(bins + 1)] for c in inputs}).first()
    edges = [np.unique(found[f"{c}_q"] or [0.0]) for c in inputs]
    sums = with_bins(rows, inputs, edges).groupBy("__fold", *[f"__b{i}" for i in range(len(inputs))]).agg(F.count(F.lit(1)).alias("n"), F.sum("__y").alias("total"))
    cells = sums.toPandas()  # at most CELLS a fold
    if not len(cells):
        raise ValueError(f"no row has {target}")
    sizes = tuple(max(1, len(e) - 1) + 1 for e in edges)
    out = {}
    for k in [None, *sorted(f for f in cells["__fold"].unique().tolist() if fold and f >= 0)]:
        own = cells[cells["__fold"] != k] if k is not None else cells
        own = own.groupby([f"__b{i}" for i in range(len(inputs))], as_index=False)[["n", "total"]].sum()
        if not len(own):
            continue
        at = own[[f"__b{i}" for i in range(len(inputs))]].to_numpy()
        # cells without rows belong to leaves too: they are in the tables with no rows and no sum
        every = np.stack([x.ravel() for x in np.indices(sizes)], 1)
        n, total = np.zeros(sizes), np.zeros(sizes)
        n[tuple(at.T)], total[tuple(at.T)] = own["n"], own["total"]
        _, value = boosted(every, sizes, n.ravel(), total.ravel(), **how)
        out[k] = BoostedTrees(tuple(inputs), edges, value.reshape(sizes))
    return out


def with_boosted_residuals(df: DataFrame, models: dict[int | None, BoostedTrees], target: str, fold: str | None = None) -> DataFrame:
    """Adds ``pred_<target>`` and ``resid_<target>``; with ``fold``, a row is predicted by the model that was
    fitted without its fold, where there is one."""
    shared = df.sparkSession.sparkContext.broadcast(models)  # CELLS numbers a fold at most
    inputs, pred = models[None].inputs, f"pred_{target}"

    def run(batches):
        for batch in batches:
            columns = [np.asarray(batch[c].cast(pa.float64()).fill_null(float("nan"))) for c in inputs]
            out = shared.value[None].predict(columns)
            if fold:
                own = np.asarray(batch[fold].cast(pa.int64()).fill_null(-1))
                for k in np.unique(own).tolist():
                    if k in shared.value:
                        out = np.where(own == k, shared.value[k].predict(columns), out)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, pred])

    schema = StructType([*df.schema.fields, StructField(pred, DoubleType())])
    return df.mapInArrow(run, schema).withColumn(f"resid_{target}", F.col(target) - F.col(pred))
