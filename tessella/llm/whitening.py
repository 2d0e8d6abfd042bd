"""Whitening of embeddings by hierarchical merging of singular value decompositions.

1. Each task centres its vectors, batch by batch, and keeps how many they are, their exact sums and
   all singular values with their right vectors (``State``). Two states merge by decomposing both
   factors and one row for the distance of their means: nothing is cut, so the last state holds the
   covariance of all vectors with all dimensions.
2. States are merged up a tree, ``FAN`` to a task. A state has d x d numbers for d dimensions,
   however many vectors it stands for; only the last one comes to the driver.
3. Vectors are projected, and the projections' own covariance is taken by the same tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import arrow_map, keep, table

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: Whole numbers beyond this are taken as this: far from what an embedding holds, and sums stay exact.
LARGEST = 1 << 52
#: Bytes of factors that one merging task holds, and vectors decomposed at once.
MERGED_BYTES, AT_ONCE = 64 << 20, 4096
_STATE = "node long, n long, sums array<decimal(38,0)>, factor binary"


@dataclass
class State:
    """``n`` vectors of whole numbers: their exact sums, and a factor whose rows are singular values
    times right singular vectors of the centred vectors."""

    n: int
    sums: list[int]
    factor: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def merged(self, other: State) -> State:
        # the means' distance by whole numbers: means themselves may be large beside it
        apart = np.array([(a * other.n - b * self.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums)])
        row = np.sqrt(self.n / (self.n + other.n) * other.n) * apart
        return State(self.n + other.n, [a + b for a, b in zip(self.sums, other.sums)], decomposed(np.vstack((self.factor, other.factor, row))))

    def components(self) -> tuple[np.ndarray, np.ndarray]:
        """Eigenvalues of the covariance (divisor n), falling, and the unit eigenvectors as rows."""
        _, s, rows = np.linalg.svd(self.factor, full_matrices=False)
        return s**2 / self.n, rows


def decomposed(rows: np.ndarray) -> np.ndarray:
    """As many rows as dimensions, or as there are, with the same scatter matrix."""
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * v


def state_of(x: np.ndarray) -> State:
    """The state of vectors of whole numbers (int64, at most ``LARGEST`` in size)."""
    low = 1 << 26
    sums = [int(h) * low + int(r) for h, r in zip((x // low).sum(0), (x % low).sum(0))]
    middle = np.array([s // len(x) for s in sums], np.int64)
    rest = (x - middle).astype(np.float64)
    return State(len(x), sums, decomposed(rest - np.array([(s - int(m) * len(x)) / len(x) for s, m in zip(sums, middle)])))


def whole_numbers(values: np.ndarray, scale: float = SCALE, offset: int = OFFSET) -> np.ndarray:
    return np.clip(np.floor(scale * values.astype(np.float64)), -LARGEST, LARGEST).astype(np.int64) + offset


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), len(flat) // max(1, len(column)))


def _row(node: int, s: State) -> dict:
    return {"node": [node], "n": [s.n], "sums": [s.sums], "factor": [np.ascontiguousarray(s.factor).tobytes()]}


def _load(n: int, sums, raw: bytes) -> State:
    sums = [int(s) for s in sums]
    return State(n, sums, np.frombuffer(raw, np.float64).reshape(-1, len(sums)))


def merged_state(vectors: DataFrame) -> State | None:
    """The state of all rows of ``vectors`` (x array<long>, of one length); None without rows."""
    from decimal import Decimal

    types = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("factor", pa.binary())])

    def out(node: int, s: State) -> pa.RecordBatch:
        row = _row(node, s)
        row["sums"] = [[Decimal(v) for v in row["sums"][0]]]
        return pa.RecordBatch.from_pydict(row, schema=types)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            x = _matrix(batch["x"])
            for i in range(0, len(x), AT_ONCE):
                new = state_of(x[i : i + AT_ONCE])
                state = new if state is None else state.merged(new)
        if state is not None:
            yield out(TaskContext.get().partitionId(), state)

    def merge(group: pa.Table) -> pa.Table:
        rows = group.sort_by("node").to_pylist()  # the same order whenever a task runs again
        state = None
        for r in rows:
            new = _load(r["n"], r["sums"], r["factor"])
            state = new if state is None else state.merged(new)
        return pa.Table.from_batches([out(rows[0]["up"], state)], schema=types)

    states = keep(vectors.select("x").mapInArrow(fold, _STATE), "states")
    while True:
        first = states.limit(2).collect()
        if len(first) < 2:
            return _load(first[0]["n"], first[0]["sums"], first[0]["factor"]) if first else None
        fan = max(2, min(64, MERGED_BYTES // (8 * len(first[0]["sums"]) ** 2 + 1)))
        states = keep(states.withColumn("up", F.floor(F.col("node") / fan)).groupBy("up").applyInArrow(merge, _STATE), "states")


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, c array<double>) of the rows whose vector has finite entries only, and the length
    that most of these have, the longer of equally many."""
    entries = F.transform(vector_col, lambda c: c.cast("double"))
    finite = F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.select(F.col(id_col).alias("vec_id"), entries.alias("c")).filter(F.col("c").isNotNull() & (F.size("c") > 0)).filter(finite)
    lengths = rows.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("c") == lengths["d"]) if lengths else rows


def with_whole_numbers(rows: DataFrame, scale: float = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, x array<long>): x = floor(scale * c) + offset for each entry."""
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch):
        x = whole_numbers(_matrix(batch["c"]), scale, offset)
        yield {"vec_id": batch["vec_id"], "x": list(x)}

    return arrow_map(rows, run, f"vec_id {kind}, x array<bigint>")


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int | None]]:
    """n * x - S as doubles, and each row's exact sum of squares, None beyond a long."""
    most = max(map(abs, sums), default=0) + n * int(np.abs(x).max(initial=0))
    if most < 1 << 62:
        apart = n * x - np.array(sums, np.int64)
        if x.shape[1] * float(np.abs(apart).max(initial=0)) ** 2 < 1 << 62:
            return apart.astype(np.float64), (apart**2).sum(1).tolist()
    whole = [[n * int(v) - s for v, s in zip(r, sums)] for r in x]
    squares = [sum(v * v for v in r) for r in whole]
    return np.array(whole, np.float64).reshape(x.shape), [s if s < 1 << 63 else None for s in squares]


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per remaining row and component: vec_id, component, n, deviation, whitened, explained,
    identity_error.

    Rows whose vector is null, empty, or holds null or non-finite entries are dropped, and those of
    another length than most. Rows that repeat an id, or have none, count each. A component without
    variance (fewer different vectors than components) has whitened null and is left out of
    identity_error; explained is null if there is no variance at all. A deviation beyond a long is
    null. Vectors with fewer dimensions have fewer components. No rows give none; other columns aren't looked at.
    """
    rows = keep(with_whole_numbers(usable(vectors, id_col, vector_col)), "vectors")
    kind = rows.schema["vec_id"].dataType.simpleString()
    state = merged_state(rows)
    schema = f"vec_id {kind}, n long, deviation long, whitened array<double>"
    if state is None:
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    values, axes = state.components()
    trace, k = float(values.sum()), min(components, len(state.sums))
    values, axes = np.pad(values, (0, k))[:k], np.pad(axes, ((0, k), (0, 0)))[:k]
    varies = values > max(trace, 1e-300) * 1e-22
    n, sums = state.n, state.sums

    def run(batch: pa.RecordBatch):
        apart, squares = _deviations(_matrix(batch["x"]), n, sums)
        w = apart / n @ axes.T / np.sqrt(np.where(varies, values, 1))
        yield {"vec_id": batch["vec_id"], "n": [n] * len(w), "deviation": squares, "whitened": [[v if ok else None for v, ok in zip(r, varies)] for r in w.tolist()]}

    white = keep(arrow_map(rows, run, schema), "whitened")
    error = identity_error(white, int(varies.sum()))
    share = F.array(*[F.lit(float(v / trace) if trace > 0 else None).cast("double") for v in values])
    return white.select("vec_id", "n", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get(share, "at").alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def identity_error(white: DataFrame, k: int) -> float | None:
    """The largest absolute entry of the covariance of the first ``k`` whitened columns, less the
    identity, by the same tree: the values as whole numbers of 2^-32. None without columns."""
    if not k:
        return None
    rows = white.select("vec_id", F.slice("whitened", 1, k).alias("c"))
    fine = with_whole_numbers(rows, 2.0**32, 0)
    state = merged_state(fine)
    covariance = state.factor.T @ state.factor / state.n / 2.0**64
    return float(np.abs(covariance - np.eye(k)).max())


def op13_query(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
