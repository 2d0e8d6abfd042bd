"""Exact nearest vectors by cosine: every query meets every vector, block by block."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.matching import top_k

#: Vectors, and queries, of a block; pairs that are scored at once.
BLOCK, AT_ONCE = 100_000, 4_000_000


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as rows, filled up with zeros, and their lengths; a vector that is null or holds a null
    is all zeros, as its cosine is 0, and has no other's length."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    length = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    row = np.repeat(np.arange(len(length)), length)
    out = np.zeros((len(length), int(length.max(initial=0)) or 1))
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)] = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    holed = row[flat.is_null().to_numpy(zero_copy_only=False)]
    out[holed], length[holed] = 0.0, -1
    return out, length


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed from left to right."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def _best(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        empty = {"qid": np.zeros(0, np.int64), "pos": np.zeros(0, np.int64), "sim": np.zeros(0)}
        if not asked.num_rows or not held.num_rows:
            return pa.table(empty)
        (q, q_len), (v, v_len) = _matrix(asked["v"]), _matrix(held["v"])
        wide = max(q.shape[1], v.shape[1])
        q, v = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (q, v))
        qid, pos = asked["id"].to_numpy(), held["id"].to_numpy()
        parts = []
        with np.errstate(all="ignore"):
            q_norm, v_norm = np.sqrt(_dot(q, q)), np.sqrt(_dot(v, v))
            unit = lambda m, n: (m / np.where(n == 0, 1.0, n)[:, None]).astype(np.float32)
            near, far = unit(q, q_norm), unit(v, v_norm)
            alike = (q_len == q_len[0]).all() and (v_len == q_len[0]).all()
            slack, step = np.float32(1e-5 + wide * 3e-7), max(1, AT_ONCE // len(pos))
            for lo in range(0, len(qid), step):
                # about, in single precision; what is near the k-th best is scored again
                about = near[lo : lo + step] @ far.T
                np.copyto(about, np.float32(1), where=np.isnan(about))
                if not alike:
                    about[q_len[lo : lo + step, None] != v_len[None, :]] = 0
                if len(pos) > 4 * (k + 1):  # of as many runs of vectors the best ones are no worse than this
                    runs = min(max(128, 2 * (k + 1)), len(pos) // 2)
                    most = about[:, : len(pos) // runs * runs].reshape(len(about), runs, -1).max(2)
                    bar = np.partition(most, runs - k - 1, axis=1)[:, runs - k - 1]  # one may be the query itself
                    a, b = np.nonzero(about >= (bar - slack)[:, None])
                else:
                    a, b = (x.ravel() for x in np.indices(about.shape))
                a += lo
                other = qid[a] != pos[b]
                a, b = a[other], b[other]
                norm = q_norm[a] * v_norm[b]
                cosine = np.where(norm == 0, 0.0, _dot(q[a], v[b]) / norm)
                cosine[q_len[a] != v_len[b]] = 0.0
                sim = np.where(np.isnan(cosine), 1.0, np.clip((cosine + 1) / 2, 0.0, 1.0))
                order = np.lexsort((pos[b], -sim, a))
                a, b, sim = a[order], b[order], sim[order]
                keep = np.arange(len(a)) - np.searchsorted(a, a) < k
                parts.append((qid[a[keep]], pos[b[keep]], sim[keep]))
        return pa.table({n: np.concatenate(x) for n, x in zip(empty, zip(*parts))})

    return run


def nearest_vectors(queries: DataFrame, vectors: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """qid, pos, sim ((cosine + 1) / 2 in double precision, as ``cosine01``) and rank of the ``k`` nearest
    other vectors of each query; both tables have id and v, an array of numbers.

    All pairs are scored: each block of queries meets each block of vectors in a task of its own, so
    memory is bounded by ``block``, while work grows with the product of both. Lengths that differ, null and
    zero vectors have a cosine of 0.
    """
    pieces = lambda df: max(1, -(-df.count() // block))
    n, m = pieces(queries), pieces(vectors)
    dealt = lambda df, own, by, all_, other: df.withColumns({own: F.pmod(F.xxhash64("id"), F.lit(by)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(all_ - 1)))})
    left = dealt(queries.select("id", "v"), "i", n, m, "j").groupBy("i", "j")
    right = dealt(vectors.select("id", "v"), "j", m, n, "i").groupBy("i", "j")
    pairs = left.cogroup(right).applyInArrow(_best(k), "qid long, pos long, sim double")
    return top_k(pairs, k, score="sim")
