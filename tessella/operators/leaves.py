"""The best points of many queries, in a task: a region's points in leaves, visited best first."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessella.config import Gate, Matching

#: Points of a leaf; queries that are asked at once; hits after which those beyond the k best are left out.
LEAF, AT_ONCE, HITS = 128, 2048, 1_000_000
#: Below all scores: that of a pair without one, and a bar that isn't there.
NONE = -np.finfo(np.float64).max


def coordinates(columns: Sequence[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """(axes, n): what the rows of a whitening make of the columns, summed as Spark sums it."""
    out = np.zeros((len(rows), len(columns[0]) if len(columns) else 0))
    for i, row in enumerate(rows):
        for w, c in zip(row, columns):
            if w:
                out[i] += float(w) * c
    return out


def passes(gate: Gate) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """``gate_condition`` on arrays."""
    if not gate.enable:
        return lambda q, x: np.ones(np.broadcast_shapes(q.shape, x.shape), bool)
    if gate.mode == "absolute":
        return lambda q, x: np.abs(q - x) <= gate.abs_threshold
    return lambda q, x: np.abs(q - x) / np.maximum(np.abs(x), 1e-9) <= gate.rel_threshold


def _halved(at: np.ndarray) -> np.ndarray:
    """An order of points in which runs of ``LEAF`` lie close together: halved along the widest axis."""
    order, todo = np.arange(at.shape[1]), [(0, at.shape[1])]
    while todo:
        lo, hi = todo.pop()
        leaves = -(-(hi - lo) // LEAF)
        if leaves <= 1 or not len(at):
            continue
        own = at[:, order[lo:hi]]
        half = leaves // 2 * LEAF
        order[lo:hi] = order[lo:hi][np.argpartition(own[own.std(1).argmax()], half)]
        todo += [(lo, lo + half), (lo + half, hi)]
    return order


class Leaves:
    """A region's points: loads, what e adds to a score (NONE without), the rank of their first position,
    and how many positions each of them has at least."""

    def __init__(self, near: np.ndarray, load: np.ndarray, adds: np.ndarray, first: np.ndarray, least: int, gate: Gate, matching: Matching):
        n = len(load)
        w_s, w_e = float(matching.d_weight_s), float(matching.d_weight_e or 0.0)
        axes = [near * np.sqrt(abs(w_s))]
        known = adds[np.isfinite(adds) & (adds != NONE)]
        if w_e and len(known):
            axes.append(np.sqrt(1 / abs(w_e)) * np.clip(adds, known.min(), known.max())[None, :])
        if gate.enable and gate.mode == "absolute" and gate.abs_threshold > 0:
            axes.append(0.3 * load[None, :] / gate.abs_threshold)
        order = _halved(np.nan_to_num(np.concatenate(axes)))
        blocks = -(-n // LEAF)
        self.take = np.concatenate([order, np.repeat(order[-1:], blocks * LEAF - n)]).reshape(blocks, LEAF)
        self.real = (np.arange(blocks * LEAF) < n).reshape(blocks, LEAF)
        self.first, self.least, self.gate, self.w_s = first, least, gate, w_s
        self.load, self.adds = load[self.take], adds[self.take]
        self.loads, self.most = (self.load.min(1), self.load.max(1)), self.adds.max(1)
        self.passes = passes(gate)

    def best(self, x: np.ndarray, q: np.ndarray, q_load: np.ndarray, bar: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, point, similarity) of at most ``k`` points of each query, the best by score, then by first
        position, of those inside the gate with a score of at least its bar; the k best positions are among them."""
        inner = x[:, self.take]
        box = inner.min(2), inner.max(2)
        parts = [self._asked(inner, box, q[:, i : i + AT_ONCE], q_load[i : i + AT_ONCE], bar[i : i + AT_ONCE], k, i) for i in range(0, len(q_load), AT_ONCE)]
        return tuple(np.concatenate(p) for p in zip(*parts)) if parts else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))

    def _bounds(self, box: tuple[np.ndarray, np.ndarray], q: np.ndarray, q_load: np.ndarray) -> np.ndarray:
        """(queries, leaves): no score of a leaf is above it; -inf if all are outside the gate."""
        out = np.zeros((len(q_load), len(self.take)))
        if self.w_s > 0:
            gap, over = np.empty_like(out), np.empty_like(out)
            for v, lo, hi in zip(q, *box):
                np.subtract(lo[None, :], v[:, None], out=gap)
                np.subtract(v[:, None], hi[None, :], out=over)
                np.maximum(gap, over, out=gap)
                np.maximum(gap, 0, out=gap)
                gap *= gap
                out += gap
            out += 1
            np.divide(self.w_s * (1 + 1e-9), out, out=out)
        out += self.most[None, :]
        if self.gate.enable and self.gate.mode == "absolute":
            out[np.maximum(self.loads[0][None, :] - q_load[:, None], q_load[:, None] - self.loads[1][None, :]) > self.gate.abs_threshold] = -np.inf
        return out

    def _asked(self, inner: np.ndarray, box: tuple[np.ndarray, np.ndarray], q: np.ndarray, q_load: np.ndarray, bar: np.ndarray, k: int, offset: int):
        few = -(-k // self.least)  # so many of the best points have k positions
        bar, best = bar.copy(), np.full((len(bar), few), NONE)
        most, ids = self._bounds(box, q, q_load), np.arange(len(bar))
        hits, size = [], 0
        while len(ids):
            at = most.argmax(1)
            rows = np.flatnonzero(most[np.arange(len(ids)), at] >= bar[ids])
            if not len(rows):
                break
            if 2 * len(rows) <= len(ids):
                most, ids, at = most[rows], ids[rows], at[rows]
                rows = np.arange(len(ids))
            own, leaf = ids[rows], at[rows]
            most[rows, leaf] = -np.inf
            s, apart = np.zeros((len(own), LEAF)), np.empty((len(own), LEAF))
            for v, p in zip(q, inner):
                np.take(p, leaf, axis=0, out=apart, mode="clip")
                np.subtract(v[own, None], apart, out=apart)
                apart *= apart
                s += apart
            s += 1
            np.divide(1, s, out=s)
            score = np.multiply(self.w_s, s, out=apart)
            score += self.adds[leaf]
            score[~(self.passes(q_load[own, None], self.load[leaf]) & self.real[leaf])] = -np.inf
            better = np.flatnonzero((score >= bar[own, None]).any(1))
            if not len(better):
                continue
            own, leaf, score, s = own[better], leaf[better], score[better], s[better]
            top = np.concatenate([best[own], score], axis=1)
            top = np.partition(top, top.shape[1] - few, axis=1)[:, -few:]
            best[own], bar[own] = top, np.maximum(bar[own], top[:, 0])
            a, b = np.nonzero(score >= bar[own, None])
            hits.append((own[a], self.take[leaf[a], b], score[a, b], s[a, b]))
            size += len(a)
            if size > HITS:
                hits = [self._few(hits, bar, k)]
                size = len(hits[0][0])
        own, point, _, s = self._few(hits, bar, k)
        return own + offset, point, s

    def _few(self, hits: list, bar: np.ndarray, k: int):
        """The ``k`` best hits of each query that reach its bar."""
        if not hits:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0)
        own, point, score, s = (np.concatenate(h) for h in zip(*hits))
        keep = np.flatnonzero(score >= bar[own])
        keep = keep[np.lexsort((self.first[point[keep]], -score[keep], own[keep]))]
        keep = keep[np.arange(len(keep)) - np.searchsorted(own[keep], own[keep]) < k]
        return own[keep], point[keep], score[keep], s[keep]


def region_search(features: Sequence[str], base: np.ndarray, rows: Sequence[np.ndarray], gate: Gate, matching: Matching, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A function of a region's queries (__id, __preset, q_load, ``q_<feature>``, __bar) and points (load,
    eff_score, the features, __pos): __id, s and the columns of its points, see ``Leaves.best``."""
    w_e = float(matching.d_weight_e or 0.0)
    number = lambda t, c: t[c].cast(pa.float64()).fill_null(0.0).to_numpy()

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        columns = ["load", "eff_score", *features, "__pos"]
        if not asked.num_rows or not held.num_rows:
            return held.slice(0, 0).select(columns).add_column(0, "s", pa.array([], pa.float64())).add_column(0, "__id", pa.array([], pa.int64()))
        positions = held["__pos"].combine_chunks()
        first = pc.rank(pc.list_element(positions, 0), null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int64)
        adds = np.zeros(held.num_rows)
        if w_e:
            adds = w_e * number(held, "eff_score")
            adds[np.isnan(adds)] = np.inf  # NaN is above all numbers
            adds[held["eff_score"].is_null().to_numpy()] = NONE
        values = [number(held, c) for c in features]
        wanted = [number(asked, f"q_{c}") for c in features]
        preset, q_load, bar = asked["__preset"].to_numpy(), number(asked, "q_load"), asked["__bar"].cast(pa.float64()).fill_null(NONE).to_numpy()
        with np.errstate(all="ignore"):
            leaves = Leaves(coordinates(values, base), number(held, "load"), adds, first, int(pc.min(pc.list_value_length(positions)).as_py()), gate, matching)
            found = []
            for p in np.unique(preset):
                own = np.flatnonzero(preset == p)
                q, point, s = leaves.best(coordinates(values, rows[p]), coordinates([v[own] for v in wanted], rows[p]), q_load[own], bar[own], k)
                found.append((own[q], point, s))
        q, point, s = (np.concatenate(f) for f in zip(*found))
        out = held.select(columns).take(pa.array(point))
        return out.add_column(0, "s", pa.array(s)).add_column(0, "__id", asked["__id"].take(pa.array(q)))

    return run
