"""Exact Jaccard join of word shingle sets, with signature trees.

Texts with equal sets are one class, of which one row goes on. Sets are ordered by (hot, hash),
where hot marks shingles frequent in a bounded hashed sample: that only moves work. Of two sets
with a Jaccard similarity of 3/4, the one whose prefix ends first shares ``1 + n / 10`` shingles
of its prefix with the other's, if prefixes are a tenth longer than the first quarter. So each
row may leave out the ``3 n / 80`` shared shingles that most rows have, and rows still meet:

1. Of each row the remaining shingle with most rows names its bucket, and the row brings its
   whole set there. In a bucket signature trees are built, one for each two neighbouring bands of
   sizes: leaves hold a bitmap of their set, nodes the OR of their children's and size ranges. A
   dual traversal drops node pairs whose largest possible overlap is too small for their smallest
   sizes; pairs of leaves that are left, and not yet connected, are compared exactly. A bucket
   with many rows is dealt out to several tasks.
2. Components of the links so far. Under every remaining shingle that ``MANY`` rows have, of two
   or more components, ``PICKED`` rows of each component meet; the same trees give the most similar
   pairs that would join them, fewer than there are components. Those are compared exactly, and
   the components joined, in ``TURNS`` turns. This only saves work.
3. Under the shingles that still have rows of two or more components, the trees give all pairs of
   rows of different components that could link, by blocks of rows, so that no task has a whole
   large bucket. Each is compared exactly, and the components are final.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.components import connected_components, joined_components
from tessella.llm.shared import SPACE, arrow_map, joined_bytes, keep, mixed, release, slices, table, text_of, unused

SHINGLE_WORDS = 5
#: Similarity as a fraction of whole numbers: 75 of 100.
PART, WHOLE = 75, 100
#: Of each set's size: what prefixes have beyond the first quarter, and what rows may leave out.
LONGER, LEFT_OUT = 10, 3.75
#: Rows, and shingles of all of them, that one task compares at once, if there is more than one row.
FAN, BUCKET_ROWS, BUCKET_SHINGLES = 16, 2048, 2 << 20
#: The more bits, the nearer to the threshold are the pairs that have to be compared exactly.
BITS_PER_SHINGLE = 8
#: Characters hashed at once, with some 50 bytes of arrays each, and bytes of bitmaps compared at once.
AT_ONCE, COMPARED_BYTES = 1 << 18, 4 << 20
#: Step 2: its turns, rows of each component, and rows of the buckets it is for; ratio of sizes of a band.
TURNS, PICKED, MANY, BAND = 2, 6, 64, 3.2
SAMPLE_ROWS, HOT_IN_SAMPLE, HOT_AT_MOST = 5_000, 10, 200_000

#: Buckets of fewer rows than triangles, with so many pairs at most, are compared without a tree.
DIRECT_PAIRS, _TRIANGLES = 48, [np.triu_indices(n, 1) for n in range(48)]

_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all texts in order, and how many each has."""
    data, offsets = joined_bytes(texts)
    data = _LOWER[data]
    inside = ~_IS_SPACE[data]
    before = np.concatenate(([False], inside[:-1])) if len(inside) else inside
    begins_text = np.zeros(len(data) + 1, bool)
    begins_text[offsets] = True
    starts = np.flatnonzero(inside & (~before | begins_text[:-1]))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    after = np.concatenate((inside[1:], [False]))
    ends = np.flatnonzero(inside & (~after | begins_text[1:])) + 1
    counts = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    # a word's hash: its bytes plus one times falling powers, by running sums of inverse powers
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    running = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(inverse, len(data)))))
    return mixed((running[ends] - running[starts]) * _powers(_BASE, len(data))[starts]), counts


def shingle_sets(texts, k: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's ``k``-word shingles; of fewer words the whole
    sequence is one, of none the set is empty."""
    out: list[np.ndarray] = []
    for lo, hi in slices(texts, AT_ONCE):
        words, counts = word_hashes(texts[lo:hi])
        rolled = np.zeros(max(0, len(words) - k + 1), np.uint64)
        for j in range(k):
            rolled = rolled * _BASE + words[j : j + len(rolled)]
        rolled = mixed(rolled)
        at = 0
        for n in counts.tolist():
            if n >= k:
                out.append(np.unique(rolled[at : at + n - k + 1]))
            elif n:
                h = np.uint64(n)
                with np.errstate(over="ignore"):
                    for w in words[at : at + n]:
                        h = h * _BASE + w
                out.append(mixed(np.array([h])))
            else:
                out.append(np.zeros(0, np.uint64))
            at += n
    return out


def prefix_length(n: int) -> int:
    return n - -(-n * PART // WHOLE) + 1 + n * LONGER // WHOLE if n else 0


def prefix(tokens: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order (hot, hash)."""
    p = prefix_length(len(tokens))
    if not len(hot):
        return tokens[:p]
    at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
    is_hot = hot[at] == tokens
    cold = tokens[~is_hot]
    return cold[:p] if len(cold) >= p else np.concatenate((cold, tokens[is_hot][: p - len(cold)]))


def links_of(overlap, n, m, part: int = PART):
    """Whether sets of ``n`` and ``m`` with that overlap are similar enough."""
    return WHOLE * overlap >= part * (n + m - overlap)


class SignatureTree:
    """Bitmaps of sets, and OR-combined bitmaps with size ranges of groups of ``FAN`` of them.
    ``labels`` are the sets' components, which ``relabel`` may lower: node pairs within one
    component are of no interest."""

    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray, labels: np.ndarray):
        self.sizes = sizes
        #: More shingles than bits: so many may hide behind bits that two sets share.
        hidden = sizes - np.bitwise_count(bitmaps).sum(1, dtype=np.int64)
        self.levels = [(bitmaps, sizes, sizes, hidden)]
        while len(self.levels[-1][0]) > FAN:
            b, lo, hi, hid = self.levels[-1]
            edges = np.arange(0, len(b), FAN)
            self.levels.append((np.bitwise_or.reduceat(b, edges), np.minimum.reduceat(lo, edges), np.maximum.reduceat(hi, edges), np.maximum.reduceat(hid, edges)))
        self.relabel(labels)

    def relabel(self, labels: np.ndarray) -> None:
        self.labels = [(labels, labels)]
        for b, *_ in self.levels[1:]:
            lo, hi = self.labels[-1]
            edges = np.arange(0, len(lo), FAN)
            self.labels.append((np.minimum.reduceat(lo, edges), np.maximum.reduceat(hi, edges)))

    def overlap(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The largest possible overlap of sets under the nodes."""
        bits, _, hi, hidden = self.levels[level]
        overlap = np.bitwise_count(bits[a] & bits[b]).sum(1, dtype=np.int64) + np.minimum(hidden[a], hidden[b])
        return np.minimum(overlap, np.minimum(hi[a], hi[b]))

    def possible(self, level: int, a: np.ndarray, b: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
        """The node pairs that may hold similar sets of different components."""
        _, lo, hi, _ = self.levels[level]
        least, most = self.labels[level]
        ok = (hi[a] * WHOLE >= lo[b] * part) & (hi[b] * WHOLE >= lo[a] * part)
        ok &= (least[a] != most[a]) | (least[b] != most[b]) | (least[a] != least[b])
        a, b = a[ok], b[ok]
        overlap = self.overlap(level, a, b)
        ok = WHOLE * overlap >= part * (lo[a] + lo[b] - overlap)
        return a[ok], b[ok]

    def pairs(self, part: int = PART) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of leaves a < b that the bounds leave, a chunk of node pairs at a time."""
        chunk = max(FAN * FAN, min(1 << 14, COMPARED_BYTES // max(1, self.levels[0][0].shape[1] * 8)))
        top = len(self.levels) - 1
        a, b = np.triu_indices(len(self.levels[top][0]))
        stack = [(top, a[i : i + chunk], b[i : i + chunk]) for i in range(0, len(a), chunk)][::-1]
        while stack:
            level, a, b = stack.pop()
            a, b = self.possible(level, a, b, part)
            if not level:
                own = a < b
                yield a[own], b[own]
                continue
            below = len(self.levels[level - 1][0])
            child, step = np.arange(FAN), chunk // (FAN * FAN)
            for i in reversed(range(0, len(a), step)):
                x = (a[i : i + step, None, None] * FAN + child[None, :, None]).repeat(FAN, 2).ravel()
                y = (b[i : i + step, None, None] * FAN + child[None, None, :]).repeat(FAN, 1).ravel()
                fine = (x < below) & (y < below) & (x <= y)
                stack.append((level - 1, x[fine], y[fine]))


def bits_for(n: int, per: int = BITS_PER_SHINGLE) -> int:
    """Bits of the bitmaps for sets up to ``n``: a power of two of ``per`` a shingle, 256 at least."""
    return max(256, 1 << (per * max(1, n) - 1).bit_length())


def bitmap(tokens: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits // 8, np.uint8)
    at = (tokens & np.uint64(bits - 1)).astype(np.int64)
    np.bitwise_or.at(out, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    return out.view(np.uint64)


def folded(raw: bytes, bits: int) -> np.ndarray:
    """A bitmap as the bitmap of fewer bits that the same set has."""
    x = np.frombuffer(raw, np.uint64)
    while len(x) * 64 > bits:
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    return x


def trees(sizes: np.ndarray, bitmaps: list[np.ndarray], labels: np.ndarray, per: int = BITS_PER_SHINGLE) -> Iterator[tuple[SignatureTree, np.ndarray]]:
    """Trees that together hold all pairs of sets whose sizes allow the similarity: one for each
    two neighbouring bands of sizes, with bitmaps for sets of that size. With each tree come the
    places of its leaves; a component's sets stand together, and sets with equal first bits."""
    band = bands(sizes)
    for k in np.unique(band):
        own = np.flatnonzero((band == k) | (band == k + 1))
        if len(own) > 1 and labels[own].min() != labels[own].max():
            bits = bits_for(int(sizes[own].min()), per)
            maps = np.stack([folded(bitmaps[i], bits) for i in own])
            _, of, count = np.unique(labels[own], return_inverse=True, return_counts=True)
            order = np.lexsort((*maps.T[3::-1], np.where(count[of] > 1, labels[own], -1)))
            yield SignatureTree(maps[order], sizes[own][order], labels[own][order]), own[order]


def bands(sizes: np.ndarray, step: float = WHOLE / PART) -> np.ndarray:
    """Sets of similar size are in the same band or in neighbouring ones."""
    return np.floor(np.log(sizes) / np.log(step) + 1e-9).astype(np.int64)


class _Labels:
    """Components of rows 0 to n - 1, given some already."""

    def __init__(self, labels: np.ndarray):
        _, first, of = np.unique(labels, return_index=True, return_inverse=True)
        self.up = first[of].tolist()

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        x, y = self.root(i), self.root(j)
        self.up[max(x, y)] = min(x, y)
        return x != y

    def all(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.up))])


def _in_bucket(ids: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links of one bucket."""
    sizes, found, joined = np.array([len(s) for s in sets], np.int64), [], _Labels(np.arange(len(ids)))
    for tree, place in trees(sizes, [bitmap(s, bits_for(len(s))) for s in sets], joined.all()):
        tree.relabel(joined.all()[place])
        for a, b in tree.pairs():
            apart = tree.labels[0][0][a] != tree.labels[0][0][b]
            for i, j in zip(place[a[apart]].tolist(), place[b[apart]].tolist()):
                if joined.root(i) != joined.root(j) and links_of(len(np.intersect1d(sets[i], sets[j], assume_unique=True)), len(sets[i]), len(sets[j])):
                    joined.join(i, j)
                    found.append((int(ids[i]), int(ids[j])))
            if apart.any():
                tree.relabel(joined.all()[place])
    return found


def _grouped(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Whole groups of consecutive rows with equal keys, of batches sorted by them, as columns."""
    rest: list[dict[str, np.ndarray]] = []
    whole = lambda parts: parts[0] if len(parts) == 1 else {c: np.concatenate([x[c] for x in parts]) for c in parts[0]}
    for batch in batches:
        if not len(batch):
            continue
        columns = {c: batch[c].to_numpy() for c in batch.columns}
        changes = np.zeros(len(batch), bool)
        for k in keys:
            v = columns[k]
            changes[1:] |= v[1:] != v[:-1]
            changes[0] |= bool(rest) and rest[-1][k][-1] != v[0]
        if rest and changes[0]:
            yield whole(rest)
            rest = []
        edges = [0, *np.flatnonzero(changes[1:]) + 1, len(batch)]
        for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
            rest.append({c: v[lo:hi] for c, v in columns.items()})
            if i < len(edges) - 2:
                yield whole(rest)
                rest = []
    if rest:
        yield whole(rest)


def _link_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for group in _grouped(batches, ["h", "salt"]):
        if len(group["rep"]) > 1:
            found = _in_bucket(group["rep"], [np.frombuffer(t, np.uint64) for t in group["tokens"]])
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])


def few_pairs(sizes: np.ndarray, raw: np.ndarray, apart: np.ndarray) -> list[tuple[float, int, int]] | None:
    """Candidates (likeness, i, j) of a small bucket, pair by pair; None if there are many pairs
    to look at. ``apart`` (i, j) tells which pairs are of interest."""
    i, j = _TRIANGLES[len(sizes)]
    ok = apart[i, j] & (sizes[i] * WHOLE >= sizes[j] * PART) & (sizes[j] * WHOLE >= sizes[i] * PART)
    if np.count_nonzero(ok) > DIRECT_PAIRS:
        return None
    out = []
    for a, b in zip(i[ok].tolist(), j[ok].tolist()):
        x, y, n, m = np.frombuffer(raw[a], np.uint64), np.frombuffer(raw[b], np.uint64), int(sizes[a]), int(sizes[b])
        bits = 64 * min(len(x), len(y))
        x, y = folded(raw[a], bits), folded(raw[b], bits)
        both = int(np.bitwise_count(x & y).sum(dtype=np.int64))
        both += min(n - int(np.bitwise_count(x).sum(dtype=np.int64)), m - int(np.bitwise_count(y).sum(dtype=np.int64)))
        both = min(both, n, m)
        if links_of(both, n, m):
            out.append((both / (n + m), a, b))
    return out


def _spanning_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each bucket, candidates that would join its components if they all were links: at most
    one fewer than there are components, the most similar by their bitmaps first."""
    found = []
    for group in _grouped(batches, ["h", "band", "salt"]):
        sizes, ids, comps, raw = group["n"], group["rep"], group["component"], group["bitmap"]
        joined = _Labels(comps)
        few = few_pairs(sizes, raw, comps[:, None] != comps[None, :]) if len(ids) < len(_TRIANGLES) else None
        if few is not None:
            found += [(ids[i], ids[j]) for _, i, j in sorted(few, key=lambda t: -t[0]) if joined.join(i, j)]
            continue
        maps = [np.frombuffer(m, np.uint64) for m in raw]
        for part in (92, 84, PART):
            for tree, place in trees(sizes, maps, joined.all()):
                tree.relabel(joined.all()[place])
                for a, b in tree.pairs(part):
                    order = np.argsort(-tree.overlap(0, a, b) / (tree.sizes[a] + tree.sizes[b]), kind="stable")
                    new = [(i, j) for i, j in zip(place[a[order]].tolist(), place[b[order]].tolist()) if joined.join(i, j)]
                    if new:
                        found += [(ids[i], ids[j]) for i, j in new]
                        tree.relabel(joined.all()[place])
    yield _both_ways(found)


def _both_ways(found: list[tuple[int, int]]) -> pd.DataFrame:
    out = np.array(found, np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": out.min(1), "b": out.max(1)})


def _first_shared(group: dict[str, np.ndarray]):
    """Whether a group's bucket is the first that a pair of its rows shares: of a numbered table whose
    key is a pair of half keys, the one with the smallest numbers of equal half keys. So a pair is
    compared in one bucket, however many it shares. None where there are no such tables."""
    if "halves" not in group:
        return None
    halves = np.stack([np.frombuffer(x, np.uint32) for x in group["halves"]])
    count = halves.shape[1] // 2
    i, j = divmod(int(group["slot"][0]), count)

    def first(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        earlier = (halves[a, :i] == halves[b, :i]).any(1)
        return ~(earlier | (halves[a, count : count + j] == halves[b, count : count + j]).any(1))

    return first


def _all_pairs(per: int):
    """Of two blocks of a bucket, or one with itself, all candidates of different components."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = []
        for group in _grouped(batches, ["h", "band", "i", "j"]):
            sizes, ids, comps, sides, raw = group["n"], group["rep"], group["component"], group["side"], group["bitmap"]
            alone, first, few = group["i"][0] == group["j"][0], _first_shared(group), None
            if len(ids) < len(_TRIANGLES):
                few = few_pairs(sizes, raw, (comps[:, None] != comps[None, :]) & (alone | (sides[:, None] != sides[None, :])))
            if few is not None:
                found += [(ids[i], ids[j]) for _, i, j in few if first is None or first(np.array([i]), np.array([j]))[0]]
                continue
            for tree, place in trees(sizes, [np.frombuffer(m, np.uint64) for m in raw], comps, per):
                for a, b in tree.pairs():
                    x, y = place[a], place[b]
                    other = (comps[x] != comps[y]) & (alone | (sides[x] != sides[y]))
                    if first is not None:
                        x, y = x[other], y[other]
                        other = first(x, y)
                    if other.any():
                        yield pd.DataFrame({"a": np.minimum(ids[x[other]], ids[y[other]]), "b": np.maximum(ids[x[other]], ids[y[other]])})
        yield _both_ways(found)

    return run


def _hot_shingles(spark: SparkSession, docs: DataFrame) -> list[tuple[int, int]]:
    """Shingles of many rows of a hashed sample of about ``SAMPLE_ROWS``, at most ``HOT_AT_MOST``
    of them, with how many rows have each by that sample."""
    rows, parts = docs.count(), 1 << 40
    share = min(1.0, SAMPLE_ROWS / max(1, rows))
    picked = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < math.ceil(share * parts))

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for lo, hi in slices(texts, AT_ONCE):
                if found := shingle_sets(texts[lo:hi]):
                    h, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pd.DataFrame({"h": h.view(np.int64), "n": n})

    counted = picked.mapInPandas(explode, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= HOT_IN_SAMPLE)
    return [(r["h"], math.ceil(r["n"] / share)) for r in counted.orderBy(F.desc("n"), "h").limit(HOT_AT_MOST).collect()]


def _summaries(docs: DataFrame, hot: Broadcast) -> DataFrame:
    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = batch["text"].to_pylist()
        for lo, hi in slices(texts, AT_ONCE):
            sets = shingle_sets(texts[lo:hi])
            key = [(np.bitwise_xor.reduce(mixed(s)).view(np.int64), np.add.reduce(mixed(s ^ _BASE)).view(np.int64)) if len(s) else (0, 0) for s in sets]
            yield {
                "doc_id": batch["doc_id"][lo:hi], "n": [len(s) for s in sets], "key1": [int(k[0]) for k in key], "key2": [int(k[1]) for k in key],
                "prefix": [prefix(s, hot.value).view(np.int64) for s in sets],
            }

    return arrow_map(docs, run, "doc_id long, n long, key1 long, key2 long, prefix array<long>")


def _whole_sets(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for lo, hi in slices(texts, AT_ONCE):
                sets = shingle_sets(texts[lo:hi], k)
                yield pd.DataFrame({"rep": batch["rep"].iloc[lo:hi].array, "tokens": [t.tobytes() for t in sets], **{c: batch[c].iloc[lo:hi].array for c in batch.columns if c not in ("rep", "text")}})

    return run


def _bitmaps(k: int, per: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _whole_sets(k)(batches):
            sets = [np.frombuffer(t, np.uint64) for t in batch["tokens"]]
            yield pd.DataFrame({"rep": batch["rep"], "n": [len(t) for t in sets], "bitmap": [bitmap(t, bits_for(len(t), per)).tobytes() for t in sets], **{c: batch[c] for c in ("halves",) if c in batch.columns}})

    return run


def _verified(part: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hit = [links_of(len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)), len(x) // 8, len(y) // 8, part) for x, y in zip(batch["tokens_a"], batch["tokens_b"])]
            yield batch[["a", "b"]][np.array(hit, bool)]

    return run


def _with_bitmaps(own: DataFrame, placed: DataFrame, k: int, per: int) -> DataFrame:
    more, kind = (["halves"], ", halves binary") if "halves" in own.columns else ([], "")
    marks = own.join(placed.select("rep").distinct(), F.col("doc_id") == F.col("rep")).select("rep", "text", *more).mapInPandas(_bitmaps(k, per), f"rep long, n long, bitmap binary{kind}")
    return placed.join(marks, "rep")


def _slot(buckets: DataFrame) -> list[str]:
    """The column that numbers tables, where buckets are of numbered tables."""
    return ["slot"] if "slot" in buckets.columns else []


def _first_bucket(slot: list[str]) -> Column:
    return F.min_by("h", "slot") if slot else F.min("h")


def _placed(buckets: DataFrame, components: DataFrame) -> DataFrame:
    """(rep, size, h, band, component): the rows of the buckets' bands of sizes. Rows at a band's edge are
    in the next band too."""
    edge = lambda n: F.floor(F.log(n) / math.log(BAND)).cast("int")
    banded = F.explode(F.array_distinct(F.array(edge(F.col("n")), edge(F.col("n") * (WHOLE / PART + 0.01))))).alias("band")
    return buckets.join(components, F.col("rep") == F.col("node"), "left").select("rep", F.col("n").alias("size"), "h", *_slot(buckets), banded, F.coalesce("component", "rep").alias("component"))


def _per_component(placed: DataFrame, turn: int) -> DataFrame:
    """Of each bucket's band a row for each component: how many rows (m) of which sizes (s), hashes of
    them all (x, y) and a few of them (reps), others in each turn."""
    rows = [F.count(F.lit(1)).alias("m"), F.sum("size").alias("s"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"), *[F.min(c).alias(c) for c in _slot(placed)]]
    picks = [F.min_by("rep", F.xxhash64("rep", F.lit(turn * PICKED + i))) for i in range(PICKED)]
    return placed.groupBy("h", "band", "component").agg(*rows, F.array_distinct(F.array(*picks)).alias("reps"))


def _open(members: DataFrame, least: int) -> DataFrame:
    """(of, in, components, top, others, tops): a row for each bucket's band that has ``least`` or more rows, of
    two or more components; top is the largest, and others and tops are the blocks for the rest and for it. Of
    bands with the same rows under several shingles one stays, that of the smallest slot if there are slots."""
    slot = _slot(members)
    rows = [F.sum("m").alias("m"), F.sum("s").alias("s"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), *[F.min(c).alias(c) for c in slot]]
    several = members.groupBy("h", "band").agg(*rows, F.count(F.lit(1)).alias("components"), F.max(F.struct("m", "component", "s")).alias("top")).filter((F.col("m") >= least) & (F.col("components") > 1))
    one = several.groupBy("band", "m", "x", "y").agg(_first_bucket(slot).alias("of"), F.max(F.struct("components", "s", "top")).alias("t"))
    own = one.select("of", F.col("band").alias("in"), "t.components", F.col("t.top.component").alias("top"), F.col("t.top.m").alias("top_m"), F.col("t.top.s").alias("top_s"), (F.col("m") - F.col("t.top.m")).alias("rest"), (F.col("t.s") - F.col("t.top.s")).alias("rest_s"))
    return own.select("of", "in", "components", "top", _blocks("rest", "rest_s").alias("others"), _blocks("top_m", "top_s").alias("tops"))


def _blocks(rows: str, shingles: str) -> Column:
    """Blocks to deal rows to, so that none has many rows or shingles."""
    return F.greatest(F.floor(F.col(rows) / BUCKET_ROWS), F.floor(F.col(shingles) / BUCKET_SHINGLES)).cast("long") + 1


def _likely_candidates(own: DataFrame, members: DataFrame, bands: DataFrame, width: int, turn: int, k: int, per: int) -> DataFrame:
    """(a, b): per open band pairs that would join its components, of a few rows of each."""
    salt = F.pmod(F.xxhash64("component", F.lit(turn)), F.expr(f"components div {BUCKET_ROWS} + 1")).alias("salt")
    few = members.join(bands, (F.col("h") == F.col("of")) & (F.col("band") == F.col("in"))).select("h", "band", "component", salt, F.explode("reps").alias("rep"))
    few = keep(few, "picked")
    met = _with_bitmaps(own, few, k, per).repartition(width, "h", "band", "salt").sortWithinPartitions("h", "band", "salt")
    out = keep(met.mapInPandas(_spanning_pairs, "a long, b long").distinct(), "likely")
    release(few)
    return out


def _all_candidates(own: DataFrame, placed: DataFrame, bands: DataFrame, width: int, k: int, per: int) -> DataFrame:
    """(a, b): per open band all pairs of rows of different components that the bitmaps leave.

    The rows of a band's largest component and all others are dealt to blocks; a block of others
    meets every block, blocks of the largest component don't meet each other.
    """
    rows = placed.join(bands, (F.col("h") == F.col("of")) & (F.col("band") == F.col("in"))).withColumn("major", F.col("component") == F.col("top"))
    rows = rows.withColumn("block", F.when(F.col("major"), F.col("others") + F.pmod(F.xxhash64("rep"), "tops")).otherwise(F.pmod(F.xxhash64("rep"), "others")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("major"), F.col("others") - 1).otherwise(F.col("others") + F.col("tops") - 1))))
    rows = rows.select("rep", "h", *_slot(placed), "band", "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("other") < F.col("block")).cast("int").alias("side"))
    met = _with_bitmaps(own, rows, k, per).repartition(width, "h", "band", "i", "j").sortWithinPartitions("h", "band", "i", "j")
    return keep(met.mapInPandas(_all_pairs(per), "a long, b long").distinct(), "candidates")


def _verify(own: DataFrame, pairs: DataFrame, k: int, part: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar, as a table of their own."""
    ends = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    tokens = keep(own.join(ends, F.col("doc_id") == F.col("rep")).select("rep", "text").mapInPandas(_whole_sets(k), "rep long, tokens binary"), "tokens")
    checked = pairs.join(tokens.withColumnsRenamed({"rep": "ra", "tokens": "tokens_a"}), F.col("a") == F.col("ra")).join(tokens.withColumnsRenamed({"rep": "rb", "tokens": "tokens_b"}), F.col("b") == F.col("rb"))
    out = keep(checked.select("a", "b", "tokens_a", "tokens_b").mapInPandas(_verified(part), "a long, b long"), "found")
    release(tokens)
    return out


def alike_buckets(meetings: DataFrame) -> DataFrame:
    """Of buckets (rep, n, h) those with several rows; of buckets with exactly the same rows one, that
    of the smallest slot if there are slots."""
    slot = _slot(meetings)
    alike = meetings.groupBy("h").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"), *[F.min(c).alias(c) for c in slot]).filter("size > 1")
    alike = keep(alike.groupBy("size", "x", "y").agg(_first_bucket(slot).alias("bucket")).select("bucket"), "alike")
    return meetings.join(alike, F.col("h") == F.col("bucket"), "left_semi")


def joined_in_buckets(own: DataFrame, buckets: DataFrame, components: DataFrame, k: int = SHINGLE_WORDS, part: int = PART, per: int = BITS_PER_SHINGLE) -> DataFrame:
    """``components`` after all links between rows of ``own`` (doc_id, text) that share a bucket
    (rep, n, h): steps 2 and 3."""
    width = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for turn in range(TURNS + 1):
        placed = _placed(buckets, components)
        members = keep(_per_component(placed, turn), "members")
        bands = keep(_open(members, 2 if turn == TURNS else MANY), "open")
        if not bands.head(1):
            release(members, bands)
            continue
        tried = _all_candidates(own, placed, bands, width, k, per) if turn == TURNS else _likely_candidates(own, members, bands, width, turn, k, per)
        more = _verify(own, tried, k, part)
        release(members, bands, tried)
        if more.head(1):
            components = keep(joined_components(components, more), "components")
    return components


def named_rows(rows: DataFrame, classes: DataFrame, components: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of rows (doc_id, n, key1, key2), whose classes are a table
    of their own, so that Spark can split one with many rows."""
    sets = classes.select(F.col("key1").alias("k1"), F.col("key2").alias("k2"), F.col("n").alias("size"), "rep")
    members = rows.filter("n > 0 and doc_id is not null").select("doc_id", "n", "key1", "key2").join(sets, (F.col("key1") == F.col("k1")) & (F.col("key2") == F.col("k2")) & (F.col("n") == F.col("size")))
    named = members.join(components, F.col("rep") == F.col("node"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    return named.unionByName(rows.filter("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links of a
    Jaccard similarity of 3/4 or more, its own included).

    Null and empty texts have an empty set, linked with nothing, not even each other. Rows with
    a null doc_id are scored but neither link nor name a component (component_id null). Rows
    that repeat a doc_id count as one document if their texts' sets are equal; else each row
    links by its own text under that id. Other columns are ignored; no rows give none.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found_hot = _hot_shingles(spark, own)
    hot = spark.sparkContext.broadcast(np.sort(np.array([h for h, _ in found_hot], np.int64).view(np.uint64)))
    hot_rows = F.broadcast(spark.createDataFrame(found_hot, "hot_h long, hot_members long"))  # HOT_AT_MOST at most
    rows = keep(_summaries(own, hot), "sets")
    classes = keep(rows.filter("n > 0 and doc_id is not null").groupBy("key1", "key2", "n").agg(F.min("doc_id").alias("rep"), F.min_by("prefix", "doc_id").alias("prefix")), "classes")
    entries = classes.select("rep", "n", F.explode("prefix").alias("h")).join(hot_rows, F.col("h") == F.col("hot_h"), "left")
    cold = entries.filter("hot_h is null").select("rep", "n", "h")
    counted = keep(cold.groupBy("h").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select(F.col("h").alias("of"), "members"), "counted")
    met = cold.join(counted, F.col("h") == F.col("of")).select("rep", "n", "h", "members")
    shared = met.unionByName(entries.filter("hot_h is not null").select("rep", "n", "h", F.col("hot_members").alias("members")))
    place = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("members"), "h"))
    left_out = F.floor(F.col("n") * LEFT_OUT / WHOLE)
    meetings = keep(shared.withColumn("place", place - left_out).filter("place > 0").select("rep", "n", "h", "members"), "meetings")
    buckets = keep(alike_buckets(meetings), "buckets")

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    best = keep(buckets.groupBy("rep", "n").agg(F.max(F.struct("members", "h")).alias("best")).select("rep", "n", F.col("best.h").alias("h")), "best")
    dealt = keep(best.groupBy("h").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("s")).filter("rows > 1").select(F.col("h").alias("of"), _blocks("rows", "s").alias("blocks")), "dealt")
    named = best.join(dealt, F.col("h") == F.col("of")).select("rep", "h", F.pmod(F.xxhash64("rep"), "blocks").alias("salt"))
    shipped = own.join(named, F.col("doc_id") == F.col("rep")).select("rep", "text", "h", "salt").mapInPandas(_whole_sets(SHINGLE_WORDS), "rep long, tokens binary, h long, salt long")
    links = keep(shipped.repartition(width, "h", "salt").sortWithinPartitions("h", "salt").mapInPandas(_link_buckets, "a long, b long").distinct(), "found")
    release(meetings, counted, best, dealt)
    components = joined_in_buckets(own, buckets, keep(connected_components(links), "components"))
    return named_rows(rows, classes, components)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is their component's smallest, and rows without id. Of rows
    that share such an id and the sequence of lower-cased words one stays; unlike texts under one id
    all stay."""
    leader, row = unused(docs, "leader"), unused(docs, "row")
    leaders = jaccard_components(docs).filter("doc_id = component_id").select(F.col("doc_id").alias(leader)).distinct()
    words = F.trim(F.regexp_replace(F.translate(text_of("text"), ascii_uppercase, ascii_lowercase), f"[{SPACE}]+", " "))
    own = docs.filter("doc_id is not null").withColumn(row, F.struct(F.col("doc_id").cast("long"), F.sha2(words, 256)))
    return own.join(leaders, own["doc_id"] == leaders[leader], "left_semi").dropDuplicates([row]).drop(row).unionByName(docs.filter("doc_id is null"))


def op7_query(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(c) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
"""
