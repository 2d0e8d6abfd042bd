"""Hierarchical Pitman-Yor bigram model, sampled and scored on Spark.

Every word is a context of its own, as is a text's start: a Chinese restaurant whose dishes are the
words after it. All share the unigram restaurant as parent, whose base is uniform over the
vocabulary and one unknown word.

Words of a hashed sample that are frequent in it, at most ``CONTEXTS`` - 1, are known by small
numbers; that only moves work. A pair (context, word) is kept where its word belongs, by a hash;
of a frequent word where its context belongs; of two frequent ones by a hash of both. So neither
a word nor a context with many pairs is one task. Pairs travel as packed arrays, by buckets:

1. Pairs are counted. Then ``rounds`` passes. In each, ``SWEEPS`` times, all customers of a word
   in a context leave and are seated again at once: their number of tables is drawn from its exact
   conditional distribution (see ``Seating``), given the context's tables as of the pass before;
   then the parent's, whose customers are those tables, the same way (of frequent words: between
   passes). Between passes the totals of contexts and frequent words are summed where these belong,
   and sent back to the buckets that have pairs of them.
2. The last ``SAMPLES`` sweeps of the last pass are samples. Each has its own totals, so its
   predictive probabilities sum to 1 in every context; scores are of the averages over samples.
3. To score, tokens go to their pair's bucket. Those of two rare words get the word's part there,
   and go on to the context's bucket. The most frequent pairs are scored where the text is.

Words are known by 63 bits of a hash, pairs within a bucket by 64.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.jaccard_join import AT_ONCE, word_hashes
from tessella.llm.shared import arrow_map, keep, mixed, release, slices, table, text_of

#: Contexts and words that the driver holds totals of: the start (as a word, the end) and frequent words.
CONTEXTS = 1 << 16
DISCOUNT, STRENGTH, PARENT_DISCOUNT, PARENT_STRENGTH = 0.8, 2.0, 0.6, 5.0
SWEEPS, SAMPLES, ROUNDS, SEED = 4, 3, 2, 11
EXACT_UP_TO = 1024
#: Pairs that scoring has at hand, at most; texts of the sample; characters of training texts a bucket.
FREQUENT, SAMPLE_ROWS, BUCKET_CHARS = 4_000_000, 8_000, 8_000_000
FOLDS, HELD_OUT_FOLD = 7, 2
COUNT_AT_ONCE, CELLS = 500_000, 2_000_000
#: Pairs in a row: arrays of half a megabyte or more would lie in regions of their own in the JVM.
PIECE = 48_000
#: Packed arrays are kept with a codec that needs less room.
_PACKED = {"spark.sql.parquet.compression.codec": "zstd"}
_RARE, _BITS, _LOW = np.uint64(1 << 63), np.uint64(16), np.uint64(CONTEXTS - 1)
_INFO = np.dtype([("id", "i8"), ("null", "u1"), ("held", "u1"), ("n", "i8"), ("known", "i8"), ("base", "f8"), ("score", "f8")])
_SUMS = np.dtype([("doc", "u4"), ("known", "u4"), ("base", "f8"), ("score", "f8")])


def tokens(texts, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens of the texts, each text's end included: words and the words before; and how many
    each text has. Words of ``hot`` are their place in it, from 1; 0 is the end, and the start."""
    words, counts = word_hashes(texts)
    code = words | _RARE
    if len(hot):
        at = np.minimum(np.searchsorted(hot, words), len(hot) - 1)
        code = np.where(hot[at] == words, at.astype(np.uint64) + np.uint64(1), code)
    word = np.zeros(len(words) + len(counts), np.uint64)
    inner = np.ones(len(word), bool)
    inner[np.cumsum(counts + 1) - 1] = False
    word[inner] = code
    before = np.zeros_like(word)
    before[1:] = word[:-1]
    return word, before, counts + 1


def _pair(word: np.ndarray, before: np.ndarray) -> np.ndarray:
    return mixed(word * np.uint64(0x9E3779B97F4A7C15) + mixed(before + np.uint64(0x5EED)))


def _owner(word: np.ndarray, before: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each pair."""
    key = np.where(word >= _RARE, word, before)
    both = key < _RARE
    key[both] = _pair(word[both], before[both])
    return (key % np.uint64(buckets)).astype(np.int64)


def _dealt(owner: np.ndarray, *columns: np.ndarray) -> tuple[list, list[list[bytes]]]:
    """The columns cut by owner, in order: owners, and each column's pieces."""
    if not len(owner):
        return [], [[] for _ in columns]
    order = np.argsort(owner.astype(np.uint16) if owner.max() < 1 << 16 else owner, kind="stable")
    owner = owner[order]
    cuts = np.flatnonzero(owner[1:] != owner[:-1]) + 1
    return owner[np.concatenate(([0], cuts))].tolist(), [[p.tobytes() for p in np.split(c[order], cuts)] for c in columns]


def _joined(column, kind) -> np.ndarray:
    """The packed arrays of a column's rows, nulls left out, as one."""
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x is not None), kind)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal keys the place of one, and the sum of n; by key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return order[edges], np.add.reduceat(n[order], edges) if len(edges) else n[:0]


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in sorted ``keys``, and which are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _rows(schema: str, *rows: dict) -> pa.Table:
    """A table of dicts of lists, with nulls for columns that a dict leaves out."""
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = pa.schema([(c.split()[0], types[c.split()[1]]) for c in schema.split(", ")])
    tables = []
    for r in rows:
        size = max(len(v) for v in r.values())
        tables.append(pa.table([pa.array(r[f.name], f.type) if f.name in r else pa.nulls(size, f.type) for f in fields], schema=fields))
    return pa.concat_tables(tables) if tables else fields.empty_table()


_COUNTED = "bucket int, both binary, word binary, before binary, n binary"


def _count(hot, buckets: int):
    """Pairs of the texts with their numbers, packed by bucket; two frequent words in 32 bits."""

    def emit(parts) -> Iterator[pa.RecordBatch]:
        word, before = (np.concatenate(x) for x in zip(*parts))
        both = (word < _RARE) & (before < _RARE)
        pairs, n = np.unique((word[both] << _BITS | before[both]).astype(np.uint32), return_counts=True)
        owner, (pairs, n) = _dealt(_owner(pairs.astype(np.uint64) >> _BITS, pairs.astype(np.uint64) & _LOW, buckets), pairs, n.astype(np.uint32))
        yield from _rows(_COUNTED, {"bucket": owner, "both": pairs, "n": n}).to_batches()
        word, before = word[~both], before[~both]
        at, n = _summed(_pair(word, before), np.ones(len(word), np.uint32))
        word, before = word[at], before[at]
        owner, (word, before, n) = _dealt(_owner(word, before, buckets), word, before, n.astype(np.uint32))
        yield from _rows(_COUNTED, {"bucket": owner, "word": word, "before": before, "n": n}).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            texts = batch["text"].to_pylist()
            for lo, hi in slices(texts, AT_ONCE):
                parts.append(tokens(texts[lo:hi], hot.value)[:2])
                size += len(parts[-1][0])
                if size >= COUNT_AT_ONCE:
                    yield from emit(parts)
                    parts, size = [], 0
        if size:
            yield from emit(parts)

    return run


class Seating:
    """Draws the number of tables of ``n`` customers of one dish, given the weight ``a`` of a new
    table: in proportion to S(n, t) * a ** t, with the generalised Stirling numbers S of the
    discount. They follow from S(n + 1, t) = S(n, t - 1) + (n - discount * t) S(n, t).

    Beyond ``EXACT_UP_TO`` customers S(n, t) / S(n, 1) * d ** (t - 1) * (t - 1)! is taken as the
    function of t / n ** discount that it tends to, as found at ``EXACT_UP_TO``.
    """

    def __init__(self, discount: float, exact: int = EXACT_UP_TO):
        self.discount, self.exact = discount, exact
        rows = np.full((exact + 1, exact + 2), -np.inf)
        rows[1, 1] = 0.0
        t = np.arange(exact + 2)
        with np.errstate(divide="ignore", invalid="ignore"):
            for n in range(1, exact):
                stay = np.where(t <= n, np.log(np.maximum(n - discount * t, 1e-300)), -np.inf) + rows[n]
                rows[n + 1, 1:] = np.logaddexp(stay[1:], rows[n, :-1])
        self.log = rows
        t = np.arange(1, exact + 1)
        self._tail = rows[exact, 1 : exact + 1] - rows[exact, 1] + (t - 1) * np.log(discount) + _log_factorial(t - 1)

    def log_weights(self, n: np.ndarray, width: int) -> np.ndarray:
        """Logarithms of S(n, t) up to a constant of each row, for t from 1 to ``width``."""
        t = np.arange(1, width + 1)
        small = n <= self.exact
        out = np.full((len(n), width), -np.inf)
        w = min(width, self.exact + 1)
        out[small, :w] = self.log[n[small], 1 : w + 1]
        if not small.all():
            large = n[~small].astype(float)[:, None]
            place = np.minimum(t * (self.exact / large) ** self.discount, self.exact)
            tail = np.interp(place, np.arange(1, self.exact + 1), self._tail)
            out[~small] = np.where(t <= large, tail - (t - 1) * np.log(self.discount) - _log_factorial(t - 1), -np.inf)
        return out

    def draw(self, n: np.ndarray, a: np.ndarray, uniform: np.ndarray) -> np.ndarray:
        """A number of tables for each row, by a random number for each: it depends on its row alone."""
        mean = a / self.discount  # of many customers; more than ``width`` tables have a chance under 1e-9
        width = np.minimum(n, np.ceil(mean + 7 * np.sqrt(mean) + 8)).astype(np.int64)
        out = np.ones(len(n), np.int64)
        order = np.argsort(width, kind="stable")
        order = order[np.searchsorted(width[order], 2) :]
        while len(order):
            # rows of up to twice the smallest width together, a bounded number of cells
            wide = int(min(2 * width[order[0]], width[order[-1]]))
            take = min(int(np.searchsorted(width[order], wide, side="right")), max(1, CELLS // wide))
            own, order = order[:take], order[take:]
            wide = int(width[own[-1]])
            logs = self.log_weights(n[own], wide) + np.arange(1, wide + 1) * np.log(np.maximum(a[own], 1e-300))[:, None]
            logs[np.arange(1, wide + 1) > width[own][:, None]] = -np.inf
            edge = np.cumsum(np.exp(logs - logs.max(1, keepdims=True)), axis=1)
            out[own] = 1 + (edge < (uniform[own] * edge[:, -1])[:, None]).sum(1)
        return out


def _log_factorial(k: np.ndarray) -> np.ndarray:
    """By Stirling's series; exact sums up to 16."""
    small = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 17)))))
    x = np.maximum(k, 17).astype(float) + 1
    return np.where(k <= 16, small[np.minimum(k, 16)], (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3))


@lru_cache(maxsize=4)
def seating(discount: float) -> Seating:
    return Seating(discount)


def uniforms(word: np.ndarray, context: np.ndarray | int, *seeds: int) -> np.ndarray:
    """A random number in [0, 1) for each word and context (-1: the parent), whatever batch it comes in."""
    key = mixed(word.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for part in (context, *seeds):
        key = mixed(key ^ mixed(np.asarray(part, np.int64).view(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(1)))
    return (key >> np.uint64(11)).astype(np.float64) * 2.0**-53


_PASS = "kind string, bucket int, to int, word binary, before binary, n binary, tables binary, names binary, names_n binary, customers binary, own binary"


class _Bucket:
    """Pairs of one bucket, by word."""

    def __init__(self, word: np.ndarray, before: np.ndarray, n: np.ndarray, buckets: int):
        self.word, self.before, self.n = word, before, n
        self.shares = max(16, buckets // 8)  # owners of the totals of frequent words
        self.edges = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        self.names = word[self.edges]
        self.each = np.repeat(np.arange(len(self.names)), np.diff(np.append(self.edges, len(word))))
        self.rare = self.names >= _RARE
        #: Rare contexts, by the bucket they belong to.
        asked, slot = np.unique(before[before >= _RARE], return_inverse=True)
        self.to = (asked % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(self.to, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.asked, self.to, self.slot = asked[order], self.to[order], place[slot]

    def pieces(self) -> list[tuple[int, int]]:
        """Ranges of about ``PIECE`` pairs; those of a rare word stay together."""
        at = np.arange(PIECE, len(self.n), PIECE)
        next_word = np.append(self.edges, len(self.n))[np.searchsorted(self.edges, at)]
        at = np.unique(np.where(self.word[at] < _RARE, at, next_word))
        at = at[at < len(self.n)].tolist()
        return list(zip([0, *at], [*at, len(self.n)]))

    def rows(self, bucket: int, tables: list, own: list) -> list[dict]:
        """What the bucket knows of totals: for the owners of contexts and frequent words, with
        numbers of customers and, by sample, of tables; and its own sums."""
        out, inner = [], self.before >= _RARE
        by = lambda where, size: [np.bincount(where[0], x[where[1]], size) for x in (self.n, *tables)]
        hot_context = by((self.before[~inner].astype(np.int64), ~inner), CONTEXTS)
        frequent = self.word < _RARE
        hot_word = by((self.word[frequent].astype(np.int64), frequent), CONTEXTS)
        sums = np.concatenate((hot_context, hot_word), axis=1)
        key = np.flatnonzero(sums[0])
        for back, keys, to, sums in ((-1, key.astype(np.uint64), key % self.shares, sums[:, key]), (bucket, self.asked, self.to, np.array(by((self.slot, inner), len(self.asked))))):
            sums = sums.astype(np.uint64)
            owner, (keys, n, *each) = _dealt(to, keys, *sums)
            out.append({"kind": ["request"] * len(owner), "bucket": [back] * len(owner), "to": owner, "word": keys, "n": n, "tables": [b"".join(x) for x in zip(*each)]})
        mine = [float(self.rare.sum()), float(self.n.sum()), *[float(x[self.rare].sum()) for x in own], *[float(x.sum()) for x in tables]]
        return [*out, {"kind": ["sums"], "bucket": [bucket], "tables": [np.array(mine).tobytes()]}]


def _gather(buckets: int):
    """The pairs of a bucket from all tasks, with one table each."""

    def run(counted: pa.Table) -> pa.Table:
        bucket = counted["bucket"][0].as_py()
        is_both = counted["both"].is_valid()
        first, other = counted.filter(is_both), counted.filter(counted["both"].is_null())
        pairs, n = _joined(first["both"], np.uint32), _joined(first["n"], np.uint32).astype(np.int64)
        at, n = _summed(pairs, n)
        pairs = pairs[at].astype(np.uint64)
        word, before, more = _joined(other["word"], np.uint64), _joined(other["before"], np.uint64), _joined(other["n"], np.uint32).astype(np.int64)
        at, more = _summed(_pair(word, before), more)
        word, before, n = np.concatenate((pairs >> _BITS, word[at])), np.concatenate((pairs & _LOW, before[at])), np.concatenate((n, more))
        order = np.lexsort((before, word))
        b = _Bucket(word[order], before[order], n[order], buckets)
        one = np.ones(len(n), np.int64)
        rows = b.rows(bucket, [one] * SAMPLES, [np.ones(len(b.names), np.int64)] * SAMPLES)
        for i, (lo, hi) in enumerate(b.pieces()):
            rows.append({"kind": ["pairs"], "bucket": [bucket], "to": [i], "word": [b.word[lo:hi].tobytes()], "before": [b.before[lo:hi].tobytes()], "n": [b.n[lo:hi].astype(np.uint32).tobytes()]})
        return _rows(_PASS, *rows)

    return run


_TOTALS = "kind string, bucket int, to int, word binary, n binary, tables binary"


def _total(last: bool):
    """Totals of the contexts and frequent words of one owner, and the answers to those who asked;
    of the last pass a row of all its rare contexts instead."""

    def run(requests: pa.Table) -> pa.Table:
        to = requests["to"][0].as_py()
        sizes = [len(x) // 8 for x in requests["word"].to_pylist()]
        key, n = _joined(requests["word"], np.uint64), _joined(requests["n"], np.uint64).astype(float)
        tables = np.concatenate([np.frombuffer(x, np.uint64).reshape(SAMPLES, -1) for x in requests["tables"].to_pylist()], axis=1).astype(float)
        names, slot = np.unique(key, return_inverse=True)
        n, tables = np.bincount(slot, n).astype(np.int64), np.array([np.bincount(slot, t) for t in tables]).astype(np.int64)
        hot = names < 2 * CONTEXTS
        rows = [{"kind": ["hot"], "bucket": [-1], "word": [names[hot].tobytes()], "n": [n[hot].tobytes()], "tables": [tables[:, hot].tobytes()]}]
        if last:
            rows.append({"kind": ["contexts"], "bucket": [to], "word": [names[~hot].tobytes()], "n": [n[~hot].tobytes()], "tables": [tables[:, ~hot].tobytes()]})
        else:
            back = np.array(requests["bucket"].to_pylist())
            pieces = np.split(slot, np.cumsum(sizes)[:-1])
            mine = np.flatnonzero(back >= 0)
            rows.append({"kind": ["answer"] * len(mine), "bucket": back[mine].tolist(), "to": [to] * len(mine), "tables": [tables[-1][pieces[i]].tobytes() for i in mine]})
        return _rows(_TOTALS, *rows)

    return run


def _seat(known, seed: int, buckets: int, last: bool):
    """One pass over a bucket, with the totals of its rare contexts."""

    def run(pairs: pa.Table, answers: pa.Table) -> pa.Table:
        d, dishes, parent, pairs = known.value, seating(DISCOUNT), seating(PARENT_DISCOUNT), pairs.sort_by("to")
        bucket, n = pairs["bucket"][0].as_py(), _joined(pairs["n"], np.uint32).astype(np.int64)
        b = _Bucket(_joined(pairs["word"], np.uint64), _joined(pairs["before"], np.uint64), n, buckets)
        inner = b.before >= _RARE
        opened = np.empty(len(n))
        opened[~inner] = d["tables"][b.before[~inner].astype(np.int64)]
        opened[inner] = _joined(answers.sort_by("to")["tables"], np.int64)[b.slot]
        opened = STRENGTH + DISCOUNT * opened
        several = np.flatnonzero(n > 1)  # one customer is at one table
        tables, own, samples = np.ones(len(n), np.int64), np.ones(len(b.names), np.int64), []
        frequent = b.names[~b.rare].astype(np.int64)
        for sweep in range(SWEEPS):
            below = (np.add.reduceat(tables, b.edges) - PARENT_DISCOUNT * own + d["opened"]) / d["all"]
            below[~b.rare] = d["below"][frequent]
            tables = tables.copy()
            tables[several] = dishes.draw(n[several], opened[several] * below[b.each[several]], uniforms(b.word[several], b.before[several].view(np.int64), seed, sweep))
            customers, own = np.add.reduceat(tables, b.edges), own.copy()
            own[b.rare] = parent.draw(customers[b.rare], np.full(b.rare.sum(), d["opened"]), uniforms(b.names[b.rare], -1, seed, sweep))
            if sweep >= SWEEPS - SAMPLES:
                samples.append((tables, customers, own))
        rows = b.rows(bucket, [x[0] for x in samples], [x[2] for x in samples])
        small, names_n = lambda values: [np.array(values).astype(np.uint32).tobytes()], np.add.reduceat(n, b.edges)
        for i, (lo, hi) in enumerate(b.pieces() if last else []):
            own_names = np.flatnonzero(b.rare & (b.edges >= lo) & (b.edges < hi))
            more = lo + np.flatnonzero(n[lo:hi] > 1)
            rows.append({
                "kind": ["pairs"], "bucket": [bucket], "to": [i], "word": [b.word[lo:hi].tobytes()], "before": [b.before[lo:hi].tobytes()], "n": small(n[lo:hi]), "tables": small([x[0][more] for x in samples]),
                "names": [b.names[own_names].tobytes()], "names_n": [names_n[own_names].tobytes()],
                "customers": small([x[1][own_names] for x in samples]), "own": small([x[2][own_names] for x in samples]),
            })
        return _rows(_PASS, *rows)

    return run


def _tables(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, words before, numbers and, by sample, tables of a row of pairs."""
    word, before, n = np.frombuffer(row["word"], np.uint64), np.frombuffer(row["before"], np.uint64), np.frombuffer(row["n"], np.uint32).astype(np.int64)
    tables = np.ones((SAMPLES, len(n)), np.int64)
    tables[:, n > 1] = np.frombuffer(row["tables"], np.uint32).reshape(SAMPLES, -1)
    return word, before, n, tables


class PitmanYor:
    """A fitted model: tables of pairs and of rare contexts by bucket, and the totals of frequent ones."""

    def __init__(self, pairs: DataFrame, contexts: DataFrame, hot: np.ndarray, buckets: int, n_tokens: int, vocabulary: int, totals: np.ndarray, own: np.ndarray, sums: np.ndarray):
        self.pairs, self.contexts, self.hot, self.buckets, self.n_tokens, self.vocabulary = pairs, contexts, hot, buckets, n_tokens, vocabulary
        #: By sample and frequent context: the weight of what comes from the parent.
        self.opened = STRENGTH + DISCOUNT * totals[1:, :CONTEXTS]
        self.below = STRENGTH + totals[0, :CONTEXTS]
        #: By sample: the parent's weight of a word's base, and all its weight.
        self.base = (PARENT_STRENGTH + PARENT_DISCOUNT * (sums[2 : 2 + SAMPLES] + own.sum(1))) / (vocabulary + 1)
        self.all = PARENT_STRENGTH + sums[2 + SAMPLES :]
        #: Of frequent words: the training tokens, and by sample the parent's probability.
        self.n = totals[0, CONTEXTS:]
        self.parent = (totals[1:, CONTEXTS:] - PARENT_DISCOUNT * own + self.base[:, None]) / self.all[:, None]

    @property
    def unknown(self) -> np.ndarray:
        """By sample the parent's probability of a word that training never saw."""
        return self.base / self.all

    def shared(self) -> dict:
        """What tasks look up."""
        return {k: getattr(self, k) for k in ("hot", "opened", "below", "base", "all", "n", "parent", "unknown", "n_tokens", "vocabulary")}

    def table(self) -> DataFrame:
        """All pairs: word, before (see ``tokens``), count, tables0, tables1, ..., and the word's parent0, ..."""
        d = self.pairs.sparkSession.sparkContext.broadcast(self.shared())

        def run(batch: pa.RecordBatch) -> Iterator[dict]:
            for row in batch.to_pylist():
                word, before, n, tables = _tables(row)
                parent = _parents(d.value, word, _names(row))[0]
                yield {"word": word.view(np.int64), "before": before.view(np.int64), "count": n} | {f"tables{s}": tables[s] for s in range(SAMPLES)} | {f"parent{s}": parent[s] for s in range(SAMPLES)}

        return arrow_map(self.pairs, run, "word long, before long, count long, " + ", ".join(f"tables{s} long, parent{s} double" for s in range(SAMPLES)))

    def parents(self) -> DataFrame:
        """The words with parent0, parent1, ...: the parent's probability by sample; and of frequent
        contexts that have the word: contexts, counts, tables0, tables1, ..."""
        entry = F.when((F.col("before") >= 0), F.struct(F.col("before").cast("int").alias("context"), "count", *[f"tables{s}" for s in range(SAMPLES)]))
        lists = self.table().groupBy("word").agg(F.collect_list(entry).alias("p"), *[F.first(f"parent{s}").alias(f"parent{s}") for s in range(SAMPLES)])
        return lists.select("word", F.col("p.context").alias("contexts"), F.col("p.count").alias("counts"), *[c for s in range(SAMPLES) for c in (f"p.tables{s}", f"parent{s}")])


def _names(row: dict) -> tuple[np.ndarray, ...]:
    """Rare words of a row of pairs, by hash; their numbers and, by sample, customers and tables."""
    return np.frombuffer(row["names"], np.uint64), np.frombuffer(row["names_n"], np.int64), *[np.frombuffer(row[c], np.uint32).reshape(SAMPLES, -1).astype(float) for c in ("customers", "own")]


def _parents(d: dict, word: np.ndarray, names: tuple) -> tuple[np.ndarray, np.ndarray]:
    """By sample the parent's probability of each word; and its training tokens."""
    out, n = np.repeat(d["unknown"][:, None], len(word), axis=1), np.zeros(len(word))
    frequent = word < _RARE
    out[:, frequent], n[frequent] = d["parent"][:, word[frequent].astype(np.int64)], d["n"][word[frequent].astype(np.int64)]
    at, there = _found(names[0], word)
    if there.any():
        at = at[there]
        out[:, there] = (names[2][:, at] - PARENT_DISCOUNT * names[3][:, at] + d["base"][:, None]) / d["all"][:, None]
        n[there] = names[1][at]
    return out, n


def _hot_words(texts: DataFrame, rows: int, limit: int) -> np.ndarray:
    """Frequent words of the different texts among a hashed sample of about ``SAMPLE_ROWS``."""
    parts = 1 << 40
    picked = texts.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) < math.ceil(min(1.0, SAMPLE_ROWS / max(1, rows)) * parts)).distinct()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = batch["text"].tolist()
            for lo, hi in slices(found, AT_ONCE):
                h, n = np.unique(word_hashes(found[lo:hi])[0], return_counts=True)
                yield pd.DataFrame({"word": h.view(np.int64), "n": n})

    words = keep(picked.mapInPandas(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "sample-words")
    hot = most_frequent(words, limit).select("word").toArrow()["word"].to_numpy().view(np.uint64)
    release(words)
    return np.sort(hot)


def fit(texts: DataFrame, rounds: int = ROUNDS, seed: int = SEED, hot_words: int = CONTEXTS - 1) -> PitmanYor:
    """Fits on all rows of a column ``text``. Null and empty texts are one end token each; without
    rows the model is uniform over one unknown word. ``hot_words``: at most so many frequent ones."""
    sc = texts.sparkSession.sparkContext
    texts = texts.select(text_of("text").alias("text"))
    size = texts.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("chars")).first()
    buckets = max(1, math.ceil((size["chars"] or 0) / BUCKET_CHARS))
    hot = _hot_words(texts, size["rows"], min(hot_words, CONTEXTS - 1))
    counted = texts.mapInArrow(_count(sc.broadcast(hot), buckets), _COUNTED)
    state = first = keep(counted.groupBy("bucket").applyInArrow(_gather(buckets), _PASS), "pairs", _PACKED)
    for i in range(rounds + 1):
        last = i == rounds
        totals = keep(state.filter("kind = 'request'").select("bucket", "to", "word", "n", "tables").groupBy("to").applyInArrow(_total(last), _TOTALS), "totals")
        hot_totals = np.zeros((1 + SAMPLES, 2 * CONTEXTS))
        for r in totals.filter("kind = 'hot'").collect():  # together at most two rows' numbers for each frequent word
            key = np.frombuffer(r["word"], np.uint64).astype(np.int64)
            hot_totals[0, key] += np.frombuffer(r["n"], np.int64)
            hot_totals[1:, key] += np.frombuffer(r["tables"], np.int64).reshape(SAMPLES, -1)
        sums = np.zeros(2 + 2 * SAMPLES)
        for r in state.filter("kind = 'sums'").select("tables").collect():  # eight numbers a bucket
            sums += np.frombuffer(r["tables"], np.float64)
        seen = np.flatnonzero(hot_totals[0, CONTEXTS:])
        vocabulary, customers = int(sums[0]) + len(seen), hot_totals[1:, CONTEXTS:]
        if i == 0:
            own = np.tile(hot_totals[0, CONTEXTS:] > 0, (SAMPLES, 1)).astype(float)
        else:
            for s in range(SAMPLES):
                own[s, seen] = seating(PARENT_DISCOUNT).draw(customers[s, seen].astype(np.int64), np.full(len(seen), opened), uniforms(seen.astype(np.uint64), -1, seed + i - 1, SWEEPS - SAMPLES + s))
        if last:
            break
        opened = (PARENT_STRENGTH + PARENT_DISCOUNT * (sums[1 + SAMPLES] + own[-1].sum())) / (vocabulary + 1)
        below = PARENT_STRENGTH + sums[-1]
        known = sc.broadcast({"tables": hot_totals[-1, :CONTEXTS], "below": (customers[-1] - PARENT_DISCOUNT * own[-1] + opened) / below, "opened": opened, "all": below})
        answers = totals.filter("kind = 'answer'").select("bucket", "to", "tables").groupBy("bucket")
        pairs = first.filter("kind = 'pairs'").select("bucket", "to", "word", "before", "n").groupBy("bucket")
        after = keep(pairs.cogroup(answers).applyInArrow(_seat(known, seed + i, buckets, i == rounds - 1), _PASS), "seated", _PACKED)
        release(totals, *[state] * (state is not first))
        state = after
    if state is not first:
        release(first)
    return PitmanYor(state.filter("kind = 'pairs'"), totals.filter("kind = 'contexts'"), hot, buckets, int(sums[1]), vocabulary, hot_totals, own, sums)


def held_out(id_col: str = "doc_id"):
    """Rows that training never sees; a null id hashes as the empty string."""
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS) == HELD_OUT_FOLD


def most_frequent(words: DataFrame, limit: int) -> DataFrame:
    """Words above a count, so chosen that they are at most ``limit``: by numbers of words in
    eighths of octaves of counts, so that no task orders the words."""
    level = F.floor(F.log2("n") * 8)
    sizes = words.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("level")).collect()  # under 512 rows
    total, lowest = 0, None
    for r in sizes:
        total += r["words"]
        if total > limit:
            break
        lowest = r["level"]
    return words.filter(F.lit(False) if lowest is None else level >= lowest)


def _probability(d: dict, gain: np.ndarray, parent: np.ndarray, opened: np.ndarray, below: np.ndarray) -> np.ndarray:
    return np.log10((gain + (opened * parent).sum(0) / SAMPLES) / below)


def _near(model: PitmanYor, frequent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with at least one in ``frequent`` of the training tokens, so at most as many, by key, and
    their scores; of frequent words only."""
    d = model.pairs.sparkSession.sparkContext.broadcast(model.shared())

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for row in batch.to_pylist():
            word, before, n, tables = _tables(row)
            at = np.flatnonzero((n * frequent >= d.value["n_tokens"]) & (word < _RARE) & (before < _RARE))
            w, u = word[at].astype(np.int64), before[at].astype(np.int64)
            score = _probability(d.value, n[at] - DISCOUNT * tables[:, at].mean(0), d.value["parent"][:, w], d.value["opened"][:, u], d.value["below"][u])
            yield {"key": _pair(word[at], before[at]).view(np.int64), "score": score}

    found = arrow_map(model.pairs, run, "key long, score double").toArrow()
    keys = found["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found["score"].to_numpy()[order]


_SENT = "bucket int, batch long, both binary, word binary, before binary, doc binary, info binary"


def _send(data, buckets: int):
    """Tokens packed by bucket, with the place of their text in the batch; and a row of each batch's
    texts with what is known at once."""

    def emit(batch: int, info: np.ndarray, parts: list) -> Iterator[pa.RecordBatch]:
        d = data.value
        word, before = (np.concatenate(x) for x in zip(*parts))
        doc = np.repeat(np.arange(len(info), dtype=np.uint32), info["n"])
        hot, known = word < _RARE, np.zeros(len(word), bool)
        base, score = np.zeros(len(word)), np.zeros(len(word))
        n = d["n"][word[hot].astype(np.int64)]
        base[hot], known[hot] = np.log10((n + 1) / (d["n_tokens"] + d["vocabulary"] + 1)), n > 0
        at, near = _found(d["keys"], _pair(word, before))
        score[near] = d["scores"][at[near]]
        edges = np.cumsum(info["n"]) - info["n"]
        info["known"], info["base"], info["score"] = (np.add.reduceat(x, edges) for x in (known.astype(np.int64), base, score))
        yield from _rows(_SENT, {"bucket": [batch % buckets], "batch": [batch], "info": [info.tobytes()]}).to_batches()
        both = hot & (before < _RARE)
        for of, names in ((both & ~near, ("both",)), (~both, ("word", "before"))):
            w, u = word[of], before[of]
            packed = [(w << _BITS | u).astype(np.uint32)] if names == ("both",) else [w, u]
            owner, (places, *packed) = _dealt(_owner(w, u, buckets), doc[of], *packed)
            yield from _rows(_SENT, {"bucket": owner, "batch": [batch] * len(owner), "doc": places} | dict(zip(names, packed))).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, infos, parts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            texts = batch["text"].to_pylist()
            for lo, hi in slices(texts, AT_ONCE):
                word, before, counts = tokens(texts[lo:hi], data.value["hot"])
                info, ids = np.zeros(hi - lo, _INFO), batch["doc_id"][lo : lo + hi - lo]
                info["id"], info["null"] = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
                info["held"], info["n"] = batch["held_out"][lo:hi].to_numpy(zero_copy_only=False), counts
                infos.append(info)
                parts.append((word, before))
                size += len(word)
                if size >= COUNT_AT_ONCE:
                    yield from emit(number, np.concatenate(infos), parts)
                    number, infos, parts, size = number + 1, [], [], 0
        if size:
            yield from emit(number, np.concatenate(infos), parts)

    return run


_PARTS = "batch long, info binary, sums binary, to int, batches binary, names binary, doc binary, gain binary, parent binary"


def _contexts(rows: list[dict]) -> tuple[np.ndarray, ...]:
    """Rare contexts by hash; their weight and, by sample, that of what comes from the parent."""
    r = rows[0] if rows else {"word": b"", "n": b"", "tables": b""}
    return np.frombuffer(r["word"], np.uint64), STRENGTH + np.frombuffer(r["n"], np.int64), STRENGTH + DISCOUNT * np.frombuffer(r["tables"], np.int64).reshape(SAMPLES, -1)


def _weights(contexts: tuple, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What comes from the parent by sample, and all; a context never seen has nothing of its own."""
    opened, below = np.full((SAMPLES, len(before)), STRENGTH), np.full(len(before), STRENGTH)
    at, there = _found(contexts[0], before)
    if there.any():
        opened[:, there], below[there] = contexts[2][:, at[there]], contexts[1][at[there]]
    return opened, below


def _groups(keys: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Different keys, and the places of each."""
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    return [(keys[of[0]], of) for of in np.split(order, cuts)]


def _by_text(doc: np.ndarray, known, base, score) -> bytes:
    """Sums over the tokens of each text."""
    order = np.argsort(doc, kind="stable")
    doc, known, base, score = (x[order] for x in (doc, known, base, score))
    edges = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    out = np.zeros(len(edges), _SUMS)
    out["doc"] = doc[edges]
    out["known"], out["base"], out["score"] = (np.add.reduceat(x, edges) for x in (known.astype(np.int64), base, score))
    return out.tobytes()


def _score_pairs(data, buckets: int):
    """Scores a bucket's tokens; those of two rare words go on to the context's bucket."""

    def run(sent: pa.Table, facts: pa.Table) -> pa.Table:
        d, facts = data.value, facts.to_pylist()
        pairs, contexts = sorted((r for r in facts if r["kind"] == "pairs"), key=lambda r: r["to"]), _contexts([r for r in facts if r["kind"] == "contexts"])
        if pairs:
            word, before, n, tables = (np.concatenate(x, axis=-1) for x in zip(*map(_tables, pairs)))
            keys, gains, names = _pair(word, before), n - DISCOUNT * tables.mean(0), tuple(np.concatenate(x, axis=-1) for x in zip(*map(_names, pairs)))
            order = np.argsort(keys)
            keys, gains = keys[order], gains[order]
        else:
            keys, gains, names = np.zeros(0, np.uint64), np.zeros(0), (np.zeros(0, np.uint64), np.zeros(0, np.int64), *[np.zeros((SAMPLES, 0))] * 2)
        rows, batches, onward = [], {}, []
        for row in sent.to_pylist():
            if row["info"] is not None:
                rows.append({"batch": [row["batch"]], "info": [row["info"]]})
                continue
            doc = np.frombuffer(row["doc"], np.uint32)
            if row["both"] is not None:
                both = np.frombuffer(row["both"], np.uint32).astype(np.uint64)
                word, before = both >> _BITS, both & _LOW
            else:
                word, before = np.frombuffer(row["word"], np.uint64), np.frombuffer(row["before"], np.uint64)
            at, there = _found(keys, _pair(word, before))
            gain = np.zeros(len(word))
            gain[there] = gains[at[there]]
            parent, n = _parents(d, word, names)
            rare, inner = word >= _RARE, before >= _RARE
            opened, below = _weights(contexts, before) if inner.any() else (np.empty((SAMPLES, len(word))), np.empty(len(word)))
            u = before[~inner].astype(np.int64)
            opened[:, ~inner], below[~inner] = d["opened"][:, u], d["below"][u]
            score = _probability(d, gain, parent, opened, below)
            on = rare & inner
            score[on] = 0.0
            base = np.where(rare, np.log10((n + 1) / (d["n_tokens"] + d["vocabulary"] + 1)), 0.0)
            batches.setdefault(row["batch"], []).append((doc, rare & (n > 0), base, score))
            if on.any():
                onward.append((before[on], np.full(on.sum(), row["batch"]), doc[on], gain[on], *parent[:, on]))
        rows += [{"batch": [batch], "sums": [_by_text(*(np.concatenate(x) for x in zip(*parts)))]} for batch, parts in batches.items()]
        if onward:
            before, *others = (np.concatenate(x) for x in zip(*onward))
            to, columns = _dealt((before % np.uint64(buckets)).astype(np.int64), before, *others)
            rows.append({"to": to, "names": columns[0], "batches": columns[1], "doc": columns[2], "gain": columns[3], "parent": [b"".join(x) for x in zip(*columns[4:])]})
        return _rows(_PARTS, *rows)

    return run


def _score_rare(sent: pa.Table, facts: pa.Table) -> pa.Table:
    """Scores tokens of two rare words, whose word's part is known, in the context's bucket."""
    contexts, parts, rows = _contexts(facts.to_pylist()), [], []
    for row in sent.to_pylist():
        opened, below = _weights(contexts, np.frombuffer(row["names"], np.uint64))
        score = _probability({}, np.frombuffer(row["gain"]), np.frombuffer(row["parent"]).reshape(SAMPLES, -1), opened, below)
        parts.append((np.frombuffer(row["batches"], np.int64), np.frombuffer(row["doc"], np.uint32), score))
    if parts:
        batch, doc, score = (np.concatenate(x) for x in zip(*parts))
        none = np.zeros(len(score))
        rows = [{"batch": [int(i)], "sums": [_by_text(doc[of], none[of], none[of], score[of])]} for i, of in _groups(batch)]
    return _rows("batch long, sums binary", *rows)


_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _finish(parts: pa.Table) -> pa.Table:
    """The texts of a batch with the sums of their tokens."""
    info = _joined(parts["info"], _INFO)
    sums = _joined(parts["sums"], _SUMS)
    known, base, score = (info[c] + np.bincount(sums["doc"], sums[c], len(info)) for c in ("known", "base", "score"))
    return _rows(_RESULT, {"doc_id": pa.array(info["id"], mask=info["null"].astype(bool)), "held_out": info["held"].astype(bool), "n_tokens": info["n"], "n_known": known.astype(np.int64), "base_score": base, "score": score})


def score(docs: DataFrame, model: PitmanYor, frequent: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null text is empty: one token, its end. Null ids stay null; repeated rows repeat; other
    columns are ignored; no rows give none.
    """
    sc = docs.sparkSession.sparkContext
    keys, scores = _near(model, frequent)
    data = sc.broadcast(model.shared() | {"keys": keys, "scores": scores})
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    sent = own.mapInArrow(_send(data, model.buckets), _SENT)
    columns = ["kind", "bucket", "to", "word", "before", "n", "tables", "names", "names_n", "customers", "own"]
    facts = model.pairs.select(columns).unionByName(model.contexts.select("kind", "bucket", "word", "n", "tables"), allowMissingColumns=True)
    parts = keep(sent.groupBy("bucket").cogroup(facts.groupBy("bucket")).applyInArrow(_score_pairs(data, model.buckets), _PARTS), "scored", _PACKED)
    rare = parts.filter("to is not null").select("to", "batches", "names", "doc", "gain", "parent").groupBy("to").cogroup(model.contexts.select("bucket", "word", "n", "tables").groupBy("bucket")).applyInArrow(_score_rare, "batch long, sums binary")
    every = parts.filter("to is null").select("batch", "info", "sums").unionByName(rare, allowMissingColumns=True)
    out = every.groupBy("batch").applyInArrow(_finish, _RESULT)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op3_query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs.filter(~held_out()).select("text")))
