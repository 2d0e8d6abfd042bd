"""Removal of repeated byte strings with run-length indexes.

A byte goes if a string of ``LENGTH`` bytes over it also starts anywhere else. Such strings are
brought together and matched in four steps, none of which pairs up documents:

1. Every window of ``LENGTH`` bytes names its anchor: the leftmost smallest hash of its
   ``GRAM``-byte strings. Equal windows have equal anchors at equal places. The windows of one
   anchor are consecutive, so each anchor gives one context: the bytes those windows cover. Rows
   hold hashes of the anchor and of the context. Anchors that occur once are dropped.
2. Contexts that occur more than once are repeated as a whole: their windows are marked.
3. Of each different context of an anchor one copy is fetched. Tasks take whole anchors, about
   ``INDEX_BYTES`` of contexts at a time, and build a run-length index: the Burrows-Wheeler transform of the
   contexts, cut into runs, with the suffix position at both ends of each run and the length of
   its match with the suffix next to it outside. A stream over the text positions gives matching
   statistics: at a sampled position the sampled length, else one less than at the position
   before. Windows with a match of ``LENGTH`` or more are marked.
4. Anchors with over ``CONTEXTS_PER_ANCHOR`` different contexts don't go to one task: their
   windows' 128-bit hashes are counted instead.

Texts that occur more than once are repeated as a whole and need no marks. Contexts and texts are
known by 64-bit hashes of their bytes (contexts within their anchor, texts with their length).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import keep, mixed, table, text_of

LENGTH, GRAM = 200, 32
WINDOW_GRAMS = LENGTH - GRAM + 1
CONTEXTS_PER_ANCHOR, INDEX_BYTES = 20_000, 1 << 18
BUFFER, PLACE_BITS = 1 << 20, 24
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS, _INVERSES = _powers(_BASE, 4 * BUFFER), _powers(_INVERSE, 4 * BUFFER)


def gram_hashes(values: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` bytes from each position; ``values`` are the bytes' own hashes."""
    out, size, done, total = values, 1, None, 0
    while True:
        if length & size:
            if done is None:
                done, total = out, size
            else:
                n = len(values) - total - size + 1
                done, total = done[: max(0, n)] * _BASE ** np.uint64(size) + out[total : total + max(0, n)], total + size
        if total == length:
            return done
        n = max(0, len(out) - size)
        out, size = out[:n] * _BASE ** np.uint64(size) + out[size : size + n], 2 * size


def contexts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Of the texts between ``offsets`` of a buffer, the contexts: text (number), first and last
    window (position in the text), anchor (bytes after the first window's start), and hashes."""
    n = len(data)
    none = {k: np.zeros(0, np.int64) for k in ("text", "first", "last", "anchor", "gram_hash", "context_hash")}
    if n < LENGTH:
        return none
    values = _BYTE[data]
    grams = mixed(gram_hashes(values, GRAM))
    place = np.uint64((1 << PLACE_BITS) - 1)
    low = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while 2 * size <= WINDOW_GRAMS:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = WINDOW_GRAMS - size
    low = np.minimum(low[: len(low) - rest], low[rest:])
    starts = np.arange(n - LENGTH + 1)
    text = np.searchsorted(offsets, starts, side="right") - 1
    starts = starts[starts + LENGTH <= offsets[text + 1]]
    if not len(starts):
        return none
    anchors = (low[starts] & place).astype(np.int64)
    new = np.concatenate(([True], (anchors[1:] != anchors[:-1]) | (starts[1:] != starts[:-1] + 1)))
    first = starts[new]
    last = starts[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(starts) - 1]))]
    anchors = anchors[new]
    running = np.concatenate(([np.uint64(0)], np.cumsum(values * _INVERSES[:n])))
    whole = (running[last + LENGTH] - running[first]) * _POWERS[first]
    own = text[first] if len(text) == n else np.searchsorted(offsets, first, side="right") - 1
    at = offsets[own]
    tag = (anchors - first).astype(np.uint64) << np.uint64(16) | (last - first).astype(np.uint64)
    return {"text": own, "first": first - at, "last": last - at, "anchor": anchors - first, "gram_hash": grams[anchors].view(np.int64), "context_hash": mixed(whole + mixed(tag + np.uint64(1))).view(np.int64)}


def _buffers(texts: list) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """Buffers of about ``BUFFER`` bytes with their texts: (number, first byte) each. Long texts
    come in parts that overlap by ``LENGTH`` - 1 bytes, so that each window is in one part."""
    parts, owners, size = [], [], 0
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        if len(raw) < LENGTH:
            continue
        for lo in range(0, len(raw) - LENGTH + 1, BUFFER):
            parts.append(raw[lo : lo + BUFFER + LENGTH - 1])
            owners.append((i, lo))
            size += len(parts[-1])
            if size >= BUFFER:
                yield np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in parts]))), owners
                parts, owners, size = [], [], 0
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in parts]))), owners


def _anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keys = batch["key"].to_numpy()
        for data, offsets, owners in _buffers(batch["text"].tolist()):
            c = contexts(data, offsets)
            number, shift = np.array([o[0] for o in owners])[c["text"]], np.array([o[1] for o in owners])[c["text"]]
            place = (c["first"] + shift) << 16 | (c["last"] - c["first"]) << 8 | c["anchor"]
            yield pd.DataFrame({"gram_hash": c["gram_hash"], "context_hash": c["context_hash"], "key": keys[number], "place": place})


def run_length_index(parts: list[bytes]) -> dict[str, np.ndarray]:
    """Index of the strings: their concatenation's suffix positions and match lengths at the
    first and the last row of each run of the Burrows-Wheeler transform. No match runs over a
    string's end. ``runs`` is the number of runs, ``begin`` each string's first position."""
    sizes = np.array([len(p) for p in parts], np.int64)
    begin = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(parts), np.uint8)
    n = len(data)
    left = np.repeat(begin + sizes, sizes) - np.arange(n)
    symbols = np.zeros(n + 7, np.uint64)
    symbols[:n] = data
    symbols[:n] += np.uint64(1)
    ranks, span = [], 7
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = key << np.uint64(9) | np.where(left > k, symbols[k : n + k], np.uint64(0))
    while True:
        order = np.argsort(key)
        ordered = key[order]
        new = np.concatenate(([False], ordered[1:] != ordered[:-1]))
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(new) + 1
        ranks.append((span, rank))
        if span >= sizes.max() or rank.max() == n:
            break
        after = np.zeros(n, np.uint64)
        after[: n - span] = rank[span:] if n > span else 0
        key = rank.astype(np.uint64) << np.uint64(32) | np.where(left > span, after, np.uint64(0))
        span *= 2
    # equal suffixes of different strings: in the order of their positions, at every length
    order = np.argsort(rank.astype(np.uint64) << np.uint64(32) | np.arange(n, dtype=np.uint64))

    # two suffixes match no further than their strings go
    def match(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b, total = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        room = np.minimum(left[a], left[b])
        for width, rank in reversed(ranks):
            for _ in range(2 if width == ranks[-1][0] else 1):
                inside = total + width <= room
                x, y = np.where(inside, a, 0), np.where(inside, b, 0)
                step = np.where(inside & (rank[x] == rank[y]), width, 0)
                total, a, b = total + step, np.minimum(a + step, n - 1), np.minimum(b + step, n - 1)
        for _ in range(6):
            step = (total < room) & (data[a] == data[b])
            total, a, b = total + step, np.minimum(a + step, n - 1), np.minimum(b + step, n - 1)
        return np.minimum(total, room)

    before = np.where(np.isin(np.arange(n), begin), -1 - np.arange(n), np.concatenate(([0], data[:-1].astype(np.int64))))
    transform = before[order]  # a string's first suffix is preceded by an end mark of its own
    heads = np.concatenate(([True], transform[1:] != transform[:-1]))
    tails = np.concatenate((heads[1:], [True]))
    head, tail = np.flatnonzero(heads), np.flatnonzero(tails)
    up = np.zeros(len(head), np.int64)
    up[head > 0] = match(order[head[head > 0]], order[head[head > 0] - 1])
    down = np.zeros(len(tail), np.int64)
    down[tail < n - 1] = match(order[tail[tail < n - 1]], order[tail[tail < n - 1] + 1])
    return {"begin": begin, "n": np.int64(n), "runs": np.int64(len(head)), "head": order[head], "head_match": up, "tail": order[tail], "tail_match": down}


def matching_statistics(index: dict[str, np.ndarray]) -> np.ndarray:
    """For each position the longest match of its suffix with any other suffix."""
    n, out = int(index["n"]), None
    for position, length in ((index["head"], index["head_match"]), (index["tail"], index["tail_match"])):
        sampled, values = np.zeros(n, np.int64), np.zeros(n, np.int64)
        sampled[position] = position
        values[position] = length
        np.maximum.accumulate(sampled, out=sampled)
        streamed = values[sampled] - (np.arange(n) - sampled)
        out = streamed if out is None else np.maximum(out, streamed)
    return np.maximum(out, 0)


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()))


def _match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Marks of contexts that come sorted by anchor: whole anchors, ``INDEX_BYTES`` at a time."""

    def index(rows: list[tuple]) -> pd.DataFrame:
        i = run_length_index([r[2] for r in rows])
        length, out = matching_statistics(i), []
        for (_, _, raw, key, first), b in zip(rows, i["begin"].tolist()):
            out += [(key, first + s, first + e) for s, e in _runs(length[b : b + len(raw) - LENGTH + 1] >= LENGTH)]
        return pd.DataFrame(out, columns=["key", "first", "last"], dtype="int64")

    rows, size, seen = [], 0, set()
    for batch in batches:
        for gram, context, raw, key, first in zip(batch["gram_hash"], batch["context_hash"], batch["raw"], batch["key"], batch["first"]):
            if size >= INDEX_BYTES and rows[-1][0] != gram:
                yield index(rows)
                rows, size, seen = [], 0, set()
            if (gram, context) not in seen:  # rows that repeat a document with a null id
                seen.add((gram, context))
                rows.append((gram, context, bytes(raw), key, first))
                size += len(raw)
    if rows:
        yield index(rows)


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for raw, key, first in zip(batch["raw"], batch["key"], batch["first"]):
            values = _BYTE[np.frombuffer(raw, np.uint8)]
            h = gram_hashes(values, LENGTH)
            g = gram_hashes(mixed(values), LENGTH)
            yield pd.DataFrame({"w1": mixed(h).view(np.int64), "w2": mixed(g).view(np.int64), "key": key, "first": first + np.arange(len(h))})


def _fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for text, key, wanted in zip(batch["text"], batch["key"], batch["wanted"]):
            raw = text.encode("utf-8", "surrogatepass")
            for w in wanted:
                first = w["place"] >> 16
                out.append((w["gram_hash"], w["context_hash"], raw[first : first + (w["place"] >> 8 & 255) + LENGTH], key, first, w["big"]))
        yield pd.DataFrame(out, columns=["gram_hash", "context_hash", "raw", "key", "first", "big"])


def removed_spans(marks, n: int) -> list[tuple[int, int]]:
    """Maximal runs (first byte, end) of the bytes under marked windows (first, last start)."""
    hit = np.zeros(n + 1, np.int32)
    for first, last in marks:
        hit[first] += 1
        hit[min(n, last + LENGTH)] -= 1
    return [(a, b + 1) for a, b in _runs(np.cumsum(hit)[:n] > 0)]


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for key, text, marks in zip(batch["key"], batch["text"], batch["marks"]):
            raw = text.encode("utf-8", "surrogatepass")
            spans = removed_spans([(m["first"], m["last"]) for m in marks], len(raw))
            at, parts = 0, []
            for a, b in spans:
                parts.append(raw[at:a])
                at = b
            parts.append(raw[at:])
            out.append((key, len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(b"".join(parts)).hexdigest(), [{"first": a, "stop": b} for a, b in spans]))
        yield pd.DataFrame(out, columns=["key", "size", "n_removed", "n_spans", "kept_sha256", "spans"])


_CUT = "key long, size long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<first: long, stop: long>>"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", contexts_per_anchor: int = CONTEXTS_PER_ANCHOR) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (first byte
    and end of each removed run).

    Strings are judged on the input, in the same or other rows, overlaps included; none crosses
    a text's end. Null text is empty; texts under 200 bytes lose nothing. Rows of equal text are
    copies of each other whatever their ids, null or repeated ones included, and lose all of a
    text of 200 bytes or more. Other columns are ignored; no rows give none.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).withColumn("key", F.xxhash64("text"))
    rows = keep(own.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256")), "rows")
    texts = rows.groupBy("key", "n_bytes").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("text_id"))

    anchors = keep(own.select("key", "text").mapInPandas(_anchors, "gram_hash long, context_hash long, key long, place long"), "anchors")
    # kept, so that the join has a plain shuffle on either side, which Spark splits at frequent anchors
    twice = keep(anchors.groupBy("gram_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("gram_hash").alias("twice")), "twice")
    shared = keep(anchors.join(twice, F.col("gram_hash") == F.col("twice"), "left_semi"), "shared")
    each = keep(shared.groupBy("gram_hash", "context_hash").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "place")).alias("copy")), "contexts")

    whole = each.filter("n > 1").select(F.col("gram_hash").alias("g"), F.col("context_hash").alias("c"))
    first, last = F.shiftright("place", 16), F.shiftright("place", 16) + F.shiftright("place", 8).bitwiseAND(F.lit(255))
    marks_whole = shared.join(whole, (F.col("gram_hash") == F.col("g")) & (F.col("context_hash") == F.col("c")), "left_semi").select("key", first.alias("first"), last.alias("last"))

    several = each.groupBy("gram_hash").agg(F.count(F.lit(1)).alias("different")).filter("different > 1").select(F.col("gram_hash").alias("g"), (F.col("different") > contexts_per_anchor).alias("big"))
    wanted = each.join(several, F.col("gram_hash") == F.col("g")).select(F.col("copy.key").alias("key"), F.struct("gram_hash", "context_hash", "big", F.col("copy.place").alias("place")).alias("wanted"))
    reps = texts.groupBy("key").agg(F.min("text_id").alias("text_id")).select(F.col("key").alias("text_key"), "text_id")
    wanted = keep(wanted.groupBy("key").agg(F.collect_list("wanted").alias("wanted")).join(reps, F.col("key") == F.col("text_key")).select("text_key", "text_id", "wanted"), "wanted")  # a text's own anchors

    plain = own.filter(F.octet_length("text") >= LENGTH)

    def of_texts(other: DataFrame) -> DataFrame:
        return plain.join(other, (F.col("key") == F.col("text_key")) & F.col("doc_id").eqNullSafe(F.col("text_id")))

    fetched = keep(of_texts(wanted).select("key", "text", "wanted").mapInPandas(_fetch, "gram_hash long, context_hash long, raw binary, key long, first long, big boolean"), "fetched")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    matched = fetched.filter("not big").repartition(width, "gram_hash").sortWithinPartitions("gram_hash").mapInPandas(_match, "key long, first long, last long")
    counted = fetched.filter("big").select("raw", "key", "first").mapInPandas(_windows, "w1 long, w2 long, key long, first long")
    often = counted.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("w1").alias("v1"), F.col("w2").alias("v2"))
    marks_big = counted.join(often, (F.col("w1") == F.col("v1")) & (F.col("w2") == F.col("v2")), "left_semi").select("key", "first", F.col("first").alias("last"))

    single = texts.filter("copies = 1").select(F.col("key").alias("text_key"), "text_id", "n_bytes")
    marks = marks_whole.unionByName(matched).unionByName(marks_big).join(single.select("text_key"), F.col("key") == F.col("text_key"), "left_semi")
    marks = marks.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("marks"))  # a text's own windows
    marks = marks.join(single, F.col("key") == F.col("text_key")).select("text_key", "text_id", "marks")
    cut = of_texts(marks).select("key", "text", "marks").mapInPandas(_cut, _CUT)

    named = rows.join(texts.select(F.col("key").alias("k"), F.col("n_bytes").alias("b"), "copies"), (F.col("key") == F.col("k")) & (F.col("n_bytes") == F.col("b")))
    named = named.join(cut.withColumnRenamed("key", "cut_key"), (F.col("key") == F.col("cut_key")) & (F.col("n_bytes") == F.col("size")), "left")
    all_gone = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    zero, no_spans = F.lit(0).cast("long"), F.expr("cast(array() as array<struct<first: bigint, stop: bigint>>)")
    return named.select(
        "doc_id", "n_bytes",
        F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(all_gone, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(all_gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "text_sha256")).alias("kept_sha256"),
        F.when(all_gone, F.array(F.struct(zero.alias("first"), F.col("n_bytes").alias("stop")))).otherwise(F.coalesce("spans", no_spans)).alias("spans"),
    )


def op1_query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")
