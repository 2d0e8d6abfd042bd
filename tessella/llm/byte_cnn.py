"""Quality classifier: a byte-level convolutional network in numpy.

Input channels are the text's UTF-8 bytes and a repetition channel: the shortest of ``LAGS`` at
which the four bytes in a filter's middle stood before. Filters of ``WIDTH`` bytes move by
``STRIDE`` over the whole document; a filter's response is a sum of learned table rows, one per
byte position and one for the lag, so no one-hot input is formed. Chunks of ``CHUNK`` bytes
overlap by one block; responses are max-pooled in each chunk, and the mean of the chunks' pooled
responses gives one probability.

Fitting is on the driver, on all chunks of a bounded sample of rows: of each label class the
``SAMPLE_PER_CLASS`` rows with the smallest hash, fewer if their texts together pass
``SAMPLE_BYTES``. Class weights restore the label shares of all training rows, so scores are probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import arrow_map, joined_bytes, slices, table, text_of

WIDTH, STRIDE, FILTERS = 8, 2, 16
BLOCK, CHUNK_BLOCKS = 64, 8
CHUNK = BLOCK * CHUNK_BLOCKS
LAGS = tuple(range(1, 17))
SAMPLE_PER_CLASS, SAMPLE_BYTES = 1500, 8 << 20
EPOCHS, RATE, SEED = 10, 0.005, 7
THRESHOLD = 0.3
FOLDS, HELD_OUT_FOLD = 5, 0


@dataclass(frozen=True)
class ByteCNN:
    """Weights: table (WIDTH, 256, FILTERS), lag (len(LAGS) + 1, FILTERS), bias, and the head."""

    table: np.ndarray
    lag: np.ndarray
    bias: np.ndarray
    head: np.ndarray
    head_bias: float


def repeats(data: np.ndarray, count: int) -> np.ndarray:
    """For filter positions 0, STRIDE, 2 * STRIDE, ...: 1 + the index of the shortest lag at which
    the filter's bytes 2 to 5 stood before; 0 if at none or if that lies before the first byte."""
    words = data[:-3].astype(np.uint32)
    for k in (1, 2, 3):
        words |= data[k : len(data) - 3 + k].astype(np.uint32) << np.uint32(8 * k)
    out = np.zeros(count, np.int8)
    for k in range(len(LAGS) - 1, -1, -1):
        first = max(0, -(-(LAGS[k] - 2) // STRIDE))
        here = words[first * STRIDE + 2 :: STRIDE][: count - first]
        there = words[first * STRIDE + 2 - LAGS[k] :: STRIDE][: len(here)]
        np.putmask(out[first:], here == there, k + 1)
    return out


def responses(net: ByteCNN, data: np.ndarray, lags: np.ndarray) -> np.ndarray:
    """Of filter positions 0, STRIDE, ... as (len(lags), FILTERS)."""
    out = net.lag.take(lags, axis=0)
    for j in range(WIDTH):
        out += net.table[j].take(data[j :: STRIDE][: len(lags)], axis=0)
    return out + net.bias


def padded(texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts, each filled with zeros to whole blocks (one at least), then WIDTH
    more zeros; and the block at which each text starts, with the end."""
    data, offsets = joined_bytes(texts)
    blocks = np.maximum(1, -(-np.diff(offsets) // BLOCK))
    first = np.concatenate(([0], np.cumsum(blocks)))
    out = np.zeros(first[-1] * BLOCK + WIDTH, np.uint8)
    shift = np.repeat(first[:-1] * BLOCK - offsets[:-1], np.diff(offsets))
    out[np.arange(len(data)) + shift] = data
    return out, first


def pooled(net: ByteCNN, texts) -> np.ndarray:
    """Per text the mean over its chunks of the chunks' max-pooled responses."""
    data, first = padded(texts)
    # a filter that starts near the end of a text's last block would see the next text
    per = BLOCK // STRIDE
    blocks = np.empty((int(first[-1]), FILTERS), np.float32)
    step = 1 << 11
    for lo in range(0, int(first[-1]), step):
        hi = min(lo + step, int(first[-1]))
        before = min(lo * BLOCK, BLOCK)
        own = data[lo * BLOCK - before : hi * BLOCK + WIDTH]
        lags = repeats(own, ((hi - lo) * BLOCK + before) // STRIDE)[before // STRIDE :].reshape(hi - lo, per)
        begins = np.flatnonzero(np.isin(np.arange(lo, hi), first[:-1]))
        lags[begins] *= lags[begins] <= np.arange(0, BLOCK, STRIDE) + 2  # what stands before a text isn't its own
        r = responses(net, own[before:], lags.ravel()).reshape(hi - lo, per, FILTERS)
        inner = r[:, : per - WIDTH // STRIDE + 1].max(1)
        whole = np.maximum(inner, r[:, per - WIDTH // STRIDE + 1 :].max(1))
        last = np.isin(np.arange(lo, hi), first[1:] - 1)
        blocks[lo:hi] = np.where(last[:, None], inner, whole)
    np.maximum(blocks, 0, out=blocks)
    chunks, sizes = [], []
    counts = np.diff(first)
    n_chunks = np.maximum(1, -(-(counts - 1) // (CHUNK_BLOCKS - 1)))
    at = np.repeat(first[:-1], n_chunks) + (CHUNK_BLOCKS - 1) * (np.arange(n_chunks.sum()) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks))
    stop = np.minimum(at + CHUNK_BLOCKS, np.repeat(first[1:], n_chunks))
    by_chunk = blocks[at]
    for k in range(1, CHUNK_BLOCKS):
        by_chunk = np.maximum(by_chunk, blocks[np.minimum(at + k, stop - 1)])
    edges = np.cumsum(n_chunks) - n_chunks
    return np.add.reduceat(by_chunk.astype(np.float64), edges) / n_chunks[:, None]


def probability(net: ByteCNN, features: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip((features * net.head).sum(1) + net.head_bias, -30, 30)))


def score_texts(net: ByteCNN, texts) -> np.ndarray:
    """Probability that each text is good; empty and null texts are scored as zero bytes."""
    out = np.empty(len(texts))
    for lo, hi in slices(texts, 1 << 19):
        out[lo:hi] = probability(net, pooled(net, texts[lo:hi]))
    return out


def fit(samples: list[list[bytes]], labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> ByteCNN:
    """Adam on weighted log loss; gradients flow to each chunk's largest response only."""
    rng = np.random.default_rng(seed)
    p = {"table": rng.normal(0, 0.08, (WIDTH, 256, FILTERS)).astype(np.float32), "lag": rng.normal(0, 0.08, (len(LAGS) + 1, FILTERS)).astype(np.float32), "bias": np.zeros(FILTERS, np.float32), "head": rng.normal(0, 0.3, FILTERS), "head_bias": np.zeros(1)}
    m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    starts = np.arange(0, CHUNK - WIDTH + 1, STRIDE)
    per_block = BLOCK // STRIDE
    data = [np.stack([np.frombuffer(c.ljust(CHUNK, b"\0"), np.uint8) for c in chunks]) for chunks in samples]
    lags = [np.stack([repeats(c, len(starts)) for c in d]) for d in data]
    used = [np.array([max(1, -(-len(c) // BLOCK)) * per_block - WIDTH // STRIDE + 1 for c in chunks]) for chunks in samples]
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        for lo in range(0, len(order), 32):
            batch = order[lo : lo + 32]
            d = np.concatenate([data[i] for i in batch])
            g_lag = np.concatenate([lags[i] for i in batch])
            u = np.concatenate([used[i] for i in batch])
            counts = np.array([len(data[i]) for i in batch])
            edges = np.cumsum(counts) - counts
            r = p["lag"].take(g_lag, axis=0) + p["bias"]
            for j in range(WIDTH):
                r += p["table"][j].take(d[:, starts + j], axis=0)
            r[np.arange(len(starts))[None, :] >= u[:, None]] = -1e9
            best = r.argmax(1)
            top = np.maximum(np.take_along_axis(r, best[:, None, :], 1)[:, 0], 0).astype(np.float64)
            x = np.add.reduceat(top, edges) / counts[:, None]
            prob = 1 / (1 + np.exp(-np.clip(x @ p["head"] + p["head_bias"], -30, 30)))
            err = weights[batch] * (prob - labels[batch]) / weights[batch].sum()
            g = {"head": x.T @ err + 1e-4 * p["head"], "head_bias": np.array([err.sum()])}
            dtop = np.repeat(err[:, None] * p["head"] / counts[:, None], counts, 0) * (top > 0)
            g["bias"] = dtop.sum(0)
            g["lag"], g["table"] = np.zeros_like(p["lag"]), np.zeros_like(p["table"])
            f = np.broadcast_to(np.arange(FILTERS), best.shape)
            np.add.at(g["lag"], (np.take_along_axis(g_lag, best, 1), f), dtop)
            for j in range(WIDTH):
                np.add.at(g["table"][j], (d[np.arange(len(d))[:, None], starts[best] + j], f), dtop)
            t += 1
            lr = rate * (1 - 0.9 * epoch / max(1, epochs - 1))
            for k in p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] ** 2 - v[k])
                p[k] -= (lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(p[k].dtype)
    return ByteCNN(p["table"], p["lag"].astype(np.float32), p["bias"].astype(np.float32), p["head"], float(p["head_bias"][0]))


def chunks_of(text: str | None) -> list[bytes]:
    """The overlapping chunks over which ``pooled`` pools."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    step, blocks = BLOCK * (CHUNK_BLOCKS - 1), max(1, -(-len(raw) // BLOCK))
    return [raw[i * step : i * step + CHUNK] for i in range(max(1, -(-(blocks - 1) // (CHUNK_BLOCKS - 1))))]


def held_out(id_col: str = "doc_id"):
    """Rows that fitting never sees; a null id hashes as the empty string."""
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS) == HELD_OUT_FOLD


def _constant(share: float) -> ByteCNN:
    zeros = lambda *shape: np.zeros(shape, np.float32)
    return ByteCNN(zeros(WIDTH, 256, FILTERS), zeros(len(LAGS) + 1, FILTERS), zeros(FILTERS), np.zeros(FILTERS), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, label_col: str = "quality", epochs: int = EPOCHS, sample_bytes: int = SAMPLE_BYTES) -> ByteCNN:
    """Fits on whole texts of at most ``2 * per_class`` labelled rows outside the held-out fold,
    and of each class on no more than ``sample_bytes``. Rows with a null id or label are not used,
    nor are ids that are labelled both ways. With labels of one class only, or none, the network
    scores that class's share (0.5 without labels)."""
    own = labels.filter(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1) & ~held_out()).select(F.col("doc_id").cast("long").alias("label_id"), F.col(label_col).cast("int").alias("label"))
    own = own.groupBy("label_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").drop("other")
    totals = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    if not totals:
        return _constant(0.5)
    ranked = F.xxhash64(F.col("label_id"), F.lit(SEED))
    chosen = own.filter("label = 0").orderBy(ranked, "label_id").limit(per_class).unionByName(own.filter("label = 1").orderBy(ranked, "label_id").limit(per_class))
    session, texts = docs.sparkSession, docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    ids = [(r["label_id"], r["label"]) for r in chosen.collect()]  # 2 * per_class rows
    found = texts.join(F.broadcast(session.createDataFrame(ids, "label_id long, label int")), F.col("doc_id") == F.col("label_id"))
    sizes = {(r["label"], r["doc_id"]): r["size"] for r in found.groupBy("label", "doc_id").agg(F.sum(F.octet_length("text")).alias("size")).collect()}
    taken, used = [], {0: 0, 1: 0}
    for doc_id, label in ids:
        size = sizes.get((label, doc_id))
        if size is not None and used[label] + size <= sample_bytes:
            used[label] += size
            taken.append((doc_id, label))
    rows = found.join(F.broadcast(session.createDataFrame([t[:1] for t in taken], "taken long")), F.col("doc_id") == F.col("taken"), "left_semi").select("doc_id", "label", "text").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    y = np.array([r["label"] for r in rows], float)
    if len(set(y)) < 2:
        return _constant(sum(k * n for k, n in totals.items()) / sum(totals.values()))
    count = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    return fit([chunks_of(r["text"]) for r in rows], y, np.array([totals[int(k)] / count[int(k)] for k in y]), epochs)


def score(docs: DataFrame, net: ByteCNN, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. Scores depend on the text alone; null text
    is empty. Null ids stay null, repeated rows repeat, other columns are ignored, and an empty
    table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a fixed size

    def run(batch):
        yield {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": score_texts(shared.value, batch["text"].to_pylist())}

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text"))
    return arrow_map(own, run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_rejected(docs: DataFrame, net: ByteCNN, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the network accepts, all columns as they are, nulls and long ids
    included. Null text is judged as empty; repeated rows are judged alike; no rows give none."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(score_texts(shared.value, batch["text"].to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op8_query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
