"""Exact document dedup by an exchange of Golomb-coded fingerprints.

1. Each task hashes its normalised texts. Fingerprints and digests are kept as a small table.
2. Each task over that table sends, to the owner of each hash range, its sorted distinct
   fingerprints as one Golomb code of the gaps (parameter a power of two near 0.69 times the mean
   gap), with a bitmap of those that it has twice itself. Messages are coded where the hashes are,
   so only codes are shuffled.
3. Each owner decodes what all tasks sent and returns one bitmap per message: bit i is set if the
   i-th fingerprint of the message is in another one too.
4. Fingerprints under a set bit are suspects. Texts with a suspect's fingerprint are grouped by the
   text itself: that is the byte verification. Partial aggregation sends one row per text and
   task, however many copies there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.shared import SPACE, keep, release, table, text_of

FINGERPRINTS_PER_OWNER = PER_MESSAGE = 1_000_000
RUN = 64


def normalised(text: str | Column) -> Column:
    """The text with each run of white space replaced by one space; null is empty."""
    return F.regexp_replace(text_of(text), f"[{SPACE}]+", " ")


def golomb_encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Sorted distinct unsigned 64-bit values as parameter exponent, coded gaps, and the first bit
    of every ``RUN``-th code, from where runs are decoded side by side."""
    if not len(values):
        return 0, b"", b""
    gaps = np.diff(values, prepend=np.uint64(0))
    mean = max(1.0, float(values[-1]) / len(values))
    b = max(0, min(63, round(math.log2(max(1.0, 0.69 * mean)))))
    quotient = (gaps >> np.uint64(b)).astype(np.int64)
    ends = np.cumsum(quotient + 1 + b)
    bits = np.zeros(int(ends[-1]), np.uint8)
    starts = ends - (quotient + 1 + b)
    ones = np.repeat(starts - np.concatenate(([0], np.cumsum(quotient)[:-1])), quotient) + np.arange(int(quotient.sum()))
    bits[ones] = 1
    for k in range(b):
        bits[ends - 1 - k] = ((gaps >> np.uint64(k)) & np.uint64(1)).astype(np.uint8)
    return b, np.packbits(bits).tobytes(), starts[::RUN].tobytes()


def golomb_decode(n: int, b: int, code: bytes, runs: bytes) -> np.ndarray:
    """The ``n`` values of ``golomb_encode``."""
    if not n:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(np.frombuffer(code, np.uint8))
    at = np.where(bits == 0, np.arange(len(bits)), len(bits))
    next_zero = np.minimum.accumulate(at[::-1])[::-1]
    pos = np.frombuffer(runs, np.int64)
    gaps = np.zeros((RUN, len(pos)), np.uint64)
    for i in range(RUN):
        pos = pos[: (n - i + RUN - 1) // RUN]  # the last run may be shorter
        stop = next_zero[pos]
        gap = (stop - pos).astype(np.uint64) << np.uint64(b)
        for k in range(b):
            gap |= bits[stop + b - k].astype(np.uint64) << np.uint64(k)
        gaps[i, : len(pos)] = gap
        pos = stop + 1 + b
    return np.cumsum(gaps.T.ravel()[:n], dtype=np.uint64)


def owner_of(values: np.ndarray, owners: int) -> np.ndarray:
    """Owners hold consecutive ranges of the hash space."""
    return ((values >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)


def range_start(owner: int, owners: int) -> int:
    return -(-(owner << 32) // owners) << 32


_MESSAGE = "message long, owner long, n long, b int, code binary, runs binary, twice binary"


def _send(owners: int):
    """Messages of all rows of a task, ``PER_MESSAGE`` rows at a time."""

    def message(number: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(parts).view(np.uint64), return_counts=True)
        owner = owner_of(values, owners)
        edges = np.flatnonzero(np.diff(owner, prepend=-1))
        rows = []
        for lo, hi in zip(edges, [*edges[1:], len(values)]):
            b, code, runs = golomb_encode(values[lo:hi] - np.uint64(range_start(int(owner[lo]), owners)))
            rows.append((TaskContext.get().partitionId() << 32 | number, int(owner[lo]), int(hi - lo), b, code, runs, np.packbits(counts[lo:hi] > 1).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=[c.split()[0] for c in _MESSAGE.split(", ")])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, number = [], 0, 0
        for batch in batches:
            parts.append(batch["h"].to_numpy())
            size += batch.num_rows
            if size >= PER_MESSAGE:
                yield message(number, parts)
                parts, size, number = [], 0, number + 1
        if size:
            yield message(number, parts)

    return send


def _answer(messages: pd.DataFrame) -> pd.DataFrame:
    values = [golomb_decode(*m) for m in zip(messages["n"], messages["b"], messages["code"], messages["runs"])]
    _, inverse, counts = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    flags = np.split(counts[inverse] > 1, np.cumsum([len(v) for v in values])[:-1])
    return pd.DataFrame({"message": messages["message"], "owner": messages["owner"], "bitmap": [np.packbits(f).tobytes() for f in flags]})


def _suspects(owners: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for owner, n, b, code, runs, twice, bitmap in zip(*(batch[c] for c in ("owner", "n", "b", "code", "runs", "twice", "bitmap"))):
                hit = np.unpackbits(np.frombuffer(twice, np.uint8) | np.frombuffer(bitmap, np.uint8))[:n].astype(bool)
                if hit.any():
                    values = golomb_decode(n, b, code, runs)[hit] + np.uint64(range_start(owner, owners))
                    yield pd.DataFrame({"suspect": values.view(np.int64)})

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fingerprints_per_owner: int = FINGERPRINTS_PER_OWNER) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after runs of white space become one space; of equal texts
    the row with the smallest doc_id stays. Null text counts as empty. A null doc_id sorts
    last: such a row stays only if no row of its group has an id, and keep_id is null then. Of
    rows that share doc_id and text one stays. Other columns of ``docs`` are ignored; an empty
    table gives no rows.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(text_col).alias("norm")).withColumn("h", F.xxhash64("norm"))
    prints = keep(own.select("doc_id", "h", F.sha2("norm", 256).alias("text_sha256")), "fingerprints")
    shuffles = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owners = max(shuffles, math.ceil(prints.count() / fingerprints_per_owner))

    messages = keep(prints.select("h").mapInArrow(_send(owners), _MESSAGE), "messages")
    bitmaps = messages.groupBy("owner").applyInPandas(_answer, "message long, owner long, bitmap binary")
    suspects = keep(messages.join(bitmaps, ["message", "owner"]).mapInPandas(_suspects(owners), "suspect long").distinct(), "suspects")
    release(messages)

    texts = own.join(suspects, F.col("h") == F.col("suspect"), "left_semi")
    groups = (
        texts.groupBy("norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1").select(F.sha2("norm", 256).alias("group_sha256"), "keep_id", "group_size")
    )
    again = F.row_number().over(Window.partitionBy("text_sha256", "doc_id").orderBy("h"))
    return (
        prints.withColumn("copy", again)
        .join(groups, F.col("text_sha256") == F.col("group_sha256"), "left")
        .select(
            "doc_id",
            F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
            (F.col("group_size").isNull() | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1))).alias("kept"),
            "text_sha256",
        )
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns; rows that share doc_id and text count as one."""
    decided = exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha256"))
    digest = F.sha2(normalised("text"), 256)
    return docs.join(decided, docs["doc_id"].eqNullSafe(decided["kept_id"]) & (digest == decided["kept_sha256"]), "left_semi").dropDuplicates(["doc_id", "text"])


def op2_query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""
