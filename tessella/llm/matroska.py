"""Media columns: Matroska files in a binary column, muxed and parsed into packet tables.

``parse`` walks EBML elements (variable-length ids and sizes, unknown sizes included), clusters,
SimpleBlocks and BlockGroups with any lacing, and cues. ``mux`` writes a byte payload as 8-bit
mono PCM at 8,000 Hz, 8 bytes a millisecond.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import arrow_map, table

#: Fixed values of the format: element ids.
EBML, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x1A45DFA3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
CONTAINERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
TOP_LEVEL = {CLUSTER, CUES, INFO, TRACKS}

UNIT = 64
FRAME_BYTES, LACED_FRAMES, BLOCKS_PER_CLUSTER, BYTES_PER_MS = 512, 8, 64, 8


@dataclass
class Parsed:
    """packets: (track, timestamp in ns, first byte, bytes, keyframe, lacing); cues: (timestamp
    in ns, track, byte of the cluster); codecs by track."""

    packets: list[tuple[int, int, int, int, bool, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    codecs: dict[int, str] = field(default_factory=dict)
    doc_type: str = ""


def number(data, at: int, keep_marker: bool) -> tuple[int, int, bool]:
    """A variable-length number at ``at``: value, bytes, and whether all its value bits are 1."""
    first = data[at]
    if not first:
        raise ValueError(f"byte {at} starts no EBML number")
    size = 9 - first.bit_length()
    raw = int.from_bytes(data[at : at + size], "big")
    if at + size > len(data):
        raise ValueError("the file ends inside a number")
    bits = raw & ((1 << 7 * size) - 1)
    return (raw if keep_marker else bits), size, bits == (1 << 7 * size) - 1


def coded(value: int, size: int | None = None) -> bytes:
    """A size as variable-length number, as short as possible unless ``size`` is given."""
    if size is None:
        size = 1
        while value >= (1 << 7 * size) - 1:
            size += 1
    return (value | 1 << 7 * size).to_bytes(size, "big")


def element(kind: int, content: bytes | int) -> bytes:
    if isinstance(content, int):
        content = content.to_bytes(max(1, (content.bit_length() + 7) // 8), "big")
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + coded(len(content)) + content


def laced(data, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """(first byte, bytes) of a block's frames; lacing 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if not lacing:
        return [(at, end - at)]
    count, at, sizes = data[at] + 1, at + 1, []
    if lacing == 2:
        if (end - at) % count:
            raise ValueError("fixed lacing of unequal frames")
        sizes = [(end - at) // count] * count
    elif lacing == 1:
        for _ in range(count - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    else:
        for i in range(count - 1):
            value, n, _ = number(data, at, False)
            sizes.append(value if not i else sizes[-1] + value - ((1 << 7 * n - 1) - 1))
            at += n
    if lacing != 2:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or at + sum(sizes) != end:
        raise ValueError("the laced frames don't fill their block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def parse(data: bytes) -> Parsed:
    """All packets and cues of a file. Raises ValueError if an element is cut short."""
    try:
        return _parsed(data)
    except IndexError as end:
        raise ValueError("the file ends inside an element") from end


def _parsed(data: bytes) -> Parsed:
    out, scale, segment_at, cluster_time, track, cue = Parsed(), 1_000_000, 0, 0, 0, [0, 0]

    def walk(at: int, end: int, inside: int) -> int:
        nonlocal scale, segment_at, cluster_time, track
        while at < end:
            kind, n, _ = number(data, at, True)
            size, m, unknown = number(data, at + n, False)
            if inside == CLUSTER and kind in TOP_LEVEL:
                return at  # a cluster of unknown size ends here
            body = at + n + m
            stop = end if unknown else body + size
            if stop > end:
                raise ValueError(f"the element at byte {at} is cut short")
            if kind == SEGMENT:
                segment_at = body
            if kind in CONTAINERS or kind == EBML:
                stop = walk(body, stop, kind)
            elif kind in (SIMPLE_BLOCK, BLOCK):
                number_, t, _ = number(data, body, False)
                offset, flags = struct.unpack_from(">hB", data, body + t)
                lacing = flags >> 1 & 3
                frames = laced(data, body + t + 3, stop, lacing)
                out.packets.extend((number_, (cluster_time + offset) * scale, first, bytes_, kind == BLOCK or flags >= 128, lacing) for first, bytes_ in frames)
            elif kind == TIMESTAMP:
                cluster_time = int.from_bytes(data[body:stop], "big")
            elif kind == TIMESTAMP_SCALE:
                scale = int.from_bytes(data[body:stop], "big")
            elif kind == TRACK_NUMBER:
                track = int.from_bytes(data[body:stop], "big")
            elif kind == CODEC_ID:
                out.codecs[track] = data[body:stop].decode("ascii", "replace")
            elif kind == DOC_TYPE:
                out.doc_type = data[body:stop].decode("ascii", "replace")
            elif kind == CUE_TIME:
                cue[0] = int.from_bytes(data[body:stop], "big")
            elif kind == CUE_TRACK:
                cue[1] = int.from_bytes(data[body:stop], "big")
            elif kind == CUE_CLUSTER_POSITION:
                out.cues.append((cue[0] * scale, cue[1], segment_at + int.from_bytes(data[body:stop], "big")))
            at = stop
        return at

    walk(0, len(data), 0)
    return out


_HEAD = element(EBML, element(DOC_TYPE, b"matroska") + element(DOC_TYPE_VERSION, 4) + element(DOC_TYPE_READ_VERSION, 2))
_START = element(INFO, element(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, b"tessella") + element(WRITING_APP, b"tessella")) + element(
    TRACKS, element(TRACK_ENTRY, element(TRACK_NUMBER, 1) + element(TRACK_UID, 1) + element(TRACK_TYPE, 2) + element(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", 8000.0)) + element(CHANNELS, 1) + element(BIT_DEPTH, 8)))
)


def simple_block(frames: list[bytes], offset: int) -> bytes:
    """One frame without lacing, equal frames with fixed lacing, others with EBML lacing."""
    sizes = [len(f) for f in frames]
    lacing = 0 if len(frames) == 1 else 2 if len(set(sizes)) == 1 else 3
    head = coded(1) + struct.pack(">hB", offset, 0x80 | lacing << 1)
    if lacing:
        head += bytes([len(frames) - 1])
    if lacing == 3:
        head += coded(sizes[0])
        for before, size in zip(sizes, sizes[1:-1]):
            n = 1
            while abs(size - before) >= (1 << 7 * n - 1) - 1:
                n += 1
            head += coded(size - before + (1 << 7 * n - 1) - 1, n)
    return element(SIMPLE_BLOCK, head + b"".join(frames))


def mux(payload: bytes) -> bytes:
    """A file that holds ``payload``, whose length is a multiple of 8, as one PCM track."""
    segment, cues = [_START], []
    position = len(_START)
    per_cluster = FRAME_BYTES * LACED_FRAMES * BLOCKS_PER_CLUSTER
    for lo in range(0, len(payload), per_cluster):
        blocks = []
        for at in range(lo, min(lo + per_cluster, len(payload)), FRAME_BYTES * LACED_FRAMES):
            stop = min(at + FRAME_BYTES * LACED_FRAMES, len(payload))
            blocks.append(simple_block([payload[i : min(i + FRAME_BYTES, stop)] for i in range(at, stop, FRAME_BYTES)], (at - lo) // BYTES_PER_MS))
        cluster = element(CLUSTER, element(TIMESTAMP, lo // BYTES_PER_MS) + b"".join(blocks))
        cues.append(element(CUE_POINT, element(CUE_TIME, lo // BYTES_PER_MS) + element(CUE_TRACK_POSITIONS, element(CUE_TRACK, 1) + element(CUE_CLUSTER_POSITION, position))))
        segment.append(cluster)
        position += len(cluster)
    return _HEAD + element(SEGMENT, b"".join([*segment, element(CUES, b"".join(cues))]))


def text_payload(text: str | None) -> tuple[int, bytes]:
    """UTF-8 bytes filled with zeros to a positive multiple of ``UNIT``, and their count before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b"\0")


def feature(parsed: Parsed, payload: bytes) -> str:
    """Packets, cues, duration in ms, sum of samples, zero crossings about 128, and the counts of
    samples in 16 equal ranges."""
    x = np.frombuffer(payload, np.uint8)
    high = x >= 128
    return ";".join(map(str, (len(parsed.packets), len(parsed.cues), len(payload) // BYTES_PER_MS, int(x.sum(dtype=np.int64)), int((high[1:] != high[:-1]).sum()), ",".join(map(str, np.bincount(x >> 4, minlength=16))))))


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per packet of a column of Matroska files: doc_id, packet, track, timestamp_ns,
    first_byte, n_bytes, keyframe, lacing. Null and empty files have no packets."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for doc_id, data in zip(batch["doc_id"].to_pylist(), batch["media"]):
            packets = parse(data.as_py()).packets if data.is_valid else []
            if packets:
                track, timestamp, first, n, key, lacing = zip(*packets)
                yield {"doc_id": [doc_id] * len(packets), "packet": range(len(packets)), "track": track, "timestamp_ns": timestamp, "first_byte": first, "n_bytes": n, "keyframe": key, "lacing": lacing}

    own = media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media"))
    return arrow_map(own, run, "doc_id long, packet long, track long, timestamp_ns long, first_byte long, n_bytes long, keyframe boolean, lacing int")


def mux_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media (binary): each text as a file; null text is empty."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        pairs = [text_payload(t) for t in batch["text"].to_pylist()]
        yield {"doc_id": batch["doc_id"], "n_bytes": [n for n, _ in pairs], "media": [mux(p) for _, p in pairs]}

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(own, run, "doc_id long, n_bytes long, media binary")


def media_digest(media: DataFrame) -> DataFrame:
    """Reads each file of (doc_id, n_bytes, media) back by its packets; per row doc_id, n_bytes,
    payload_bytes, payload_sha256, tail_crc32 (of the last 64 bytes), media_bytes, media_sha256,
    feature. Null media gives nulls; repeated rows repeat; no rows give none."""

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        rows = []
        for value in batch["media"]:
            if not value.is_valid:
                rows.append((None,) * 6)
                continue
            data = value.as_py()
            parsed = parse(data)
            payload = b"".join(data[first : first + n] for _, _, first, n, _, _ in parsed.packets)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(parsed, payload)))
        if rows:
            yield {"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"], **dict(zip(names, map(list, zip(*rows))))}

    return arrow_map(media.select("doc_id", "n_bytes", "media"), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op9_query(spark, sf_dir: str) -> DataFrame:
    return media_digest(mux_texts(table(spark, sf_dir, "documents")))
