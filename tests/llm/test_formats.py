"""WARC and Matroska round trips, and byte-level BPE against a public implementation."""

import base64
import hashlib
import itertools
import struct
import zlib

import numpy as np
import pytest

from tessella.llm import byte_bpe, matroska, warc

AWKWARD = [None, "", " ", "  two  spaces\r\n\r\nand lines\n", "é ü 漢字 🙂 x y", "a" * 9_000, "don't I'LL 12345 ...!!! \t\t x", "<|endoftext|>", "0" * 999, "0" * 1000]


# --- op6 ---------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    html = [*AWKWARD, *["<p>" + "same " * 300] * 40, "<p>" + "same " * 300 + "!"]
    pages = spark.createDataFrame([(i, f"http://h/{i}\n x" if i % 3 else None, h, "clash") for i, h in enumerate(html)], "page_id long, url string, html string, same string")
    got = {r["page_id"]: tuple(r)[1:] for r in warc.warc_round_trip(pages).collect()}
    raws = [(h or "").encode() for h in html]
    for i, raw in enumerate(raws):
        last = max(j for j, other in enumerate(raws) if other == raw)
        revisit = len(raw) >= 1000 and i != last
        assert got[i] == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", last if revisit else None)
    assert warc.warc_round_trip(pages.limit(0)).count() == 0
    texts = {r["page_id"]: r["payload"] for r in warc.read_warc(warc.write_warc(pages)).filter("record_type = 'response'").collect()}
    assert all(bytes(v) == raws[k] for k, v in texts.items())


def test_warc_null_ids(spark):
    pages = spark.createDataFrame([(None, None, "x" * 1200), (3, None, "x" * 1200), (None, None, "y" * 1200), (None, None, "y" * 1200)], "page_id long, url string, html string")
    rows = warc.warc_round_trip(pages).collect()
    assert sorted((r["record_type"], r["refers_to"] or 0) for r in rows) == [("response", 0)] * 3 + [("revisit", 3)]


def test_warc_damage_is_seen():
    good = warc.record(1, "http://h/", b"payload")
    assert [ok for *_, ok in warc.records([good[:10], good[10:], good])] == [True, True]
    raw = zlib.decompress(good, 31).replace(b"payload", b"pAyload")
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    assert [ok for *_, ok in warc.records([deflate.compress(raw) + deflate.flush()])] == [False]
    with pytest.raises(ValueError):
        list(warc.records([good[:-9]]))


def test_warc_files(spark, tmp_path):
    (tmp_path / "one.warc.gz").write_bytes(warc.record(1, "http://h/1", b"first") + warc.record(2, None, b""))
    rows = warc.read_warc_files(spark, str(tmp_path)).orderBy("page_id").collect()
    assert [(r["page_id"], bytes(r["payload"]), r["valid"]) for r in rows] == [(1, b"first", True), (2, b"", True)]


# --- op9 ---------------------------------------------------------------------------------------


def test_matroska_round_trip(documents):
    texts = [*AWKWARD, "x" * 64, "x" * 65, "y" * 300_000, AWKWARD[4]]
    rows = matroska.media_digest(matroska.mux_texts(documents(texts))).orderBy("doc_id").collect()
    for r, t in zip(rows, texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert tuple(rows[4])[1:] == tuple(rows[-1])[1:]
    assert matroska.media_digest(matroska.mux_texts(documents([]))).count() == 0


def test_archives_cut_anywhere_are_an_error():
    whole = [warc.record(i, f"http://a/{i}", b"p" * (i * 700)) for i in range(2)]
    for cut in range(1, len(whole[1])):
        for size in (7, 1 << 16):
            data = whole[0] + whole[1][:cut]
            found = warc.records(data[i : i + size] for i in range(0, len(data), size))
            assert next(found)[2]
            with pytest.raises(ValueError):
                next(found)
    assert len(list(warc.records([b"".join(whole), b""]))) == 2


@pytest.mark.parametrize("field,valid", [("", True), ("WARC-Payload-Digest: md5:abc\r\n", True), ("WARC-Payload-Digest: sha1:not base 32\r\n", True), ("WARC-Payload-Digest: sha1:" + "0" * 40 + "\r\n", False), (f"WARC-Payload-Digest: sha1:{hashlib.sha1(b'body').hexdigest()}\r\n", True)])
def test_foreign_digests(field, valid):
    block = b"HTTP/1.1 200 OK\r\n\r\nbody"
    raw = f"WARC/1.0\r\nWARC-Type: response\r\n{field}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    row = next(warc._parsed([deflate.compress(raw) + deflate.flush()]))
    assert row[5] == hashlib.sha1(b"body").hexdigest() and row[6] == b"body" and row[7] == valid


def test_packet_table(documents):
    media = matroska.mux_texts(documents(["q" * 5000, None]))
    data = {r["doc_id"]: bytes(r["media"]) for r in media.collect()}
    packets = matroska.packet_table(media).orderBy("doc_id", "packet").collect()
    assert b"".join(data[0][r["first_byte"] : r["first_byte"] + r["n_bytes"]] for r in packets if r["doc_id"] == 0) == b"q" * 5000 + b"\0" * (-5000 % 64)
    assert [r["timestamp_ns"] for r in packets if r["doc_id"] == 0] == sorted(r["timestamp_ns"] for r in packets if r["doc_id"] == 0)


@pytest.mark.parametrize("lacing", [0, 1, 2, 3])
def test_foreign_lacing_and_unknown_sizes(lacing):
    frames = [b"a" * 300, b"b" * 300, b"c" * 300] if lacing == 2 else [b"a" * 300, b"b" * 255, b"c" * 7]
    frames = frames[:1] if not lacing else frames
    head = matroska.coded(1) + struct.pack(">hB", 5, lacing << 1)
    if lacing == 1:
        head += bytes([2, 255, 45, 255, 0])
    elif lacing == 2:
        head += bytes([2])
    elif lacing == 3:
        head += bytes([2]) + matroska.coded(300, 2) + matroska.coded(-45 + (1 << 13) - 1, 2)
    group = matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, head + b"".join(frames)))
    cluster = matroska.element(matroska.TIMESTAMP, 10) + group
    unknown = bytes([0xFF])
    segment = matroska.element(matroska.INFO, matroska.element(matroska.TIMESTAMP_SCALE, 1_000_000))
    for _ in range(2):
        segment += matroska.CLUSTER.to_bytes(4, "big") + unknown + cluster
    data = matroska.element(matroska.EBML, matroska.element(matroska.DOC_TYPE, b"matroska")) + matroska.SEGMENT.to_bytes(4, "big") + unknown + segment
    parsed = matroska.parse(data)
    assert [data[p[2] : p[2] + p[3]] for p in parsed.packets] == frames * 2
    assert {p[1] for p in parsed.packets} == {15_000_000} and {p[5] for p in parsed.packets} == {lacing}
    with pytest.raises(ValueError):
        matroska.parse(matroska._HEAD + matroska.element(matroska.SEGMENT, b"x" * 50)[:20])


# --- op10 --------------------------------------------------------------------------------------


def test_bpe_equals_the_public_library(documents):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = byte_bpe.default_vocabulary()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    public = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(8)
    texts = [*AWKWARD, "".join(chr(97 + c) for c in rng.integers(0, 26, 3000)), "".join(chr(c) for c in rng.integers(0x4E00, 0x9000, 400)), "ab" * 4000, "-=" * 500]
    rows = byte_bpe.bpe_digest(documents(texts)).orderBy("doc_id").collect()
    for r, t in zip(rows, texts):
        ids = public.encode_ordinary(t or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    coded = byte_bpe.bpe_encode(documents(texts))
    assert {r["doc_id"]: bytes(r["decoded"]) for r in byte_bpe.bpe_decode(coded).collect()} == {i: (t or "").encode() for i, t in enumerate(texts)}
    assert byte_bpe.bpe_digest(documents([])).count() == 0


def test_tree_joins_equal_whole_merges():
    rng = np.random.default_rng(0)
    pieces = [bytes(p) for p in itertools.product(b"ab", repeat=2)] + [b"aba", b"abab", b"bba", b"babab", b"aab"]
    ranks = {bytes([c]): c for c in range(256)} | {p: 256 + i for i, p in enumerate(pieces)}
    bpe = byte_bpe.TreeBPE(ranks)
    for n in (1, 2, 17, 33, 100, 400):
        raw = bytes(rng.integers(97, 99, n).astype(np.uint8))
        assert bpe.tree(raw) == bpe.merged(raw) and b"".join(bpe.tree(raw)) == raw
