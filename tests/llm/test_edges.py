"""Long ids beside nulls, repeated rows and empty tables, for every operator."""

import numpy as np
import pytest

from tessella.llm import byte_bpe, byte_cnn, exact_dedup, jaccard_join, line_dedup, matroska, minhash_dedup, mixing, pitman_yor, suffix_dedup, warc

BIG = 2**60 + 1
TEXTS = ["one text of six words here"] * 2 + ["another text", "another text", None, "y" * 300, "y" * 300]
IDS = [BIG, BIG + 2, None, BIG + 4, BIG + 6, None, BIG + 8]


def network():
    rng = np.random.default_rng(0)
    return byte_cnn.ByteCNN(*(rng.normal(size=s).astype(np.float32) for s in ((8, 256, 16), (17, 16), (16,))), rng.normal(size=16), 0.1)


PER_ROW = {
    "op1": suffix_dedup.remove_repeats,
    "op2": exact_dedup.exact_dedup,
    "op3": lambda docs: pitman_yor.score(docs, pitman_yor.fit(docs.select("text"))),
    "op4": mixing.mix_counts,
    "op7": jaccard_join.jaccard_components,
    "op8": lambda docs: byte_cnn.score(docs, network()),
    "op9": lambda docs: matroska.media_digest(matroska.mux_texts(docs)),
    "op10": byte_bpe.bpe_digest,
    "op10 ids": lambda docs: byte_bpe.bpe_decode(byte_bpe.bpe_encode(docs)),
    "op11": minhash_dedup.minhash_components,
    "rejected": lambda docs: byte_cnn.drop_rejected(docs, network(), 0.0),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_a_row_for_each_row_with_its_own_id(documents, name):
    docs = documents([*TEXTS, TEXTS[0]], ids=[*IDS, BIG]).coalesce(1)
    got = sorted(r["doc_id"] or 0 for r in PER_ROW[name](docs).collect())
    assert got == sorted(i or 0 for i in [*IDS, BIG])


def test_long_ids_in_results(documents, spark):
    docs = documents(TEXTS, ids=IDS).coalesce(1)
    exact = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(docs).collect()}
    assert exact == {(BIG, BIG, 2), (BIG + 2, BIG, 2), (None, BIG + 4, 2), (BIG + 4, BIG + 4, 2), (BIG + 6, BIG + 6, 1), (None, BIG + 8, 2), (BIG + 8, BIG + 8, 2)}
    near = {(r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_components(docs).collect() if r["doc_id"]}
    assert near == {(BIG, BIG), (BIG + 2, BIG), (BIG + 4, BIG + 4), (BIG + 6, BIG + 6), (BIG + 8, BIG + 8)}
    lines = {r["doc_id"]: r["n_kept"] for r in line_dedup.line_dedup(docs).collect()}
    assert lines == {BIG: 1, BIG + 2: 0, BIG + 4: 1, BIG + 6: 0, BIG + 8: 1, None: 0}
    pages = spark.createDataFrame([(i, None, "z" * 1000) for i in (BIG, BIG + 2, None)], "page_id long, url string, html string").coalesce(1)
    got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.warc_round_trip(pages).collect()}
    assert got == {(BIG, "revisit", BIG + 2), (BIG + 2, "response", None), (None, "revisit", BIG + 2)}
    packets = matroska.packet_table(matroska.mux_texts(docs)).select("doc_id").distinct().collect()
    assert {r["doc_id"] for r in packets} == set(IDS)


def test_labels_of_both_kinds_are_not_used(documents, spark):
    docs = documents(["good text"] * 6 + ["bad"] * 6)
    labels = spark.createDataFrame([(i, int(i < 6), 0) for i in range(12)] + [(i, 1, 0) for i in range(6, 12)], "doc_id long, quality int, toxic int")
    net = byte_cnn.train(docs, labels)
    assert all(r["score"] > 0.9 for r in byte_cnn.score(docs, net).collect())


def test_pooling_equals_a_plain_convolution():
    net, rng = network(), np.random.default_rng(2)
    for text in ["", "a", "abcabcabc" * 9, "".join(map(chr, rng.integers(32, 127, 3000)))]:
        raw = text.encode()
        blocks = max(1, -(-len(raw) // 64))
        padded = raw.ljust(blocks * 64, b"\0")
        last = len(padded) - 8
        responses = {}
        for at in range(0, last + 1, 2):
            lag = next((k for k in range(1, 17) if at + 2 - k >= 0 and padded[at + 2 : at + 6] == padded[at + 2 - k : at + 6 - k]), 0)
            responses[at] = net.lag[lag] + net.bias + sum(net.table[j][padded[at + j]] for j in range(8))
        pools = []
        for first in range(0, max(1, blocks - 1), 7):
            here = [r for at, r in responses.items() if first * 64 <= at < (first + 8) * 64]
            pools.append(np.maximum(np.max(here, axis=0), 0))
        want = np.mean(pools, axis=0)
        assert np.allclose(byte_cnn.pooled(net, [text])[0], want, atol=1e-4)
