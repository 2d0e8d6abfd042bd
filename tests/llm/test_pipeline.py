"""The whole pipeline against a plain version of its stages."""

import hashlib
import re
from functools import partial

import numpy as np
import pytest
from test_dedup import components_by_force, passage

import corpus_pipeline
from tessella.llm import byte_bpe, byte_cnn, mixing

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars int"


def tables(spark, folder, rows, labels):
    spark.createDataFrame(rows, DOCUMENT).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_run_equals_a_plain_version(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(byte_cnn, "train", partial(byte_cnn.train, epochs=80))  # few rows: more steps
    rng = np.random.default_rng(6)
    good = [passage(rng, int(rng.integers(30, 120))) for _ in range(40)]
    texts = good + ["#0 " * int(rng.integers(40, 90)) for _ in range(30)]
    texts += [good[3], good[4].replace(" ", "\n "), good[5] + " tail", good[5] + " end", None, ""]
    rows = [(i, t, "en", ["hot", "hot", "b", None][i % 4], len(t or "")) for i, t in enumerate(texts)] + [(None, good[7], "en", "b", 3)]
    folder = tables(spark, tmp_path, rows, [(i, int(i < 40), 0) for i in range(70)])
    net = byte_cnn.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))

    accepted = [r for r, s in zip(rows, byte_cnn.score_texts(net, [r[1] for r in rows])) if s >= byte_cnn.THRESHOLD]
    assert {r[0] for r in accepted} >= set(range(40)) and not {r[0] for r in accepted} & set(range(40, 70))
    first = {}
    for r in sorted(accepted, key=lambda r: (r[0] is None, r[0])):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), r)
    left = list(first.values())
    component = components_by_force([r[1] for r in left])
    left = [r for i, r in enumerate(left) if component[i][1] == i]
    text_of = {r[0]: r[1] or "" for r in left}
    assert {3, 4, 5} <= set(text_of) and not {70, 71, 72, 73, None} & set(text_of)

    got = corpus_pipeline.run(spark, folder).collect()
    path, pattern = byte_bpe.default_vocabulary()
    assert {r["doc_id"] for r in got} <= set(text_of)
    counts = mixing.mix_counts(spark.createDataFrame(left, DOCUMENT)).collect()
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in counts if r["taken"] or not r["size"]}
    whole = 0
    for r in got:
        text = text_of[r["doc_id"]]
        if r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest():
            whole += 1
            assert r["n_tokens"] == len(byte_bpe.encode(text, path, pattern))
    assert whole > len(text_of) // 3


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 2])
def test_run_of_empty_and_null_tables(spark, tmp_path, rows):
    folder = tables(spark, tmp_path, rows, [])
    assert {r["n_tokens"] for r in corpus_pipeline.run(spark, folder).collect()} <= {0}


def test_python_steps_expand_a_bounded_part_of_a_batch():
    """Two workers share an executor's memory with its JVM."""
    import tracemalloc

    import numpy as np

    from tessella.llm import byte_cnn, jaccard_join

    rng = np.random.default_rng(0)
    net = byte_cnn.ByteCNN(*(rng.normal(size=s).astype(np.float32) for s in ((8, 256, 16), (17, 16), (16,))), rng.normal(size=16), 0.1)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 5000, 400)) for _ in range(1000)]
    for step, most in ((lambda: byte_cnn.score_texts(net, texts), 20e6), (lambda: jaccard_join.shingle_sets(texts), 16e6)):
        tracemalloc.start()
        try:
            step()
            assert tracemalloc.get_traced_memory()[1] < most
        finally:
            tracemalloc.stop()
