"""The filter audit and embedding whitening against plain versions, and their edge cases."""

import re
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest

from tessella.llm import filter_audit, whitening

COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit_by_hand(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    fails = []
    for i, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        fails.append((i, lang or "", f))
    out, removed_of = {}, defaultdict(int)
    for part in {p for _, p, _ in fails}:
        for order in map("".join, permutations("ABCDE")):
            left = [x for x in fails if x[1] == part]
            gone = []
            for step, name in enumerate(order, 1):
                here = [x for x in left if x[2][name]]
                redundant = sum(x[2][name] for x in gone)
                left, gone = [x for x in left if not x[2][name]], gone + here
                unique = sum(1 for x in fails if x[1] == part and x[2][name] and sum(x[2].values()) == 1)
                out[part, order, step] = [len(left), len(here), redundant, unique, sum(x[0] in good for x in here), sum(x[0] in toxic for x in here)]
                removed_of[part, name] += len(here)
    return {k: [*v, removed_of[k[0], k[1][k[2] - 1]]] for k, v in out.items()}


def audit(spark, docs, labels):
    d = spark.createDataFrame([(i, t, l, "x", 1, 2, 3) for i, t, l in docs], "doc_id long, text string, lang string, part string, mask int, step int, good int")
    x = spark.createDataFrame([(*r, "y", 0) for r in labels], "doc_id long, quality int, toxic int, lang string, mask int")
    rows = filter_audit.filter_interactions(d, x).collect()
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COLUMNS] for r in rows}
    assert len(got) == len(rows)
    return got


def test_audit_equals_a_plain_version(spark):
    rng = np.random.default_rng(1)
    words = ["alpha", "beta", "gamma", "Delta", "EPS", "zeta$", "eta", "été", " "]
    docs = []
    for i in range(90):
        n = int(rng.choice([0, 3, 150, 199, 200, 260]))
        vocabulary = words if rng.random() < 0.4 else [f"w{k}" for k in range(int(rng.choice([60, 100, 400])))]
        docs.append((int(rng.integers(0, 70)), rng.choice([" ", "\t", "\n "]).join(rng.choice(vocabulary, n)), str(rng.choice(["en", "de", ""]))))
    docs += [(None, docs[0][1], "en"), (None, None, None), (500, None, "en"), (501, "", "fr"), (502, docs[3][1], "fr"), (502, docs[3][1], "fr"), (503, "A" * 3 + "a" * 97, "fr"), (504, "A" * 4 + "a" * 96, "fr"), (505, "a " * 200_000, "fr")]
    labels = [(int(i), int(i % 3 == 0), int(i % 5 == 0)) for i in range(0, 506)] + [(3, 0, 1), (3, 1, None), (None, 1, 1), (4, None, None)]
    assert audit(spark, docs, labels) == audit_by_hand(docs, labels)


def test_audit_of_one_and_of_no_document(spark):
    assert audit(spark, [], [(1, 1, 1)]) == {}
    got = audit(spark, [(1, "x", "en")], [])
    assert len(got) == 600 and got["en", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120] and got["en", "BCDEA", 1] == [1, 0, 0, 0, 0, 0, 0]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 7, "x", 1.5) for i, v in rows], "vec_id long, embedding array<float>, n int, component string, whitened double")


def by_hand(values, k=8):
    x = np.floor(1024 * values.astype(np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    centred = (n * x - s) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]
    return n, deviation, centred @ v / np.sqrt(e), e / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize("tasks", [1, 13])
def test_whitening_equals_an_eigendecomposition(spark, tasks, monkeypatch):
    monkeypatch.setattr(whitening, "MERGED_BYTES", 1 << 16)
    rng = np.random.default_rng(3)
    values = (rng.normal(size=(700, 20)) @ rng.normal(size=(20, 20)) + 3).astype(np.float32)
    bad = [(-1, None), (-2, [1.0, None] * 10), (-3, [float("nan")] * 20), (-4, [float("inf")] + [0.0] * 19), (-5, []), (-6, [1.0])]
    rows = whitening.whiten(vectors(spark, [(i, v.tolist()) for i, v in enumerate(values)] + bad).repartition(tasks)).collect()
    n, deviation, want, share = by_hand(values)
    got = np.zeros((700, 8))
    for r in rows:
        assert r["n"] == n and r["deviation"] == deviation[r["vec_id"]] and abs(r["identity_error"]) < 1e-6
        assert abs(r["explained"] / share[r["component"] - 1] - 1) < 1e-9
        got[r["vec_id"], r["component"] - 1] = r["whitened"]
    assert len(rows) == 700 * 8
    got *= np.sign((got * want).sum(0))
    assert np.allclose(got, want, atol=1e-7)


def test_merging_keeps_every_dimension():
    rng = np.random.default_rng(5)
    x = rng.integers(-50, 50, (120, 9)).astype(np.int64) * np.array([1, 1000, 1, 1, 1, 1, 1, 1, 100_000]) + 10**9
    state = None
    for part in np.split(x, [1, 2, 7, 60]):
        new = whitening.state_of(part)
        state = new if state is None else state.merged(new)
    assert state.n == 120 and state.sums == [int(s) for s in x.sum(0)]
    centred = x - x.mean(0)
    assert np.allclose(state.factor.T @ state.factor, centred.T @ centred, rtol=1e-10, atol=1e-3)


def test_whitening_edges(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).count() == 0
    one = whitening.whiten(vectors(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in sorted(one, key=lambda r: r["component"])] == [(1, 0, None, None, None), (2, 0, None, None, None)]
    rows = [(1, [1.0, 2.0, 5.0]), (1, [1.0, 2.0, 5.0]), (None, [3.0, 2.0, 5.0]), (None, [3.0, 2.0, 5.0]), (2**60 + 1, [3e30, 2.0, 5.0]), (9, [1.0, 2.0])]
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert len(got) == 15 and sorted({r["vec_id"] or 0 for r in got}) == [0, 1, 2**60 + 1]
    first = [r for r in got if r["component"] == 1]
    assert all(r["deviation"] is None for r in first if r["vec_id"] == 2**60 + 1) and abs(sum(r["whitened"] for r in first)) < 1e-6 and first[0]["identity_error"] < 1e-4
    assert all(r["whitened"] is None for r in got if r["component"] > 1)
