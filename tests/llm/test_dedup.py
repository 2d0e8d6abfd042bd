"""Exact, substring, near and line dedup against brute force."""

import hashlib
import itertools
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import exact_dedup, jaccard_join, line_dedup, minhash_dedup, suffix_dedup

AWKWARD = [None, "", " ", "\n\t", "word", "Word", "a b c d e", "a b c d e", "a  b c\td e", "é ü 漢字 🙂 x y", "z" * 3000]


def passage(rng, words):
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(words))


# --- op1 ---------------------------------------------------------------------------------------


def removed_by_force(texts):
    seen = {}
    raws = [(t or "").encode() for t in texts]
    for d, raw in enumerate(raws):
        for i in range(len(raw) - 199):
            seen.setdefault(raw[i : i + 200], []).append((d, i))
    gone = [np.zeros(len(r), bool) for r in raws]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + 200] = True
    out = []
    for raw, g in zip(raws, gone):
        spans = int((np.diff(np.concatenate(([0], g.astype(int)))) == 1).sum())
        out.append((len(raw), int(g.sum()), spans, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~g])).hexdigest()))
    return out


def repetitive_texts():
    rng = np.random.default_rng(3)
    shared = [passage(rng, n) for n in (30, 45, 70, 400)]
    texts = [passage(rng, 40) + " " + shared[i % 4] + " " + passage(rng, 20) for i in range(24)]
    texts += [shared[0], shared[0][:199], shared[1][:200], shared[1] * 3, "ab" * 400, "z" * 3000, "z" * 199, "z" * 201]
    near = bytearray(shared[2].encode())
    for at in range(0, len(near), 211):
        near[at] = 90
    return [*texts, near.decode(), "é" * 150 + "x" + "é" * 150, texts[0], *AWKWARD]


@pytest.mark.parametrize("contexts_per_anchor", [20_000, 2])
def test_repeated_strings(documents, contexts_per_anchor):
    texts = repetitive_texts()
    got = suffix_dedup.remove_repeats(documents(texts), contexts_per_anchor=contexts_per_anchor).orderBy("doc_id").collect()
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got] == removed_by_force(texts)
    for r, t in zip(got, texts):
        raw, at, left = (t or "").encode(), 0, b""
        for a, b in r["spans"]:
            left, at = left + raw[at:a], b
        assert hashlib.sha256(left + raw[at:]).hexdigest() == r["kept_sha256"]


def test_matching_statistics_by_force():
    rng = np.random.default_rng(5)
    parts = [bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in (40, 3, 17, 40, 1, 60)]
    parts.append(parts[0])
    got = suffix_dedup.matching_statistics(suffix_dedup.run_length_index(parts))
    suffixes = [p[i:] for p in parts for i in range(len(p))]
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    want = [max(common(a, b) for j, b in enumerate(suffixes) if j != i) for i, a in enumerate(suffixes)]
    assert got.tolist() == want


def test_repeats_in_an_empty_table_and_null_ids(documents):
    assert suffix_dedup.remove_repeats(documents([])).count() == 0
    rows = suffix_dedup.remove_repeats(documents(["q" * 250, "q" * 250], ids=[None, None])).collect()
    assert [(r["doc_id"], r["n_removed"]) for r in rows] == [(None, 250)] * 2


# --- op2 ---------------------------------------------------------------------------------------


def test_golomb_codes_come_back():
    rng = np.random.default_rng(1)
    for values in (np.zeros(0, np.uint64), np.array([0], np.uint64), np.array([2**63 + 5], np.uint64), np.unique(rng.integers(0, 2**60, 5000).astype(np.uint64)), np.arange(300, dtype=np.uint64)):
        assert exact_dedup.golomb_decode(len(values), *exact_dedup.golomb_encode(values)).tolist() == values.tolist()


def test_exact_groups(documents):
    texts = [*AWKWARD, *["many copies"] * 300, "Many copies"]
    want = {}
    for i, t in enumerate(texts):
        want.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    expected = {i: (g[0], len(g), i == g[0], hashlib.sha256(n.encode()).hexdigest()) for n, g in want.items() for i in g}
    rows = exact_dedup.exact_dedup(documents(texts).repartition(5)).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == expected
    left = exact_dedup.drop_exact_copies(documents(texts))
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(g[0] for g in want.values()) and left.columns == documents([]).columns


def test_exact_edge_cases(documents):
    assert exact_dedup.exact_dedup(documents([])).count() == 0
    rows = exact_dedup.exact_dedup(documents(["t", "t", "u", "u", "u"], ids=[None, 4, 7, 7, None])).collect()
    assert sum(r["kept"] for r in rows) == 2 and {(r["keep_id"], r["group_size"]) for r in rows} == {(4, 2), (7, 3)}


# --- op7 ---------------------------------------------------------------------------------------


def components_by_force(texts, k=5, part=75):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= part * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in range(len(texts))}


def near_copies():
    rng = np.random.default_rng(9)
    texts = []
    for size in (8, 12, 40, 160, 600):
        for _ in range(4):
            base = passage(rng, size).split()
            for edits in range(7):
                words = list(base)
                for at in rng.integers(0, size, edits * max(1, size // 60)):
                    words[at] = "edit" + str(int(rng.integers(0, 1000)))
                texts.append(" ".join(words))
    chain = passage(rng, 60).split()  # a chain whose ends are far apart
    for i in range(12):
        chain[i * 4] = f"link{i}"
        texts.append(" ".join(chain))
    return [*texts, *AWKWARD]


def test_jaccard_components(documents):
    texts = near_copies()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(documents(texts)).collect()}
    assert got == components_by_force(texts)


def test_large_groups_of_near_copies(documents, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BUCKET_ROWS", 16)
    rng = np.random.default_rng(2)
    base, texts = passage(rng, 80).split(), []
    for i in range(150):
        words = list(base)
        words[int(rng.integers(0, 80))] = f"w{i}"
        texts.append(" ".join(words))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(documents(texts)).collect()}
    assert got == components_by_force(texts)


def test_jaccard_edge_cases(documents):
    assert jaccard_join.jaccard_components(documents([])).count() == 0
    rows = jaccard_join.jaccard_components(documents(["a b", "a b", "a b", None], ids=[None, 5, 5, 6])).collect()
    assert sorted((r["doc_id"] is None, r["component_id"]) for r in rows if r["doc_id"] != 6) == [(False, 5), (False, 5), (True, None)]
    kept = jaccard_join.drop_near_copies(documents(["a b", "a b", "A b", None], ids=[3, 5, 9, 6]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 6]


def test_unlike_texts_under_one_id_stay(documents):
    rows = documents(["a b c d e f g h", "totally other words are here", "A b c d  e f g h", "totally other words are here"], ids=[1, 1, 1, 2])
    kept = jaccard_join.drop_near_copies(rows.withColumnRenamed("h", "leader").withColumnRenamed("n", "row"))
    assert sorted((r["doc_id"], r["text"].split()[0].lower()) for r in kept.collect()) == [(1, "a"), (1, "totally")]
    assert kept.columns == ["doc_id", "text", "source", "key", "leader", "row"]


# --- op11 --------------------------------------------------------------------------------------


def test_minhash_components(documents):
    texts = near_copies()
    rows = minhash_dedup.minhash_components(documents(texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == components_by_force(texts, 4, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_minhash_in_large_groups(documents, monkeypatch):
    """Links that the pivots don't make are found in the buckets, by blocks."""
    monkeypatch.setattr(jaccard_join, "BUCKET_ROWS", 16)
    monkeypatch.setattr(minhash_dedup, "pivot_pairs", lambda buckets: buckets.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0))
    rng = np.random.default_rng(2)
    base, texts = passage(rng, 120).split(), []
    for i in range(120):
        words = list(base)
        words[int(rng.integers(0, 120))] = f"w{i}"
        texts.append(" ".join(words))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.minhash_components(documents(texts)).collect()}
    assert got == components_by_force(texts, 4, 80)


def test_turns_take_a_row_of_each_component_and_bucket(documents, monkeypatch):
    """A large group that is one component already isn't brought to its open buckets row by row."""
    kept, keep = [], jaccard_join.keep
    monkeypatch.setattr(jaccard_join, "keep", lambda df, name, *more: kept.append((name, keep(df, name, *more))) or kept[-1][1])
    monkeypatch.setattr(jaccard_join, "release", lambda *tables: None)
    rng = np.random.default_rng(2)
    base, texts = passage(rng, 120).split(), []
    for i in range(100):
        words = list(base)
        for at in rng.integers(0, 120, 1 if i < 90 else 10):
            words[int(at)] = f"w{i}"
        texts.append(" ".join(words))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash_dedup.minhash_components(documents(texts)).collect()}
    assert got == components_by_force(texts, 4, 80) and len({c for _, c in got.values()}) > 1
    opened = [t for name, t in kept if name == "open"]
    assert opened and all(t.groupBy("of", "in").count().filter("count > 1").count() == 0 for t in opened if t.head(1))
    assert all(t.groupBy("h", "band", "component").count().filter("count > 1").count() == 0 for name, t in kept if name == "members")


def test_half_keys_agree_as_often_as_sets():
    """A half key is shared with probability J to the power of its minima."""
    rng, hits, tries = np.random.default_rng(8), 0, 0
    for _ in range(120):
        pool = np.unique(rng.integers(0, 2**63, 120).astype(np.uint64))
        a, b = minhash_dedup.half_keys([pool[:108], pool[12:]])
        hits, tries = hits + int((a == b).sum()), tries + len(a)
    assert abs(hits / tries - 0.8**minhash_dedup.ROWS) < 0.03


def test_minhash_edge_cases(documents):
    assert minhash_dedup.minhash_components(documents([])).count() == 0
    rows = minhash_dedup.minhash_components(documents(["a b", "A b", "a  b", None, "", " ", "x " * 300_000], ids=[None, 5, 5, 6, 7, 8, 9])).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in rows) == [(0, 1, None, True), (5, 1, 5, True), (5, 1, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 1, 9, True)]
    kept = minhash_dedup.drop_copies(documents(["a b", "a b", "A b", "c", None], ids=[3, 5, 9, 3, None])).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == [(0, ""), (3, "a b"), (3, "c")]


def test_signature_trees_keep_similar_pairs():
    rng = np.random.default_rng(4)
    pool = np.unique(rng.integers(0, 2**63, 900).astype(np.uint64))
    sets = [np.unique(rng.choice(pool[k : k + 52], int(rng.integers(44, 52)), replace=False)) for k in rng.integers(0, 800, 300)]
    labels = rng.integers(0, 150, 300)
    maps = [jaccard_join.bitmap(s, jaccard_join.bits_for(len(s))) for s in sets]
    want = {(i, j) for i, j in itertools.combinations(range(300), 2) if labels[i] != labels[j] and jaccard_join.links_of(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))}
    got = set()
    for tree, place in jaccard_join.trees(np.array([len(s) for s in sets]), maps, labels):
        got |= {(min(i, j), max(i, j)) for a, b in tree.pairs() for i, j in zip(place[a].tolist(), place[b].tolist())}
    assert len(want) > 30 and want <= got and len(got) < 300 * 299 // 4


# --- op5 ---------------------------------------------------------------------------------------


def test_fuzzy_lines(documents):
    rng = np.random.default_rng(6)
    base = [passage(rng, 14) for _ in range(30)]
    texts = []
    for i in range(30):
        close = base[i][:-3] + "xyz"
        texts.append("\n".join([base[i], "", f"  {base[(i + 1) % 30].upper()} ", close, passage(rng, 3)]))
    texts += [None, "", "\n\n", "k", "k", "ab" * 500, "ab" * 501, "lone " * 4000]
    keys = {}
    for d, t in enumerate(texts):
        for n, line in enumerate((t or "").split("\n")):
            if line.strip(" "):
                keys.setdefault(line.strip(" ").lower(), (d, n))
    shingles = {k: {k.encode()[i : i + 8] for i in range(max(1, len(k.encode()) - 7))} for k in keys}
    up = {k: k for k in keys}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    linked = 0
    for a, b in itertools.combinations(keys, 2):
        both = len(shingles[a] & shingles[b])
        if 100 * both >= 75 * (len(shingles[a]) + len(shingles[b]) - both):
            linked += 1
            x, y = root(a), root(b)
            up[max(x, y, key=keys.get)] = min(x, y, key=keys.get)
    assert linked > 25
    want = {d: 0 for d in range(len(texts))}
    for k in keys:
        want[keys[k][0]] += root(k) == k
    got = {r["doc_id"]: r["n_kept"] for r in line_dedup.line_dedup(documents(texts)).collect()}
    off = sum(abs(got[d] - want[d]) for d in want)
    assert set(got) == set(want) and off <= 0.02 * sum(want.values())  # the banding's recall


def test_fuzzy_lines_of_a_large_bucket_are_all_compared(documents, monkeypatch):
    """All lines meet in one bucket of over 32: near copies unlike its first line are still found."""
    monkeypatch.setattr(line_dedup, "line_bands", lambda lines: lines.selectExpr("line_id", "1L AS band"))
    monkeypatch.setattr(line_dedup, "BLOCK", 16, raising=False)
    rng = np.random.default_rng(7)
    texts = [passage(rng, 14) for _ in range(60)]
    texts += [t[:-2] + "#" for t in texts[20:60]]
    got = {r["doc_id"]: r["n_kept"] for r in line_dedup.line_dedup(documents(texts)).collect()}
    assert got == {d: int(d < 60) for d in range(100)}


def test_only_lines_that_meet_others_are_brought_to_comparisons(documents, monkeypatch):
    seen, linked = [], line_dedup._linked
    monkeypatch.setattr(line_dedup, "_linked", lambda pairs, lines, signed: seen.append((lines.count(), signed.count())) or linked(pairs, lines, signed))
    rng = np.random.default_rng(11)
    texts = [passage(rng, 14) for _ in range(40)]
    texts += [t[:-2] + "#" for t in texts[:2]]
    got = {r["doc_id"]: r["n_kept"] for r in line_dedup.line_dedup(documents(texts)).collect()}
    assert got == {d: int(d < 40) for d in range(42)}
    assert seen and all(2 <= n <= 8 for counts in seen for n in counts)


def test_recall_of_links_under_a_shared_header(documents):
    """Pairs of a similarity just over 3/4 whose lines all begin alike."""
    rng, header = np.random.default_rng(8), passage(np.random.default_rng(1), 8)[:40]
    texts = []
    for _ in range(150):
        line = header + passage(rng, 40)
        at = int(rng.integers(60, len(line) - 30))
        texts += [line, line[:at] + passage(rng, 6)[: len(line) // 9] + line[at:]]
    sets = [{t.encode()[i : i + 8] for i in range(len(t) - 7)} for t in texts]
    similar = lambda x, y: 100 * len(x & y) >= 75 * len(x | y)
    linked = [k for k in range(150) if similar(sets[2 * k], sets[2 * k + 1])]
    assert len(linked) > 100 and not any(similar(sets[2 * i], sets[2 * j]) for i, j in itertools.combinations(range(150), 2))
    got = {r["doc_id"]: r["n_kept"] for r in line_dedup.line_dedup(documents(texts)).collect()}
    assert sum(got[2 * k + 1] == 0 for k in linked) >= 0.95 * len(linked)
    assert all(got[2 * k + 1] == 1 for k in range(150) if k not in linked)


def test_fine_signatures_keep_links_and_leave_out_lines_half_alike(documents):
    """Similarities near 3/4 pass, of those near 1/2 few do; short lines have empty parts."""
    rng = np.random.default_rng(13)
    texts, similarity = [], []
    for i in range(200):
        letters = rng.integers(97, 123, 60 if i % 4 == 0 else 600, dtype=np.uint8).tobytes().decode()
        tail = len(letters) // (8 if i % 2 else 3)
        texts += [letters, letters[:-tail] + rng.integers(97, 123, tail, dtype=np.uint8).tobytes().decode()]
        a, b = ({t[j : j + 8] for j in range(len(t) - 7)} for t in texts[-2:])
        similarity.append(len(a & b) / len(a | b))
    signed = line_dedup.fine_signatures(documents(texts).selectExpr("doc_id AS line_id", "text AS key")).localCheckpoint()
    left, right = line_dedup._marked(signed, "_a"), line_dedup._marked(signed, "_b")
    met = {r["line_id_a"] // 2 for r in left.join(right, (left.line_id_a % 2 == 0) & (left.line_id_a + 1 == right.line_id_b) & line_dedup._finely_near("_a", "_b")).select("line_id_a").collect()}
    links, halves = ({i for i, x in enumerate(similarity) if low <= x < high} for low, high in ((0.75, 1), (0.4, 0.55)))
    assert len(links) > 90 and links <= met
    assert len(halves) > 45 and len({i for i in halves if len(texts[2 * i]) > 100} & met) <= 5


def test_shingles_of_a_long_line_take_time_in_proportion(documents):
    line = np.random.default_rng(14).integers(97, 123, 600_000, dtype=np.uint8).tobytes().decode()
    docs = documents([line]).coalesce(1)
    began = time.monotonic()
    assert docs.select(F.size(line_dedup.shingle_set("text"))).first()[0] == len({line[i : i + 8] for i in range(len(line) - 7)})
    assert time.monotonic() - began < 12  # a copy of the line for each shingle is 360 GB


def test_lines_run_without_python(documents):
    plan = line_dedup.line_bands(line_dedup.signatures(documents(["a"]).selectExpr("doc_id AS line_id", "text AS key")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert line_dedup.line_dedup(documents([])).count() == 0
