"""Language model, quality classifier, mixing and the pipeline."""

import math
import re
import zlib

import numpy as np

import corpus_pipeline
from tessella.llm import byte_cnn, mixing, pitman_yor

AWKWARD = [None, "", " ", "One", "one ONE one", "é ü 漢字 🙂", "long " * 20_000]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


# --- op3 ---------------------------------------------------------------------------------------


def test_base_score_and_counts(documents):
    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{int(k)}" for k in rng.zipf(1.5, 40)) for _ in range(60)] + AWKWARD
    docs = documents(texts)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    count = {}
    for i, t in enumerate(texts):
        for w in [*words(t), None] if not held(i) else []:
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    model = pitman_yor.fit(docs.filter(~pitman_yor.held_out()).select("text"))
    rows = {r["doc_id"]: r for r in pitman_yor.score(docs, model, frequent=20).collect()}
    again = {r["doc_id"]: r for r in pitman_yor.score(docs, model).collect()}
    for i, t in enumerate(texts):
        tokens = [*words(t), None]
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(tokens), sum(w in count for w in tokens), n)
        assert math.isclose(r["base_score"], sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in tokens), rel_tol=1e-9)
        assert math.isclose(r["score"], again[i]["score"], rel_tol=1e-9) and r["score"] < 0
    assert sum(r["score"] for r in rows.values()) > sum(r["base_score"] for r in rows.values())
    assert pitman_yor.score(documents([]), pitman_yor.fit(documents([]).select("text"))).count() == 0


def test_frequent_words_keep_to_their_limit(spark):
    words = spark.createDataFrame([(i, n) for i, n in enumerate([1] * 500 + [2] * 30 + [3] * 9 + [100, 1000])], "word long, n long")
    for limit, want in ((0, 0), (1, 1), (2, 2), (10, 2), (11, 11), (60, 41), (10_000, 541)):
        assert pitman_yor.most_frequent(words, limit).count() == want


def test_order_of_words_counts(documents):
    docs = documents(["alpha beta gamma delta"] * 30 + ["delta beta"] * 2)
    model = pitman_yor.fit(docs.select("text"))
    ordered, shuffled = (r["score"] for r in pitman_yor.score(documents(["alpha beta gamma delta", "beta alpha delta gamma"]), model).orderBy("doc_id").collect())
    assert ordered > shuffled + 1


def test_probabilities_sum_to_one_in_every_context(documents):
    rng = np.random.default_rng(3)
    docs = documents([" ".join(f"w{int(k)}" for k in rng.zipf(1.4, 60) % 300) for _ in range(50)])
    model = pitman_yor.fit(docs.select("text"))
    words = model.parents().collect()
    assert len(words) == model.vocabulary
    for s in range(pitman_yor.SAMPLES):
        sums = np.zeros(pitman_yor.CONTEXTS)
        for r in words:
            p = model.opened[s] * r[f"parent{s}"]
            p[r["contexts"]] += np.array(r["counts"]) - pitman_yor.DISCOUNT * np.array(r[f"tables{s}"])
            sums += p / model.below
        assert np.allclose(sums + model.opened[s] * model.unknown[s] / model.below, 1)


def test_each_word_is_a_context_of_its_own(documents):
    """Every context has a follower of its own: no other context's follower is as likely there."""
    model = pitman_yor.fit(documents([f"c{i} f{i}" for i in range(300)] * 3).select("text"))
    pairs = [(i, (i + j) % 300) for i in range(300) for j in range(8)]
    rows = pitman_yor.score(documents([f"c{i} f{j}" for i, j in pairs]), model).orderBy("doc_id").collect()
    scores = {pair: r["score"] for pair, r in zip(pairs, rows)}
    assert all(scores[i, i] > scores[i, j] + 0.5 for i, j in pairs if i != j)


def test_scores_by_bucket_are_the_models(documents, monkeypatch):
    """Many buckets and few frequent words, against sums over the tables of pairs."""
    monkeypatch.setattr(pitman_yor, "BUCKET_CHARS", 400)
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{int(k)}" for k in rng.zipf(1.3, 50) % 400) for _ in range(80)]
    model = pitman_yor.fit(documents(texts[:60]).select("text"), hot_words=15)
    assert model.buckets > 5 and 1 <= len(model.hot) <= 15
    pairs, parent, below, opened = {}, {}, {}, {}
    for r in model.table().collect():
        tables = np.array([r[f"tables{s}"] for s in range(pitman_yor.SAMPLES)])
        pairs[r["before"], r["word"]] = r["count"], tables
        parent[r["word"]] = np.array([r[f"parent{s}"] for s in range(pitman_yor.SAMPLES)])
        below[r["before"]] = below.get(r["before"], pitman_yor.STRENGTH) + r["count"]
        opened[r["before"]] = opened.get(r["before"], pitman_yor.STRENGTH) + pitman_yor.DISCOUNT * tables
        assert (1 <= tables).all() and (tables <= r["count"]).all()
    assert len(parent) == model.vocabulary and np.allclose(sum(parent.values()) + model.unknown, 1)

    def probability(word, before):
        n, tables = pairs.get((before, word), (0, np.zeros(pitman_yor.SAMPLES)))
        rest = opened.get(before, pitman_yor.STRENGTH) * parent.get(word, model.unknown)
        return (n - pitman_yor.DISCOUNT * tables + rest) / below.get(before, pitman_yor.STRENGTH)

    for before in list(below)[::40]:
        assert np.allclose(sum(probability(w, before) for w in parent) + probability(None, before), 1)
    for frequent in (0, 1000):
        for r in pitman_yor.score(documents(texts), model, frequent=frequent).collect():
            word, before, _ = pitman_yor.tokens([texts[r["doc_id"]]], model.hot)
            want = sum(math.log10(probability(w, u).mean()) for w, u in zip(word.view(np.int64).tolist(), before.view(np.int64).tolist()))
            assert math.isclose(r["score"], want, rel_tol=1e-9)
    assert sum(u < 0 and w < 0 for u, w in pairs) > 100  # two rare words


def test_scores_do_not_depend_on_batches(documents, spark):
    rng = np.random.default_rng(6)
    docs = documents([" ".join(f"w{int(k)}" for k in rng.zipf(1.4, 60) % 300) for _ in range(50)])
    setting, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(setting)
    for rows in ("7", before):
        spark.conf.set(setting, rows)
        try:
            seen.append({r["doc_id"]: r["score"] for r in pitman_yor.score(docs, pitman_yor.fit(docs.select("text"))).collect()})
        finally:
            spark.conf.set(setting, before)
    assert len(seen[0]) == 50 and all(abs(seen[0][i] - seen[1][i]) < 1e-9 * abs(seen[0][i]) for i in seen[0])


def test_seating_agrees_with_a_customer_by_customer_sampler():
    rng, discount = np.random.default_rng(4), 0.8
    for n, a in ((2, 0.5), (7, 1.0), (30, 4.0), (60, 0.2)):
        sizes, seen = [n], []
        for sweep in range(3000):
            for _ in range(n):  # one customer leaves and comes back
                k = rng.choice(len(sizes), p=np.array(sizes) / n)
                sizes[k] -= 1
                sizes = [x for x in sizes if x]
                weights = np.array([*(x - discount for x in sizes), a])
                k = rng.choice(len(weights), p=weights / weights.sum())
                if k == len(sizes):
                    sizes.append(1)
                else:
                    sizes[k] += 1
                if len(seen) > 40_000:
                    break
            seen.append(len(sizes))
        at_once = pitman_yor.seating(discount).draw(np.full(20_000, n), np.full(20_000, a), rng.random(20_000))
        assert abs(np.mean(seen) - at_once.mean()) < 0.05 * np.mean(seen) + 0.03, (n, a)


def test_seating_of_many_customers_follows_the_recurrence():
    short, long = pitman_yor.Seating(0.8, 256), pitman_yor.Seating(0.8, 1024)
    rng = np.random.default_rng(5)
    for n, a in ((600, 0.5), (1000, 5.0), (1000, 60.0)):
        one, other = (s.draw(np.full(20_000, n), np.full(20_000, a), rng.random(20_000)) for s in (short, long))
        assert abs(one.mean() - other.mean()) < 0.02 * other.mean() + 0.02, (n, a)
    assert long.draw(np.array([10_000_000]), np.array([50.0]), rng.random(1))[0] > 20


# --- op4 ---------------------------------------------------------------------------------------


def targets_by_force(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mix(documents):
    rng = np.random.default_rng(1)
    sources = [["hot", "hot", "b", "Z", "é", None][int(k)] for k in rng.integers(0, 6, 400)]
    texts = [" ".join(["w"] * int(k)) for k in rng.integers(0, 300, 400)]
    texts[:6] = [None, "", "x " * 5000, "dup", "dup", "dup"]
    ids = list(range(400))
    ids[4] = 3
    docs = documents(texts, ids=ids, sources=sources)
    sizes = {}
    for s, t in zip(sources, texts):
        sizes[s] = sizes.get(s, 0) + len(words(t))
    want = targets_by_force(sizes)
    rows = mixing.mix_counts(docs).collect()
    assert len(rows) == 400 and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    by_id, source_of = {}, dict(zip(ids[5:], sources[5:]))
    for r in rows:
        if r["doc_id"] in source_of:
            s = source_of[r["doc_id"]]
            assert r["source_size"] == sizes[s] and math.isclose(r["target"], want[s], rel_tol=1e-9)
    taken = {s: 0 for s in sizes}
    for r in rows:
        taken[next(s for s in sizes if sizes[s] == r["source_size"])] += r["taken"]
    assert len(set(sizes.values())) == len(sizes) and all(abs(taken[s] - want[s]) <= 2 * mixing.BLOCK_WORDS for s in sizes)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_counts(docs.repartition(7)).collect()))
    by_id = {r["doc_id"]: r["taken"] for r in rows if r["doc_id"] >= 5}
    documents_out = mixing.mixed_documents(docs)
    assert documents_out.columns == docs.columns
    got = {}
    for r in documents_out.filter("doc_id >= 5").collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(words(r["text"]))
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in by_id.items() if v}


def test_shards_draw_multinomial_counts_that_meet_the_targets(spark, documents):
    share = ("b", "c", "hot")  # weights 3, 1, 2
    docs = documents(["w " * 400] * 60, sources=[["hot", "b", "c"][i % 3] for i in range(60)])
    setting = dict(block_words=2, slots_per_shard=50)
    counts = mixing.shard_counts(docs, **setting).collect()
    assert sorted(map(str, counts)) == sorted(map(str, mixing.shard_counts(docs.repartition(5), **setting).collect()))
    total = {s: sum(r["n_slots"] for r in counts if r["source"] == s) for s in share}
    assert total == {"b": 8000, "c": 3333, "hot": 6667}  # b stops at twice its 4000 blocks
    shards = {}
    for r in counts:
        shards.setdefault(r["shard"], {})[r["source"]] = r["n_slots"]
    n = sum(total.values())
    assert {sum(c.values()) for k, c in shards.items() if k < n // 50} == {50} and len(shards) == -(-n // 50)
    for s in share:
        own, p = [c.get(s, 0) for k, c in shards.items() if k < n // 50], total[s] / n
        assert abs(np.var(own) / (50 * p * (1 - p)) - 1) < 0.25  # of a multinomial draw; even shares would have none
    slots = mixing.mix(docs, **setting).select("shard", "slot", "source", "epoch", "block").distinct().collect()
    assert len(slots) == n and len({(r["shard"], r["slot"]) for r in slots}) == n and len({(r["source"], r["epoch"], r["block"]) for r in slots}) == n
    assert {r["slot"] for r in slots} == set(range(50))


def test_mix_stays_in_the_jvm(documents):
    plan = mixing.mix_counts(documents(["a b", "c"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan
    assert mixing.mix_counts(documents([])).count() == 0
    assert [r["taken"] for r in mixing.mix_counts(documents([None, ""])).collect()] == [0, 0]


# --- op8 ---------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    net = byte_cnn.train(docs, labels)
    rows = {r["doc_id"]: r for r in byte_cnn.score(docs, net).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect() if r["doc_id"] in rows and rows[r["doc_id"]]["held_out"]}
    good, bad = ([rows[i]["score"] for i, q in truth.items() if q == k] for k in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.8
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows.values())


def test_quality_edge_cases(documents, spark):
    docs = documents([*AWKWARD, "One"], ids=[*range(len(AWKWARD)), None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in byte_cnn.score(docs, byte_cnn.train(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1, 0) for i in range(7)] + [(None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    assert all(r["predicted"] == 1 for r in byte_cnn.score(docs, byte_cnn.train(docs, one)).collect())
    rng = np.random.default_rng(0)
    net = byte_cnn.ByteCNN(*(rng.normal(size=s).astype(np.float32) for s in ((8, 256, 16), (17, 16), (16,))), rng.normal(size=16), 0.1)
    together = byte_cnn.score_texts(net, [t for t in AWKWARD])
    assert np.allclose(together, [byte_cnn.score_texts(net, [t])[0] for t in AWKWARD])  # neighbours don't matter
    tail = byte_cnn.score_texts(net, ["q" * 5000, "q" * 4990 + "Z!" * 5])
    assert tail[0] != tail[1]  # the whole text counts


# --- pipeline ----------------------------------------------------------------------------------


def test_pipeline_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    seen, rows = docs, [docs.count()]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, seen, data)
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / str(number)))
        seen = spark.read.parquet(str(tmp_path / str(number)))
        rows.append(seen.count())
    assert rows[0] >= rows[1] >= rows[2] >= rows[3] > 0 and rows[3] < rows[0]
    final = corpus_pipeline.STAGES[-1][1](spark, seen, data)
    assert final.count() == rows[-1] and final.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
