"""Language, quality, language model and decontamination."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from genoloom.llm import decontaminate as D
from genoloom.llm import gru_lm as G
from genoloom.llm import language as L
from genoloom.llm import linear
from genoloom.llm import quality as Q


def test_language_on_held_out_documents(spark, data):
    out = L.op3_language_id(spark, data)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang")
    rows = out.join(docs, "doc_id").collect()
    assert len(rows) == docs.count() and {r["held_out"] for r in rows} == {True, False}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_texts(spark, data):
    model = L.train(spark.read.parquet(f"{data}/documents.parquet"))
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 -- ½ ²", "x"), (4, "é", "x"), (5, "Hi", "x"), (5, "Hi", "x")], "doc_id long, text string, lang_pred string")
    got = [(r["lang_pred"], r["score"]) for r in L.identify(rows, model).orderBy("doc_id").collect()]
    assert [g[0] for g in got[:3]] == ["und"] * 3 and all(g[0] in model.languages for g in got[3:]) and got[4] == got[5]
    assert [r["lang_pred"] for r in L.identify(rows, None).collect()] == ["und"] * 6
    assert L.train(rows.withColumn("lang", F.lit(None).cast("string"))) is None
    one = L.train(rows.withColumn("lang", F.lit("en")).withColumn("text", F.concat("text", F.lit(" some text"))))
    assert [r["lang_pred"] for r in L.identify(rows.where("doc_id = 5"), one).collect()] == ["en", "en"]
    assert L.identify(rows.where("false"), model).count() == 0


def test_predictions_do_not_look_at_other_columns(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = L.train(docs)
    a = L.identify(docs, model).select("doc_id", "lang_pred").collect()
    b = L.identify(docs.withColumn("lang", F.lit("de")).withColumn("source", F.lit("s")), model).select("doc_id", "lang_pred").collect()
    assert a == b


def test_quality_separates(spark, data):
    data = data.replace("sf0.001", "sf0.01")  # labels of the smaller are too few
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet").withColumnRenamed("quality", "y")
    model = Q.train(docs, labels.where("doc_id % 3 <> 0").withColumnRenamed("y", "quality"))
    rows = Q.classify(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    good, bad = [r["keep"] for r in rows if r["y"] == 1], [r["keep"] for r in rows if r["y"] == 0]
    assert len(good) > 10 and len(bad) > 1
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.35 * len(bad)


def test_quality_of_odd_rows(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    model = Q.train(docs, labels)
    rows = spark.createDataFrame([(1, None, None, None, None, 3), (2, "", "en", "s", 0, 3), (3, "x " * 20000, "en", "new", -5, 3)], "doc_id long, text string, lang string, source string, n_chars long, keep int")
    got = Q.classify(rows, model).orderBy("doc_id").collect()
    assert [r["keep"] for r in got[:2]] == [False, False] and all(0 <= r["quality"] <= 1 for r in got)
    assert Q.train(docs, labels.where("quality = 1")) is None and Q.train(docs.where("false"), labels) is None
    assert [r["keep"] for r in Q.classify(rows, None).orderBy("doc_id").collect()] == [False, False, True]


def test_repeated_rows_are_learned_from_once(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    often = docs.union(docs).union(docs)
    one, more = (L.train(x, per_language=20) for x in (docs, often))
    assert one.languages == more.languages and np.allclose(one.weights, more.weights)
    one, more = (Q.train(x, labels) for x in (docs, often))
    assert np.allclose(one.tri_w, more.tri_w) and one.cut == pytest.approx(more.cut)


def test_sizes_of_training():
    import inspect

    sizes = {k: v.default for f in (L.train, Q.train) for k, v in inspect.signature(f).parameters.items()}
    assert (sizes["per_language"], sizes["max_labelled"], sizes["max_pool"], L.BITS, Q.BITS) == (500, 4000, 2000, 12, 11)


def test_training_copies_no_matrix():
    import tracemalloc

    rng = np.random.default_rng(1)
    x = (rng.random((1000, 1 << 12)) * (rng.random((1000, 1 << 12)) < 0.1)).astype(np.float32)
    assert (linear.unpack(linear.pack(x), 1 << 12) == x).all()
    y = (x[:, 0] + x[:, 1] > 0.1).astype(float)
    for fit in (lambda: linear.svm(x, 2 * y - 1, steps=3), lambda: linear.logistic(x, y, steps=3), lambda: linear.scale_of(x)):
        tracemalloc.start()
        fit()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < x.nbytes * 0.9


TEXTS = [(i, " ".join(f"w{(i * 7 + k) % 40}" if k % 3 else "The" for k in range(i % 25))) for i in range(120)] + [(500, None), (501, ""), (502, "new words Only"), (502, "new words Only")]


def test_base_scores_and_probabilities(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    learn = docs.where(~L.held_out(7, 2))
    # head: a few words only, so that most counts are joined
    got = G.lm_scores(docs, learn, n_frequent=10, n_rare=3, head=12, sample=50, steps=60).collect()
    assert len(got) == len(TEXTS)
    count: Counter = Counter()
    for i, t in TEXTS:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update((t or "").lower().split() + ["\x03"])
    n, v = sum(count.values()), len(count)
    text = dict(TEXTS)
    for r in got:
        w = (text[r["doc_id"]] or "").lower().split() + ["\x03"]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(count[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        assert r["score"] < 0


def test_network_is_a_distribution_and_learns():
    counts = np.array([5.0] * 20 + [30.0, 10.0])
    net = G.Gru(20, 2, 8, 6, counts)
    h = np.random.default_rng(0).normal(size=(4, 8)).astype(np.float32)
    total = sum(np.exp(net.loss_of(h, np.full(4, y))) for y in range(22))
    assert total == pytest.approx(1, abs=1e-3)
    stream = np.tile(np.arange(6), 800).astype(np.int32)
    ids, at = np.tile(np.arange(6), 3), np.array([0, 18])
    before = net.scores(ids[1:], np.array([0, 17]), 0)[0]
    net.fit(stream, lanes=8, window=12, steps=250)
    assert net.scores(ids[1:], np.array([0, 17]), 0)[0] > before / 2
    # gradient of the output layer against differences
    net = G.Gru(20, 2, 8, 6, counts)
    net.p = {k: w.astype(np.float64) for k, w in net.p.items()}
    y, h = np.array([3, 19, 21]), np.random.default_rng(1).normal(size=(3, 8))
    grads, back = {k: np.zeros_like(w) for k, w in net.p.items()}, np.zeros((3, 8))
    net.loss_of(h, y, grads, back)
    for k, place in (("c", (2, 1)), ("o", (0, 3, 3)), ("q", (3, 1)), ("d", (5,))):
        old = net.p[k][place]
        net.p[k][place] = old + 1e-5
        up = -net.loss_of(h, y).sum()
        net.p[k][place] = old - 1e-5
        assert grads[k][place] == pytest.approx((up + net.loss_of(h, y).sum()) / 2e-5, abs=1e-6)
        net.p[k][place] = old
    h2 = h.copy()
    h2[1, 4] += 1e-5
    assert back[1, 4] == pytest.approx((net.loss_of(h, y).sum() - net.loss_of(h2, y).sum()) / 1e-5, abs=1e-3)


def test_gradients_through_time():
    rng = np.random.default_rng(3)
    net = G.Gru(7, 2, 5, 3, rng.random(9) * 9)
    net.p = {k: w.astype(np.float64) for k, w in net.p.items()}
    x, y = rng.integers(0, 9, (6, 4)), rng.integers(0, 9, (6, 4))
    h = rng.normal(size=(4, 5))
    grads, last = net.gradients(x, y, h)

    def loss():
        states, now = [], h
        for t in range(6):
            a, g = net.p["e"][x[t]] @ net.p["x"] + net.p["b"], now @ net.p["u"]
            r, z = 1 / (1 + np.exp(-(a + g)[:, :5])), 1 / (1 + np.exp(-(a + g)[:, 5:10]))
            new = np.tanh(a[:, 10:] + r * g[:, 10:])
            now = new + z * (now - new)
            states.append(now)
        assert np.allclose(now, last, atol=1e-3)
        return -net.loss_of(np.concatenate(states), y.ravel()).sum()

    for k, w in net.p.items():
        for at in rng.choice(w.size, min(12, w.size), replace=False):
            flat, was = w.reshape(-1), w.reshape(-1)[at]
            if was < -15:  # a slot without a word
                continue
            flat[at] = was + 1e-5
            up = loss()
            flat[at] = was - 1e-5
            down = loss()
            flat[at] = was
            assert (up - down) / 2e-5 == pytest.approx(grads[k].reshape(-1)[at], rel=1e-4, abs=1e-6), k


def test_learns_in_every_task(spark):
    rng = np.random.default_rng(1)
    names = [f"w{i}" for i in range(40)]

    def text(n, step):
        at, out = int(rng.integers(40)), []
        for _ in range(n):
            at = (at + step + int(rng.integers(2))) % 40
            out.append(names[at])
        return " ".join(out)

    rows = [(i, text(300, 3)) for i in range(400)] + [(1000, text(200_000, 3))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4, "doc_id")
    of = lambda **o: G.lm_scores(df.where("doc_id < 50"), df.where("doc_id >= 50"), sample=2, steps=20, hidden=8, **o).agg({"score": "sum"}).first()[0]
    few, all_ = of(every=10**6), of(every=1)
    assert all_ > 0.9 * few > 3 * all_


def test_every_token_is_learned_from(spark, monkeypatch):
    seen, step = [], G.Gru.gradients
    monkeypatch.setattr(G.Gru, "gradients", lambda self, xs, ys, h: seen.extend(zip(xs.ravel().tolist(), ys.ravel().tolist(), strict=True)) or step(self, xs, ys, h))
    for n in (1, 2, 30, 193, 1000, 2000):
        seen.clear()
        stream = np.random.default_rng(n).permutation(2000)[:n]
        net = G.Gru(2000, 2, 4, 64, np.ones(2002))
        assert net.passages(stream, G.Adam(net.p), lanes=3) == n - 1
        assert set(seen) == set(zip(stream[:-1].tolist(), stream[1:].tolist(), strict=True)) and len(seen) < n + 192
    learned, go_on = [], G.learn_everywhere
    monkeypatch.setattr(G, "learn_everywhere", lambda *a, **k: learned.append(go_on(*a, **k)))
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)
    assert learned == [G.lm_scores(docs, docs, n_frequent=10, n_rare=3, sample=5, steps=5).first()["train_tokens"]]


def test_places_are_found_by_leading_bits():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 50, 5000):
        h = np.unique(np.concatenate([rng.integers(0, 2**64, n, np.uint64), rng.integers(0, 40, n, np.uint64)]))
        x = np.concatenate([h, rng.integers(0, 2**64, 50, np.uint64), rng.integers(0, 50, 50, np.uint64), [np.uint64(2**64 - 1)]]).astype(np.uint64)
        k, hit = G.Places(h)(x)
        assert (hit == np.isin(x, h)).all() and (h[k[hit]] == x[hit]).all()


def test_state_goes_through_long_texts():
    net = G.Gru(20, 2, 8, 6, np.ones(22))
    rng = np.random.default_rng(2)
    sizes = [0, 1, 7, 300]
    at, ids = np.cumsum([0] + sizes), rng.integers(0, 22, sum(sizes))
    a = net.scores(ids, at, 0, room=10)
    b = net.scores(ids, at, 0, room=10**6)
    alone = [net.scores(ids[x:y], np.array([0, y - x]), 0)[0] for x, y in zip(at, at[1:], strict=False)]
    assert np.allclose(a, b, rtol=1e-5) and np.allclose(a, alone, rtol=1e-5)


def test_lm_without_training_texts(spark):
    docs = spark.createDataFrame(TEXTS[:5], "doc_id long, text string")
    got = G.lm_scores(docs, docs.where("false")).collect()
    assert [r["n_known"] for r in got] == [0] * 5 and all(r["train_tokens"] == 0 and r["base_score"] == 0 for r in got)
    assert G.lm_scores(docs.where("false"), docs).count() == 0


ITEMS = [(1, "A train leaves Berlin at 9 and travels 120 km to reach Hamburg before the evening meal of Anna and Anna"), (2, "short one here"), (3, "is"), (4, None), (5, "the quick brown fox jumps over the lazy dog while nine other animals watch it from far away")]


def leaked(spark, texts, **o):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {(r["doc_id"], r["item_id"]): (round(r["covered"], 2), r["n_changed"] > 0) for r in D.leaks(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), **o).collect()}


def test_copies_and_reparameterised_questions(spark):
    t = ITEMS[0][1]
    texts = [
        "Before. " + t + " after",
        t.replace("9", "11").replace("120", "345").replace("Berlin", "Paris").replace("Hamburg", "New York").replace("km", "miles").replace("Anna", "Bob"),
        t.replace("Anna and Anna", "Anna and Bob").replace("Berlin", "Paris"),
        t.upper(),
        "nothing of the kind in this text at all, only other words",
        None,
        "",
        "well short one here",
        "the quick brown fox",
        "the quick brown fox jumps over the lazy dog while nine other",
    ]
    got = leaked(spark, texts)
    assert got[0, 1] == (1.0, False) and got[1, 1][0] > 0.7 and got[1, 1][1]
    assert (3, 1) in got and got[7, 2] == (1.0, False) and got[9, 5][0] > 0.5
    assert not any(k[0] in (4, 5, 6, 8) or k[1] in (3, 4) for k in got)


def test_slots_map_one_to_one():
    def rows(mine, theirs):
        return [(0, (D.LITERAL, D.NUMBER, D.LITERAL, D.NUMBER), (1, mine[0], 2, mine[1]), (1, theirs[0], 2, theirs[1]))]

    assert D.judge(rows((3, 5), (4, 9))) == ({0, 1, 2, 3}, 2, 2) and D.judge(rows((3, 3), (4, 4)))[0] == {0, 1, 2, 3}
    assert not D.judge(rows((3, 5), (4, 4)))[0] and not D.judge(rows((3, 3), (4, 5)))[0]
    # a window that disagrees goes, the others stay
    many = [(p, (D.LITERAL, D.NUMBER), (1, 3), (1, 4)) for p in (0, 2, 4)] + [(6, (D.LITERAL, D.NUMBER), (1, 3), (1, 5))]
    assert D.judge(many)[0] == set(range(6))


def test_slots_names_and_items_with_one_id(spark):
    items = [
        (1, "On day 3 Tom bought 5 kg and Ann bought 7 kg so how many kg do 3 shops need in 12 days"),
        (2, "Compute 3 + 4 + 5 + 6"),
        (3, "Tom runs. Al swims. Eve reads. Who of them is it that does not sit at home"),
        (4, "the first text of an item that has two of them under one id"),
        (4, "and here is another one that has no word of it at all in common with that"),
    ]
    texts = [
        "On day 8 Jim bought 2 kg and Sue bought 9 kg so how many kg do 8 shops need in 14 days",
        "x. Compute 30 + 41 + 52 + 63",
        "Bob runs. Ed swims. Zoe reads. Who of them is it that does not sit at home",
        "see: the first text of an item that has two of them under one id.",
        "see: and here is another one that has no word of it at all in common with that.",
        "1 2 3 4 5 6 7 8 9 10 11 12 13 14 and 3 + 4 + 5",
        "On day 8 it rained. 5 kg and 7 kg are 12 kg. Nobody bought it",
    ]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, k1 string")
    got = {(r["doc_id"], r["item_id"]): r["covered"] for r in D.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(0, 1), (1, 2), (2, 3), (3, 4), (4, 4)} and min(got.values()) > 0.8
    long = spark.createDataFrame([(1, "other words " * 200_000 + texts[0] + " more of it" * 200_000)], "doc_id long, text string")
    assert D.leaks(long, spark.createDataFrame(items, "item_id long, text string")).first()["item_id"] == 1


def test_clean_keeps_the_rest_as_it_is(spark):
    rows = spark.createDataFrame([(1, "x " + ITEMS[4][1], "a"), (2, "fine", "b"), (2, "fine", "b"), (None, None, None)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert sorted(map(str, D.clean(rows, bench).collect())) == sorted(map(str, rows.where("doc_id = 2 or doc_id is null").collect()))
    assert D.clean(rows, bench.where("false")).count() == 4 and D.leaks(rows, bench.where("false")).count() == 0


def test_planted_items_are_found(spark, data):
    bench = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    want = {(d["doc_id"], i) for d in docs for i, t in bench.items() if d["text"] and t in d["text"]}
    got = {(r["doc_id"], r["item_id"]) for r in D.op10_decontaminate(spark, data).collect()}
    assert want <= got and len(got - want) <= 0.1 * len(got) + 1
