import random

import numpy as np
import pytest

from genoloom.llm import pieces as P


@pytest.fixture(scope="module")
def model():
    return P.load(P.MODEL)


def brute(model, s, n):
    out = []

    def go(i, score):
        if i == len(s):
            out.append(score)
        for j in range(i + 1, min(len(s), i + model.most) + 1):
            if (e := model._edge(s, i, j)) > -np.inf:
                go(j, score + e)

    go(0, 0.0)
    return sorted(out, reverse=True)[:n]


def test_nbest_and_round_trip(model):
    rng = random.Random(1)
    for _ in range(120):
        t = "".join(rng.choice("the ré \n▁x<0ç\u200b") for _ in range(rng.randint(0, 11)))
        want = brute(model, P.lattice(" " + t), 4) if t else [0.0]
        assert [x[0] for x in model.nbest_text(t, 4)] == pytest.approx(want)
        assert model.decode(model.encode(t)) == t
        data = np.frombuffer(t.encode(), np.uint8)
        ids, scores, ok, _ = next(P.Encoder(model, 4).chunk(data, np.array([0, len(data)]), 0, 1))
        assert scores == pytest.approx(want) and ok and model.decode(ids) == t


def test_many_texts_share_units(model):
    texts = ["", "a b", "  a  b ", "\n\n", "x" * 200, "the the the", "a b"] * 3
    raw = [t.encode() for t in texts]
    at = np.cumsum([0] + [len(r) for r in raw])
    got = list(P.Encoder(model, 3, most=5).chunk(np.frombuffer(b"".join(raw), np.uint8), at, 0, len(texts)))
    for t, (ids, scores, ok, others) in zip(texts, got, strict=True):
        assert ok and model.decode(ids) == t
        assert scores == pytest.approx([x[0] for x in model.nbest_text(t, 3)])
        for score, change in zip(scores[1:], others, strict=True):
            path = list(ids)
            for a, n, new in reversed(change):
                path[a : a + n] = new
            assert path != list(ids) and model.decode(path) == t


def test_long_unit_without_a_space(model):
    import time
    import tracemalloc

    rng = random.Random(5)
    for text in ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(1 << 15)), "a" * (1 << 15), "中文" * (1 << 13)):
        raw = np.frombuffer(text.encode(), np.uint8)
        began = time.time()
        tracemalloc.start()
        ids, scores, ok, others = next(P.Encoder(model, 3).chunk(raw, np.array([0, len(raw)]), 0, 1))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert ok and model.decode(ids) == text and len(others) == len(scores) - 1 and scores == sorted(scores, reverse=True)
        assert most < 200 * len(text) + (30 << 20) and time.time() - began < 60
    short = text[:300]
    assert [x[0] for x in model.nbest(P.lattice(short), 3)] == pytest.approx(brute_nbest(model, P.lattice(short), 3))


def brute_nbest(model, s, n):
    """Scores of the n best paths, by keeping the n best of each prefix."""
    best = [[0.0]]
    for j in range(1, len(s) + 1):
        best.append(sorted((x + e for i in range(max(0, j - model.most), j) if (e := model._edge(s, i, j)) > -np.inf for x in best[i]), reverse=True)[:n])
    return best[-1]


def test_nbest_against_the_n_best_of_each_prefix(model):
    rng = random.Random(2)
    for _ in range(40):
        s = P.lattice(" " + "".join(rng.choice(["the", "re", "un", "a", " ", "in", "g"]) for _ in range(rng.randint(1, 30))))
        for n in (1, 2, 5, 9):
            got = model.nbest(s, n)
            assert [x for x, _ in got] == pytest.approx(brute_nbest(model, s, n)) and len({e for _, e in got}) == len(got)


def test_query_columns(spark):
    rows = spark.createDataFrame([(1, "Hello there", "x"), (2, None, "y"), (2, "", "y"), (None, "é\t▁", "z")], "doc_id long, text string, ids string")
    out = P.encode(rows)
    got = P.digest(out).collect()
    assert [r["n_pieces"] > 0 for r in got] == [True, False, False, True] and all(r["decodes"] for r in got)
    paths = out.select("text", *[P.nbest_ids(k).alias(f"p{k}") for k in (1, 2, 3)]).collect()
    assert all(len({tuple(r[p]) for p in ("p1", "p2", "p3")}) == 3 and P.load(P.MODEL).decode(r["p3"]) == r["text"] for r in paths if r["text"] == "Hello there")
    assert [r["p2"] is None for r in paths] == [False, True, True, False]
    assert [r["text"] for r in P.decode(out.select("ids")).collect()] == ["Hello there", "", "", "é\t▁"]
    assert P.encode(rows.where("false")).count() == 0
