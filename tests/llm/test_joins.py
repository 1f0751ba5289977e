"""The n-gram Jaccard join and the pivot index against brute force."""

import random

import numpy as np
import pytest

from genoloom.llm import jaccard_join as J
from genoloom.llm.components import components
from genoloom.llm.pivot_dedup import near_dups
from genoloom.llm.scratch import Scratch


def find(parent, a):
    while parent[a] != a:
        parent[a] = parent[parent[a]]
        a = parent[a]
    return a


def plain(rows, width, num, den):
    """(n, component) by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    parent = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(parent, a), find(parent, b)))
                parent[y] = x
    return {i: (len(sets[i]), find(parent, i)) for i in sets}


def corpus(seed, n=260):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("ijklmn") + str(rng.randint(0, 30))
    base = [[word() for _ in range(rng.randint(1, 120))] for _ in range(12)]
    passage = [word() for _ in range(60)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "one  two"), (7, "a b c"), (8, "a b c")]
    for i in range(10, n):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            t[rng.randrange(len(t))] = word()
        if rng.random() < 0.15:
            t += passage
        rows.append((i, " ".join(t)))
    return rows


@pytest.mark.parametrize("width,num,den,hot", [(3, 90, 100, 32), (3, 90, 100, 3), (5, 80, 100, 2), (2, 1, 2, 1000)])
def test_same_as_all_pairs(spark, width, num, den, hot):
    rows = corpus(width + hot)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_join(df, width=width, threshold=(num, den), hot_df=hot, block=20).collect()}
    assert got == plain(rows, width, num, den)


def test_hot_table_stays_bounded(spark):
    rows = corpus(9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in J.jaccard_join(df, hot_df=1, hot_limit=5).collect()}
    assert got == {k: v[1] for k, v in plain(rows, 3, 90, 100).items()}


def test_repeated_rows_clashing_columns_and_nothing(spark):
    rows = [(1, "a b c d", "x"), (1, "a b c d", "x"), (2, "A b c D", "y"), (None, "a b c d", "z"), (3, "q", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_shingles string")
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in J.jaccard_join(df).collect())
    assert got[1:] == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 1, 3)] and got[0][0] == 0
    assert J.jaccard_join(df.where("false")).count() == 0


def test_packed_hashes():
    h = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 50).astype(np.uint64))
    assert (J._unpack(J._pack(h)) == h >> np.uint64(16)).all()


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(25)] + [(5, 5)]
    parent = {i: i for p in links for i in p}
    for a, b in links:
        x, y = sorted((find(parent, a), find(parent, b)))
        parent[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()}
    assert got == {i: find(parent, i) for i in parent if any(i in p and p[0] != p[1] for p in links)}


def vectors(seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(30, 16))
    rows = [(0, None, 1), (1, [0.0] * 16, 1), (2, [float("nan")] * 16, 1), (3, [1.0] * 16, None), (4, [], 1), (5, [None] * 16, 1)]
    for i in range(10, 260):
        v = base[rng.integers(30)] if rng.random() < 0.7 else rng.normal(size=16)
        v = v + rng.normal(size=16) * rng.choice([0, 0.05, 0.12, 0.3])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(2))))
    rows += [(1000 + i, rows[20][1], rows[20][2]) for i in range(40)] + [(2000, [3.0] + [1.0] * 7, 1), (2001, [3.0] + [1.0] * 7, 1), (2002, [3.0] + [1.1] * 7, 1)]
    return rows


@pytest.mark.parametrize("block,crowd", [(1024, 4096), (16, 4096), (16, 8), (1024, 1)])
def test_same_as_all_cosines(spark, block, crowd):
    rows = vectors(1)
    ok = {i: (np.array(v, float), g) for i, v, g in rows if v and g is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    parent, n = {r[0]: r[0] for r in rows}, {r[0]: 0 for r in rows}
    for a, (x, g) in ok.items():
        for b, (y, k) in ok.items():
            if a < b and g == k and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98:
                n[a] += 1
                n[b] += 1
                u, v = sorted((find(parent, a), find(parent, b)))
                parent[v] = u
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in near_dups(df, block=block, crowd=crowd).collect()}
    assert len(got) == len(rows)
    found, true = sum(r["n_links"] for r in got.values()), sum(n.values())
    assert all(r["n_links"] <= n[i] for i, r in got.items()) and found >= 0.9 * true and true > 1500
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    if found == true:
        assert {i: r["component_id"] for i, r in got.items()} == {i: find(parent, i) for i in parent}
    assert near_dups(df.where("false")).count() == 0


def test_crowded_lists_meet_the_same_pairs(spark):
    df = spark.createDataFrame(vectors(2), "vec_id long, embedding array<double>, label int")
    plain, dealt = (sorted(map(tuple, near_dups(df, crowd=c).collect())) for c in (10**9, 1))
    assert plain == dealt and sum(r[1] for r in plain) > 1500


@pytest.mark.parametrize("name", ["op4_jaccard_join", "op8_pivot_dedup"])
def test_same_as_sql(spark, data, name):
    import duckdb

    from genoloom.llm.queries import ORACLE, QUERIES

    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    want = c.sql(ORACLE[name])
    assert sorted(map(tuple, QUERIES[name](spark, data).select(*want.columns).collect())) == sorted(want.fetchall())
