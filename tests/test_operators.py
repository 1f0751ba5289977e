"""Cases that the tables at hand do not have."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from genoloom.functions import stats
from genoloom.operators import combine, diagnose, expression, graph_latent, gss, intervals, ld, neighbors, ranks, regress, sumstats
from genoloom.plans.catalog import ORACLE, QUERIES


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_tails_are_inverse_and_deep():
    p = np.array([0.5, 0.1, 1e-5, 1e-14, 1e-40, 1e-200])
    z = np.array([stats._isf(x) for x in p])
    assert np.allclose(np.log(stats.norm_sf_array(z)), np.log(p), rtol=1e-10)
    assert stats._isf(0) == math.inf and stats._isf(1) == -math.inf


def combined(spark, ps):
    return frame(spark, [("a", p) for p in ps], "annotation string, p double").groupBy("annotation").agg(stats.acat(F.col("p")).alias("c")).first()["c"]


def test_tiny_p_where_p_underflows(spark, tmp_path):
    rows = [("a", v) for v in (1.0, 40.0, 760.0)] + [("b", v) for v in (0.0, 3.0, -400.0)] + [("c", v) for v in (700.0, 712.0)]
    frame(spark, rows, "event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["annotation"]: r["log_t"] for r in QUERIES["cauchy_tiny_p"](spark, str(tmp_path)).collect()}
    want = duckdb.connect().sql(ORACLE["cauchy_tiny_p"].replace("from events", f"from '{tmp_path}/events.parquet/*.parquet'")).fetchall()
    assert got == dict(want) and got["a"] == got["c"] == math.inf and got["b"] < 200


def test_acat_edges(spark):
    assert combined(spark, [0.3, 0.3, 0.3]) == pytest.approx(0.3)
    assert combined(spark, [0.0, 0.5]) == 0 and combined(spark, [1.0, 0.5]) == 1
    assert combined(spark, [1e-18, 0.5]) == pytest.approx(2e-18, rel=1e-6)
    for wrong in ([0.0, 1.0], [0.5, None], [1.5], [float("nan")]):
        with pytest.raises(Exception, match="p-values"):
            combined(spark, wrong)


def test_outliers_are_removed_only_when_few(spark):
    few = [(1, 0.5 - i / 1000) for i in range(50)] + [(1, 1e-30)]
    many = [(2, 0.5 - i / 1000) for i in range(75)] + [(2, 1e-30)] * 25
    out = combine.remove_outliers(frame(spark, few + many, "g int, p double"), ["g"]).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in out} == {1: 50, 2: 100}


def test_null_annotations_are_left_out(spark):
    out = combine.cauchy_combination(frame(spark, [(None, 0.1), ("a", 0.2)], "annotation string, p double")).collect()
    # one value is its own outlier, and nothing is left: half
    assert [(r["annotation"], r["p_cauchy"], r["p_median"]) for r in out] == [("a", 0.5, 0.2)]


def test_a_p_of_zero_is_an_outlier_like_others(spark):
    rows = [("a", 0.5 - i / 1000) for i in range(50)] + [("a", 0.0)]
    got = combine.cauchy_combination(frame(spark, rows, "annotation string, p double")).first()
    assert got["p_cauchy"] > 0.4
    got = combine.cauchy_combination(frame(spark, [("a", 0.0)] * 30 + rows, "annotation string, p double")).first()
    assert got["p_cauchy"] == 0


GWAS = [
    ("rs1", "a", "C", 1.0, 0.5, 0.3, 0.95, 0.01, 1000.0, 0),
    ("rs1", "A", "C", 2.0, 0.5, 0.3, 0.95, 0.01, 1000.0, 1),  # twice: the first stays
    ("rs2", "A", "T", 1.0, 0.5, 0.3, 0.95, 0.01, 1000.0, 2),  # strand
    ("rs3", "A", "G", 1.0, 0.5, 1.3, 0.95, 0.01, 1000.0, 3),  # frequency
    ("rs4", "A", "G", 1.0, 0.5, 0.01, 0.95, 0.01, 1000.0, 4),  # rare: strictly above is kept
    ("rs5", "A", "G", 1.0, 0.5, 0.3, 0.5, 0.01, 1000.0, 5),  # INFO
    ("rs6", "A", "G", 1.0, 0.5, 0.3, None, 0.01, 1000.0, 6),  # INFO missing
    ("rs7", "A", "G", 1.0, 0.5, 0.3, 0.95, 0.0, 1000.0, 7),  # P
    ("rs8", "A", "G", 1.0, 0.5, 0.3, 0.95, 1.0, 1000.0, 8),
    ("rs9", "A", "G", 1.0, 0.5, 0.3, 0.95, 0.01, 10.0, 9),  # N
    ("rs10", None, "G", 1.0, 0.5, 0.3, 0.95, 0.01, 1000.0, 10),
]


def test_sumstats_filters(spark):
    raw = frame(spark, GWAS, "SNP string, EA string, NEA string, BETA double, se double, EAF double, Info double, PVAL double, N double, _seq long")
    got = sumstats.format_sumstats(raw).orderBy("SNP").collect()
    assert [r["SNP"] for r in got] == ["rs1", "rs8"]
    assert got[0]["A1"] == "A" and got[0]["Z"] == pytest.approx(2.5758, abs=1e-3) and got[1]["Z"] == pytest.approx(0, abs=1e-9)


def test_sumstats_rules(spark):
    base = frame(spark, [("rs1", "A", "C", -2.0, "0.5", 10.0)], "SNP string, A1 string, A2 string, OR double, SE_OR string, N double")
    out = sumstats.with_effects(base.withColumn("SE_OR", F.col("SE_OR").cast("double"))).first()
    assert out["BETA"] is None and out["SE"] == pytest.approx(math.log(0.5))
    with pytest.raises(ValueError, match="twice"):
        sumstats.standard_names(["P", "PVAL"])
    with pytest.raises(ValueError, match="sign"):
        sumstats.with_z(frame(spark, [(0.1,)], "P double"), "sumstats")
    with pytest.raises(ValueError, match="COJO"):
        sumstats.with_z(frame(spark, [(0.1,)], "P double"), "COJO")
    with pytest.raises(ValueError, match="N is needed"):
        sumstats.format_sumstats(frame(spark, [("a", 0.1)], "SNP string, Z double"))
    bad = frame(spark, [("rs1", "A", "C", "x", "5"), ("rs2", "A", "C", "2", "5")], "SNP string, A1 string, A2 string, Z string, N string")
    assert [r["SNP"] for r in sumstats.format_sumstats(bad).collect()] == ["rs2"]


def test_ids_from_places(spark):
    g = frame(spark, [(1, 10), (2, 20), (2, 30)], "Chr int, Pos int")
    m = frame(spark, [("chr1", "10", "rsA", 1), ("chr1", "10", "rsB", 0), ("chr2", "20", "rsC", 2), ("chr2", "30", "rsC", 3)], "chr string, pos string, dbsnp string, seq int")
    assert {(r["Chr"], r["SNP"]) for r in sumstats.resolve_ids(g, m).collect()} == {(1, "rsB"), (2, "rsC")}


def test_ranks_count_absent_genes(spark):
    x = frame(spark, [("s", "a", "g1", 2.0), ("s", "a", "g2", 2.0), ("s", "a", "g3", 5.0)], "sample string, spot string, gene string, value double")
    got = {r["gene"]: r["rank"] for r in ranks.average_ranks(x, 6).collect()}
    assert got == {"g1": 4.5, "g2": 4.5, "g3": 6.0}
    genes = frame(spark, [("s", f"g{i}") for i in range(1, 7)], "sample string, gene string")
    spots = frame(spark, [("s", "a"), ("s", "empty")], "sample string, spot string")
    mean = {r["gene"]: r["g_mean"] for r in ranks.rank_means(x, genes, spots).collect()}
    assert mean["g3"] == pytest.approx(math.sqrt(6 * 3.5)) and mean["g6"] == pytest.approx(math.sqrt(2 * 3.5))
    with pytest.raises(ValueError, match="two samples"):
        ranks.slice_mean(frame(spark, [("s", "g", 1.0, 1, 1)], "sample string, gene string, g_mean double, n_expressed long, n_spots long"))


def test_interval_edges(spark):
    w = frame(spark, [("a", "chr1", 10, 20, 12, 0), ("b", "chr1", 19, 200, 40, 1), ("c", "chr1", 5, 5, 5, 2)], "gene string, chrom string, win_start long, win_end long, tss long, seq int")
    s = frame(spark, [(i, "chr1", i) for i in (10, 11, 20, 21, 27, 300)] + [(9, "chr2", 15)], "snp long, chrom string, bp long")
    for size in (3, 7, 1000):
        got = {r["snp"]: r["gene"] for r in intervals.snp_to_gene(s, w, bin_size=size).collect()}
        # 20 is point 19, in a and b: distances 7 and 21; 27 is point 26
        assert got == {10: None, 11: "a", 20: "a", 21: "b", 27: "b", 300: None, 9: None}


def test_nearest_ties_go_by_order(spark):
    w = frame(spark, [("late", "chr1", 0, 100, 40, 5), ("early", "chr1", 0, 100, 60, 1)], "gene string, chrom string, win_start long, win_end long, tss long, seq int")
    s = frame(spark, [(1, "chr1", 51)], "snp long, chrom string, bp long")
    assert intervals.nearest_gene(s, w).first()["gene"] == "early"


def test_enhancer_priority(spark):
    w = frame(spark, [("g", "chr1", 0, 100, 40, 0)], "gene string, chrom string, win_start long, win_end long, tss long, seq int")
    e = frame(spark, [("chr1", 50, 60, "e1", 1.0, 55, 0), ("chr1", 50, 60, "e2", 3.0, None, 1)], "chrom string, start long, end long, gene string, avg_mkscore double, tss long, seq int")
    s = frame(spark, [(1, "chr1", 55), (2, "chr1", 90), (3, "chr1", 500)], "snp long, chrom string, bp long")
    get = lambda p: {r["snp"]: r["gene"] for r in intervals.snp_to_gene(s, w, e, p).collect()}
    assert get("gene_window_first") == {1: "g", 2: "g", 3: None}
    assert get("enhancer_first") == {1: "e2", 2: "g", 3: None}
    assert get("enhancer_only") == {1: "e2", 2: None, 3: None}


def test_knn_is_exact(spark):
    rng = np.random.default_rng(1)
    xy = np.vstack([rng.normal(size=(60, 2)), rng.normal(size=(5, 2)) * 50, np.zeros((3, 2))])
    pdf = pd.DataFrame({"sample": "s", "annotation": ["a"] * 60 + ["b"] * 8, "pos": range(68), "sx": xy[:, 0], "sy": xy[:, 1]})
    spots = spark.createDataFrame(pdf)
    key = lambda df: sorted((r["src"], r["rank"], r["dst"]) for r in df.collect())
    got = key(neighbors.knn_spatial(spots, 7))
    assert got == key(neighbors.knn_exact(spots, 7)) and len(got) == 68 * 7
    assert len(key(neighbors.knn_spatial(spots, 100))) == 60 * 60 + 8 * 8


def test_cosine_without_direction(spark):
    latent = frame(spark, [("s", 0, [1.0, 0.0]), ("s", 1, [0.0, 0.0]), ("s", 2, [1.0, 1.0])], "sample string, pos int, vec array<double>")
    edges = frame(spark, [("s", 0, i) for i in range(3)], "sample string, src int, dst int")
    got = [(r["dst"], r["similarity"]) for r in neighbors.cosine_topk(edges, latent, 3).orderBy("rank").collect()]
    assert [g[0] for g in got] == [0, 2, 1] and got[2][1] is None


def brute_ld(g, pairs, targets, n):
    z = ld.standardized(list(g), n)
    r2 = (z @ z.T / n) ** 2
    r2 -= (1 - r2) / (n - 2)
    out = {}
    for i, j in pairs:
        out[i, targets[j]] = out.get((i, targets[j]), 0) + r2[i, j]
    return out


@pytest.mark.parametrize("window", [3, 12, 1000])
def test_ld_band(spark, window):
    rng = np.random.default_rng(2)
    m, n, c = 57, 12, 10
    g = rng.integers(0, 3, (m, n)).astype(int)
    g[3, 2] = 9
    g[4] = 1
    rows = frame(spark, [(1, i, g[i].tolist(), i, 0.0) for i in range(m)], "chr int, idx long, g array<tinyint>, bp long, cm double")
    targets = [f"t{i % 4}" for i in range(m)]
    got = ld.ld_scores(rows, frame(spark, [(1, i, t) for i, t in enumerate(targets)], "chr int, idx long, target string"), "SNP", window, c)
    left = [max(0, i - window) for i in range(m)]
    first = next((i for i in range(m) if left[i] > 0), None)
    b0 = m if first is None else -(-first // c) * c
    pairs = set()
    if b0 > m or first is None:
        pairs = {(i, j) for i in range(m) for j in range(m)}
    else:
        pairs = {(i, j) for i in range(b0) for j in range(b0)}
        for at in range(b0, m, c):
            low = at - -(-(at - left[at]) // c) * c
            for i in range(at, min(at + c, m)):
                for j in range(max(0, low), min(at + c, m)):
                    pairs |= {(i, j), (j, i)}
    want = brute_ld(g, pairs, targets, n)
    have = {(r["idx"], r["target"]): r["w"] for r in got.collect()}
    assert have.keys() == want.keys() and all(have[k] == pytest.approx(want[k], abs=1e-9) for k in want)


@pytest.mark.parametrize("window", [0, 1, 2.5, 100])
def test_left_edges(spark, window):
    rng = np.random.default_rng(3)
    rows = [(int(c), i, float(x)) for i, (c, x) in enumerate(zip(rng.integers(1, 4, 200), rng.integers(0, 60, 200) / 2, strict=True))]
    got = ld.left_edges(frame(spark, rows, "chr int, idx long, coord double"), window).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["left"] == sum(c == r["chr"] and x < r["coord"] - window for c, _, x in rows)


def test_every_variant_has_a_left_edge(spark, data):
    orders = [r[0] for r in spark.read.parquet(f"{data}/orders.parquet").select("o_orderkey").collect()]
    place = {i: i * 100 + i % 7 * 5 for i in orders}
    got = {r["idx"]: r["left_edge"] for r in QUERIES["ld_window_left"](spark, data).collect()}
    assert got == {i: sum(j % 22 == i % 22 and place[j] < place[i] - 10000 for j in orders) for i in orders}


def test_invalid_variants_go(spark):
    rows = frame(spark, [(1, 0, [1, 1, 9]), (1, 1, [0, 1, 2]), (1, 2, [2, 2, 2])], "chr int, idx long, g array<tinyint>")
    got = ld.valid_snps(ld.allele_stats(rows)).orderBy("idx").collect()
    assert [(r["idx"], r["freq"], r["maf"]) for r in got] == [(0, 0.5, 0.5), (1, 1.0, 0.0)]


def test_subset(spark):
    rows = frame(spark, [(1, 0, [0, 1, 2, 9]), (1, 1, [2, 2, 2, 0]), (1, 2, [1, 1, 0, 0])], "chr int, idx long, g array<tinyint>")
    got = ld.subset(rows, frame(spark, [(1, 0), (1, 1)], "chr int, idx long"), [0, 3], 0.1).collect()
    assert [(r["idx"], r["g"], r["freq"]) for r in got] == [(1, [2, 0], 0.5)]
    with pytest.raises(ValueError):
        regress.jackknife(np.zeros((3, 2, 2)), np.zeros((3, 1)))


def test_zero_centimorgans_are_base_pairs(spark):
    rows = frame(spark, [(1, 0, 0, 0.0), (1, 1, 900_000, 0.0), (1, 2, 2_000_000, 0.0), (2, 0, 0, 0.1)], "chr int, idx long, bp long, cm double")
    placed, w = ld.coordinates(rows)
    assert w == 1.0 and [r["coord"] for r in placed.orderBy("chr", "idx").collect()] == pytest.approx([0.0, 0.9, 2.0, 0.1])


def test_regression_against_numpy(spark):
    rng = np.random.default_rng(3)
    m, blocks, spots = 400, 10, 3
    x = rng.gamma(2, size=(m, spots)).astype(np.float32)
    x[:, 2] = 0  # singular
    base = np.stack([rng.gamma(3, size=m), rng.gamma(3, size=m) + 1], 1)
    n, w_ld = rng.integers(900, 1100, m).astype(float), rng.gamma(2, size=m)
    z = rng.normal(size=m) * np.sqrt(1 + 0.3 * x[:, 0])
    snps = [f"rs{i}" for i in range(m)]
    trait = frame(spark, list(zip(snps, z.tolist(), n.tolist(), strict=True)), "snp string, z double, n double")
    b = frame(spark, [(s, i, base[i].tolist()) for i, s in enumerate(snps)], "snp string, idx long, base array<double>")
    w = frame(spark, list(zip(snps, w_ld.tolist(), strict=True)), "snp string, l2 double")
    lds = frame(spark, [(s, 1, x[i].tolist()) for i, s in enumerate(snps)], "snp string, chunk int, l2 array<float>")
    names = frame(spark, [(1, ["a", "b", "c"])], "chunk int, spots array<string>")
    rows = regress.regression_rows(trait, b, w, blocks).withColumn("trait", F.lit("t"))
    fewer = regress.regression_rows(trait.where("snp < 'rs3'"), b, w, blocks).withColumn("trait", F.lit("u"))
    both = regress.spatial_ldsc(rows.unionByName(fewer), lds, names, slice_size=64).collect()
    got = {r["spot"]: r for r in both if r["trait"] == "t"}
    assert set(got) == {"a", "b"} and {r["spot"] for r in both if r["trait"] == "u"} == {"a", "b"}
    alone = {r["spot"]: r for r in regress.spatial_ldsc(fewer, lds, names).collect()}
    for r in both:
        if r["trait"] == "u":
            assert r["beta"] == pytest.approx(alone[r["spot"]]["beta"]) and r["se"] == pytest.approx(alone[r["spot"]]["se"])
    nbar, chi = n.mean(), z**2
    cut = np.floor(np.linspace(0, m, blocks + 1)).astype(int)
    for k, spot in enumerate("ab"):
        full = x[:, k].astype(float) + base.sum(1)
        h = np.clip(10000 * (chi.mean() - 1) / (full * n).mean(), 0, 1)
        wt = np.sqrt(1 / (2 * (1 + h * n / 10000 * np.maximum(full, 1)) ** 2) / np.maximum(w_ld, 1))
        design = np.column_stack([x[:, k], base * (n / nbar)[:, None], np.ones(m)]) * wt[:, None]
        y = chi * wt
        est = np.linalg.lstsq(design, y, rcond=None)[0]
        gone = np.array([np.linalg.lstsq(np.delete(design, slice(s, e), 0), np.delete(y, slice(s, e)), rcond=None)[0] for s, e in zip(cut, cut[1:], strict=False)])
        pseudo = blocks * est - (blocks - 1) * gone
        assert got[spot]["beta"] == pytest.approx(pseudo.mean(0)[0] / nbar, rel=1e-6)
        assert got[spot]["se"] == pytest.approx(np.sqrt(pseudo.var(0, ddof=1) / blocks)[0] / nbar, rel=1e-6)
        assert got[spot]["p"] == pytest.approx(0.5 * math.erfc(got[spot]["z"] / math.sqrt(2)))


def test_gradients_of_the_graph_encoder():
    rng = np.random.default_rng(0)
    x, label = rng.normal(size=(14, 6)), rng.integers(0, 2, 10)
    graph = graph_latent.graph_of(14, np.repeat(np.arange(14), 3), rng.integers(0, 14, 42))
    net = graph_latent.Net(6, 2, graph_latent.Shape(hidden1=7, hidden2=5, gat1=4, gat2=3, heads=2, drop=0.0), np.float64)
    loss = lambda: net.loss(x, graph, 10, label, np.random.default_rng(1))
    loss()
    found = {k: v.copy() for k, v in net.g.items()}
    for k, w in net.p.items():
        for _ in range(4):
            i = tuple(rng.integers(0, d) for d in w.shape)
            old, h = w[i], 1e-6
            w[i] = old + h
            up = loss()
            w[i] = old - h
            down = loss()
            w[i] = old
            assert found[k][i] == pytest.approx((up - down) / 2 / h, rel=1e-4, abs=1e-6)


def test_graph_latent_in_one_tile_and_many(spark):
    rng = np.random.default_rng(2)
    label = [i % 2 for i in range(120)]
    rows = [(i, float(rng.normal() + 5 * (i % 2)), float(rng.normal()), (rng.normal(size=8) + 2 * (i % 2)).tolist(), i % 2) for i in range(120)]
    nodes = frame(spark, rows, "pos long, sx double, sy double, vec array<double>, label int")
    near = neighbors.knn_spatial(nodes.withColumn("sample", F.lit("s")), 6, ("sample",)).where("distance > 0")
    shape = graph_latent.Shape(hidden1=16, hidden2=12, gat1=6, gat2=4, epochs=30, rate=0.01)
    for tile in (1000, 50):
        got = graph_latent.graph_latent(nodes, near, shape, 2, tile).toPandas().sort_values("pos")
        assert got["pos"].tolist() == list(range(120))
        z = np.stack(got["latent"].to_list())
        assert np.isfinite(z).all()
        centre = np.stack([z[np.array(label) == k].mean(0) for k in (0, 1)])
        close = ((z[:, None] - centre[None]) ** 2).sum(2).argmin(1)
        assert (close == label).mean() > 0.95
    assert graph_latent.graph_latent(nodes.limit(0), near, shape).count() == 0


def test_variable_genes_by_counts(spark):
    rng = np.random.default_rng(4)
    x = rng.poisson(rng.gamma(2, size=40)[None], (80, 40))
    x[:, 7] *= rng.integers(0, 6, 80)
    counts = frame(spark, [("s", f"c{i}", f"g{k:02}", float(x[i, k])) for i in range(80) for k in range(40) if x[i, k]], "sample string, spot string, gene string, value double")
    got = expression.variable_genes_counts(counts, 80, 40).toPandas().set_index("gene")["dispersion"]
    assert got.index[0] == "g07"
    mean, var = x.mean(0), x.var(0, ddof=1)
    sd = np.sqrt(10 ** expression.loess(np.log10(mean), np.log10(var)))
    low = np.minimum(x, mean + sd * 80**0.5)
    want = ((low - mean) ** 2).sum(0) / 79 / sd**2
    assert got.to_numpy() == pytest.approx(np.sort(want)[::-1])
    t = np.linspace(0, 1, 50)
    assert expression.loess(t, 1 + 2 * t - 3 * t * t) == pytest.approx(1 + 2 * t - 3 * t * t)


def test_local_fits_are_made_once_a_place(monkeypatch):
    rng = np.random.default_rng(6)
    x = np.log10(rng.integers(1, 60, 3000) ** 2)
    y = x - 0.2 * x * x + 0.1 * rng.normal(size=3000)
    made, solve = [], np.linalg.lstsq
    monkeypatch.setattr(np.linalg, "lstsq", lambda a, *o, **k: made.append(len(a)) or solve(a, *o, **k))
    got = expression.loess(x, y)
    assert len(made) == len(set(x)) and max(made) <= len(set(x))
    for i in range(0, 3000, 100):  # of points one by one
        d = np.abs(x - x[i])
        u = (x - x[i]) / np.sort(d)[899]
        w = np.maximum(0, 1 - np.abs(u) ** 3) ** 1.5
        assert got[i] == pytest.approx(solve(np.stack([w, w * u, w * u * u], 1), w * y, rcond=None)[0][0])
    assert expression.loess(np.array([1.0, 1, 1, 1, 2]), np.array([1.0, 2, 3, 6, 9])) == pytest.approx([3, 3, 3, 3, 9])


def test_annotation_chunks_against_rows(spark):
    rng = np.random.default_rng(8)
    w = rng.random((50, 6)) * (rng.random((50, 6)) < 0.5)
    g = rng.random((6, 7)) * (rng.random((6, 7)) < 0.5)
    weights = frame(spark, [(1, i, f"g{k}" if k < 5 else None, float(w[i, k])) for i in range(50) for k in range(6) if w[i, k]], "chr int, idx long, gene string, w double")
    gss = frame(spark, [(f"g{k}", f"s{s}", float(g[k, s])) for k in range(5) for s in range(7) if g[k, s]], "gene string, spot string, score double")
    spots = frame(spark, [(f"s{s}", s // 4 + 1, s) for s in range(7)], "spot string, chunk int, seq long")
    got = {(r["idx"], r["chunk"]): r["l2"] for r in ld.annotation_chunks(weights, gss, spots, block=16).collect()}
    want = w[:, :5] @ g[:5]
    for i in range(50):
        for c, at in ((1, slice(0, 4)), (2, slice(4, 7))):
            assert got.get((i, c), [0.0] * len(want[i, at])) == pytest.approx(want[i, at].tolist())
    assert max(ld.annotation_chunks(weights, gss, spots, clamp=0.5).select(F.array_max("l2")).toPandas().iloc[:, 0]) <= 0.5


def test_blocks_are_even(spark):
    rows = spark.range(1003).withColumnRenamed("id", "i").repartition(5)
    got = [r["block"] for r in regress.with_blocks(rows, ["i"], 20).orderBy("i").collect()]
    cut = np.floor(np.linspace(0, 1003, 21)).astype(int)
    assert got == np.repeat(np.arange(20), np.diff(cut)).tolist()


def test_nonnegative_jackknife():
    rng = np.random.default_rng(4)
    x = np.abs(rng.normal(size=(6, 50, 2)))
    y = x @ np.array([1.0, -0.5])
    xtx, xty = np.einsum("bni,bnj->bij", x, x), np.einsum("bni,bn->bi", x, y)
    est, _ = regress.jackknife_nonnegative(xtx, xty)
    assert est[1] == pytest.approx(0, abs=1e-9) and est[0] > 0


def test_medians_and_correlations_count_absent_scores(spark):
    s = frame(spark, [("g", 1, 5.0), ("g", 2, 3.0), ("h", 1, 1.0)], "gene string, spot int, score double")
    a = frame(spark, [(1, "x"), (2, "x"), (3, "x"), (4, "y")], "spot int, annotation string")
    med = {(r["gene"], r["annotation"]): r["median_gss"] for r in diagnose.median_by_annotation(s, a).collect()}
    assert med == {("g", "x"): 3.0, ("h", "x"): 0.0}
    p = frame(spark, [(i, 10.0**-i) for i in range(1, 5)], "spot int, p double")
    pcc = {r["gene"]: r["pcc"] for r in diagnose.gene_correlation(s, p).collect()}
    assert pcc["g"] == pytest.approx(np.corrcoef([5, 3, 0, 0], [1, 2, 3, 4])[0, 1])


def test_specificity_of_a_lonely_gene(spark):
    edges = frame(spark, [("s", "a", "a"), ("s", "a", "b"), ("s", "b", "b")], "sample string, src string, dst string")
    r = frame(spark, [("s", "b", "g", 4.0), ("s", "b", "MT-1", 4.0)], "sample string, spot string, gene string, rank double")
    zero = frame(spark, [("s", "a", 2.5), ("s", "b", 1.5)], "sample string, spot string, zero_rank double")
    means = frame(spark, [("g", 2.0, 0.4), ("MT-1", 1.0, 0.1)], "gene string, g_mean double, frac double")
    got = {r["spot"]: r["score"] for r in gss.specificity(edges, r, zero, means).collect()}
    assert got == {"a": pytest.approx(math.exp(math.sqrt(10) / 2) - 1), "b": pytest.approx(math.exp(2) - 1)}


def test_every_row_is_winsorized(spark, data):
    rows = spark.read.parquet(f"{data}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_extendedprice").toPandas()
    top = np.quantile(rows["l_extendedprice"].astype(float), 0.99)
    want = sorted(zip(rows["l_orderkey"], rows["l_linenumber"], np.minimum(rows["l_extendedprice"].astype(float), top), strict=True))
    got = sorted((r["l_orderkey"], r["l_linenumber"], float(r["price"])) for r in QUERIES["winsorize"](spark, data).collect())
    assert len(got) == len(want)
    assert all(a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-6) for a, b in zip(got, want, strict=True))


def test_homologs_keep_first(spark):
    x = frame(spark, [("m1", 1.0), ("m2", 2.0), ("m3", 3.0)], "gene string, value double")
    h = frame(spark, [("m1", "H", 1), ("m2", "H", 0), ("m3", "K", 2), ("m3", "L", 3)], "species_gene string, human_gene string, seq int")
    assert {(r["gene"], r["value"]) for r in expression.to_human_genes(x, h, 1).collect()} == {("H", 2.0), ("K", 3.0)}
    with pytest.raises(ValueError, match="fewer"):
        expression.to_human_genes(x, h, 100)


def test_empty_tables(spark):
    e = frame(spark, [], "annotation string, p double")
    assert combine.cauchy_combination(e).count() == 0
    assert intervals.snp_to_gene(frame(spark, [], "snp long, chrom string, bp long"), frame(spark, [], "gene string, chrom string, win_start long, win_end long, tss long, seq int")).count() == 0
    assert neighbors.knn_spatial(frame(spark, [], "sample string, annotation string, pos long, sx double, sy double"), 3).count() == 0


def test_homologs_of_genes_that_are_there(spark):
    pairs = spark.createDataFrame([("m1", "H1", 1), ("m2", "H1", 2), ("m3", "H3", 3), ("m3", "H4", 4)], "species_gene string, human_gene string, seq int")
    rows = spark.createDataFrame([("s", "a", "m2", 1.0), ("s", "a", "m3", 2.0)], "sample string, spot string, gene string, value double")
    got = {r["gene"]: r["value"] for r in expression.to_human_genes(rows, pairs, least=0).collect()}
    assert got == {"H1": 1.0, "H3": 2.0}


def test_neighbours_on_a_given_grid_lose_no_spot(spark):
    spots = spark.createDataFrame([("s", "a", i, float(i * i % 37), float(i % 7)) for i in range(31)] + [("s", "a", 99, 1e6, 0.0)], "sample string, annotation string, pos int, sx double, sy double")
    key = lambda df: sorted((r["src"], r["rank"], r["dst"]) for r in df.collect())
    assert key(neighbors.knn_spatial(spots, 5, cell=64.0)) == key(neighbors.knn_exact(spots, 5))


def test_dense_residuals_have_every_cell(spark):
    rows = spark.createDataFrame([("s", "a", "g", 4.0), ("s", "a", "h", 1.0), ("s", "b", "h", 5.0)], "sample string, spot string, gene string, value double")
    spots = spark.createDataFrame([("s", x) for x in "abc"], "sample string, spot string")
    got = {(r["spot"], r["gene"]): r["value"] for r in expression.dense_residuals(rows, spark.createDataFrame([("g",)], "gene string"), spots).collect()}
    mean = {"a": 4 * 5 / 10, "b": 4 * 5 / 10}
    want = {(x, "g"): (v - mean[x]) / (mean[x] + mean[x] ** 2 / 100) ** 0.5 for x, v in (("a", 4), ("b", 0))} | {("c", "g"): 0.0}
    assert got == pytest.approx(want)
