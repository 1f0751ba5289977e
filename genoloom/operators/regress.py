"""Spatial LD-score regression: weights, block sums, block jackknife."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.stats import norm_sf
from ..tables import cut

M = 10_000.0  # fixed value: number of variants in the heritability scale


def block_of(i, n, blocks: int):
    """Block of row i of n: bounds are the floors of an even division."""
    return F.floor(((i + 1) * blocks - 1) / n)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``seq``, their number from 0 in ``order``, and ``total``, without bringing them to one task.

    Rows are dealt by ranges of the order and sorted there; a range's first number is the count of those before.
    """
    # kept, as ranges come from a sample: a second one could deal otherwise
    dealt = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    local = dealt.withColumn("_k", F.row_number().over(W.partitionBy("_p").orderBy(*order)))
    parts = dealt.groupBy("_p").agg(F.count("*").alias("_n"))
    before = parts.withColumn("_b", F.sum("_n").over(W.orderBy("_p")) - F.col("_n"))  # a row a partition
    total = parts.agg(F.sum("_n").alias("total"))
    out = local.join(F.broadcast(before.select("_p", "_b")), "_p").crossJoin(F.broadcast(total))
    return out.withColumn("seq", F.col("_b") + F.col("_k") - 1).drop("_p", "_k", "_b")


def with_blocks(rows: DataFrame, order: list[str], blocks: int) -> DataFrame:
    """Jackknife blocks over all rows in ``order``."""
    out = numbered(rows, order)
    return out.withColumn("block", block_of(F.col("seq"), F.col("total"), blocks)).drop("seq", "total")


def regression_rows(sumstats: DataFrame, baseline: DataFrame, weights: DataFrame, blocks: int = 200) -> DataFrame:
    """(snp, idx, block, chisq, n, nbar, base array, w_ld): the variants that all three have, in order of idx.
    ``baseline``: snp, idx, vals array; ``weights``: snp, l2.  Filter chi-squares before."""
    rows = baseline.join(sumstats.select("snp", (F.col("z") ** 2).alias("chisq"), "n"), "snp").join(weights.select("snp", F.col("l2").alias("w_ld")), "snp")
    mean = rows.agg(F.avg("n").alias("nbar"))
    return with_blocks(rows.crossJoin(F.broadcast(mean)), ["idx"], blocks)


def _sides(pdf: pd.DataFrame, keys: list[str]):
    """The spots' LD of a group's variants, and each trait's rows of it: (key values, rows of the matrix, trait)."""
    x = np.stack(pdf["l2"].to_list()).astype(float)
    flat = pd.DataFrame([{**t, "_row": i} for i, ts in enumerate(pdf["t"]) for t in ts])
    whose = list(zip(*(flat[k] for k in keys), strict=True)) if keys else [()] * len(flat)
    for key, at in pd.Series(range(len(flat))).groupby(pd.Series(whose, dtype=object), sort=False):
        t = flat.iloc[at.to_numpy()]
        yield key, x[t["_row"].to_numpy()], t


def _block_sums(x: np.ndarray, t: pd.DataFrame, h: np.ndarray):
    """(block, sums): by spot the weighted normal equations, p * p and p numbers."""
    base = np.stack(t["base"].to_list()).astype(float).reshape(len(t), -1)
    n, chi, wl, nbar = (t[c].to_numpy(float)[:, None] for c in ("n", "chisq", "w_ld", "nbar"))
    full = np.maximum(x + base.sum(1, keepdims=True), 1)
    w2 = 1 / (2 * (1 + h[None] * n / M * full) ** 2) / np.maximum(wl, 1)
    rest = np.hstack([base * n / nbar, np.ones_like(n)])  # p - 1 columns
    p, blocks = rest.shape[1] + 1, t["block"].to_numpy()
    for block in np.unique(blocks):
        at = blocks == block
        w, z, r, c = w2[at], x[at], rest[at], chi[at]
        xtx, xty = np.empty((x.shape[1], p, p)), np.empty((x.shape[1], p))
        xtx[:, 0, 0] = (w * z * z).sum(0)
        xtx[:, 0, 1:] = xtx[:, 1:, 0] = (w * z).T @ r
        xtx[:, 1:, 1:] = np.einsum("vs,va,vb->sab", w, r, r, optimize=True)
        xty[:, 0] = (w * z * c).sum(0)
        xty[:, 1:] = (w * c).T @ r
        yield int(block), np.concatenate([xtx.reshape(len(xtx), -1), xty], 1)


def spatial_ldsc(rows: DataFrame, ld: DataFrame, spots: DataFrame, slice_size: int = 4096) -> DataFrame:
    """(keys..., spot, beta, se, z, p): a weighted regression of chi-squares for each spot.

    ``rows``: as from ``regression_rows``, with any key columns (trait) besides, all traits at once; ``ld``: (snp,
    chunk, l2 array), a row a variant and chunk of spots; ``spots``: (chunk, spots array), the names in that order.
    Design: the spot's LD, baseline columns times N over its mean, and an intercept; both sides times
    w = sqrt(het * over-counting) with h = clip(M (mean chisq - 1) / mean(x N), 0, 1), x the LD of spot and baselines.

    The matrix of variants by spots stays in arrays.  It meets the traits once, a variant's traits in one row, and is
    kept dealt by chunk and slice of ``slice_size`` neighbouring variants, whatever their number; a slice gives a
    trait's sums for the block or few that it touches, by matrix products.  Only sums go further: one row a trait,
    chunk and block reaches the jackknife.  A spot whose normal equations are singular is left out.
    """
    keys = [c for c in rows.columns if c not in ("snp", "idx", "block", "chisq", "n", "nbar", "base", "w_ld")]
    types = dict(rows.dtypes)
    place = numbered(rows.select("snp", "idx").distinct(), ["idx", "snp"]).select("snp", F.floor(F.col("seq") / slice_size).alias("slice"))
    values = F.struct(*keys, "block", *[F.col(c).cast("double").alias(c) for c in ("chisq", "n", "nbar", "w_ld")], F.col("base").cast("array<double>").alias("base"))
    packed = rows.groupBy("snp").agg(F.collect_list(values).alias("t")).join(place, "snp")  # a struct a trait
    joined = cut(ld.select("snp", "chunk", "l2").join(packed, "snp").select("chunk", "slice", "l2", "t").repartition("chunk", "slice"))
    head = "".join(f"{c} {types[c]}, " for c in keys) + f"chunk {dict(ld.dtypes)['chunk']}"

    def totals(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, x, t in _sides(pdf, keys):
            full = x + np.stack(t["base"].to_list()).astype(float).reshape(len(t), -1).sum(1)[:, None]
            out.append((*key, pdf["chunk"].iloc[0], pdf["slice"].iloc[0], (full * t["n"].to_numpy(float)[:, None]).sum(0), t["chisq"].sum(), len(t)))
        return pd.DataFrame(out, columns=[*keys, "chunk", "slice", "v", "c", "m"])

    part = cut(joined.groupBy("chunk", "slice").applyInPandas(totals, f"{head}, slice long, v array<double>, c double, m long"))
    each = part.select(*keys, "chunk", "c", "m", F.posexplode("v").alias("k", "x"))  # a row a slice and spot, not a variant
    h = each.groupBy(*keys, "chunk", "k").agg((F.sum("c") / F.sum("m")).alias("mc"), (F.sum("x") / F.sum("m")).alias("mx"))
    h = h.withColumn("h", F.least(F.greatest(M * (F.col("mc") - 1) / F.col("mx"), F.lit(0.0)), F.lit(1.0)))
    h = h.groupBy(*keys, "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda v: v["h"]).alias("h"))
    h = part.select(*keys, "chunk", "slice").join(h, [*keys, "chunk"])  # to each slice

    def sums(pdf: pd.DataFrame, shares: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pdf):
            of = {tuple(r[: len(keys)]): np.asarray(r[-1], float) for r in shares[[*keys, "h"]].itertuples(index=False, name=None)}
            for key, x, t in _sides(pdf, keys):
                out += [(*key, pdf["chunk"].iloc[0], b, v.ravel(), x.shape[1], t["nbar"].iloc[0]) for b, v in _block_sums(x, t, of[tuple(key)])]
        return pd.DataFrame(out, columns=[*keys, "chunk", "block", "v", "s", "nbar"])

    shape = f"{head}, block long, v array<double>, s int, nbar double"
    parts = joined.groupBy("chunk", "slice").cogroup(h.groupBy("chunk", "slice")).applyInPandas(sums, shape)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.iloc[:1].copy()
        out["v"] = [np.sum(np.stack(pdf["v"].to_list()), 0)]
        return out

    added = parts.groupBy(*keys, "chunk", "block").applyInPandas(add, shape)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        s, nbar = int(pdf["s"].iloc[0]), float(pdf["nbar"].iloc[0])
        v = np.stack(pdf["v"].to_list()).reshape(len(pdf), s, -1)
        p = int(round(((1 + 4 * v.shape[2]) ** 0.5 - 1) / 2))
        found = [jackknife(v[:, k, : p * p].reshape(-1, p, p), v[:, k, p * p :]) for k in range(s)]
        beta, se = ([None if f is None else float(f[i][0] / nbar) for f in found] for i in (0, 1))
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in keys), pdf["chunk"].iloc[0], beta, se]], columns=[*keys, "chunk", "beta", "se"])

    out = added.groupBy(*keys, "chunk").applyInPandas(solve, f"{head}, beta array<double>, se array<double>")
    out = out.join(spots.select("chunk", F.col("spots").cast("array<string>").alias("spot")), "chunk").select(*keys, F.inline(F.arrays_zip("spot", "beta", "se")))
    z = out.withColumn("z", F.col("beta") / F.col("se")).where("z is not null and not isnan(z)")
    return z.withColumn("p", F.greatest(F.least(norm_sf(F.col("z")), F.lit(1.0)), F.lit(1e-300)))


def jackknife(xtx: np.ndarray, xty: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Mean and standard error of pseudovalues from block sums; None where an equation is singular."""
    b = len(xtx)
    if xtx.ndim != 3 or xty.ndim != 2 or xtx.shape[:2] != xty.shape or xtx.shape[1] != xtx.shape[2]:
        raise ValueError("block sums are (blocks, p, p) and (blocks, p)")
    if b < 2:
        return None
    total, right = xtx.sum(0), xty.sum(0)
    try:
        est = np.linalg.solve(total, right)
        gone = np.linalg.solve(total[None] - xtx, (right[None] - xty)[..., None])[..., 0]
    except np.linalg.LinAlgError:
        return None
    pseudo = b * est[None] - (b - 1) * gone
    out = pseudo.mean(0), np.sqrt(pseudo.var(0, ddof=1) / b)
    return out if all(np.isfinite(x).all() for x in out) else None


def jackknife_nonnegative(xtx: np.ndarray, xty: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """As ``jackknife`` with coefficients not below zero, by cyclic coordinate descent on the normal equations."""

    def fit(a, y):
        x = np.zeros(len(y))
        for _ in range(rounds):
            old = x.copy()
            for k in range(len(y)):
                if a[k, k] > 0:
                    x[k] = max(0.0, x[k] + (y[k] - a[k] @ x) / a[k, k])
            if np.abs(x - old).max() <= 1e-12 * max(1.0, np.abs(x).max()):
                break
        return x

    b, total, right = len(xtx), xtx.sum(0), xty.sum(0)
    est = fit(total, right)
    pseudo = b * est[None] - (b - 1) * np.array([fit(total - u, right - v) for u, v in zip(xtx, xty, strict=True)])
    return pseudo.mean(0), np.sqrt(pseudo.var(0, ddof=1) / b)


def ratio_jackknife(rows: DataFrame, x: str, y: str, keys: list[str], block: str = "block") -> DataFrame:
    """(keys..., est, se): y through the origin on x, in closed form with DataFrame operations."""
    sums = rows.groupBy(*keys, block).agg(F.sum(F.col(x) * F.col(y)).alias("xy"), F.sum(F.col(x) * F.col(x)).alias("xx"))
    w = W.partitionBy(*keys)
    t = sums.withColumn("b", F.count("*").over(w)).withColumn("sxy", F.sum("xy").over(w)).withColumn("sxx", F.sum("xx").over(w))
    pseudo = t.select(*keys, "b", (F.col("b") * F.col("sxy") / F.col("sxx") - (F.col("b") - 1) * (F.col("sxy") - F.col("xy")) / (F.col("sxx") - F.col("xx"))).alias("v"))
    return pseudo.groupBy(*keys).agg(F.avg("v").alias("est"), F.sqrt(F.var_samp("v") / F.first("b")).alias("se"))
