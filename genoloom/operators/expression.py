"""Expression matrices as long tables: filters, normalisation, scaling, variable genes, components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..tables import cut
from .sumstats import first_of


def keep_annotated(spots: DataFrame, least: int = 30, keys: tuple = ("sample",)) -> DataFrame:
    """Spots with an annotation that at least ``least`` spots of their sample have."""
    n = F.count("*").over(W.partitionBy(*keys, "annotation"))
    return spots.where(F.col("annotation").isNotNull()).withColumn("_n", n).where(F.col("_n") >= least).drop("_n")


def keep_expressed(expression: DataFrame, min_cells: int = 1) -> DataFrame:
    """Without genes that fewer than ``min_cells`` spots of their sample express."""
    many = expression.groupBy("sample", "gene").agg(F.count_if(F.col("value") > 0).alias("k")).where(F.col("k") >= min_cells)
    return expression.join(many.drop("k"), ["sample", "gene"], "left_semi")


def without_mitochondrial(genes: DataFrame, gene: str = "gene") -> DataFrame:
    return genes.where(~(F.col(gene).startswith("MT-") | F.col(gene).startswith("mt-")))


def to_human_genes(expression: DataFrame, homologs: DataFrame, least: int = 100) -> DataFrame:
    """Genes renamed by ``homologs`` (species_gene, human_gene, seq); of the genes that the sample has, those of one
    human gene leave the first by seq.  Fewer than ``least`` common genes are an error."""
    there = expression.select("gene").distinct()
    pairs = homologs.join(there, F.col("species_gene") == F.col("gene"), "left_semi")
    pairs = first_of(pairs, ["species_gene"], ["seq", "human_gene"])
    common = first_of(pairs, ["human_gene"], ["seq", "species_gene"]).select(F.col("species_gene").alias("gene"), "human_gene")
    if least and common.limit(least).count() < least:
        raise ValueError(f"fewer than {least} genes have a homolog")
    return expression.join(common, "gene").withColumn("gene", F.col("human_gene")).drop("human_gene")


def normalize_log1p(expression: DataFrame, total: float = 1e4, spot: tuple = ("sample", "spot")) -> DataFrame:
    """Counts scaled to ``total`` per spot, then log(1 + x)."""
    return expression.withColumn("value", F.log1p(F.col("value") * total / F.sum("value").over(W.partitionBy(*spot))))


def gene_moments(expression: DataFrame, n_spots) -> DataFrame:
    """(gene, mean, sd): moments over all spots, zeros counted though they are not rows."""
    n = F.lit(float(n_spots))
    mean = F.sum("value") / n
    variance = (F.sum(F.col("value") * F.col("value")) - n * mean * mean) / (n - 1)
    return expression.groupBy("gene").agg(mean.alias("mean"), F.sqrt(F.greatest(variance, F.lit(0.0))).alias("sd"))


def _dense(expression: DataFrame, genes: DataFrame, spots: DataFrame) -> DataFrame:
    """A row for each spot and each of ``genes`` (gene, and columns that stay), zeros among them: choose genes first."""
    listed = genes.agg(F.collect_list(F.struct(*genes.columns)).alias("g"))  # one row: the chosen genes
    rows = spots.select("sample", "spot").crossJoin(F.broadcast(listed)).select("sample", "spot", F.inline("g"))
    rows = rows.join(expression.select("sample", "spot", "gene", "value"), ["sample", "spot", "gene"], "left")
    return rows.withColumn("value", F.coalesce("value", F.lit(0.0)))


def scale(expression: DataFrame, moments: DataFrame, spots: DataFrame, top: float = 10.0) -> DataFrame:
    """Zero mean and unit variance per gene, clipped at ``top``; every spot gets a row for each of the given genes
    (choose genes first).  A gene that does not vary is zero."""
    genes = moments.select("gene", "mean", F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0).alias("sd"))
    rows = _dense(expression, genes, spots)
    return rows.select("sample", "spot", "gene", F.least((F.col("value") - F.col("mean")) / F.col("sd"), F.lit(top)).alias("value"))


def _residual(value, mean, theta: float, clip: float | None):
    r = F.when(mean > 0, (value - mean) / F.sqrt(mean + mean * mean / theta)).otherwise(0.0)
    return r if clip is None else F.greatest(F.least(r, F.lit(clip)), F.lit(-clip))


def dense_residuals(expression: DataFrame, genes: DataFrame, spots: DataFrame, theta: float = 100.0, clip: float | None = 10.0) -> DataFrame:
    """Pearson residuals of counts of the chosen ``genes`` in all ``spots``, those of cells without a count too, under
    totals over all genes of ``expression``."""
    by_spot = expression.groupBy("sample", "spot").agg(F.sum("value").alias("_s"))
    total = expression.groupBy("sample").agg(F.sum("value").alias("_t"))
    by_gene = expression.join(F.broadcast(genes.select("gene")), "gene", "left_semi").groupBy("sample", "gene").agg(F.sum("value").alias("_g"))
    rows = _dense(expression, genes.select("gene"), spots).join(by_spot, ["sample", "spot"], "left").join(by_gene, ["sample", "gene"], "left").join(total, "sample")
    mean = F.coalesce(F.col("_g") * F.col("_s") / F.col("_t"), F.lit(0.0))
    return rows.select("sample", "spot", "gene", _residual(F.col("value"), mean, theta, clip).alias("value"))


def pearson_residuals(expression: DataFrame, theta: float = 100.0, clip: float | None = 10.0) -> DataFrame:
    """Residuals of a negative binomial with common dispersion, for the rows there are (a dense layer has all)."""
    by_gene, by_spot = W.partitionBy("sample", "gene"), W.partitionBy("sample", "spot")
    rows = expression.withColumn("_g", F.sum("value").over(by_gene)).withColumn("_s", F.sum("value").over(by_spot))
    total = expression.groupBy("sample").agg(F.sum("value").alias("_t"))
    rows = rows.join(total, "sample").withColumn("_m", F.col("_g") * F.col("_s") / F.col("_t"))
    return rows.withColumn("value", _residual(F.col("value"), F.col("_m"), theta, clip)).drop("_g", "_s", "_t", "_m")


def variable_genes(expression: DataFrame, n_spots, n_top: int = 3000, bins: int = 20) -> DataFrame:
    """(gene, dispersion) of the ``n_top`` genes with most dispersion for their mean: the logarithm of variance over
    mean, standardised within ``bins`` of the logarithm of the mean."""
    m = gene_moments(expression, n_spots).where("mean > 0")
    m = m.withColumn("d", F.when(F.col("sd") > 0, F.ln(F.col("sd") * F.col("sd") / F.col("mean")))).withColumn("lm", F.log1p("mean"))
    span = m.agg(F.min("lm").alias("lo"), F.max("lm").alias("hi"))
    m = m.crossJoin(F.broadcast(span)).withColumn("bin", F.least(F.floor(F.try_divide((F.col("lm") - F.col("lo")) * bins, F.col("hi") - F.col("lo"))), F.lit(bins - 1)))
    by = m.groupBy("bin").agg(F.avg("d").alias("bm"), F.stddev("d").alias("bs"))
    z = F.when(F.coalesce("bs", F.lit(0.0)) > 0, (F.col("d") - F.col("bm")) / F.col("bs")).otherwise(1.0)
    return m.join(by, "bin").select("gene", z.alias("dispersion")).where("dispersion is not null").orderBy(F.desc("dispersion"), "gene").limit(n_top)


def local_fits(at: np.ndarray, x: np.ndarray, n: np.ndarray, y: np.ndarray, span: float = 0.3) -> np.ndarray:
    """Local quadratic fits at each of ``at`` of points given once for each distinct ``x`` (ascending), as their number
    ``n`` and their mean ``y``: those of the ``span`` share of nearest points, weighted by the tricube of their
    distance over the farthest one's.  Of points with one x all or none have a weight, so that this is the fit of the
    points one by one; where more than that share are at the very place, all of them are taken."""
    ends = np.cumsum(n)
    total = int(ends[-1])
    q = min(total, max(3, int(np.floor(span * total + 1e-5))))
    place = lambda k: np.searchsorted(ends, k, "right")  # noqa: E731  of the k-th point, counted from 0
    lo, hi = np.zeros(len(at), np.int64), np.full(len(at), total - q)
    while (lo < hi).any():
        mid = (lo + hi) // 2
        move = x[place(np.minimum(mid + q, total - 1))] - at < at - x[place(mid)]
        lo, hi = np.where(move & (lo < hi), mid + 1, lo), np.where(move, hi, np.minimum(hi, mid))
    first, last = place(lo), place(lo + q - 1)
    fit = np.empty(len(at))
    for i, (a, b) in enumerate(zip(first.tolist(), (last + 1).tolist(), strict=True)):
        d = x[a:b] - at[i]
        far = np.abs(d).max()
        w = np.sqrt(n[a:b] * np.maximum(0, 1 - (np.abs(d) / far) ** 3) ** 3) if far > 0 else np.sqrt(n[a:b])
        u = d / far if far > 0 else d
        fit[i] = np.linalg.lstsq(np.stack([w, w * u, w * u * u], 1), w * y[a:b], rcond=None)[0][0]
    return fit


def loess(x: np.ndarray, y: np.ndarray, span: float = 0.3) -> np.ndarray:
    """Local quadratic fits of y at each x: its ``span`` share of nearest points, weighted by the tricube of their
    distance over the farthest one's."""
    xs, back, n = np.unique(x, return_inverse=True, return_counts=True)
    return local_fits(xs, xs, n, np.bincount(back, y) / n, span)[back]


def variable_genes_counts(counts: DataFrame, n_spots: int, n_top: int = 3000, span: float = 0.3) -> DataFrame:
    """(gene, dispersion) of the ``n_top`` genes whose raw counts vary most: the variance of counts over the deviation
    that a local fit of log10 variance on log10 mean expects, each count bounded by the mean and sqrt(n) deviations.
    The fit takes a row a distinct mean (of counts: a distinct total), and its places are dealt out to tasks; genes
    that do not vary have 0."""
    n = float(n_spots)
    spark = counts.sparkSession
    # cut, so that means are the same numbers wherever they are joined
    moments = cut(gene_moments(counts, n_spots))
    by_mean = moments.where("sd > 0 and mean > 0").groupBy("mean").agg(F.count("*").alias("n"), F.avg(2 * F.log10("sd")).alias("y"))
    points = by_mean.toPandas().sort_values("mean")
    x, at = np.unique(np.log10(points["mean"].to_numpy(float)), return_inverse=True)
    many = np.bincount(at, points["n"], len(x))
    shared = spark.sparkContext.broadcast((x, many, np.bincount(at, points["n"] * points["y"], len(x)) / many))

    def fit(batches):
        for pdf in batches:
            got = local_fits(np.log10(pdf["mean"].to_numpy(float)), *shared.value, span)
            yield pd.DataFrame({"mean": pdf["mean"], "expected": np.sqrt(10**got)})

    places = by_mean.select("mean").repartition(1 + len(points) // 512, "mean")
    fitted = moments.join(places.mapInPandas(fit, "mean double, expected double"), "mean", "left").select("gene", "mean", F.coalesce("expected", F.lit(0.0)).alias("expected"))
    top = F.least(F.col("value").cast("double"), F.col("mean") + F.col("expected") * n**0.5)
    sums = counts.join(fitted, "gene").groupBy("gene").agg(F.first("mean").alias("m"), F.first("expected").alias("e"), F.sum(top).alias("a"), F.sum(top * top).alias("b"))
    score = F.when(F.col("e") > 0, (n * F.col("m") * F.col("m") + F.col("b") - 2 * F.col("m") * F.col("a")) / ((n - 1) * F.col("e") * F.col("e"))).otherwise(0.0)
    return sums.select("gene", score.alias("dispersion")).orderBy(F.desc("dispersion"), "gene").limit(n_top)


def pca(vectors: DataFrame, k: int, column: str = "vec") -> DataFrame:
    """``vectors`` with ``latent``: the first ``k`` principal components of an array column, centred.  Signs are free."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.withColumn("_v", array_to_vector(F.col(column).cast("array<double>")))
    rows = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(rows).transform(rows)
    rows = PCA(k=k, inputCol="_c", outputCol="_p").fit(rows).transform(rows)
    return rows.withColumn("latent", vector_to_array("_p")).drop("_v", "_c", "_p")
