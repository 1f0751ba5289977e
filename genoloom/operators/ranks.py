"""Ranks with implicit zeros, geometric means of ranks, and the mean over slices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.stats import geometric_mean


def average_ranks(expression: DataFrame, n_genes, spot: list[str] | None = None, value: str = "value") -> DataFrame:
    """``expression`` (spot..., gene, value; zeros left out) with the average rank of each value within its spot over
    ``n_genes`` genes (a number or column), counting genes that are not there as zeros.  Values are not negative.
    """
    spot = spot or ["sample", "spot"]
    w = W.partitionBy(*spot)
    zeros = F.lit(n_genes) if isinstance(n_genes, int) else n_genes
    zeros = zeros - F.count("*").over(w)
    rank = F.rank().over(w.orderBy(value)) + (F.count("*").over(W.partitionBy(*spot, value)) - 1) / 2 + zeros
    return expression.where(F.col(value) != 0).withColumn("n_zero", zeros).withColumn("rank", rank).withColumn("zero_rank", (F.col("n_zero") + 1) / 2)


def rank_means(expression: DataFrame, genes: DataFrame, spots: DataFrame) -> DataFrame:
    """(sample, gene, g_mean, n_expressed, n_spots): geometric mean of each gene's ranks over all spots of a sample.

    The logarithm of a zero's rank depends on the spot alone, so the sum over a gene's zeros is that over all spots
    less that over the spots where the gene is not zero: no zero is ever made a row.  ``genes``: (sample, gene).
    """
    per = genes.groupBy("sample").agg(F.count("*").alias("n_genes"))
    ranked = average_ranks(expression.join(per, "sample"), F.col("n_genes"))
    own = ranked.groupBy("sample", "gene").agg(F.sum(F.ln("rank") - F.ln("zero_rank")).alias("more"), F.count("*").alias("n_expressed"))
    zero = spots.select("sample", "spot").join(ranked.groupBy("sample", "spot").agg(F.first("zero_rank").alias("z")), ["sample", "spot"], "left").join(per, "sample")
    zero = zero.groupBy("sample").agg(F.sum(F.ln(F.coalesce("z", (F.col("n_genes") + 1) / 2))).alias("all"), F.count("*").alias("n_spots"))
    out = genes.join(own, ["sample", "gene"], "left").join(zero, "sample")
    return out.select("sample", "gene", F.exp((F.col("all") + F.coalesce("more", F.lit(0.0))) / F.col("n_spots")).alias("g_mean"), F.coalesce("n_expressed", F.lit(0)).alias("n_expressed"), "n_spots")


def slice_mean(partials: DataFrame) -> DataFrame:
    """(gene, g_mean, frac) of ``partials`` (sample, gene, g_mean, n_expressed, n_spots): a geometric mean weighted by
    spots and the pooled share, over genes that every sample has.  At least two samples."""
    n = partials.agg(F.count_distinct("sample").alias("n")).first()["n"]
    if n < 2:
        raise ValueError("a mean over slices needs two samples at least")
    out = partials.groupBy("gene").agg(F.exp(F.sum(F.col("n_spots") * F.ln("g_mean")) / F.sum("n_spots")).alias("g_mean"), (F.sum("n_expressed") / F.sum("n_spots")).alias("frac"), F.count("*").alias("k"))
    return out.where(F.col("k") == n).drop("k").orderBy("gene")


def expressed_share(expression: DataFrame, n_spots) -> DataFrame:
    """(gene, frac): share of spots where a gene is not zero, a little above none."""
    return expression.groupBy("gene").agg((F.count_if(F.col("value") != 0) / F.lit(n_spots) + 1e-12).alias("frac"))
