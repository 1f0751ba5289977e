"""Gene specificity scores of spots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .expression import without_mitochondrial


def specificity(edges: DataFrame, ranks: DataFrame, zero_ranks: DataFrame, means: DataFrame, exponential: bool = True) -> DataFrame:
    """(sample, gene, spot, score) of scores above zero.

    ``edges`` (sample, src, dst): a spot's neighbours; ``ranks`` (sample, spot, gene, rank) of genes that are not
    zero; ``zero_ranks`` (sample, spot, zero_rank); ``means`` (gene, g_mean, frac).  For a spot and gene: the
    geometric mean over the neighbours of rank / g_mean, 0 unless above 1; times whether the share of neighbours that
    express the gene is above frac; exp of that less 1.

    A gene that no neighbour expresses scores 0, so only pairs with a neighbour's row are ever made; the ranks of the
    other neighbours enter by their zero ranks, as a sum over all neighbours less that over those with a row.
    """
    z = edges.join(zero_ranks.withColumnRenamed("spot", "dst"), ["sample", "dst"]).groupBy("sample", "src").agg(F.sum(F.ln("zero_rank")).alias("all"), F.count("*").alias("k"))
    r = ranks.join(zero_ranks, ["sample", "spot"]).select("sample", F.col("spot").alias("dst"), "gene", (F.ln("rank") - F.ln("zero_rank")).alias("more"))
    own = edges.select("sample", "src", "dst").join(r, ["sample", "dst"]).groupBy("sample", "src", "gene").agg(F.sum("more").alias("more"), F.count("*").alias("has"))
    rows = own.join(z, ["sample", "src"]).join(means, "gene")
    g = F.exp((F.col("all") + F.col("more")) / F.col("k")) / F.col("g_mean")
    g = F.when(g > 1, g).otherwise(0.0)
    f = F.when(F.col("has") / F.col("k") / F.col("frac") > 1, 1.0).otherwise(0.0)
    score = F.exp(g * f) - 1 if exponential else g * f
    out = rows.select("sample", "gene", F.col("src").alias("spot"), score.alias("score")).where("score > 0")
    return without_mitochondrial(out)


def mean_score(gss: DataFrame, n_spots) -> DataFrame:
    """(gene, avg_mkscore): mean over all spots, those without a row as zero."""
    return gss.groupBy("gene").agg((F.sum("score") / F.lit(n_spots)).alias("avg_mkscore"))
