"""Tables that explain a result: genes, variants, positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.stats import two_sided_p
from .sumstats import first_of


def gene_correlation(gss: DataFrame, results: DataFrame) -> DataFrame:
    """(gene, pcc): Pearson correlation of a gene's scores with -log10 p over all spots of ``results`` (spot, p); a
    spot without a row scores zero.  Sums over rows and over all spots are enough; genes that do not vary go."""
    y = results.select("spot", (-F.log10("p")).alias("y"))
    whole = y.agg(F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"))
    part = gss.join(y, "spot").groupBy("gene").agg(F.sum("score").alias("sx"), F.sum(F.col("score") * F.col("score")).alias("sxx"), F.sum(F.col("score") * F.col("y")).alias("sxy"))
    t = part.crossJoin(F.broadcast(whole))
    vx, vy = F.col("n") * F.col("sxx") - F.col("sx") ** 2, F.col("n") * F.col("syy") - F.col("sy") ** 2
    return t.where((vx > 1e-12 * F.col("n") * F.col("sxx")) & (vy > 0)).select("gene", ((F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(vx * vy)).alias("pcc"))


def median_by_annotation(gss: DataFrame, spots: DataFrame) -> DataFrame:
    """(gene, annotation, median_gss): medians over all spots of an annotation, absent ones as zero.

    With z zeros among n, the median is that of the sorted scores behind them: positions are shifted, no zero is made.
    """
    n = spots.where("annotation is not null").groupBy("annotation").agg(F.count("*").alias("n"))
    rows = gss.where("score > 0").join(spots.select("spot", "annotation").where("annotation is not null"), "spot")
    lists = rows.groupBy("gene", "annotation").agg(F.array_sort(F.collect_list("score")).alias("s")).join(n, "annotation")
    at = lambda i: F.when(i < F.col("n") - F.size("s"), F.lit(0.0)).otherwise(F.get("s", (i - (F.col("n") - F.size("s"))).cast("int")))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    return lists.select("gene", "annotation", ((at(low) + at(high)) / 2).alias("median_gss"))


def best_annotation(medians: DataFrame) -> DataFrame:
    """A gene's annotation with the largest median, equal ones by name."""
    return first_of(medians, ["gene"], [F.desc("median_gss"), "annotation"])


def gene_table(gss: DataFrame, results: DataFrame, spots: DataFrame) -> DataFrame:
    """(gene, annotation, median_gss, pcc), by pcc descending."""
    return gene_correlation(gss, results).join(best_annotation(median_by_annotation(gss, spots)), "gene").select("gene", "annotation", "median_gss", "pcc").orderBy(F.desc("pcc"), "gene")


def winsorize(rows: DataFrame, column: str, quantile: float = 0.9999) -> DataFrame:
    top = rows.agg(F.percentile(column, quantile).alias("_top"))
    return rows.crossJoin(F.broadcast(top)).withColumn(column, F.least(column, "_top")).drop("_top")


def pick_snps(rows: DataFrame, p: str = "p", small: float = 1e-5, most: int = 100_000) -> DataFrame:
    """Variants for a plot: all with p below ``small`` if those are more than ``most``, else the ``most`` smallest."""
    many = rows.agg((F.count_if(F.col(p) < small) > most).alias("_many"))
    top = rows.orderBy(p, "snp").limit(most)
    below = rows.where(F.col(p) < small)
    flag = F.broadcast(many)
    return below.crossJoin(flag).where("_many").drop("_many").unionByName(top.crossJoin(flag).where("not _many").drop("_many"))


def with_p(sumstats: DataFrame) -> DataFrame:
    """Two-sided p from Z, not below 1e-300."""
    return sumstats.withColumn("p", two_sided_p(F.col("z")))


def cumulative_position(rows: DataFrame) -> DataFrame:
    """``rows`` (chr, bp, ...) with ``x``: bp behind the last positions of all chromosomes before."""
    last = rows.groupBy("chr").agg(F.max("bp").alias("_last"))
    before = last.withColumn("_off", F.coalesce(F.sum("_last").over(W.orderBy("chr").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("chr", "_off")  # a row a chromosome
    return rows.join(F.broadcast(before), "chr").withColumn("x", F.col("bp") + F.col("_off")).drop("_off")


def manhattan_table(sumstats: DataFrame, snp_gene: DataFrame, genes: DataFrame) -> DataFrame:
    """Variants with a gene that has diagnostics, for a Manhattan plot, by p; with a text for each point."""
    rows = with_p(sumstats).join(snp_gene.select("snp", "gene", "chr", "bp"), "snp").join(genes, "gene")
    hover = F.concat_ws("<br>", F.concat(F.lit("Gene: "), "gene"), F.concat(F.lit("Annotation: "), "annotation"), F.concat(F.lit("Median GSS: "), F.round("median_gss", 4).cast("string")), F.concat(F.lit("PCC: "), F.round("pcc", 4).cast("string")))
    return cumulative_position(rows).withColumn("hover", hover).orderBy("p", "snp")


def unmatched_genes(genes: DataFrame, table: DataFrame) -> DataFrame:
    """Genes without a variant to highlight."""
    return genes.select("gene").join(table.select("gene"), "gene", "left_anti").distinct()
