"""Variants to genes: interval joins by bins, nearest site, best enhancer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sumstats import first_of


def gene_windows(gtf: DataFrame, size: int = 50_000) -> DataFrame:
    """(gene, chrom, win_start, win_end, tss, ted, seq) of a table's genes (chromosome, start, end, strand, feature,
    gene_name, seq): the body and ``size`` on both sides, cut off at 0; of a name that comes twice the first."""
    g = first_of(gtf.where("feature = 'gene' and gene_name is not null"), ["gene_name"], ["seq"])
    minus = F.col("strand") == "-"
    chrom = F.when(F.col("chromosome").cast("string").startswith("chr"), F.col("chromosome").cast("string")).otherwise(F.concat(F.lit("chr"), F.col("chromosome").cast("string")))
    return g.select(F.col("gene_name").alias("gene"), chrom.alias("chrom"), F.greatest(F.lit(0), F.col("start") - size).cast("long").alias("win_start"), (F.col("end") + size).cast("long").alias("win_end"), F.when(minus, F.col("end")).otherwise(F.col("start")).cast("long").alias("tss"), F.when(minus, F.col("start")).otherwise(F.col("end")).cast("long").alias("ted"), "seq")


def interval_join(points: DataFrame, ranges: DataFrame, bin_size: int = 100_000, point: str = "point", start: str = "win_start", end: str = "win_end", on: str = "chrom") -> DataFrame:
    """Points within half-open ranges: an equi-join on (chromosome, bin), then the bounds.

    A range has a row for each bin it touches and a point one, so work follows the ranges' length over ``bin_size``;
    choose it near the median range.  Adaptive execution splits a bin that is crowded.
    """
    r = ranges.where(F.col(end) > F.col(start)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / bin_size), F.floor((F.col(end) - 1) / bin_size))))
    p = points.withColumn("_bin", F.floor(F.col(point) / bin_size))
    return p.join(r, [on, "_bin"]).where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("_bin")


def snp_points(snps: DataFrame) -> DataFrame:
    """A variant at bp is the half-open range [bp - 1, bp)."""
    return snps.withColumn("point", (F.col("bp") - 1).cast("long"))


def nearest_gene(snps: DataFrame, windows: DataFrame, bin_size: int = 100_000) -> DataFrame:
    """(snp, gene): of the genes whose window holds a variant the one with the nearest TSS, equal ones by seq."""
    met = interval_join(snp_points(snps).select("snp", "chrom", "point"), windows, bin_size)
    return first_of(met.withColumn("_d", F.abs(F.col("point") - F.col("tss"))), ["snp"], ["_d", "seq"]).select("snp", "gene")


def best_enhancer(snps: DataFrame, enhancers: DataFrame, rule: str = "max_mkscore", bin_size: int = 10_000) -> DataFrame:
    """(snp, gene): of the enhancers (chrom, start, end, gene, avg_mkscore, tss, seq) that hold a variant the one with
    the largest mean score, or the nearest TSS; equal ones by seq."""
    met = interval_join(snp_points(snps).select("snp", "chrom", "point"), enhancers, bin_size, start="start", end="end")
    order = {"max_mkscore": F.desc("avg_mkscore"), "nearest_TSS": F.asc("_d")}
    if rule not in order:
        raise ValueError(f"unknown rule {rule}")
    return first_of(met.withColumn("_d", F.abs(F.col("point") - F.col("tss"))), ["snp"], [order[rule], "seq"]).select("snp", "gene")


def enhancer_table(bed: DataFrame, means: DataFrame, windows: DataFrame) -> DataFrame:
    """Enhancers of genes with a mean score, with the gene's TSS where it is known."""
    return bed.join(means, "gene").join(windows.select("gene", "tss"), "gene", "left")


def snp_to_gene(snps: DataFrame, windows: DataFrame | None, enhancers: DataFrame | None = None, priority: str = "gene_window_first", rule: str = "max_mkscore", bin_size: int = 100_000) -> DataFrame:
    """(snp's columns, gene): each variant with its gene or null.

    priority: gene_window_first, enhancer_first, or enhancer_only; with one source that one counts.
    """
    g = nearest_gene(snps, windows, bin_size).withColumnRenamed("gene", "_g") if windows is not None and priority != "enhancer_only" else None
    e = best_enhancer(snps, enhancers, rule).withColumnRenamed("gene", "_e") if enhancers is not None else None
    out = snps
    for x in (g, e):
        if x is not None:
            out = out.join(x, "snp", "left")
    names = [c for c in (("_g", "_e") if priority == "gene_window_first" else ("_e", "_g")) if c in out.columns]
    return out.withColumn("gene", F.coalesce(*names) if names else F.lit(None).cast("string")).drop("_g", "_e")


def add_annotation(snps: DataFrame, extra: DataFrame) -> DataFrame:
    """``extra`` (snp, name, value) for every variant, 0 where it says nothing."""
    names = extra.select("name").distinct()
    return snps.select("snp").crossJoin(F.broadcast(names)).join(extra, ["snp", "name"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
