"""Streams: the row filters of summary statistics, and p-values combined by window.

An extension: what needs a whole table (the first of equal SNPs, the quantile of N) is left to the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import acat
from ..operators.sumstats import STRAND_SAFE, SumstatsOptions


def clean_stream(gwas: DataFrame, o: SumstatsOptions | None = None) -> DataFrame:
    """The stateless filters, for a stream under our names: complete rows, INFO, MAF, P, strand-safe alleles."""
    o = o or SumstatsOptions()
    have = set(gwas.columns)
    gwas = gwas.na.drop("any", subset=[c for c in gwas.columns if c != "INFO"])
    if "INFO" in have:
        gwas = gwas.where(F.col("INFO") >= o.info_min)
    if "FRQ" in have:
        gwas = gwas.where((F.least(F.col("FRQ"), 1 - F.col("FRQ")) > o.maf_min) & F.col("FRQ").between(0, 1))
    if "P" in have:
        gwas = gwas.where((F.col("P") > 0) & (F.col("P") <= 1))
    return gwas.withColumns({c: F.upper(c) for c in ("A1", "A2")}).where(F.concat("A1", "A2").isin(*STRAND_SAFE))


def windowed_cauchy(events: DataFrame, time: str, annotation: str, p: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, annotation, p_cauchy, n) of a stream or table: p-values of an annotation combined by window; those
    later than ``late`` are dropped by a stream."""
    rows = events.withWatermark(time, late)
    return rows.groupBy(F.window(time, window).alias("window"), F.col(annotation).alias("annotation")).agg(acat(F.col(p)).alias("p_cauchy"), F.count("*").alias("n"))
