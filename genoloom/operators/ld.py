"""LD scores: allele statistics, the chunk-aligned band, and sums of unbiased squared correlations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

MISSING = 9


def allele_stats(geno: DataFrame) -> DataFrame:
    """``geno`` (chr, idx, g array<tinyint>, 9 is missing) with freq, maf and het_miss, the count of heterozygous or
    missing calls."""
    called = F.filter("g", lambda x: x != MISSING)
    freq = F.aggregate(called, F.lit(0), lambda s, x: s + x) / (2 * F.size(called))
    out = geno.withColumn("n", F.size("g")).withColumn("freq", F.when(F.size(called) > 0, freq))
    out = out.withColumn("maf", F.least("freq", 1 - F.col("freq")))
    return out.withColumn("het_miss", F.size(F.filter("g", lambda x: (x == 1) | (x == MISSING))))


def valid_snps(stats: DataFrame) -> DataFrame:
    """Without variants that are heterozygous or missing in everyone; indices are counted anew."""
    w = W.partitionBy("chr").orderBy("idx")
    return stats.where("het_miss < n").withColumn("idx", (F.row_number().over(w) - 1).cast("long"))


def common(stats: DataFrame, least: float = 0.05) -> DataFrame:
    return stats.where(F.col("maf") > least)


def subset(geno: DataFrame, snps: DataFrame | None = None, individuals: list[int] | None = None, least_maf: float | None = None) -> DataFrame:
    """Some variants (chr, idx), some individuals (places within the calls), and those above a frequency, of all that
    are asked for; frequencies are of what is left."""
    if snps is not None:
        geno = geno.join(snps.select("chr", "idx"), ["chr", "idx"], "left_semi")
    if individuals is not None:
        if not individuals:
            raise ValueError("no individuals are left")
        geno = geno.withColumn("g", F.transform(F.array(*[F.lit(i) for i in individuals]), lambda i: F.get("g", i)))
    out = allele_stats(geno)
    return out if least_maf is None else out.where(F.col("maf") > least_maf)


def coordinates(snps: DataFrame, unit: str = "CM", window: float = 1.0) -> tuple[DataFrame, float]:
    """``snps`` with ``coord`` and the window in its unit: index, base pairs (KB times 1000) or centimorgans; where a
    chromosome's are all 0, base pairs with 1,000,000."""
    if unit == "SNP":
        return snps.withColumn("coord", F.col("idx").cast("double")), window
    if unit == "KB":
        return snps.withColumn("coord", F.col("bp").cast("double")), window * 1000
    if unit != "CM":
        raise ValueError(f"unknown unit {unit}")
    none = F.max(F.abs(F.col("cm"))).over(W.partitionBy("chr")) == 0
    return snps.withColumn("coord", F.when(none, F.col("bp") * (window / 1_000_000)).otherwise(F.col("cm")).cast("double")), window


def left_edges(snps: DataFrame, window: float) -> DataFrame:
    """``snps`` (chr, coord) with ``left``: of its chromosome, the variants strictly before its window's left edge."""
    # those up to the edge less those on it
    over = "count(*) over (partition by chr order by coord range between {} preceding and {}D preceding)"
    reach = repr(float(window))
    return snps.withColumn("left", F.expr(over.format("unbounded", reach)) - F.expr(over.format(reach + "D", reach)))


def band(snps: DataFrame, window: float, chunk: int = 100, exact: bool = False) -> DataFrame:
    """(chr, a, b): pairs of chunks of ``chunk`` variants, b not after a, whose variants are paired.

    The band is chunk-aligned: it holds every pair within the window (inclusive) and rounds outwards.  Up to the first
    variant whose window leaves the start behind, all are paired; from there a chunk takes as many variants to its left
    as its first one's window holds, rounded up to whole chunks.  ``exact`` (with a filter by the caller) keeps only
    the chunks that the window of one of its variants reaches.
    """
    rows = left_edges(snps, window).select("chr", "idx", "left")
    size = rows.groupBy("chr").agg(F.count("*").alias("m"), F.min(F.when(F.col("left") > 0, F.col("idx"))).alias("first"))
    b0 = F.ceil(F.col("first") / chunk).cast("long")
    start = rows.where(F.col("idx") % chunk == 0).join(size, "chr").withColumn("a", (F.col("idx") / chunk).cast("long")).withColumn("b0", b0)
    behind = F.ceil((F.col("idx") - F.col("left")) / chunk).cast("long")
    if exact:
        low = rows.groupBy("chr", F.floor(F.col("idx") / chunk).alias("a")).agg(F.floor(F.min("left") / chunk).alias("low"))
        start = start.join(low, ["chr", "a"])
        lowest = F.col("low")
    else:
        lowest = F.when(F.col("b0").isNull() | (F.col("b0") * chunk > F.col("m")) | (F.col("a") < F.col("b0")), 0).otherwise(F.greatest(F.col("a") - behind, F.lit(0)))
    return start.select("chr", "a", F.explode(F.sequence(lowest.cast("long"), F.col("a"))).alias("b"))


def standardized(blob: list, n: int) -> np.ndarray:
    """Calls by variant, missing ones at the mean, over the population deviation (1 where there is none)."""
    g = np.array([np.asarray(x, np.float64) for x in blob])
    gone = g == MISSING
    mean = np.where(gone, 0, g).sum(1) / np.maximum(1, (~gone).sum(1))
    g = np.where(gone, mean[:, None], g) - mean[:, None]
    sd = g.std(1)
    return g / np.where(sd > 0, sd, 1)[:, None]


def pair_scores(geno: DataFrame, pairs: DataFrame, targets: DataFrame, chunk: int = 100) -> DataFrame:
    """(chr, idx, target, w): sums over paired variants j of unbiased squared correlation r2 - (1 - r2) / (n - 2), by
    j's target.  ``geno``: chr, idx, g; ``pairs``: chunks; ``targets``: chr, idx, target (any number of rows a variant,
    with ``value`` as a weight).

    A chunk is one row that holds its variants' calls; a pair of chunks is one matrix product.  Both variants of a
    pair get it, a variant with itself once.  Sums by target leave the kernel, not pairs of variants.
    """
    packed = geno.withColumn("c", F.floor(F.col("idx") / chunk)).groupBy("chr", "c").agg(F.array_sort(F.collect_list(F.struct("idx", "g"))).alias("v"))
    if "value" not in targets.columns:
        targets = targets.withColumn("value", F.lit(1.0))
    listed = targets.withColumn("c", F.floor(F.col("idx") / chunk)).groupBy("chr", "c").agg(F.collect_list(F.struct("idx", "target", "value")).alias("t"))
    packed = packed.join(listed, ["chr", "c"], "left")
    side = lambda s: packed.select("chr", F.col("c").alias(s), F.col("v").alias(f"v{s}"), F.col("t").alias(f"t{s}"))
    rows = pairs.join(side("a"), ["chr", "a"]).join(side("b"), ["chr", "b"]).select("chr", "a", "b", "va", "ta", "vb", "tb")
    target_type = dict(targets.dtypes)["target"]

    def sums(r2, idx, other, listed):
        place = {v["idx"]: k for k, v in enumerate(other)}
        by: dict = {}
        for t in listed if listed is not None else []:
            by[t["target"]] = by.get(t["target"], 0) + r2[:, place[t["idx"]]] * t["value"]
        return [(int(i), k, float(x)) for k, w in by.items() for i, x in zip(idx, w, strict=True)]

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                n = len(row.va[0]["g"])
                x, y = (standardized([v["g"] for v in side], n) for side in (row.va, row.vb))
                r2 = (x @ y.T / n) ** 2
                r2 = r2 - (1 - r2) / (n - 2)
                out += [(row.chr, *s) for s in sums(r2, [v["idx"] for v in row.va], row.vb, row.tb)]
                if row.a != row.b:
                    out += [(row.chr, *s) for s in sums(r2.T, [v["idx"] for v in row.vb], row.va, row.ta)]
            yield pd.DataFrame(out, columns=["chr", "idx", "target", "w"])

    chr_type = dict(geno.dtypes)["chr"]
    parts = rows.mapInPandas(run, f"chr {chr_type}, idx long, target {target_type}, w double")
    return parts.groupBy("chr", "idx", "target").agg(F.sum("w").alias("w"))


def ld_scores(snps: DataFrame, targets: DataFrame, unit: str = "CM", window: float = 1.0, chunk: int = 100) -> DataFrame:
    """``pair_scores`` within the band of ``snps`` (chr, idx, bp, cm, g)."""
    placed, reach = coordinates(snps, unit, window)
    return pair_scores(snps, band(placed, reach, chunk), targets, chunk)


def snp_gene_weight(snps: DataFrame, snp_gene: DataFrame, keep: DataFrame | None = None, **band_options) -> DataFrame:
    """(chr, idx, gene, w): each variant's LD with the variants of each gene (null: of none).  ``keep`` (chr, idx)
    restricts the rows that come out, not the sums."""
    w = ld_scores(snps, snp_gene.select("chr", "idx", F.col("gene").alias("target")), **band_options).withColumnRenamed("target", "gene")
    return w if keep is None else w.join(keep, ["chr", "idx"], "left_semi")


def baseline(weights: DataFrame) -> DataFrame:
    """(chr, idx, all_gene, base): sums over real genes, and with the variants of none."""
    return weights.groupBy("chr", "idx").agg(F.sum(F.when(F.col("gene").isNotNull(), F.col("w")).otherwise(0.0)).alias("all_gene"), F.sum("w").alias("base"))


def annotation_chunks(weights: DataFrame, gss: DataFrame, spots: DataFrame, clamp: float | None = None, block: int = 2048) -> DataFrame:
    """(chr, idx, chunk, l2 array): each variant's weights by gene times each spot's scores, a row a variant and chunk
    of ``spots`` (spot, chunk, seq) in their order, zeros where a spot has none.

    A sparse product in blocks: a gene's scores in a chunk are one row, its weights in a block of variants another;
    they meet by gene, and a (block, chunk) is one matrix product.  Variants by spots are never rows.
    """
    placed = spots.withColumn("at", F.row_number().over(W.partitionBy("chunk").orderBy("seq")) - 1)
    sizes = spots.groupBy("chunk").agg(F.count("*").cast("int").alias("width"))
    packed = gss.join(placed, "spot").groupBy("gene", "chunk").agg(F.collect_list(F.struct("at", F.col("score").cast("double").alias("s"))).alias("s"))
    packed = packed.join(sizes, "chunk").select("gene", "chunk", "width", F.col("s.at").alias("at"), F.col("s.s").alias("s"))
    listed = weights.where("gene is not null").withColumn("blk", F.floor(F.col("idx") / block))
    listed = listed.groupBy("chr", "blk", "gene").agg(F.collect_list(F.struct("idx", F.col("w").cast("double").alias("w"))).alias("w"))
    rows = listed.select("chr", "blk", "gene", F.col("w.idx").alias("idx"), F.col("w.w").alias("w")).join(packed, "gene")

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("gene")
        idx = np.unique(np.concatenate(pdf["idx"].to_list()))
        left, right = np.zeros((len(idx), len(pdf))), np.zeros((len(pdf), int(pdf["width"].iloc[0])))
        for k, (i, w, at, s) in enumerate(zip(pdf["idx"], pdf["w"], pdf["at"], pdf["s"], strict=True)):
            np.add.at(left[:, k], np.searchsorted(idx, i), w)
            np.add.at(right[k], at, s)
        l2 = left @ right if clamp is None else np.minimum(left @ right, clamp)
        return pd.DataFrame({"chr": pdf["chr"].iloc[0], "idx": idx, "chunk": pdf["chunk"].iloc[0], "l2": list(l2)})

    types = dict(rows.dtypes)
    return rows.groupBy("chr", "blk", "chunk").applyInPandas(product, f"chr {types['chr']}, idx {dict(weights.dtypes)['idx']}, chunk {types['chunk']}, l2 array<double>")


def regression_weights(snps: DataFrame, keep: DataFrame | None, base: DataFrame | None = None, **band_options) -> DataFrame:
    """(chr, idx, l2): with ``keep``, LD among the kept variants alone, their band counted anew; else all_gene."""
    if keep is None:
        return base.select("chr", "idx", F.col("all_gene").alias("l2"))
    w = W.partitionBy("chr").orderBy("old")
    kept = snps.join(keep, ["chr", "idx"], "left_semi").withColumnRenamed("idx", "old").withColumn("idx", (F.row_number().over(w) - 1).cast("long"))
    out = ld_scores(kept, kept.select("chr", "idx", F.lit(0).alias("target")), **band_options)
    return out.join(kept.select("chr", "idx", "old"), ["chr", "idx"]).select("chr", F.col("old").alias("idx"), F.col("w").alias("l2"))


def m_values(snp_gene: DataFrame, gss: DataFrame, maf: DataFrame | None = None) -> DataFrame:
    """(chr, spot, m): sums of scores over variants' genes; with ``maf`` (chr, idx) over those alone."""
    rows = snp_gene if maf is None else snp_gene.join(maf, ["chr", "idx"], "left_semi")
    counts = rows.where("gene is not null").groupBy("chr", "gene").agg(F.count("*").alias("k"))
    return counts.join(gss, "gene").groupBy("chr", "spot").agg(F.sum(F.col("k") * F.col("score")).alias("m"))
