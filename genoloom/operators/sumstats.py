"""GWAS summary statistics: names, Z scores, ids, quality control."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.stats import finite, norm_isf

# What columns are called, by what we call them; and pairs of alleles that tell the strand.
ALIASES = {
    "SNP": "SNP RS RSID RS_NUMBER RS_NUMBERS",
    "P": "P PVALUE P_VALUE PVAL P_VAL GC_PVALUE p",
    "A1": "A1 ALLELE1 ALLELE_1 EFFECT_ALLELE REFERENCE_ALLELE INC_ALLELE EA",
    "A2": "A2 ALLELE2 ALLELE_2 OTHER_ALLELE NON_EFFECT_ALLELE DEC_ALLELE NEA",
    "N": "N WEIGHT",
    "N_CAS": "NCASE CASES_N N_CASE N_CASES N_CAS",
    "N_CON": "N_CONTROLS N_CON NCONTROL CONTROLS_N N_CONTROL",
    "Z": "ZSCORE Z-SCORE GC_ZSCORE Z",
    "OR": "OR",
    "BETA": "B BETA EFFECTS EFFECT b beta",
    "LOG_ODDS": "LOG_ODDS",
    "SE": "se",
    "INFO": "INFO Info",
    "FRQ": "EAF FRQ MAF FRQ_U F_U frq_A1 frq freq",
}
STRAND_SAFE = ("AC", "AG", "CA", "CT", "GA", "GT", "TC", "TG")
_NAME = {alias: name for name, aliases in ALIASES.items() for alias in aliases.split()}
NUMBERS = ("P", "Z", "BETA", "SE", "OR", "SE_OR", "N", "FRQ", "INFO")
OUTPUT = {"sumstats": ("SNP", "A1", "A2", "Z", "N"), "COJO": ("SNP", "A1", "A2", "FRQ", "BETA", "SE", "P", "N")}


@dataclass(frozen=True)
class SumstatsOptions:
    """format: an output layout; names: our name to the file's, where the aliases do not help; n: a constant N."""

    format: str = "sumstats"
    info_min: float = 0.9
    maf_min: float = 0.01
    n: int | None = None
    keep_chr_pos: bool = False
    names: dict = field(default_factory=dict)


def standard_names(columns: list[str], names: dict | None = None) -> list[str]:
    """Aliases first, case-sensitive; then a user's names, where such a column is there; two alike are an error."""
    out = [_NAME.get(c, c) for c in columns]
    for ours, theirs in (names or {}).items():
        out = [ours if c == theirs else c for c in out]
    if twice := sorted({c for c in out if out.count(c) > 1}):
        raise ValueError(f"columns given twice: {', '.join(twice)}")
    return out


def with_effects(gwas: DataFrame) -> DataFrame:
    """BETA and SE as logarithms of OR and SE_OR, where both are there."""
    if {"OR", "SE_OR"} <= set(gwas.columns):
        log = lambda c: F.when(F.col(c) > 0, F.ln(c))
        gwas = gwas.withColumn("BETA", log("OR")).withColumn("SE", log("SE_OR"))
    return gwas


def with_z(gwas: DataFrame, layout: str) -> DataFrame:
    """Z: as given, else from P and the effect's sign, else BETA / SE.  COJO needs all its columns and takes Z from P."""
    have = set(gwas.columns)
    sign = F.when(F.col("BETA") < 0, -1.0).otherwise(1.0) if "BETA" in have else None
    if layout == "COJO":
        if missing := [c for c in ("A1", "A2", "FRQ", "BETA", "SE", "P", "N") if c not in have]:
            raise ValueError(f"COJO needs {', '.join(missing)}")
        return gwas.withColumn("Z", norm_isf(F.col("P") / 2) * sign)
    if layout != "sumstats":
        raise ValueError(f"unknown format {layout}")
    if not ("P" in have or "Z" in have or {"BETA", "SE"} <= have):
        raise ValueError("P, Z, or BETA and SE are needed")
    if "Z" in have:
        return gwas
    if "P" in have:
        if sign is None:
            raise ValueError("P without BETA gives no sign")
        return gwas.withColumn("Z", norm_isf(F.col("P") / 2) * sign)
    return gwas.withColumn("Z", F.try_divide("BETA", "SE"))


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Of rows with equal keys the first by ``order``."""
    return rows.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def resolve_ids(gwas: DataFrame, dbsnp: DataFrame | None) -> DataFrame:
    """SNP ids of rows that have only Chr and Pos, from ``dbsnp`` (chr, pos, ref, alt, dbsnp, seq): of a place or an id
    that is there twice the first.  The prefix of the map's chromosomes is kept out of the comparison."""
    if "SNP" in gwas.columns:
        return gwas
    if not {"Chr", "Pos"} <= set(gwas.columns):
        raise ValueError("SNP, or Chr and Pos, are needed")
    if dbsnp is None:
        raise ValueError("Chr and Pos need a dbsnp map")
    bare = lambda c: F.regexp_replace(F.col(c).cast("string"), r"^\D+", "")
    place = dbsnp.select(F.concat_ws("_", bare("chr"), F.col("pos").cast("string")).alias("_id"), F.col("dbsnp").alias("SNP"), "seq")
    rows = gwas.withColumn("_id", F.concat_ws("_", bare("Chr"), F.col("Pos").cast("string"))).join(place, "_id")
    rows = first_of(rows, ["SNP"], ["seq", "_id"])
    return first_of(rows, ["_id"], ["seq", "SNP"]).drop("_id", "seq")


def clean(gwas: DataFrame, o: SumstatsOptions, order: list | None = None) -> DataFrame:
    """The row filters, in order: complete rows (but for INFO), INFO, MAF, P, strand-safe alleles, the first of each
    SNP by ``order``, N of at least the 0.9 quantile over 1.5.  Only the last two shuffle."""
    have = set(gwas.columns)
    gwas = gwas.na.drop("any", subset=[c for c in gwas.columns if c != "INFO" and not c.startswith("_")])
    if "INFO" in have:
        gwas = gwas.where(F.col("INFO") >= o.info_min)
    if "FRQ" in have:
        gwas = gwas.where((F.least(F.col("FRQ"), 1 - F.col("FRQ")) > o.maf_min) & F.col("FRQ").between(0, 1))
    if "P" in have:
        gwas = gwas.where((F.col("P") > 0) & (F.col("P") <= 1))
    gwas = gwas.withColumns({c: F.upper(c) for c in ("A1", "A2") if c in have})
    if {"A1", "A2"} <= have:
        gwas = gwas.where(F.concat("A1", "A2").isin(*STRAND_SAFE))
    gwas = first_of(gwas, ["SNP"], order or [F.col(c) for c in sorted(gwas.columns)])
    quantile = gwas.agg((F.percentile("N", 0.9) / 1.5).alias("_least"))
    return gwas.crossJoin(F.broadcast(quantile)).where("N >= _least").drop("_least")  # one row


def format_sumstats(gwas: DataFrame, options: SumstatsOptions | None = None, dbsnp: DataFrame | None = None) -> DataFrame:
    """A raw table to the columns of a layout.  Text that is no number counts as missing.  A column ``_seq``, if there
    is one, gives the file's order for what is there twice."""
    o = options or SumstatsOptions()
    names = {"SNP": None} | o.names
    gwas = gwas.toDF(*standard_names(gwas.columns, {k: v for k, v in names.items() if v}))
    if o.n is not None:
        gwas = gwas.withColumn("N", F.lit(o.n))
    if "N" not in gwas.columns:
        raise ValueError("N is needed, as a column or a constant")
    gwas = gwas.withColumns({c: finite(F.expr(f"try_cast(`{c}` as double)")) for c in NUMBERS if c in gwas.columns})
    gwas = resolve_ids(with_z(with_effects(gwas), o.format), dbsnp)
    gwas = clean(gwas, o, ["_seq"] if "_seq" in gwas.columns else None)
    extra = [c for c in ("Chr", "Pos") if o.keep_chr_pos and c in gwas.columns]
    return gwas.select(*OUTPUT[o.format], *extra)


def summary(sumstats: DataFrame) -> DataFrame:
    """Mean and largest chi-square, lambda GC, how many are genome-wide significant, and N."""
    chi = F.col("Z") ** 2
    return sumstats.agg(F.count("*").alias("n_snps"), F.avg(chi).alias("mean_chisq"), (F.median(chi) / 0.4549).alias("lambda_gc"), F.max(chi).alias("max_chisq"), F.count_if(chi > 29).alias("n_significant"), F.avg("N").alias("mean_n"), F.max("N").alias("max_n"))


def chisq_filter(sumstats: DataFrame, chisq_max: float | None = None) -> DataFrame:
    """Z squared below ``chisq_max``, by default max(0.001 of the largest N, 80); missing Z go."""
    limit = F.lit(chisq_max) if chisq_max is not None else F.greatest(0.001 * F.max("N"), F.lit(80.0))
    top = sumstats.agg(F.max("N").alias("N")).select(limit.alias("_top")) if chisq_max is None else None
    rows = sumstats.where(finite(F.col("Z")).isNotNull())
    if top is None:
        return rows.where(F.col("Z") ** 2 < chisq_max)
    return rows.crossJoin(F.broadcast(sumstats.agg(limit.alias("_top")))).where("Z * Z < _top").drop("_top")


def common_snps(baseline: DataFrame, weights: DataFrame, *traits: DataFrame) -> DataFrame:
    """Rows of ``baseline`` (snp, idx, ...) whose snp is in the weights and in each trait, in order of idx."""
    out = baseline
    for other in (weights, *traits):
        out = out.join(other.select("snp").distinct(), "snp", "left_semi")
    return out.orderBy("idx")
