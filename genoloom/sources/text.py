"""Readers of the text formats of genetics and tissue data."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import finite
from ..operators.sumstats import first_of

# Words that stand for a missing value.
MISSING = (".", "NA", "", "N/A", "n/a", "NaN", "nan", "-NaN", "-nan", "NULL", "null", "None", "<NA>", "#N/A", "#NA", "-1.#IND", "1.#IND", "-1.#QNAN", "1.#QNAN", "#N/A N/A")


def number(c: Column, kind: str = "double") -> Column:
    """A number, null where the text is none: ANSI mode would stop."""
    return finite(c.try_cast("double")).cast(kind) if kind == "double" else c.try_cast(kind)


def read_columns(spark: SparkSession, path: str, sep: str = r"\s+", header: bool = True, comment: str | None = None, names: list[str] | None = None) -> DataFrame:
    """A delimited text, plain, gzipped or bzipped by its suffix, as string columns and ``_seq``, the order of lines.

    The header is one line on the driver.  A whole gzip is one task, as Spark cannot split it; lines keep their order
    by file and offset, so ``_seq`` grows with them without a shuffle.
    """
    lines = spark.read.text(path)
    if comment:
        lines = lines.where(~F.col("value").startswith(comment))
    cut = F.split(F.trim("value") if sep == r"\s+" else F.col("value"), sep, -1)
    if header:
        first = lines.first()
        if first is None:
            raise ValueError(f"{path} is empty")
        head = first["value"]
        names = re.split(sep, head.strip() if sep == r"\s+" else head)
        lines = lines.where(F.col("value") != head)
    elif names is None:
        raise ValueError("names are needed where there is no header")
    rows = lines.withColumn("_seq", F.monotonically_increasing_id()).where(F.length(F.trim("value")) > 0).withColumn("_c", cut)
    value = lambda i: F.when(~F.get("_c", F.lit(i)).isin(*MISSING), F.get("_c", F.lit(i)))
    return rows.select(*[value(i).alias(n) for i, n in enumerate(names)], "_seq")


def read_gwas(spark: SparkSession, path: str) -> DataFrame:
    """A raw GWAS table under the names of its file."""
    return read_columns(spark, path)


def read_dbsnp(spark: SparkSession, path: str) -> DataFrame:
    return read_columns(spark, path, "\t", names=["chr", "pos", "ref", "alt", "dbsnp"], header=False).where("chr <> 'chr' or pos <> 'pos'").withColumnRenamed("_seq", "seq")


def read_sumstats(spark: SparkSession, path: str, trait: str | None = None, alleles: bool = False, dropna: bool = False) -> DataFrame:
    """snp, z, n (a1, a2 with ``alleles``): of a SNP that comes twice the first line."""
    raw = read_columns(spark, path)
    if gone := {"SNP", "Z", "N", *(("A1", "A2") if alleles else ())} - set(raw.columns):
        raise ValueError(f"{path} has no {', '.join(sorted(gone))}")
    rows = raw.select(F.col("SNP").alias("snp"), *([F.col("A1").alias("a1"), F.col("A2").alias("a2")] if alleles else []), number(F.col("Z")).alias("z"), number(F.col("N")).alias("n"), "_seq")
    if dropna:
        rows = rows.na.drop()
    rows = first_of(rows, ["snp"], ["_seq"]).drop("_seq")
    return rows if trait is None else rows.withColumn("trait", F.lit(trait))


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """snp, l2 of weight files: but for places and frequencies the first column is the SNP, the second the weight."""
    raw = read_columns(spark, path)
    left = [c for c in raw.columns if c not in ("MAF", "CM", "Gene", "TSS", "CHR", "BP", "_seq")]
    order = [number(F.col(c)) for c in ("CHR", "BP") if c in raw.columns]
    rows = raw.select(F.col(left[0]).alias("snp"), number(F.col(left[1])).alias("l2"), F.struct(*order, "_seq").alias("place"))
    return rows


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """chromosome, start (0-based), end, strand, feature, gene_name, seq."""
    raw = read_columns(spark, path, "\t", False, "#", ["chromosome", "source", "feature", "start", "end", "score", "strand", "frame", "attribute"])
    name = F.regexp_extract("attribute", 'gene_name "([^"]+)"', 1)
    return raw.select("chromosome", (number(F.col("start"), "long") - 1).alias("start"), number(F.col("end"), "long").alias("end"), "strand", "feature", F.when(name != "", name).alias("gene_name"), F.col("_seq").alias("seq"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, gene, seq of an enhancer list."""
    raw = read_columns(spark, path, "\t", False, None, ["chrom", "start", "end", "gene"])
    return raw.select("chrom", number(F.col("start"), "long").alias("start"), number(F.col("end"), "long").alias("end"), "gene", F.col("_seq").alias("seq"))


def read_bim(spark: SparkSession, path: str) -> DataFrame:
    """chr, snp, cm, bp, a1, a2, idx: the place within its chromosome's file."""
    from pyspark.sql.window import Window as W

    raw = read_columns(spark, path, r"\s+", False, None, ["CHR", "SNP", "CM", "BP", "A1", "A2"])
    rows = raw.select(number(F.col("CHR"), "int").alias("chr"), F.col("SNP").alias("snp"), F.coalesce(number(F.col("CM")), F.lit(0.0)).alias("cm"), number(F.col("BP"), "long").alias("bp"), F.col("A1").alias("a1"), F.col("A2").alias("a2"), "_seq")
    return rows.withColumn("idx", (F.row_number().over(W.partitionBy("chr").orderBy("_seq")) - 1).cast("long")).drop("_seq")


def read_fam(spark: SparkSession, path: str) -> DataFrame:
    raw = read_columns(spark, path, r"\s+", False, None, ["fid", "iid"])
    return raw.select("iid", F.col("_seq").alias("seq"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """A list of SNPs to keep, one a line."""
    return spark.read.text(path).select(F.trim("value").alias("snp")).where("snp <> ''").distinct()


def read_annotation(spark: SparkSession, path: str) -> DataFrame:
    """snp, name, value of an annotation table, wide in its file."""
    raw = read_columns(spark, path, "\t")
    names = [c for c in raw.columns if c not in ("SNP", "CHR", "BP", "CM", "_seq")]
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.coalesce(number(F.col(c)), F.lit(0.0)).alias("value")) for c in names])
    return raw.select(F.col("SNP").alias("snp"), F.inline(pairs))


def read_homologs(spark: SparkSession, path: str) -> DataFrame:
    """species_gene, human_gene, seq: exactly two columns."""
    raw = read_columns(spark, path, "\t")
    names = [c for c in raw.columns if c != "_seq"]
    if len(names) != 2:
        raise ValueError("a homolog map has two columns")
    return raw.select(F.col(names[0]).alias("species_gene"), F.col(names[1]).alias("human_gene"), F.col("_seq").alias("seq"))


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """A regression result with logp."""
    rows = spark.read.csv(path, header=True, schema="spot string, beta double, se double, z double, p double")
    return rows.withColumn("logp", -F.log10("p"))


def by_chromosome(spark: SparkSession, pattern: str, read, chromosomes=range(1, 23)) -> DataFrame:
    """Union of ``read`` over the files of ``pattern`` ('{chr}' is the number) that are there, with ``chr``."""
    found = None
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    for c in chromosomes:
        where = fs_path(pattern.format(chr=c))
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where):
            rows = read(spark, pattern.format(chr=c)).withColumn("chr", F.lit(c))
            found = rows if found is None else found.unionByName(rows)
    if found is None:
        raise ValueError(f"no file fits {pattern}")
    return found


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A table by its suffix: parquet, feather (through the Arrow reader), else delimited text."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".feather"):
        from .arrow import read_feather

        return read_feather(spark, path)
    return read_columns(spark, path)
