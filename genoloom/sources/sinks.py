"""Writers of results.  Tables between steps are parquet, partitioned; text is for people and other programs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LARGEST_HALF = 65504.0  # fixed value: the largest number of half precision


def write_sumstats(rows: DataFrame, path: str) -> None:
    """Tab-separated, gzipped, every floating-point number with three decimals."""
    shown = [F.format_string("%.3f", F.col(c).cast("double")).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes]
    rows.select(*shown).write.mode("overwrite").csv(path, sep="\t", header=True, compression="gzip")


def write_table(rows: DataFrame, path: str, *by: str) -> None:
    """Parquet, partitioned by the given columns; rows of a partition are brought together first, so that each is few
    files."""
    if by:
        rows = rows.repartition(*by)
    rows.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_scores(rows: DataFrame, path: str) -> None:
    """LD scores (chr, idx, snp, chunk, l2 array) by chunk and chromosome, in single precision, those beyond the largest
    half at it."""
    l2 = F.transform("l2", lambda x: F.greatest(F.least(x, F.lit(LARGEST_HALF)), F.lit(-LARGEST_HALF)).cast("float"))
    write_table(rows.withColumn("l2", l2), path, "chunk", "chr")


def write_weights(rows: DataFrame, path: str) -> None:
    rows.select(F.col("chr").alias("CHR"), F.col("snp").alias("SNP"), F.col("bp").alias("BP"), F.col("cm").alias("CM"), F.col("l2").alias("L2")).write.mode("overwrite").csv(path, sep="\t", header=True, compression="gzip")


def write_results(rows: DataFrame, path: str) -> None:
    """spot, beta, se, z, p; p within 1e-300 and 1."""
    rows.select("spot", "beta", "se", "z", F.greatest(F.least("p", F.lit(1.0)), F.lit(1e-300)).alias("p")).write.mode("overwrite").csv(path, header=True, compression="gzip")


def write_small(rows: DataFrame, path: str, compression: str | None = "gzip") -> None:
    """A table of a few rows as one file."""
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True, **({"compression": compression} if compression else {}))


def done(spark, path: str) -> bool:
    """Whether a table was written whole."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
