"""Region-level association: Cauchy combination of spot p-values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import acat


def mark_outliers(rows: DataFrame, keys: list[str], p: str = "p", share: float = 0.01, least: int = 20) -> DataFrame:
    """``rows`` with ``removed``: -log10 p not below median + 3 IQR of the group, where those are more than none and
    fewer than max(share of the group, least).  In a small group of equal values that is all of them.

    One shuffle for the thresholds and counts (the exact percentiles come from one aggregate), and one join of the
    rows with a row a group.
    """
    logp = F.when(F.col(p) == 0, F.lit(float("inf"))).otherwise(-F.log10(F.col(p)))
    q = rows.groupBy(*keys).agg(F.percentile(logp, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.count("*").alias("n"))
    q = q.select(*keys, "n", (F.col("q")[1] + 3 * (F.col("q")[2] - F.col("q")[0])).alias("limit"))
    marked = rows.join(q, keys).withColumn("out", ~((logp < F.col("limit")) & ~F.isnan("limit")))
    over = marked.groupBy(*keys).agg(F.count_if("out").alias("k"))
    drop = (F.col("k") > 0) & (F.col("k") < F.greatest(share * F.col("n"), F.lit(float(least))))
    return marked.join(over, keys).withColumn("removed", drop & F.coalesce("out", F.lit(False))).drop("q", "n", "limit", "out", "k")


def remove_outliers(rows: DataFrame, keys: list[str], **options) -> DataFrame:
    return mark_outliers(rows, keys, **options).where("not removed").drop("removed")


def cauchy_combination(results: DataFrame, spots: DataFrame | None = None, keys: list[str] | None = None, annotation: str = "annotation", p: str = "p") -> DataFrame:
    """(keys..., annotation, p_cauchy, p_median): ``results`` by spot, joined with ``spots`` unless they carry the
    annotation already.  Spots of several samples are pooled by giving their union.  Null annotations are left out.
    The median is that of all p-values, outliers too."""
    keys = keys or []
    rows = results if spots is None else results.join(spots.select(*{"sample", "spot", annotation} & set(spots.columns)), [c for c in ("sample", "spot") if c in results.columns and c in spots.columns])
    rows = rows.where(F.col(annotation).isNotNull()).select(*keys, annotation, F.col(p).cast("double").alias("p"))
    marked = mark_outliers(rows, [*keys, annotation])
    out = marked.groupBy(*keys, annotation).agg(acat(F.col("p"), ~F.col("removed")).alias("p_cauchy"), F.median("p").alias("p_median"))
    return out.orderBy(*keys, "p_cauchy", annotation)
