"""Statistical functions and aggregates."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

_ERFC = np.frompyfunc(math.erfc, 1, 1)


def norm_sf_array(z) -> np.ndarray:
    """Upper tail of the standard normal distribution."""
    return 0.5 * _ERFC(np.asarray(z, np.float64) / math.sqrt(2)).astype(np.float64)


def _isf(p: float) -> float:
    """Inverse of the upper tail; below the quantile function's range by Newton steps on the logarithm."""
    if not 0 < p < 1:
        return math.inf if p == 0 else -math.inf if p == 1 else math.nan
    if p > 1e-15:
        return -NormalDist().inv_cdf(p)
    x = math.sqrt(-2 * math.log(p))
    for _ in range(40):
        tail = 0.5 * math.erfc(x / math.sqrt(2))
        if tail == 0:
            return x
        step = (math.log(tail) - math.log(p)) * tail * math.sqrt(2 * math.pi) * math.exp(x * x / 2)
        x += step
        if abs(step) < 1e-13 * x:
            break
    return x


@pandas_udf(DoubleType())
def norm_sf(z: pd.Series) -> pd.Series:
    return pd.Series(np.where(z.isna(), np.nan, norm_sf_array(z.fillna(0)))).replace({np.nan: None}).astype("float64")


@pandas_udf(DoubleType())
def norm_isf(p: pd.Series) -> pd.Series:
    return p.map(_isf, na_action="ignore")


def two_sided_p(z: Column, floor: float = 1e-300) -> Column:
    return F.greatest(2 * norm_sf(F.abs(z)), F.lit(floor))


def z_from_p(p: Column, beta: Column) -> Column:
    """Size from a two-sided p-value, sign of the effect; an effect that is null or zero counts as positive."""
    return norm_isf(p / 2) * F.when(beta < 0, -1.0).otherwise(1.0)


def finite(x: Column) -> Column:
    """NaN as null: in comparisons NaN is the largest number to Spark, and never true elsewhere."""
    return F.when(~F.isnan(x), x)


def cauchy_tail(t: Column) -> Column:
    """Upper tail of the standard Cauchy distribution, exact where 1 - cdf would cancel."""
    return F.atan2(F.lit(1.0), t) / F.lit(math.pi)


def cauchy_statistic(p: Column, small: float = 1e-15) -> Column:
    """Mean of the Cauchy transforms of p-values; tiny ones by their limit 1 / (p pi), infinite where p is 0."""
    each = F.when(p == 0, F.lit(math.inf)).when(p < small, 1 / p / F.lit(math.pi)).otherwise(F.tan((0.5 - p) * F.lit(math.pi)))
    return F.avg(F.when((p >= 0) & (p < 1), each))


def acat(p: Column, use: Column | None = None) -> Column:
    """Cauchy combination of a group's p-values, of those with ``use`` if given.  0 if one is 0, 1 if one is 1; both,
    null or out of range: an error.  Without any p-value the statistic is 0 and the result 0.5."""
    use = F.lit(True) if use is None else use
    some = lambda x: F.coalesce(F.max((use & x).cast("int")) == 1, F.lit(False))
    wrong = some(p.isNull() | F.isnan(p) | (p < 0) | (p > 1))
    zero, one = some(p == 0), some(p == 1)
    t = F.coalesce(cauchy_statistic(F.when(use, p)), F.lit(0.0))
    return (
        F.when(wrong, F.raise_error(F.lit("p-values must be within 0 and 1")).cast("double"))
        .when(zero & one, F.raise_error(F.lit("p-values of 0 and of 1 cannot be combined")).cast("double"))
        .when(zero, 0.0)
        .when(one, 1.0)
        .otherwise(F.when(t > 1e15, 1 / t / F.lit(math.pi)).otherwise(cauchy_tail(t)))
    )


def geometric_mean(x: Column) -> Column:
    return F.exp(F.avg(F.ln(x)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))
