"""Tail probabilities of test statistics.

The tests reduce the data in Spark to one row per test; these functions turn the statistic of such
a row into a p-value. The normal and chi-square tails need ``erfc`` / the incomplete gamma function,
which Spark SQL does not offer, so they run as an Arrow batch over that tiny result.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def _chi2_tail(x: float, dof: int) -> float:
    """P(X > x) by the finite recurrence Q(a+1, t) = Q(a, t) + t^a e^-t / Gamma(a+1)."""
    if x <= 0:
        return 1.0
    t = x / 2.0
    if dof % 2:
        a, tail = 0.5, math.erfc(math.sqrt(t))
    else:
        a, tail = 1.0, math.exp(-t)
    while a < dof / 2.0:
        tail += math.exp(a * math.log(t) - t - math.lgamma(a + 1.0))
        a += 1.0
    return min(tail, 1.0)


@pandas_udf(T.DoubleType())
def chi2_p_value(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([
        None if pd.isna(x) or pd.isna(d) else 1.0 if d == 0 else _chi2_tail(float(x), int(d))
        for x, d in zip(stat, dof)
    ], dtype="float64")


@pandas_udf(T.DoubleType())
def normal_two_sided_p(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(v / math.sqrt(2.0)) if v > 0 else 1.0, na_action="ignore")


def kolmogorov_p(distance: Column, n_effective: Column) -> Column:
    """Limiting two-sample tail 2 * sum (-1)^(k-1) exp(-2 k^2 x^2); the series stays in the JVM."""
    x = F.sqrt(n_effective) * distance
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, k: acc
        + F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(-2.0 * k * k * x * x),
    )
    # below 0.2 the tail is 1 to more than ten digits, and the alternating sum converges slowly
    return F.when(x < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))
