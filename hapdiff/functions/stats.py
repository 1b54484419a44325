"""Distribution functions that Spark SQL lacks."""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: 1.4901161193847656e-08, the square root of the double's epsilon.
SQRT_EPS = math.sqrt(2.0**-52)


def t_two_sided(t: float, df: int) -> float:
    """Two-sided p of Student's t by the finite series for whole degrees of freedom (Abramowitz & Stegun 26.7.3-4)."""
    theta = math.atan(abs(t) / math.sqrt(df))
    c, s = math.cos(theta), math.sin(theta)
    if df == 1:
        return 1 - 2 * theta / math.pi
    term, total = (c if df % 2 else 1.0), 0.0
    for k in range(1 + df % 2, df, 2):
        total += term
        term *= c * c * k / (k + 1)
    a = (2 / math.pi) * (theta + s * total) if df % 2 else s * total
    return 1 - a


@lru_cache(maxsize=None)
def t_critical(df: int, p: float = 0.01) -> float:
    """The t whose two-sided p is p."""
    lo, hi = 0.0, 1e4
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_two_sided(mid, df) > p else (lo, mid)
    return hi


#: Degrees of freedom that are tabulated; beyond them the normal quantile's expansion is exact to 1e-7.
T_TABLE = 600


def t_table(spark: SparkSession) -> DataFrame:
    """df, t_crit for df 1..T_TABLE."""
    return spark.createDataFrame([(d, t_critical(d)) for d in range(1, T_TABLE + 1)], "df int, t_crit double")


def t_far(df: Column) -> Column:
    """The critical t beyond the table, by the expansion in 1/df around the normal quantile of 0.995."""
    z = 2.5758293035489004
    g1, g2 = (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96
    return F.lit(z) + g1 / df + g2 / (df * df)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))
