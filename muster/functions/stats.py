"""Statistics that neither Spark SQL nor plain SQL has, as vectorised functions."""

from __future__ import annotations

import difflib
import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def chi2_sf_df1(x: pd.Series) -> pd.Series:
    """P(chi-square with one degree of freedom > 2 x), for a log likelihood ratio x >= 0."""
    return x.map(lambda v: 0.5 * math.erfc(math.sqrt(max(0.0, v))))


def chi2_sf_odd(x: float, df: int) -> float:
    """P(chi-square with an odd number of degrees of freedom > x), closed form."""
    h = max(0.0, x) / 2
    total = math.erfc(math.sqrt(h))
    if h > 0:
        for j in range(1, (df - 1) // 2 + 1):
            total += math.exp(-h + (j - 0.5) * math.log(h) - math.lgamma(j + 0.5))
    return min(1.0, total)


@F.pandas_udf(DoubleType())
def chi2_sf_df19(x: pd.Series) -> pd.Series:
    return x.map(lambda v: chi2_sf_odd(v, 19))


@F.pandas_udf(DoubleType())
def ratcliff(a: pd.Series, b: pd.Series) -> pd.Series:
    """Gestalt pattern matching ratio of two strings."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])
