"""Upper tail of the F distribution, for tables with one row per variable."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _tail_function():
    """Build the tail function as a closure, which travels to Python workers by value."""

    def front(a: float, b: float, x: float) -> float:
        if x <= 0:
            return 0.0
        logs = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
        return math.exp(logs) / a

    def fraction(a: float, b: float, x: float) -> float:
        tiny = 1e-300
        c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
        d = 1.0 / (d if abs(d) > tiny else tiny)
        value = d
        for m in range(1, 2000):
            for numerator in (
                m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
            ):
                d = 1.0 + numerator * d
                d = 1.0 / (d if abs(d) > tiny else tiny)
                c = 1.0 + numerator / c
                c = c if abs(c) > tiny else tiny
                value *= c * d
            if abs(c * d - 1.0) < 1e-15:
                break
        return value

    def tail(f: float, df1: float, df2: float) -> float:
        if f is None or math.isnan(f):
            return math.nan
        if math.isinf(f):
            return 0.0
        if f <= 0:
            return 1.0
        # P(F > f) is the regularised incomplete beta I_x(df2/2, df1/2); the continued fraction converges fast
        # on one side of its mean, the complement serves the other.
        a, b, x = df2 / 2, df1 / 2, df2 / (df2 + df1 * f)
        if x > (a + 1) / (a + b + 2):
            return 1.0 - front(b, a, 1 - x) * fraction(b, a, 1 - x)
        return front(a, b, x) * fraction(a, b, x)

    return tail


def f_tail(f: Column, df_between: Column, df_within: Column) -> Column:
    """P(F > f) as a column."""
    tail = _tail_function()

    @F.pandas_udf("double")
    def survival(values: pd.Series, first: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series([tail(v, a, b) for v, a, b in zip(values, first, second)], dtype=float)

    return survival(f, df_between.cast("double"), df_within.cast("double"))
