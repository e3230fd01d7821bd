"""Column expressions that Spark lacks: log-gamma, softmax and log-sum-exp over arrays, one-hot rows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Stirling's series for log-gamma, of 1/z, 1/z^3, ...
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)
_SHIFT = 8


def lgamma(x: Column) -> Column:
    """log-gamma of a positive number, by shifting the argument up and Stirling's series; NULL for others."""
    z = x + F.lit(float(_SHIFT))
    product = x
    for i in range(1, _SHIFT):
        product = product * (x + F.lit(float(i)))
    series, power = F.lit(0.0), z
    for c in STIRLING:
        series = series + F.lit(c) / power
        power = power * z * z
    value = (z - 0.5) * F.ln(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + series - F.ln(product)
    return F.when(x > 0, value)


def ln0(x: Column) -> Column:
    """Natural logarithm with minus infinity at 0 (Spark's gives NULL there)."""
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(float("-inf")))


def log_sum_exp(logs: Column) -> Column:
    """log of the sum of exp of an array's values; infinity if one is infinite, minus infinity if all are minus infinite."""
    top = F.array_max(logs)
    total = F.aggregate(logs, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
    return F.when(top.isin(float("inf"), float("-inf")), top).otherwise(F.ln(total) + top)


def softmax(logs: Column) -> Column:
    """Shares of exp of an array's values. Where a value is plus infinity, the first such one takes all."""
    top = F.array_max(logs)
    weights = F.transform(logs, lambda v: F.exp(v - top))
    total = F.aggregate(weights, F.lit(0.0), lambda acc, v: acc + v)
    first = F.array_position(logs, F.lit(float("inf")))
    sure = F.transform(logs, lambda v, i: F.when(i == first - 1, 1.0).otherwise(0.0))
    return F.when(first > 0, sure).otherwise(F.transform(weights, lambda v: v / total))


def softmax_marking_infinite(logs: Column) -> Column:
    """Shares of exp of an array's values; where some are infinite (either sign), those get 1 and the others 0."""
    infinite = lambda v: v.isin(float("inf"), float("-inf"))
    top = F.array_max(logs)
    weights = F.transform(logs, lambda v: F.exp(v - top))
    total = F.aggregate(weights, F.lit(0.0), lambda acc, v: acc + v)
    marked = F.transform(logs, lambda v: F.when(infinite(v), 1.0).otherwise(0.0))
    return F.when(F.exists(logs, infinite), marked).otherwise(F.transform(weights, lambda v: v / total))


def shares(values: Column) -> Column:
    """Values of an array over their sum; NULL where the sum is 0."""
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(values, lambda v: F.try_divide(v, total))


def one_hot(label: Column, k: int) -> Column:
    """Array of length k with 1 at the label (from 1); all zeros for a null label."""
    return F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.when(i == label, 1.0).otherwise(0.0))
