"""Transforms of rain amounts to near-Gaussian variables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_RAIN, LOG_OFFSET, TAIL = 0.06, 0.6, 0.001

# Rational approximation of the inverse normal distribution, highest power first.
CENTRE_OVER = (-39.6968302866538, 220.946098424521, -275.928510446969, 138.357751867269, -30.6647980661472, 2.50662827745924)
CENTRE_UNDER = (-54.4760987982241, 161.585836858041, -155.698979859887, 66.8013118877197, -13.2806815528857, 1.0)
TAIL_OVER = (-0.00778489400243029, -0.322396458041136, -2.40075827716184, -2.54973253934373, 4.37466414146497, 2.93816398269878)
TAIL_UNDER = (0.00778469570904146, 0.32246712907004, 2.445134137143, 3.75440866190742, 1.0)
LOW = 0.02425


def _polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal distribution; null outside (0, 1)."""
    side = F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    tail = _polynomial(side, TAIL_OVER) / _polynomial(side, TAIL_UNDER)
    off = p - 0.5
    centre = off * _polynomial(off * off, CENTRE_OVER) / _polynomial(off * off, CENTRE_UNDER)
    return F.when((p > 0) & (p < 1), F.when(p < LOW, tail).when(p > 1 - LOW, -tail).otherwise(centre))


def without_tails(p: Column) -> Column:
    return F.when(p.isNotNull(), F.greatest(F.lit(TAIL), F.least(F.lit(1 - TAIL), p)))  # greatest and least skip nulls


def log_amount(rain: Column) -> Column:
    return F.when(rain < NO_RAIN, math.log(LOG_OFFSET)).otherwise(F.ln(rain + LOG_OFFSET))


def with_place(df: DataFrame, rain: str, cdf: str, no_rain: str) -> DataFrame:
    """``place``: that of an amount in a climatology given as ascending bounds of equal shares, linear between bounds.

    No rain goes to the middle of its own share. Steps are columns of their own, so none is computed twice.
    """
    amount, bounds = F.col(rain), F.col(cdf)
    df = df.withColumn("below", F.size(F.filter(bounds, lambda x: x <= amount)))
    df = df.withColumns({"low": F.get(bounds, F.col("below") - 1), "high": F.get(bounds, F.col("below")), "shares": F.size(bounds) - 1})
    inside = (F.col("below") - 1 + (amount - F.col("low")) / (F.col("high") - F.col("low"))) / F.col("shares")
    place = F.when(amount.isNull(), None).when(amount < NO_RAIN, F.col(no_rain) * 0.5).when(F.col("below") == 0, 0.0).when(F.col("below") > F.col("shares"), 1.0).otherwise(inside)
    return df.withColumn("place", place).drop("below", "low", "high", "shares")


def with_gaussian(df: DataFrame, out: str, rain: str, cdf: str, no_rain: str) -> DataFrame:
    """A column ``out`` with the Gaussian variable of an amount."""
    df = with_place(df, rain, cdf, no_rain).withColumn("place", without_tails(F.col("place")))
    return df.withColumn(out, inverse_normal(F.col("place"))).drop("place")


def split_at_trace(no_rain: Column, dry_share: Column, rain_mean: Column) -> tuple[Column, Column]:
    """Mean and standard deviation of the normal distribution for dry members.

    ``no_rain`` is the climatology's dry share, ``dry_share`` the ensemble's, and ``rain_mean`` the
    sum of the wet members' Gaussian values over the number of all members.
    """
    trace, trace_b = inverse_normal(without_tails(no_rain)), inverse_normal(without_tails(dry_share))
    density = -F.exp(-0.5 * trace_b * trace_b) / math.sqrt(2 * 3.1415926535)
    below = density + (1 - dry_share) * trace_b
    return (density * trace + rain_mean * trace_b) / below, ((1 - dry_share) * trace - rain_mean) / below


def with_gaussian_observation(df: DataFrame, out: str, rain: str, cdf: str, no_rain: str) -> DataFrame:
    """A column ``out`` with observed amounts on the scale of an ensemble split by ``split_at_trace``.

    Columns of ``df``: ``no_rain_model``, the model climatology's dry share, ``dry_share``, the ensemble's, and
    the split's ``mean`` and ``sd``.
    """
    df = with_place(df, rain, cdf, no_rain)
    dry = F.col("place") < F.col("no_rain_model")
    p = F.when(dry, F.col("place") / F.col("no_rain_model") * F.col("dry_share")).otherwise(F.col("place"))
    df = df.withColumn("is_dry", dry).withColumn("place", without_tails(p)).withColumn("place", inverse_normal(F.col("place")))
    return df.withColumn(out, F.when(F.col("is_dry"), F.col("mean") + F.col("sd") * F.col("place")).otherwise(F.col("place"))).drop("place", "is_dry")
