"""Updates of an ensemble, or of a bias ensemble, by one observation at a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def serial_update(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, mem, gain, pert): gain of the bias for an observation, and the bias perturbations after it.

    ``members`` (keys, mem, b, hb, hx, r) holds a point's bias members, what the observation would be of them and of the
    state's members, and its error variance. Members are summed before the shuffle; one join brings the sums back.
    """
    sums = members.groupBy(*keys).agg(F.covar_samp("b", "hb").alias("c"), (F.var_samp("hb") + F.var_samp("hx")).alias("v"), F.max("r").alias("error"), F.avg("b").alias("bm"), F.avg("hb").alias("hm"))
    total = F.col("v") + F.col("error")
    gains = sums.select(*keys, (F.col("c") / total).alias("gain"), (1 + F.sqrt(F.col("error") / total)).alias("alpha"), "bm", "hm")
    joined = members.join(gains, list(keys))
    return joined.select(*keys, "mem", "gain", (F.col("b") - F.col("bm") - F.col("gain") * (F.col("hb") - F.col("hm")) / F.col("alpha")).alias("pert"))


def scalar_gain(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, gain, xa_mean): Kalman gain of a point for one observation, and its mean after the update; ``members`` (keys, mem, x, hx, dep, r). Sums only."""
    gain = F.covar_samp("x", "hx") / (F.var_samp("hx") + F.max("r"))
    return members.groupBy(*keys).agg(gain.alias("gain"), (F.avg("x") + gain * F.max("dep")).alias("xa_mean"))


def square_root_update(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, mem, pert): perturbations of a point after the serial square-root update by one observation; ``members`` (keys, mem, x, hx, r)."""
    sums = members.groupBy(*keys).agg(F.avg("x").alias("xm"), F.avg("hx").alias("hm"), F.var_samp("hx").alias("v"), F.covar_samp("x", "hx").alias("c"), F.max("r").alias("error"))
    total = F.col("v") + F.col("error")
    gains = sums.select(*keys, "xm", "hm", (F.col("c") / total / (1 + F.sqrt(F.col("error") / total))).alias("reduced"))
    return members.join(gains, list(keys)).select(*keys, "mem", (F.col("x") - F.col("xm") - F.col("reduced") * (F.col("hx") - F.col("hm"))).alias("pert"))
