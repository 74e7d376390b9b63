"""Fractional level of an observation in the model column above it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.functions import codes
from isohyet.operators.observations import interpolated

SURFACE = 9999  # elements above it are at the surface


def bracketed(obs: DataFrame, profile: DataFrame, ascending: bool = False) -> DataFrame:
    """Observations (obs_id, elm, ri, rj, lev, qc) with ``rk`` and the codes for above and below the model.

    ``profile`` (gi, gj, k, x) holds the logarithm of pressure, falling with k, or heights, rising with k
    (``ascending``); ``lev`` is on the same scale. Surface elements keep ``lev``. Corners meet the
    profile by an equi-join, and the bracket is a pair of aggregates of the column.
    """
    upper = obs.filter((F.col("qc") == 0) & (F.col("elm") <= SURFACE))
    column = interpolated(upper, profile.withColumnRenamed("k", "mem")).withColumnsRenamed({"mem": "k", "hx": "x"})
    sign = 1 if ascending else -1
    placed = column.join(upper.select("obs_id", "lev"), "obs_id").withColumns({"x": F.col("x") * sign, "at": F.col("lev") * sign})
    under, over = F.col("x") <= F.col("at"), F.col("x") > F.col("at")
    found = placed.groupBy("obs_id").agg(
        F.max("x").alias("top"), F.min("x").alias("bottom"), F.first("at").alias("at"),
        F.max(F.when(under, F.struct("k", "x"))).alias("lo"), F.min(F.when(over, F.struct("k", "x"))).alias("hi"),
    )
    share = F.when(F.col("hi").isNull(), 0.0).otherwise((F.col("at") - F.col("lo.x")) / (F.col("hi.x") - F.col("lo.x")))
    code = F.when(F.col("at") > F.col("top"), codes.ABOVE_MODEL).when(F.col("at") < F.col("bottom"), codes.BELOW_MODEL).otherwise(codes.GOOD)
    found = found.select("obs_id", code.alias("code"), F.when(code == 0, F.col("lo.k") + share).alias("rk"))
    qc = F.when(F.col("qc") == 0, F.coalesce("code", F.lit(codes.GOOD))).otherwise(F.col("qc"))
    rk = F.when((F.col("elm") > SURFACE) & (F.col("qc") == 0), F.col("lev")).otherwise(F.col("rk"))
    return obs.join(found, "obs_id", "left").withColumns({"rk": rk, "qc": qc}).drop("code")
