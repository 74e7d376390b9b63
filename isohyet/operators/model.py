"""What an observation would be, given the model's state at its place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.functions import codes, physics
from isohyet.functions.precipitation import inverse_normal

VIRTUAL = codes.R_VAPOUR / codes.R_DRY - 1
Operator = Callable[[], Column]

# Element name -> column over the interpolated u, v, t, q, rh, ps, t2, q2 and topo; add to it for new elements.
OPERATORS: dict[str, Operator] = {
    "U": lambda: F.col("u"),
    "V": lambda: F.col("v"),
    "T": lambda: F.col("t"),
    "Tv": lambda: F.col("t") * (1 + VIRTUAL * F.col("q")),
    "Q": lambda: F.col("q"),
    "RH": lambda: F.col("rh"),
    "PS": lambda: physics.pressure_at(F.col("ps"), F.col("rk") - F.col("topo"), F.col("t2"), F.col("q2")),
}


def simulated(state: DataFrame, steepest: float = 100.0) -> DataFrame:
    """``hx`` and ``qc`` of rows with an element ``elm``, a level or station height ``rk`` and interpolated state columns.

    Surface pressure is adjusted to the station's height; a gap of more than ``steepest`` metres has code 10,
    an element without an operator has code 90 and no value. Rows with a code keep it.
    """
    value, known = F.lit(None).cast("double"), F.lit(False)
    for name, operator in OPERATORS.items():
        here = F.col("elm") == codes.ID[name]
        value, known = F.when(here, operator()).otherwise(value), known | here
    gap = (F.col("elm") == codes.ID["PS"]) & (F.abs(F.col("rk") - F.col("topo")) > steepest)
    qc = F.when(F.col("qc") != codes.GOOD, F.col("qc")).when(~known, codes.UNUSED).when(gap, codes.TERRAIN).otherwise(codes.GOOD)
    return state.withColumn("hx", value).withColumn("qc", qc)


def simulated_radar(echo: DataFrame, least: float = 10.0, least_dbz: float = 10.0, shift: float = 0.0) -> DataFrame:
    """``hx`` and ``qc`` of radar rows with ``elm``, ``ref`` (linear) and ``vr``: dBZ or radial wind.

    A weak echo has code 11 for both, yet keeps a value; a row above the radar itself (no ``vr``) has code 98, one without a reflectivity code 99.
    """
    missing = F.col("ref").isNull()
    weak, wind = F.col("ref") < least, F.col("elm") == codes.ID["Vr"]
    dbz = F.when(weak, least_dbz + shift).otherwise(10 * F.log10(F.greatest(F.col("ref"), F.lit(least))))
    qc = F.when(F.col("qc") != codes.GOOD, F.col("qc")).when(F.col("vr").isNull(), codes.OUT_OF_DOMAIN).when(missing, codes.UNDEFINED).when(weak, codes.REF_LOW).otherwise(codes.GOOD)
    return echo.withColumn("hx", F.when(F.col("vr").isNull() | missing, None).when(wind, F.col("vr")).otherwise(dbz)).withColumn("qc", qc)


def noise(key: Column, seed: int) -> Column:
    """A standard normal number of a key and a seed: the same however rows are partitioned or retried."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 8)
    return inverse_normal((F.conv(digits, 16, 10).cast("double") + 0.5) / 2.0**32)


def synthetic(truth: DataFrame, seed: int) -> DataFrame:
    """Observations of a true state: ``dat`` is ``hx`` with noise of the error's size; rows with a code have no value."""
    return truth.withColumn("noise", noise(F.col("obs_id"), seed)).withColumn("dat", F.when(F.col("qc") == codes.GOOD, F.col("hx") + F.col("err") * F.col("noise"))).drop("noise")
