"""Thinning: observations of a cell merged to one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Report types whose observations are at the surface whatever their element (fixed values).
SURFACE_TYPES = (8, 9, 10, 11, 15)
SURFACE_ELEMENTS = 9999  # elements above it are at the surface
TOO_FAR, TOO_HIGH, NOT_USED, UNSUPPORTED = 2, 3, 4, 5


def merged(obs: DataFrame, keys: list[str], method: int, carried: tuple[str, ...] = ("ri", "rj", "dat")) -> DataFrame:
    """One row per cell, with ``carried`` and the least error. 1: of the least errors the one nearest to the centre; 2: the mean of all; 3: the mean of those with the least error.

    Cells have centres ``ci``, ``cj`` and, where ``obs`` has a layer ``ck`` other than 0, distance counts in three dimensions. Ties go to the smaller obs_id.
    """
    if method == 1:
        centre = lambda c, place: F.col(c) if c in obs.columns else F.floor(F.col(place) + 0.5)
        apart = [F.pow(F.col(p) - centre(c, p), F.lit(2.0)) for c, p in (("ci", "ri"), ("cj", "rj"))]
        if "ck" in obs.columns:
            apart.append(F.when(F.col("ck") == 0, 0.0).otherwise(F.pow(F.col("rk") - F.col("ck"), F.lit(2.0))))
        best = Window.partitionBy(*keys).orderBy("err", F.sqrt(sum(apart[1:], apart[0])), "obs_id")
        return obs.withColumn("rank", F.row_number().over(best)).filter("rank = 1").select(*keys, F.lit(1).cast("long").alias("n_used"), *carried, "err")
    least = F.min("err").over(Window.partitionBy(*keys))
    used = obs.withColumn("least", least)
    if method == 3:
        used = used.filter("err = least")
    return used.groupBy(*keys).agg(F.count("*").alias("n_used"), *[F.round(F.avg(c), 6).alias(c) for c in carried], F.min("err").alias("err"))


def at_surface() -> Column:
    return F.col("typ").isin(*SURFACE_TYPES) | (F.col("elm") > SURFACE_ELEMENTS)


def placed(obs: DataFrame, nx: int) -> DataFrame:
    """Cells ci, cj and layers ck of fractional positions: longitudes wrap around, the surface is layer 0, lower ones count as layer 1."""
    nearest = lambda c: F.floor(F.col(c) + 0.5).cast("int")
    column = F.when(nearest("ri") < 1, nearest("ri") + nx).when(nearest("ri") > nx, nearest("ri") - nx).otherwise(nearest("ri"))
    return obs.withColumns({"ci": column, "cj": nearest("rj"), "ck": F.when(at_surface(), 0).otherwise(F.greatest(nearest("rk"), F.lit(1)))})


def removal_codes(obs: DataFrame, ny: int, levels: int, unused: list[tuple[int, int]], supported: tuple[int, int]) -> DataFrame:
    """qc before thinning, the first of: above the levels, outside the rows, a type and element not to be used, an unsupported one.

    Observations at the surface are never too high. ``unused`` lists (typ, elm) pairs of the settings; ``supported`` bounds typ.
    """
    pair = F.lit(False)
    for typ, elm in unused:
        pair = pair | ((F.col("typ") == typ) & (F.col("elm") == elm))
    high = ~at_surface() & (F.ceil("rk") > levels)
    qc = F.when(high, TOO_HIGH).when((F.ceil("rj") < 2) | (F.ceil("rj") > ny), TOO_FAR).when(pair, NOT_USED).when(~F.col("typ").between(*supported), UNSUPPORTED).otherwise(0)
    return obs.withColumn("qc", qc)


def temporal(obs: DataFrame, keys: list[str], base: int) -> DataFrame:
    """Of the observations of one element at one place, that nearest to the base slot; the earlier slot, then the smaller id wins ties."""
    best = Window.partitionBy(*keys).orderBy(F.abs(F.col("slot") - base), "slot", "obs_id")
    return obs.withColumn("rank", F.row_number().over(best)).filter("rank = 1").drop("rank")


def superob(obs: DataFrame, base: int, method: int, nx: int, ny: int, levels: int, unused: list[tuple[int, int]], supported: tuple[int, int], vertical: int = 1) -> DataFrame:
    """The whole thinning: removal codes, then one row per layer of a record, then one slot per place, then one row per cell.

    A record is what one type reports of one element at one place and slot; its layers are merged by the method ``vertical``.
    """
    good = placed(removal_codes(obs, ny, levels, unused, supported).filter("qc = 0"), nx)
    record = ["elm", "typ", "ri", "rj", "slot", "ci", "cj", "ck"]
    first = good.groupBy(*record).agg(F.min("obs_id").alias("obs_id"))
    thin = merged(good, record, vertical, ("rk", "dat")).drop("n_used").join(first, record)
    kept = temporal(thin, ["elm", "typ", "ri", "rj", "ck"], base)
    return merged(kept, ["elm", "ci", "cj", "ck"], method)
