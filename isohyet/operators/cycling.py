"""One cycle of analysis and adaptive inflation of a two-dimensional ensemble."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.operators import gridded, inflation, volume
from isohyet.sources import states


def assimilated(obs: DataFrame, prior: DataFrame, earlier: DataFrame, scale: float, most: int | None = None, threshold: float = 5.0, rtpp: float = 0.0) -> DataFrame:
    """(gi, gj, mem, x, infl): the analysis of ``prior`` (gi, gj, mem, x) by ``obs`` (obs_id, elm, typ, ri, rj, dat, err, qc), inflated by the factors of ``earlier`` (gi, gj, mem, infl), and these factors adapted.

    A point without a factor in ``earlier`` keeps 1. Observations with a code, and those too far from the prior's mean, are left out.
    """
    prior = prior.select("gi", "gj", "mem", "x")
    told = gridded.Simulated(obs, prior)
    dep = states.kept(told.departures(threshold).select("obs_id", "elm", "typ", "ri", "rj", "dat", "err", "qc", "dep", "hx_sprd"), "departures")
    points = prior.select("gi", "gj").distinct()
    felt = told.felt(dep.filter("qc = 0").drop("hx_sprd"), points, scale, most).withColumns({"lev": F.lit(1.0e5), "hori_loc": F.lit(scale), "vert_loc": F.lit(0.0)})
    factors = points.join(earlier.groupBy("gi", "gj").agg(F.first("infl").alias("infl")), ["gi", "gj"], "left").select("gi", "gj", F.coalesce("infl", F.lit(1.0)).alias("infl"))
    state = prior.join(factors, ["gi", "gj"]).withColumns({"k": F.lit(1), "p": F.lit(1.0e5)})
    analysed = volume.analysis_by_tile(state, ["x"], felt, widest=scale, most=most, rtpp=rtpp)
    adapted = inflation.adapted_at(points, told.seen(dep, ["obs_id", "ri", "rj", "err"]), scale, factors)
    return analysed.select("gi", "gj", "mem", "x").join(adapted, ["gi", "gj"])
