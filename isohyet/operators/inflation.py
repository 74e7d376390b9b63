"""Inflation of an ensemble: adaptive factors and additive perturbations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.operators.kernels import PRIOR_SD
from isohyet.operators.localization import local_observations, pairs_in_reach


def adapted(local: DataFrame, dep: DataFrame, inflation: float | DataFrame) -> DataFrame:
    """(gi, gj, infl) after one adaptive update from the local observations of a point; without any, as before.

    ``inflation`` is one number, or that of each point (gi, gj, infl) as the cycle before left it.

    ``local`` holds (gi, gj, obs_id, rloc, rdiag), ``dep`` (obs_id, dep, hx_sprd). Sums only: no member leaves its row.
    """
    return _updated(_sums(local.join(dep.select("obs_id", "dep", "hx_sprd"), "obs_id", "left")), inflation)


def adapted_at(points: DataFrame, obs: DataFrame, scale: float, inflation: float | DataFrame) -> DataFrame:
    """``adapted`` of every point (gi, gj) by its local observations, ``obs`` (obs_id, ri, rj, err, dep, hx_sprd) bringing their departures along: pairs are summed where they are made."""
    sums = _sums(pairs_in_reach(points, obs.select("obs_id", "ri", "rj", "err", "dep", "hx_sprd"), scale))
    return _updated(points.select("gi", "gj").join(sums, ["gi", "gj"], "left"), inflation)


def _sums(seen: DataFrame) -> DataFrame:
    return seen.groupBy("gi", "gj").agg(
        F.sum(F.col("dep") * F.col("dep") / F.col("rdiag")).alias("p1"),
        F.sum(F.col("hx_sprd") * F.col("hx_sprd") / F.col("rdiag")).alias("p2"),
        F.sum("rloc").alias("p3"),
    )


def _updated(sums: DataFrame, inflation: float | DataFrame) -> DataFrame:
    prior = F.lit(inflation) if isinstance(inflation, float | int) else F.col("prior")
    if not isinstance(inflation, float | int):
        sums = sums.join(inflation.select("gi", "gj", F.col("infl").alias("prior")), ["gi", "gj"])
    spread = 2 / F.col("p3") * F.pow((prior * F.col("p2") + F.col("p3")) / F.col("p2"), F.lit(2.0))
    step = PRIOR_SD**2 / (spread + PRIOR_SD**2) * ((F.col("p1") - F.col("p3")) / F.col("p2") - prior)
    return sums.select("gi", "gj", F.when((F.col("p2") > 0) & (F.col("p3") > 0), prior + step).otherwise(prior).alias("infl"))


def reach_weight(points: DataFrame, obs: DataFrame, scale: float) -> DataFrame:
    """(gi, gj, weight): taper of the distance to the nearest observation; 0 where none is within the cutoff."""
    near = local_observations(points, obs, scale)
    return near.groupBy("gi", "gj").agg(F.coalesce(F.max("rloc"), F.lit(0.0)).alias("weight"))


def added(analysis: DataFrame, extra: DataFrame, amount: float, weight: DataFrame | None = None, order: Sequence[int] | None = None, of_mean: DataFrame | None = None) -> DataFrame:
    """(gi, gj, mem, x) with perturbations of another ensemble ``extra`` added.

    ``order`` gives, for each member, the one whose perturbation it takes; ``weight`` (gi, gj, weight)
    scales by point, ``of_mean`` (gi, gj, mean) makes amounts relative (for moisture).
    """
    mean = extra.groupBy("gi", "gj").agg(F.avg("x").alias("m"))
    pert = extra.join(mean, ["gi", "gj"]).select("gi", "gj", F.col("mem").alias("src"), (F.col("x") - F.col("m")).alias("p"))
    source = F.get(F.array(*map(F.lit, order)), F.col("mem") - 1) if order else F.col("mem")
    out = analysis.withColumn("src", source).join(pert, ["gi", "gj", "src"])
    factor = F.lit(amount)
    if weight is not None:
        out, factor = out.join(weight, ["gi", "gj"]), factor * F.col("weight")
    if of_mean is not None:
        out, factor = out.join(of_mean, ["gi", "gj"]), factor * F.col("mean")
    return out.select("gi", "gj", "mem", (F.col("x") + F.col("p") * factor).alias("x"))


def limited_spread(ensemble: DataFrame, keys: Sequence[str], variable: str, most: float) -> DataFrame:
    """``ensemble`` with perturbations of ``variable`` shrunk where its spread, relative to its mean, exceeds ``most``; the mean stays. Where the mean is 0 nothing is shrunk."""
    stats = ensemble.groupBy(*keys).agg(F.avg(variable).alias("_mean"), F.stddev_samp(variable).alias("_spread"))
    ratio = F.col("_spread") / F.nullif(F.col("_mean"), F.lit(0.0))
    shrunk = F.when(ratio > most, F.col("_mean") + (F.col(variable) - F.col("_mean")) * most / ratio).otherwise(F.col(variable))
    return ensemble.join(stats, list(keys)).withColumn(variable, shrunk).drop("_mean", "_spread")
