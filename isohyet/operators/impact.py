"""Impact of observations on a forecast's error."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isohyet.functions import codes, physics
from isohyet.operators import tiles
from isohyet.operators.localization import CUTOFF, RAIN_BASE, distances, with_vertical_place

REFERENCE_T, REFERENCE_P = 280.0, 1.0e5
TERMS = ("ke", "pe", "me")


def by_region(impact: DataFrame, bound: float = 20.0, keys: Sequence[str] = ()) -> DataFrame:
    """(typ, region, elm, n_obs, total, percent_negative) of impacts with ``lat``: by type, region and element, and by type alone (region and element null).

    ``keys`` are further columns to group by. Regions are NH above ``bound`` degrees, SH below -``bound``, TR between, bounds included.
    """
    region = F.when(F.col("lat") > bound, "NH").when(F.col("lat") < -bound, "SH").otherwise("TR")
    sums = (F.count("*").alias("n_obs"), F.sum("impact").alias("total"), (100 * F.avg(F.when(F.col("impact") < 0, 1.0).otherwise(0.0))).alias("percent_negative"))
    named = impact.withColumn("region", region)
    parts, none = named.groupBy(*keys, "typ", "region", "elm").agg(*sums), F.lit(None)
    return parts.unionByName(named.groupBy(*keys, "typ").agg(*sums).select(*keys, "typ", none.cast("string").alias("region"), none.cast("int").alias("elm"), "n_obs", "total", "percent_negative"))


def observation_impact(local: DataFrame, forecast: DataFrame, error: DataFrame, analysed: DataFrame, dep: DataFrame) -> DataFrame:
    """(obs_id, impact): departure times the sensitivity of the error norm to the observation.

    ``local`` (gi, gj, obs_id, rloc, err), ``forecast`` and ``analysed`` are ensembles (gi, gj, mem, x) and
    (obs_id, mem, hx), ``error`` (gi, gj, e) the sum of two forecasts' errors, weighted as the norm is,
    and ``dep`` (obs_id, dep). Members are packed per point and per observation, so a row of ``local``
    is never multiplied by the members; the sum over points is combined before the shuffle.
    """
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("mem", c))), lambda s: s[c])
    centred = lambda c: F.transform(c, lambda v: v - F.aggregate(c, F.lit(0.0), lambda a, b: a + b) / F.size(c))
    points = forecast.groupBy("gi", "gj").agg(ordered("x").alias("x")).join(error, ["gi", "gj"])
    points = points.select("gi", "gj", "e", centred("x").alias("x"))
    obs = analysed.groupBy("obs_id").agg(ordered("hx").alias("hx")).select("obs_id", centred("hx").alias("y"))
    met = local.filter("obs_id is not null").join(points, ["gi", "gj"]).join(obs, "obs_id")
    product = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    share = F.col("rloc") / (F.col("err") * F.col("err")) * F.col("e") * product / (2 * (F.size("x") - 1))
    felt = met.groupBy("obs_id").agg(F.sum(share).alias("felt"))
    return felt.join(dep.select("obs_id", "dep"), "obs_id").select("obs_id", (F.col("felt") * F.col("dep")).alias("impact"))


def forecast_error(recent: DataFrame, older: DataFrame, verifying: DataFrame) -> DataFrame:
    """(gi, gj, k, u, v, t, q, p): half the sum of the errors of two mean forecasts against a verifying analysis, all of them (gi, gj, k, u, v, t, q, p).

    A point that one of them lacks has no row.
    """
    place, names = ["gi", "gj", "k"], ("u", "v", "t", "q", "p")
    named = lambda df, mark: df.select(*place, *[F.col(c).alias(c + mark) for c in names])
    met = named(recent, "_r").join(named(older, "_o"), place).join(named(verifying, "_a"), place)
    return met.select(*place, *[(0.5 * (F.col(c + "_r") + F.col(c + "_o")) - F.col(c + "_a")).alias(c) for c in names])


def energy_products(forecast: DataFrame, error: DataFrame, levels: tuple[int, int] | None = None, area: Sequence[float] | None = None, moist: float = 1.0, latent: float = 2.5e6) -> DataFrame:
    """(gi, gj, k, ke, pe, me): members' forecast perturbations times the forecasts' error in the moist total-energy norm.

    ``forecast`` (gi, gj, k, mem, u, v, t, q, p, lon, lat, share), ``share`` being the square root of a column's share of the whole area;
    ``error`` as ``forecast_error`` gives it. Each term is an array over members in their order, divided by their number less one.
    A layer reaches half way to the levels around it, the lowest from the lowest level's pressure, which is the surface's, the highest up to 0; surface
    pressure counts in ``pe`` of the lowest level. Points outside ``levels`` or ``area`` (west, east, south, north; bounds included) have no row.
    """
    at = Window.partitionBy("gi", "gj").orderBy("k")
    packed = forecast.groupBy("gi", "gj", "k").agg(
        F.array_sort(F.collect_list(F.struct("mem", "u", "v", "t", "q", "p"))).alias("all"), *[F.avg(c).alias(c + "_m") for c in ("u", "v", "t", "q", "p")], F.first("lon").alias("lon"), F.first("lat").alias("lat"), F.first("share").alias("share"))
    below, above, own = F.lag("p_m").over(at), F.lead("p_m").over(at), F.col("p_m")
    layer = F.when(below.isNull(), own).otherwise((below + own) / 2) - F.when(above.isNull(), 0.0).otherwise((own + above) / 2)
    layers = packed.withColumns({"dp": layer, "lowest": below.isNull(), "ps_m": F.first("p_m").over(at)})
    if levels:
        layers = layers.filter(F.col("k").between(*levels))
    if area:
        layers = layers.filter(F.col("lon").between(area[0], area[1]) & F.col("lat").between(area[2], area[3]))
    met = layers.join(error.select("gi", "gj", "k", *[F.col(c).alias(c + "_e") for c in ("u", "v", "t", "q", "p")]), ["gi", "gj", "k"])
    met = met.withColumn("mass", F.col("dp") / F.col("ps_m") * F.col("share") * F.col("share") / (F.size("all") - 1))
    met = met.withColumn("ground", F.when(F.col("lowest"), codes.R_DRY * REFERENCE_T / REFERENCE_P**2 * F.col("share") * F.col("share") / (F.size("all") - 1)).otherwise(0.0))
    product = lambda s, c: (s[c] - F.col(c + "_m")) * F.col(c + "_e")
    heat, wet = codes.CP_DRY / REFERENCE_T, moist * latent**2 / (codes.CP_DRY * REFERENCE_T)
    return met.select(
        "gi", "gj", "k",
        F.transform("all", lambda s: F.col("mass") * (product(s, "u") + product(s, "v"))).alias("ke"),
        F.transform("all", lambda s: F.col("mass") * heat * product(s, "t") + F.col("ground") * product(s, "p")).alias("pe"),
        F.transform("all", lambda s: F.col("mass") * wet * product(s, "q")).alias("me"),
    )


def advected_points(points: DataFrame, hours: float, rate: float = 1.0) -> DataFrame:
    """``points`` (lon, lat, ua, va of the analysis, uf, vf of the forecast) with ``lon`` and ``lat`` of where the air of the forecast was at the analysis, by the mean of both winds."""
    lon, lat = physics.advected(F.col("lon"), F.col("lat"), 0.5 * (F.col("ua") + F.col("uf")), 0.5 * (F.col("va") + F.col("vf")), hours, rate)
    return points.withColumns({"lon": lon, "lat": lat})


def three_term_impact(points: DataFrame, products: DataFrame, obs: DataFrame, widest: float, dx: float = 1.0, tile: int = 8, rain_base: float = RAIN_BASE, of_a_task: int = tiles.OBS_OF_A_TASK) -> DataFrame:
    """(obs_id, ke, pe, me): the estimated change of the forecast's error energy by each observation, negative where it helped.

    ``points`` (gi, gj, k, xi, xj, p, z) with the place (xi, xj) about which a point looks for observations, advected or its own; ``products`` of
    ``energy_products``; ``obs`` (obs_id, elm, typ, ri, rj, lev, dat, err, dep, hori_loc, vert_loc, y) with the analysed members ``y``, centred, in order.
    An observation that no point feels has 0 for all terms; points without a product feel none.

    Points lie in one tile by their place, an observation goes once to each tile in reach, with its members. A tile's
    observations are dealt to as many tasks as keep each below about ``of_a_task`` of them, its points to all of these. A task returns one
    row per observation, so no pair of a point and an observation is ever a row.
    """
    reach = widest * CUTOFF / dx
    over = lambda c, n: F.explode(F.sequence(F.floor((F.col(c) - reach - 1) / tile).cast("int"), F.floor((F.col(c) + reach - 1) / tile).cast("int"))).alias(n)
    placed = with_vertical_place(obs, rain_base).select("*", over("ri", "ti")).select("*", over("rj", "tj"))
    sent = placed.select("ti", "tj", "obs_id", "ri", "rj", "base", "by_height", "hori_loc", "vert_loc", "err", "dep", "y")
    located = points.select("gi", "gj", "k", tiles.tile_of(F.col("xi"), tile).alias("ti"), tiles.tile_of(F.col("xj"), tile).alias("tj"), "xi", "xj", "p", "z").join(products, ["gi", "gj", "k"])

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        got, matrix = tiles.values, tiles.matrix
        ids = got(right, "obs_id")
        sums = {c: np.zeros(len(ids)) for c in TERMS}
        if len(left) and len(right):
            order = np.lexsort((got(left, "k"), got(left, "gj"), got(left, "gi")))
            xi, xj, lp, z = got(left, "xi")[order], got(left, "xj")[order], np.log(got(left, "p"))[order], got(left, "z").astype(float)[order]
            energy = {c: matrix(left, c)[order] for c in TERMS}
            y = matrix(right, "y")
            places = {c: got(right, c) for c in ("ri", "rj", "base", "by_height", "hori_loc", "vert_loc")}
            scale = got(right, "dep") / got(right, "err") ** 2
            for a in range(0, len(ids), 1024):  # distances of all points to some observations at a time
                nd2 = distances(xi, xj, lp, z, {c: v[a : a + 1024] for c, v in places.items()}, dx)
                weight = np.exp(-0.5 * nd2)
                for c in TERMS:
                    sums[c][a : a + 1024] = ((weight.T @ energy[c]) * y[a : a + 1024]).sum(axis=1) * scale[a : a + 1024]
        return pa.table({"obs_id": pa.array(ids, pa.int64()), **sums})

    parts = tiles.together(located, sent, work, "obs_id long, ke double, pe double, me double", of_a_task)
    return parts.groupBy("obs_id").agg(*[F.sum(c).alias(c) for c in TERMS])


def report(impacts: DataFrame, bound: float = 20.0) -> DataFrame:
    """(term, typ, region, elm, n_obs, total, percent_negative) of the three terms and their sum, by ``by_region``; ``impacts`` (typ, elm, lat, ke, pe, me)."""
    each = impacts.select("typ", "elm", "lat", F.inline(F.array(*[F.struct(F.lit(c).alias("term"), F.col(c).alias("impact")) for c in TERMS], F.struct(F.lit("all").alias("term"), (F.col("ke") + F.col("pe") + F.col("me")).alias("impact")))))
    return by_region(each, bound, ["term"]).select("term", "typ", "region", "elm", "n_obs", "total", "percent_negative")
