"""Observations that matter to each grid point: a bucketed range join with weights and limits."""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isohyet.functions import codes, physics

CUTOFF = 3.651483717
LIMIT2 = 13.33333333


def local_observations(points: DataFrame, obs: DataFrame, scale: float) -> DataFrame:
    """(gi, gj, obs_id, ..., nd2, rloc, rdiag): every observation within the cutoff of every point, and points without one.

    Both sides are dealt to square buckets as wide as the cutoff. An observation is copied
    to the nine buckets around its own, so a point finds all of its own in one bucket by
    an equi-join; the exact distance is a condition of that join. The join keeps every point.
    """
    width = scale * CUTOFF
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    spread = obs.withColumn("n", F.explode(around)).withColumn("bi", F.floor(F.col("ri") / width) + F.col("n.a")).withColumn("bj", F.floor(F.col("rj") / width) + F.col("n.b")).drop("n").alias("o")
    placed = points.withColumn("bi", F.floor(F.col("gi") / width)).withColumn("bj", F.floor(F.col("gj") / width)).alias("p")
    nd = F.hypot(F.col("p.gi") - F.col("o.ri"), F.col("p.gj") - F.col("o.rj")) / scale
    near = (F.col("p.bi") == F.col("o.bi")) & (F.col("p.bj") == F.col("o.bj")) & (nd <= CUTOFF) & (nd * nd <= LIMIT2)
    joined = placed.join(spread, near, "left").withColumn("nd2", nd * nd).withColumn("rloc", F.exp(-0.5 * nd * nd))
    return joined.select("p.gi", "p.gj", *[f"o.{c}" for c in obs.columns], "nd2", "rloc", (F.col("err") * F.col("err") / F.col("rloc")).alias("rdiag"))


def pairs_in_reach(points: DataFrame, obs: DataFrame, scale: float) -> DataFrame:
    """The pairs of ``local_observations``, without points that have none. Here it is points that are copied to nine buckets, so that an observation moves once, or not at all where the points are few."""
    width = scale * CUTOFF
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    put = points.select("gi", "gj", F.explode(around).alias("n")).select("gi", "gj", (F.floor(F.col("gi") / width) + F.col("n.a")).alias("bi"), (F.floor(F.col("gj") / width) + F.col("n.b")).alias("bj"))
    met = obs.withColumns({"bi": F.floor(F.col("ri") / width), "bj": F.floor(F.col("rj") / width)}).join(put, ["bi", "bj"])
    nd = F.hypot(F.col("gi") - F.col("ri"), F.col("gj") - F.col("rj")) / scale
    near = met.withColumn("_nd", nd).filter((F.col("_nd") <= CUTOFF) & (F.col("_nd") * F.col("_nd") <= LIMIT2)).withColumn("nd2", F.col("_nd") * F.col("_nd"))
    near = near.withColumn("rloc", F.exp(-0.5 * F.col("nd2")))
    return near.select("gi", "gj", *obs.columns, "nd2", "rloc", (F.col("err") * F.col("err") / F.col("rloc")).alias("rdiag"))


ORDERS = {"distance": ("nd2", True), "weight": ("rloc", False), "error": ("rdiag", True)}
MOST_CELLS = 6  # cells of the counts in one cutoff, at most
SAFE = 1 + 1e-9


def limit_group(elm: Column, typ: Column) -> Column:
    """The class that a limit counts: element and report type, reflectivities of radars with and without an echo being one."""
    merged = (typ == codes.RADAR_TYPE) & (elm == codes.ID["RE0"])
    return F.struct(F.when(merged, F.lit(codes.ID["REF"])).otherwise(elm).alias("elm"), typ.alias("typ"))


def limited(local: DataFrame, most: int, order: str = "distance", group: str = "limit_group") -> DataFrame:
    """The ``most`` best observations per point and group; ties go to the smaller obs_id. Points without observations stay."""
    column, up = ORDERS[order]
    best = F.col(column).asc() if up else F.col(column).desc()
    ranked = local.withColumn("rank", F.row_number().over(Window.partitionBy("gi", "gj", group).orderBy(best, "obs_id")))
    return ranked.filter(F.col("rank") <= most)


def _bounds(obs: DataFrame, side: float, scale: float, most: int, order: str, slack: float) -> DataFrame:
    """(ci, cj, grp, most_value, qi, qj, least_d2): cells that a cell's points have to look into for a group, and a bound of the value of their ``most``-th best.

    Only counts by cell move here. Of the rings of cells around a cell, as many as hold ``most`` observations lie within a radius that is sure;
    the bound is the squared distance to their far corners, or for errors the largest variance in them over its weight.
    """
    rings = math.ceil(CUTOFF * scale / side) + 1
    counts = obs.groupBy("ci", "cj", "grp").agg(F.count("*").alias("n"), F.max(F.col("err") * F.col("err")).alias("worst"), F.min(F.col("err") * F.col("err")).alias("finest"))
    steps = [(a, b) for a in range(-rings, rings + 1) for b in range(-rings, rings + 1)]
    apart = lambda d: max(abs(d) - 1, 0) * side / scale  # noqa: E731  least distance of points of two cells, in one direction
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(max(abs(a), abs(b))).alias("ring"), F.lit(apart(a) ** 2 + apart(b) ** 2).alias("d2")) for a, b in steps if apart(a) ** 2 + apart(b) ** 2 <= LIMIT2])
    seen = counts.withColumn("s", F.explode(around)).select((F.col("ci") + F.col("s.a")).alias("ci"), (F.col("cj") + F.col("s.b")).alias("cj"), "grp", "n", "worst", "finest", "s.ring", F.col("ci").alias("qi"), F.col("cj").alias("qj"), F.col("s.d2").alias("least_d2"))
    within = [F.col("ring") <= t for t in range(rings + 1)]
    sums = seen.groupBy("ci", "cj", "grp").agg(*[F.sum(F.when(w, F.col("n"))).alias(f"n{t}") for t, w in enumerate(within)], *[F.max(F.when(w, F.col("worst"))).alias(f"worst{t}") for t, w in enumerate(within)])
    far2 = [2 * ((t + 1) * side / scale) ** 2 for t in range(rings + 1)]
    value = (lambda t: F.lit(far2[t])) if order != "error" else (lambda t: F.col(f"worst{t}") * F.exp(F.lit(far2[t] / 2)))
    sure = F.least(*[F.when((F.col(f"n{t}") >= most) & F.lit(far2[t] <= LIMIT2 and far2[t] ** 0.5 <= CUTOFF), value(t)) for t in range(rings + 1)])
    bound = sums.select("ci", "cj", "grp", F.coalesce(sure * SAFE + slack, F.lit(math.inf)).alias("most_value"))
    lowest = F.col("least_d2") if order != "error" else F.col("finest") * F.exp(F.col("least_d2") / 2)
    return seen.join(bound, ["ci", "cj", "grp"]).filter(lowest <= F.col("most_value")).select("ci", "cj", "grp", "most_value", "qi", "qj", "least_d2")


def best_local(points: DataFrame, obs: DataFrame, scale: float, most: int, order: str = "distance", group: str = "limit_group", places: int = 9, ranked: bool = True) -> DataFrame:
    """``limited(local_observations(...))`` with values rounded to ``places``, but of the pairs of points and observations only those are made that can be among the ``most`` best.

    ``obs`` has the column ``group``, as limited() takes it. Counts of observations by small cells give every cell of points, for each group, a radius
    (for ``error`` a variance) within which its points surely find ``most``; observations are sent to those cells alone that may need them,
    and a pair beyond the bound is no row. Sparse groups keep the cutoff's whole reach. Cells are as small as leaves about ``most`` observations
    of a group in one. ``obs`` is read twice, so it should be a table. With ``ranked`` false, the pairs come as they go into the ranking.
    """
    whole = obs.agg(F.count("*").alias("n"), F.approx_count_distinct(group).alias("groups"), (F.max("ri") - F.min("ri")).alias("wide"), (F.max("rj") - F.min("rj")).alias("deep")).first()
    area = max(1.0, (whole.wide or 0) / (scale * CUTOFF)) * max(1.0, (whole.deep or 0) / (scale * CUTOFF))
    side = scale * CUTOFF / min(MOST_CELLS, max(1, round(1.5 * (whole.n / max(1, whole.groups) / area / most) ** 0.5)))
    dealt = obs.withColumns({"ci": F.floor(F.col("ri") / side), "cj": F.floor(F.col("rj") / side), "grp": F.col(group)})
    placed = points.withColumns({"ci": F.floor(F.col("gi") / side), "cj": F.floor(F.col("gj") / side)})
    cells = placed.select("ci", "cj").distinct()
    slack = 4 * 10.0**-places * math.exp(LIMIT2 / 2)  # rounded values tie within this
    wanted = _bounds(dealt, side, scale, most, order, slack).join(cells, ["ci", "cj"], "left_semi")
    sent = dealt.withColumnsRenamed({"ci": "qi", "cj": "qj"}).join(wanted, ["qi", "qj", "grp"])
    if order == "error":
        sent = sent.filter(F.col("err") * F.col("err") * F.exp(F.col("least_d2") / 2) <= F.col("most_value"))
    met = placed.select("gi", "gj", "ci", "cj").join(sent.drop("qi", "qj", "least_d2"), ["ci", "cj"])
    nd = F.hypot(F.col("gi") - F.col("ri"), F.col("gj") - F.col("rj")) / scale
    met = met.withColumn("nd2", nd * nd).filter((nd <= CUTOFF) & (F.col("nd2") <= LIMIT2))
    met = met.withColumn("rloc", F.exp(-0.5 * F.col("nd2"))).withColumn("rdiag", F.col("err") * F.col("err") / F.col("rloc"))
    pairs = met.filter(F.col("rdiag" if order == "error" else "nd2") <= F.col("most_value")).drop("ci", "cj", "grp", "most_value")
    pairs = pairs.withColumns({c: F.round(c, places) for c in ("nd2", "rloc", "rdiag")})
    if not ranked:
        return pairs
    taken = limited(pairs, most, order, group)
    columns = ["gi", "gj", *obs.columns, "nd2", "rloc", "rdiag", "rank"]
    bare = points.select("gi", "gj").join(taken.select("gi", "gj"), ["gi", "gj"], "left_anti").withColumn("rank", F.lit(1))
    return taken.select(*columns).unionByName(bare, allowMissingColumns=True)


def counted(local: DataFrame) -> DataFrame:
    """Observations and largest distance of every point, points without any included."""
    return local.groupBy("gi", "gj").agg(F.count("obs_id").alias("n_obs"), F.round(F.sqrt(F.max("nd2")), 6).alias("farthest"))


NO_WEIGHT = 1e-30


RAIN_BASE = 85000.0


def with_vertical_place(obs: DataFrame, rain_base: float = RAIN_BASE, at_height: Column | None = None) -> DataFrame:
    """``obs`` (elm, typ, lev, dat) with ``base`` and ``by_height``: what its vertical distance from a point is taken from.

    Surface pressure lies at the logarithm of its value, rain at that of ``rain_base``, radar types at their height, all others at the
    logarithm of their pressure. A null level or value makes a null place, and such an observation is near to nothing.
    ``at_height`` says which observations lie at their height, whatever their element; without it surface pressure and rain go before the type.
    """
    pressure = (F.col("elm") == codes.ID["PS"]) | (F.col("elm") == codes.ID["PRC"])
    height = (F.col("typ") == codes.RADAR_TYPE) & ~pressure if at_height is None else at_height
    base = F.when(height, F.col("lev")).when(F.col("elm") == codes.ID["PS"], F.ln("dat")).when(F.col("elm") == codes.ID["PRC"], F.lit(math.log(rain_base))).otherwise(F.ln("lev"))
    return obs.withColumns({"base": base, "by_height": height})


def local_observations_3d(points: DataFrame, obs: DataFrame, widest: float, dx: float = 1.0, rain_base: float = RAIN_BASE, at_height: Column | None = None) -> DataFrame:
    """(gi, gj, k, obs_id, nd2, rloc, rdiag) in three dimensions, points without an observation included.

    ``points`` (gi, gj, k, p, z); ``obs`` (obs_id, elm, typ, ri, rj, lev, dat, err, hori_loc, vert_loc, weight), lengths
    being those of its type and ``weight`` that of its class for the variable; ``widest`` bounds ``hori_loc``.
    Vertical places are those of ``with_vertical_place``, which takes ``at_height``; ``vert_loc`` 0 means any level. Comparisons are strict, so a distance
    equal to the cutoff counts.
    """
    width = widest * CUTOFF / dx
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    used = with_vertical_place(obs.filter(F.col("weight") >= NO_WEIGHT), rain_base, at_height).withColumn("n", F.explode(around))
    spread = used.withColumn("bi", F.floor(F.col("ri") / width) + F.col("n.a")).withColumn("bj", F.floor(F.col("rj") / width) + F.col("n.b")).drop("n").alias("o")
    placed = points.withColumn("bi", F.floor(F.col("gi") / width)).withColumn("bj", F.floor(F.col("gj") / width)).alias("p")
    o, p = (lambda c: F.col("o." + c)), (lambda c: F.col("p." + c))
    apart = F.abs(o("base") - F.when(o("by_height"), p("z")).otherwise(F.ln(p("p"))))
    nd_v = F.when(o("vert_loc") == 0, 0.0).otherwise(apart / F.nullif(o("vert_loc"), F.lit(0.0)))
    nd_h = F.hypot(p("gi") - o("ri"), p("gj") - o("rj")) * dx / o("hori_loc")
    nd2 = nd_h * nd_h + nd_v * nd_v
    near = (p("bi") == o("bi")) & (p("bj") == o("bj")) & (nd_v <= CUTOFF) & (nd_h <= CUTOFF) & (nd2 <= LIMIT2)
    joined = placed.join(spread, near, "left").withColumn("nd2", nd2)
    joined = joined.withColumn("rloc", o("weight") * F.exp(-0.5 * F.col("nd2")))
    return joined.select("p.gi", "p.gj", "p.k", "o.obs_id", "nd2", "rloc", (o("err") * o("err") / F.col("rloc")).alias("rdiag"))


def distances(i: np.ndarray, j: np.ndarray, lp: np.ndarray, z: np.ndarray, obs: Mapping[str, np.ndarray], dx: float) -> np.ndarray:
    """Squared normalised distances of points (n) and observations (m), as n x m; infinite beyond the cutoffs.

    ``obs`` has arrays ri, rj, base, by_height, hori_loc and vert_loc, as ``with_vertical_place`` gives them.
    """
    far = np.hypot(i[:, None] - obs["ri"], j[:, None] - obs["rj"]) * dx / obs["hori_loc"]
    apart = np.abs(np.where(obs["by_height"], z[:, None], lp[:, None]) - obs["base"])
    high = np.where(obs["vert_loc"] > 0, apart / np.where(obs["vert_loc"] > 0, obs["vert_loc"], 1.0), 0.0)
    nd2 = far * far + high * high
    with np.errstate(invalid="ignore"):
        return np.where((far <= CUTOFF) & (high <= CUTOFF) & (nd2 <= LIMIT2), nd2, np.inf)


def nearest_positions(obs: DataFrame, cells: DataFrame, reach: float, most: int = 4) -> DataFrame:
    """(obs_id, oi, oj): place on a curvilinear grid as the mean of the ``most`` nearest cells, by inverse squared distance.

    ``obs`` (obs_id, x, y), ``cells`` (i, j, x, y), on one plane; ``reach`` bounds the search. Both sides meet by an
    equi-join on square buckets; fewer cells in reach than asked for give a null place, a cell's own place is its own.
    """
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    near = obs.withColumn("n", F.explode(around)).select("obs_id", F.col("x").alias("ox"), F.col("y").alias("oy"), (F.floor(F.col("x") / reach) + F.col("n.a")).alias("bi"), (F.floor(F.col("y") / reach) + F.col("n.b")).alias("bj"))
    put = cells.withColumns({"bi": F.floor(F.col("x") / reach), "bj": F.floor(F.col("y") / reach)})
    met = near.join(put, ["bi", "bj"]).withColumn("d2", F.pow(F.col("x") - F.col("ox"), F.lit(2.0)) + F.pow(F.col("y") - F.col("oy"), F.lit(2.0))).filter(F.col("d2") <= reach * reach)
    best = met.withColumn("rank", F.row_number().over(Window.partitionBy("obs_id").orderBy("d2", "j", "i"))).filter(F.col("rank") <= most)
    inverse = F.when(F.col("d2") > 0, 1 / F.nullif(F.col("d2"), F.lit(0.0)))
    exact = lambda c: F.min(F.when(F.col("d2") == 0, F.col(c).cast("double")))
    whole = F.count("*") >= most
    place = lambda c: F.when(whole, F.coalesce(exact(c), F.sum(F.col(c) * inverse) / F.sum(inverse)))
    found = best.groupBy("obs_id").agg(place("i").alias("oi"), place("j").alias("oj"))
    return obs.select("obs_id").join(found, "obs_id", "left")


def containing_positions(obs: DataFrame, points: DataFrame, width: float, at_corner: bool = True) -> DataFrame:
    """(obs_id, oi, oj): place on a curvilinear grid by the cell whose range of longitude and latitude holds it.

    ``obs`` (obs_id, lon, lat) with one row per id, ``points`` (i, j, lon, lat). Of several cells the one with the largest j counts, and of
    these the one with the smallest i; its corners weigh by inverse squared distance on the sphere, a corner's own place is its own, or without
    ``at_corner`` not a number, as infinite weights leave it. Outside of all cells, or for a null place, oi and oj are null. Cells and observations meet by an equi-join on buckets of ``width``
    degrees, a cell in each bucket that it touches; ``width`` should be near a cell's size.
    """
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    owned = points.withColumn("c", corner).select((F.col("i") - F.col("c.a")).alias("i"), (F.col("j") - F.col("c.b")).alias("j"), F.struct("c.a", "c.b", "lon", "lat").alias("corner"))
    ends = [f(f"corner.{c}").alias(f"{c}_{n}") for c in ("lon", "lat") for n, f in (("low", F.min), ("high", F.max))]
    cells = owned.groupBy("i", "j").agg(F.collect_list("corner").alias("corners"), *ends).filter(F.size("corners") == 4)
    bucket = lambda c: F.floor(F.col(c) / width)
    put = cells.withColumn("bx", F.explode(F.sequence(bucket("lon_low"), bucket("lon_high")))).withColumn("by", F.explode(F.sequence(bucket("lat_low"), bucket("lat_high"))))
    met = obs.select("obs_id", "lon", "lat", bucket("lon").alias("bx"), bucket("lat").alias("by")).join(put, ["bx", "by"])
    inside = met.filter(F.col("lon").between(F.col("lon_low"), F.col("lon_high")) & F.col("lat").between(F.col("lat_low"), F.col("lat_high")))
    last = F.max(F.struct("j", (-F.col("i")).alias("i"), "corners")).alias("cell")
    weighed = inside.groupBy("obs_id", "lon", "lat").agg(last).select("obs_id", F.inline(F.transform("cell.corners", lambda c: F.struct(
        (c.a - F.col("cell.i")).alias("i"), (c.b + F.col("cell.j")).alias("j"), physics.great_circle(c.lon, c.lat, F.col("lon"), F.col("lat")).alias("d")))))
    inverse = 1 / F.nullif(F.col("d") * F.col("d"), F.lit(0.0))
    own = lambda c: F.min(F.when(F.col("d") == 0, F.col(c).cast("double") if at_corner else F.lit(float("nan"))))
    place = lambda c: F.coalesce(own(c), F.sum(F.col(c) * inverse) / F.sum(inverse))
    return obs.select("obs_id").join(weighed.groupBy("obs_id").agg(place("i").alias("oi"), place("j").alias("oj")), "obs_id", "left")
