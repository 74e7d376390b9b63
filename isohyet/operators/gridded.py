"""Departures and members of observations of a two-dimensional ensemble, from a table of its cells: no row of an observation and a member."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.operators import localization
from isohyet.operators import observations as ob
from isohyet.sources import states

CORNERS = ((0, 0), (0, 1), (1, 0), (1, 1))
PAIRS = [(a, b) for a in range(4) for b in range(a, 4)]


def _cells(grid: DataFrame) -> DataFrame:
    """(i, j, mem, x0, x1, x2, x3): a member's values at the corners of each cell, null where it has none."""
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in CORNERS]))
    owned = grid.select("gi", "gj", "mem", "x", corner.alias("c"))
    values = [F.sum(F.when((F.col("c.a") == a) & (F.col("c.b") == b), F.col("x"))).alias(f"x{n}") for n, (a, b) in enumerate(CORNERS)]
    return owned.groupBy((F.col("gi") - F.col("c.a")).cast("int").alias("i"), (F.col("gj") - F.col("c.b")).cast("int").alias("j"), "mem").agg(*values)


def _mask(given: list[Column]) -> Column:
    """Bit n is set where the n-th of ``given`` holds."""
    return sum((F.when(c, 1 << n).otherwise(0) for n, c in enumerate(given)), F.lit(0))


def _in_cell(obs: DataFrame) -> DataFrame:
    """``obs`` with its cell (i, j), the weights w0 to w3 of the cell's corners, and ``use``, a mask of those that are not 0."""
    i, j = (F.greatest(F.ceil(c) - 1, F.lit(1)).cast("int") for c in ("ri", "rj"))
    placed = obs.withColumns({"i": i, "j": j}).withColumns({"_di": F.col("ri") - F.col("i"), "_dj": F.col("rj") - F.col("j")})
    weights = {f"w{n}": (F.col("_di") if a else 1 - F.col("_di")) * (F.col("_dj") if b else 1 - F.col("_dj")) for n, (a, b) in enumerate(CORNERS)}
    weighed = placed.withColumns(weights).drop("_di", "_dj")
    return weighed.withColumn("use", _mask([F.col(w) != 0 for w in weights]))


def _moments(grid: DataFrame) -> DataFrame:
    """(i, j, groups): of the members of a cell that have the same corners, their number, means and sums of products of deviations; one group where the grid is whole."""
    held = _cells(grid).withColumn("mask", _mask([F.col(f"x{n}").isNotNull() for n in range(4)])).filter("mask > 0")
    n, none = F.count("*"), F.lit(0.0)
    means = F.array(*[F.coalesce(F.avg(f"x{a}"), none) for a in range(4)])
    products = F.array(*[F.coalesce(F.covar_pop(f"x{a}", f"x{b}") * n, none) for a, b in PAIRS])
    groups = held.groupBy("i", "j", "mask").agg(n.alias("n"), means.alias("m"), products.alias("c"))
    return groups.groupBy("i", "j").agg(F.array_sort(F.collect_list(F.struct("mask", "n", "m", "c"))).alias("groups"))


def _with_moments(obs: DataFrame, grid: DataFrame) -> DataFrame:
    """``obs`` with hx_mean and hx_sprd, null for rows with a code or without an id. A mean over members is linear in the corners' weights and a variance quadratic, so sums over a cell's members do for all that lies in it."""
    w = [F.col(f"w{n}") for n in range(4)]
    total = lambda terms: sum(terms[1:], terms[0])
    own = F.transform(
        F.filter("groups", lambda g: g["mask"].bitwiseAND(F.col("use")) != 0),
        lambda g: F.struct(g["n"].alias("n"), total([w[a] * g["m"][a] for a in range(4)]).alias("m"), total([w[a] * w[b] * g["c"][k] * (1 if a == b else 2) for k, (a, b) in enumerate(PAIRS)]).alias("s")),
    )
    met = _in_cell(obs).join(_moments(grid), ["i", "j"], "left").withColumn("own", F.when((F.col("qc") == 0) & F.col("obs_id").isNotNull(), own))
    met = met.withColumn("_n", F.aggregate("own", F.lit(0).cast("long"), lambda t, g: t + g["n"]))
    met = met.withColumn("hx_mean", F.when(F.col("_n") > 0, F.aggregate("own", F.lit(0.0), lambda t, g: t + g["n"] / F.col("_n") * g["m"])))
    square = F.aggregate("own", F.lit(0.0), lambda t, g: t + g["s"] + g["n"] * (g["m"] - F.col("hx_mean")) * (g["m"] - F.col("hx_mean")))
    met = met.withColumn("hx_sprd", F.when(F.col("_n") > 1, F.sqrt(F.greatest(square, F.lit(0.0)) / (F.col("_n") - 1))))
    return met.select(*obs.columns, "hx_mean", "hx_sprd")


class Simulated:
    """What an ensemble ``grid`` (gi, gj, mem, x) says of observations ``obs`` (obs_id, ri, rj, dat, err, qc), those without a code.

    Observations that share an id count as one whose values are added up, as when members are rows: they alone are worked on by rows. Ids are counted
    once, when that is first asked for.
    """

    def __init__(self, obs: DataFrame, grid: DataFrame):
        self.obs, self.grid = obs, grid

    @cached_property
    def repeated(self) -> DataFrame | None:
        """Ids of more than one row, if there are any."""
        again = states.kept(self.obs.groupBy("obs_id").agg(F.count("*").alias("n")).filter("n > 1 and obs_id is not null").select("obs_id"), "repeated")
        return None if again.isEmpty() else again

    def _parts(self, obs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Observations whose id is their own, and the others."""
        if self.repeated is None:
            return obs, None
        return obs.join(self.repeated, "obs_id", "left_anti"), obs.join(self.repeated, "obs_id", "left_semi")

    def departures(self, threshold: float = 5.0) -> DataFrame:
        """The rows of ``observations.departures`` for all members, without a row of any."""
        single, shared = self._parts(self.obs)
        out = ob.coded_departures(_with_moments(single, self.grid), threshold)
        if shared is None:
            return out
        return out.unionByName(ob.departures(shared, ob.interpolated(shared.filter("qc = 0"), self.grid), threshold).select(*out.columns))

    def seen(self, dep: DataFrame, columns: list[str]) -> DataFrame:
        """Good observations of ``dep`` (``columns``) with dep and hx_sprd, one row for each row of their id, as a join by id gives them."""
        good = dep.filter("qc = 0")
        if self.repeated is None:
            return good.select(*columns, "dep", "hx_sprd")
        single, shared = self._parts(good)
        joined = shared.select(*columns).join(dep.select("obs_id", "dep", "hx_sprd"), "obs_id")
        return single.select(*columns, "dep", "hx_sprd").unionByName(joined)

    def members(self, good: DataFrame) -> DataFrame:
        """``good``, rows of the observations without a code (obs_id, ri, rj, ...), with ``y``: their centred simulated members in the order of ``mem``. Those without any have no row."""
        single, shared = self._parts(good.filter("obs_id is not null"))
        held = _cells(self.grid).groupBy("i", "j").agg(F.array_sort(F.collect_list(F.struct("mem", *[f"x{n}" for n in range(4)]))).alias("s"))
        given = lambda s: _mask([s[f"x{n}"].isNotNull() for n in range(4)]).bitwiseAND(F.col("use")) != 0
        value = lambda s: sum((F.col(f"w{n}") * F.coalesce(s[f"x{n}"], F.lit(0.0)) for n in range(1, 4)), F.col("w0") * F.coalesce(s["x0"], F.lit(0.0)))
        out = _in_cell(single).join(held, ["i", "j"]).select(*good.columns, F.transform(F.filter("s", given), value).alias("h")).filter("size(h) > 0")
        if shared is not None:
            ordered = F.transform(F.array_sort(F.collect_list(F.struct("mem", "hx"))), lambda s: s["hx"])
            hx = ob.interpolated(self.obs.filter("qc = 0").join(self.repeated, "obs_id", "left_semi"), self.grid).groupBy("obs_id").agg(ordered.alias("h"))
            out = out.unionByName(shared.join(hx, "obs_id"))
        out = out.withColumn("_m", F.aggregate("h", F.lit(0.0), lambda t, h: t + h) / F.size("h"))
        return out.select(*good.columns, F.transform("h", lambda h: h - F.col("_m")).alias("y"))

    def felt(self, good: DataFrame, points: DataFrame, scale: float, most: int | None = None) -> DataFrame:
        """``good`` (obs_id, elm, typ, ri, rj, err, dep, ...) with ``y``; with ``most``, of them those alone that are among the ``most`` nearest of their class for any of ``points`` (gi, gj), so that members are simulated for what is left.

        With ``most``, ``good`` is read several times, so it should be a table.
        """
        good = good.filter("obs_id is not null and dep is not null")
        if most is not None:
            classed = good.select("obs_id", "elm", "typ", "ri", "rj", "err").withColumn("limit_group", localization.limit_group(F.col("elm"), F.col("typ")))
            best = localization.best_local(points, classed, scale, most).filter("obs_id is not null").select("obs_id").distinct()
            good = good.join(states.kept(best, "best"), "obs_id", "left_semi")
        return self.members(good)
