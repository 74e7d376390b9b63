"""Three dimensions and several variables: columns at observations, simulated values, and the whole analysis by tiles."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.functions import codes, geometry, physics
from isohyet.operators import tiles
from isohyet.operators.kernels import adapted_factor, spread_factor
from isohyet.operators.localization import CUTOFF, NO_WEIGHT, ORDERS, RAIN_BASE, distances, with_vertical_place
from isohyet.operators.model import simulated, simulated_radar
from isohyet.sources import states


def _corners(obs: DataFrame, axes: Sequence[tuple[str, str]]) -> DataFrame:
    """A row per observation and corner of its cell, with its weight; corners without weight are left out.

    ``axes`` pairs fractional positions with names of grid indices. A position on a grid node belongs to the cell before it.
    """
    out = obs
    for place, index in axes:
        low = F.greatest(F.ceil(place) - 1, F.lit(1)).cast("int")
        part = F.col(place) - low
        side = F.array(F.struct(low.alias("at"), (1 - part).alias("w")), F.struct((low + 1).alias("at"), part.alias("w")))
        out = out.withColumn("_side", F.explode(side)).filter(f"_side.w <> 0 and {place} >= 1")
        weight = F.col("_side.w") if "wt" not in out.columns else F.col("wt") * F.col("_side.w")
        out = out.withColumns({index: F.col("_side.at"), "wt": weight}).drop("_side")
    return out


def interpolated(obs: DataFrame, state: DataFrame, variables: Sequence[str]) -> DataFrame:
    """(obs_id, mem, variables): trilinear values at observations (obs_id, ri, rj, rk); a hash join on up to eight corners.

    An observation of which a corner is not on the grid has no row.
    """
    corners = _corners(obs.select("obs_id", "ri", "rj", "rk"), (("ri", "gi"), ("rj", "gj"), ("rk", "k"))).select("obs_id", "gi", "gj", "k", "wt")
    met = corners.join(state.select("gi", "gj", "k", "mem", *variables), ["gi", "gj", "k"]).groupBy("obs_id", "mem")
    sums = met.agg(F.sum("wt").alias("whole"), *[F.sum(F.col("wt") * F.col(v)).alias(v) for v in variables])
    return sums.filter("abs(whole - 1) < 1e-9").drop("whole")


def with_humidity(state: DataFrame) -> DataFrame:
    """``state`` (t, q, p) with relative humidity ``rh`` and terrain ``topo``, where it lacks them; terrain is then 0."""
    rh = F.col("rh") if "rh" in state.columns else physics.relative_humidity(F.col("t"), F.col("q"), F.col("p"))
    topo = F.col("topo") if "topo" in state.columns else F.lit(0.0)
    return state.withColumns({"rh": rh, "topo": topo})


def observed(obs: DataFrame, state: DataFrame) -> DataFrame:
    """(obs_id, mem, qc, hx): the observation operator on each member's own column.

    ``obs`` (obs_id, elm, ri, rj, lev, qc) has pressures as levels, and heights for surface elements; ``state`` (gi, gj, k,
    mem, p, u, v, t, q, and where given rh and topo) has its lowest level first. Upper-air elements, relative humidity among them, are interpolated in the
    logarithm of pressure between the levels around them, with codes above and below the model; surface pressure is that of the lowest level, whose
    temperature and moisture adjust it from the terrain to the station. Observations with a code have no rows, nor have those beside the
    grid; rows with a code of their own have no value.
    """
    good = obs.filter("qc = 0")
    upper = F.col("elm") <= 9999
    placed = good.select("obs_id", "ri", "rj", F.when(upper, F.ln("lev")).otherwise(0.0).alias("at"))
    found = tiles.columns_at(placed, with_humidity(state).withColumn("lp", F.ln("p")), "lp", ("u", "v", "t", "q", "rh", "topo"), downward=True)
    joined = found.join(good.select("obs_id", "elm", "lev"), "obs_id")
    code = F.when(upper & (F.col("inside") < 0), codes.BELOW_MODEL).when(upper & (F.col("inside") > 0), codes.ABOVE_MODEL).otherwise(codes.GOOD)
    surface = {"ps": F.exp("lp_1"), "t2": F.col("t_1"), "q2": F.col("q_1"), "topo": F.col("topo_1"), "rk": F.when(~upper, F.col("lev"))}
    ready = joined.select("obs_id", "mem", "elm", code.alias("qc"), "u", "v", "t", "q", "rh", *[c.alias(n) for n, c in surface.items()])
    return simulated(ready).select("obs_id", "mem", "qc", F.when(F.col("qc") == 0, F.col("hx")).alias("hx"))


RADAR_VARIABLES = ("u", "v", "w", "t", "p", "q", "qc", "qr", "qi", "qs", "qg")
RADAR_METHODS = (1, 2, 3)


def observed_radar(obs: DataFrame, state: DataFrame, site: tuple[float, float, float], method: int = 3, fall: bool = True, least: float = 10.0, least_dbz: float = 10.0, shift: float = 0.0) -> DataFrame:
    """(obs_id, mem, qc, hx): reflectivity in dBZ, or wind along the beam of the radar at ``site`` (lon, lat, z), of each member.

    ``obs`` (obs_id, elm, lon, lat, ri, rj, lev, qc) has heights as levels; ``state`` (gi, gj, k, mem, z and RADAR_VARIABLES) has its lowest level first.
    All eleven variables are interpolated between the levels around the height. ``method`` is that of the reflectivity; with ``fall`` the particles'
    fall speed is taken off the vertical wind. Codes are those of ``simulated_radar``, and those above and below the model, which have no value.
    """
    if method not in RADAR_METHODS:
        raise ValueError(f"method {method} is none of {RADAR_METHODS}")
    good = obs.filter("obs_id is not null and qc = 0")
    found = tiles.columns_at(good.select("obs_id", "ri", "rj", F.col("lev").alias("at")), state, "z", RADAR_VARIABLES, downward=False)
    gas = codes.R_DRY * (1 - F.col("q") - F.col("qc") - F.col("qr") - F.col("qi") - F.col("qs") - F.col("qg")) + codes.R_VAPOUR * F.col("q")
    air = found.withColumn("rho", F.col("p") / (gas * F.col("t")))
    if method == 1:
        echo = air.withColumns({"ref": physics.reflectivity_of_total(F.col("rho"), F.col("qr"), F.col("qs"), F.col("qg")), "fall": physics.terminal_velocity(F.col("qr") + F.col("qs") + F.col("qg"), F.col("p"))})
    else:
        echo = physics.with_reflectivity_by_species(air) if method == 2 else physics.with_reflectivity_melting(air)
    met = echo.select("obs_id", "mem", "inside", "u", "v", "w", "ref", "fall").join(good.select("obs_id", "elm", "lon", "lat", "lev"), "obs_id")
    azimuth, elevation = geometry.beam(F.col("lon"), F.col("lat"), F.col("lev"), tuple(F.lit(float(x)) for x in site))
    met = met.withColumns({"az": azimuth, "el": elevation})
    code = F.when(F.col("inside") < 0, codes.BELOW_MODEL).when(F.col("inside") > 0, codes.ABOVE_MODEL).otherwise(codes.GOOD)
    met = met.withColumns({"vr": physics.radial_velocity(F.col("u"), F.col("v"), F.col("w"), F.col("az"), F.col("el"), F.col("fall") if fall else None), "qc": code})
    told = simulated_radar(met, least, least_dbz, shift)
    return told.select("obs_id", "mem", "qc", F.when(F.col("inside") == 0, F.col("hx")).alias("hx"))


def simulated_fields(state: DataFrame, elements: Sequence[str]) -> DataFrame:
    """(gi, gj, k, mem, elm, hx, qc): what would be observed at every grid point, for each element by name; surface pressure at the terrain's height."""
    rows = with_humidity(state).withColumn("elm", F.explode(F.array(*[F.lit(codes.ID[e]) for e in elements])))
    surface = {"ps": F.col("p"), "t2": F.col("t"), "q2": F.col("q"), "rk": F.col("topo"), "qc": F.lit(0)}
    return simulated(rows.withColumns(surface)).select("gi", "gj", "k", "mem", "elm", "hx", "qc")


def to_history(state: DataFrame) -> DataFrame:
    """The diagnostic table of a state (gi, gj, k, mem, u, v, t, p, q, height): each level with its column's surface values.

    Terrain is that of the state, or the lowest level's height; surface pressure, wind, temperature and moisture are that level's.
    """
    first = state.groupBy("gi", "gj", "mem").agg(F.min_by(F.struct("height", "p", "u", "v", "t", "q"), "k").alias("s"))
    named = {"topo": "height", "ps": "p", "u10": "u", "v10": "v", "t2": "t", "q2": "q"}
    rh = physics.relative_humidity(F.col("t"), F.col("q"), F.col("p"))
    named = {n: c for n, c in named.items() if n not in state.columns}
    return state.join(first, ["gi", "gj", "mem"]).select(*state.columns, *[F.col(f"s.{c}").alias(n) for n, c in named.items()], *([] if "rh" in state.columns else [rh.alias("rh")]))


def land(topo: Column) -> Column:
    """Share of land of a point by its height: 0 up to 10 m, 1 from 11 m."""
    return F.least(F.greatest(topo - 10.0, F.lit(0.0)), F.lit(1.0))


def _best(nd2: np.ndarray, group: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Positions of the ``most`` nearest of each group, ties to smaller ids."""
    order = np.lexsort((ids, nd2, group))
    first = np.flatnonzero(np.diff(group[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return np.sort(order[rank < most])


def transforms(square: np.ndarray, pull: np.ndarray, inflation: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of perturbations and of the mean, and covariances, for stacks of Y'R^-1Y (n x m x m) and Y'R^-1d (n x m)."""
    m = square.shape[-1]
    values, vectors = np.linalg.eigh(square + np.eye(m) * ((m - 1) / inflation)[:, None, None])
    turned = np.swapaxes(vectors, 1, 2)
    covariance = (vectors / values[:, None, :]) @ turned
    return (vectors * np.sqrt((m - 1) / values)[:, None, :]) @ turned, (covariance @ pull[:, :, None])[:, :, 0], covariance


@dataclass(frozen=True)
class _Setup:
    """What a task has to know of the analysis."""

    names: tuple[str, ...]
    patterns: tuple[tuple[tuple, tuple[str, ...]], ...]  # weights of elements, and the variables that have them
    fields: tuple[str, ...]
    most: int | None
    dx: float
    inflation: float
    least_inflation: float
    rtpp: float
    rtps: float
    moist: tuple[str, ...]
    moist_top: float
    place: tuple[str, str, str] = ("int", "int", "int")  # types of gi, gj and k
    order: str = "distance"

    def schema(self) -> str:
        return ", ".join(f"{c} {t}" for c, t in zip(("gi", "gj", "k"), self.place, strict=True)) + ", mem int, " + ", ".join(f"{v} double" for v in self.names) + ", n_obs int, infl double" + "".join(f", relax_{v} double" for v in self.names)

    def partial(self) -> str:
        return PARTIAL.format("".join(f"{c} {t}, " for c, t in zip(("gi", "gj", "k"), self.place, strict=True)).rstrip())


class _Points:
    """A table of points: places, members of each variable, and fields."""

    def __init__(self, table: pa.Table, setup: _Setup):
        self.n = len(table)
        self.gi, self.gj, self.k, self.p = (tiles.values(table, c) for c in ("gi", "gj", "k", "p"))
        self.z, self.lp = tiles.values(table, "z").astype(float), np.log(self.p)  # heights that are not given are no numbers, and near to nothing
        self.mems = tiles.matrix(table, "mems")
        self.x = {v: tiles.matrix(table, v) for v in setup.names}
        given = tiles.values(table, "infl") if "infl" in setup.fields else np.full(self.n, float(setup.inflation))
        self.infl = np.maximum(given, setup.least_inflation or -np.inf)
        self.beta = tiles.values(table, "beta") if "beta" in setup.fields else np.ones(self.n)


class _Felt:
    """A table of observations, in the order of their ids, and which of them each point feels."""

    def __init__(self, table: pa.Table, members: int):
        table = table.sort_by("obs_id")
        self.ids, self.elm, typ, err, self.dep = (tiles.values(table, c) for c in ("obs_id", "elm", "typ", "err", "dep"))
        self.variance = err**2
        self.y = tiles.matrix(table, "y") if len(table) else np.zeros((0, members))
        self.places = {c: tiles.values(table, c) for c in ("ri", "rj", "base", "by_height", "hori_loc", "vert_loc")}
        merged = np.where((typ == codes.RADAR_TYPE) & (self.elm == codes.ID["RE0"]), codes.ID["REF"], self.elm)
        self.group = np.unique(np.stack([merged, typ]), axis=1, return_inverse=True)[1].ravel() if len(self.ids) else self.ids

    def of(self, points: _Points, setup: _Setup) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(point, positions of its observations, squared distances), column by column: the horizontal search is one for all levels."""
        if not points.n:
            return
        order = np.lexsort((points.k, points.gj, points.gi))
        new = np.flatnonzero(np.append(True, (np.diff(points.gi[order]) != 0) | (np.diff(points.gj[order]) != 0)))
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(order)], strict=True):
            js = order[a:b]
            i, j = points.gi[js[0]], points.gj[js[0]]
            reach = CUTOFF * self.places["hori_loc"] / setup.dx
            near = np.flatnonzero((np.abs(i - self.places["ri"]) <= reach) & (np.abs(j - self.places["rj"]) <= reach))
            own = {c: v[near] for c, v in self.places.items()}
            for c in range(0, len(js), 16):
                some = js[c : c + 16]
                nd2 = distances(points.gi[some], points.gj[some], points.lp[some], points.z[some], own, setup.dx)
                for row, point in zip(nd2, some.tolist(), strict=True):
                    mine = np.flatnonzero(np.isfinite(row))
                    d2, mine = row[mine], near[mine]
                    if setup.most is not None and len(mine):
                        value = self.variance[mine] / np.exp(-0.5 * d2) if setup.order == "error" else d2
                        best = _best(np.round(value, 9), self.group[mine], self.ids[mine], setup.most)
                        mine, d2 = mine[best], d2[best]
                    yield point, mine, d2

    def factor(self, pattern: tuple) -> np.ndarray:
        out = np.ones(len(self.ids))
        for element, w in pattern:
            out[self.elm == element] = w
        return out


#: Sums over a point's observations: Y'R^-1Y (upper triangle), Y'R^-1d, their number, and d'R^-1d, trace of Y'R^-1Y over m - 1, sum of weights.
SUMS = ("square", "pull", "n_used", "p1", "p2", "p3")


def _sums(felt: _Felt, members: int, taken: list[tuple[np.ndarray, np.ndarray]], pattern: tuple) -> dict[str, np.ndarray]:
    n, m = len(taken), members
    factor = felt.factor(pattern)
    out = {"square": np.zeros((n, m, m)), "pull": np.zeros((n, m)), **{c: np.zeros(n) for c in SUMS[2:]}}
    for j, (mine, nd2) in enumerate(taken):
        use = factor[mine] >= NO_WEIGHT
        at = mine[use]
        weight = factor[at] * np.exp(-0.5 * nd2[use])
        inverse = weight / felt.variance[at]
        scaled = felt.y[at] * inverse[:, None]
        out["square"][j], out["pull"][j] = scaled.T @ felt.y[at], felt.dep[at] @ scaled
        out["n_used"][j], out["p1"][j], out["p3"][j] = len(at), (felt.dep[at] ** 2 * inverse).sum(), weight.sum()
        out["p2"][j] = np.trace(out["square"][j]) / (m - 1)
    return out


def _finished(points: _Points, js: np.ndarray, setup: _Setup, sums: list[dict[str, np.ndarray]], counts: np.ndarray) -> pa.Table:
    """Analysed members of the points ``js`` from the sums of each pattern."""
    m = points.mems.shape[1]
    infl, beta = points.infl[js], points.beta[js]
    out, relaxation = {}, {}
    for (_, same), told in zip(setup.patterns, sums, strict=True):
        some = told["n_used"] > 0
        w, mean, covariance = transforms(told["square"], told["pull"], infl)
        w[~some] = np.sqrt(infl[~some])[:, None, None] * np.eye(m)
        if setup.rtpp:
            relaxed = np.where(some, setup.rtpp, 0.0)[:, None, None]
            w = (1 - relaxed) * w + relaxed * np.sqrt(infl)[:, None, None] * np.eye(m)
        for v in same:
            x = points.x[v][js]
            centre = x.mean(axis=1, keepdims=True)
            own, relaxed = w, np.ones(len(js))
            if setup.rtps and not setup.rtpp:
                relaxed = np.array([spread_factor(x[j] - centre[j], covariance[j], infl[j], setup.rtps) if some[j] else 1.0 for j in range(len(js))])
                own = w * relaxed[:, None, None]
            relaxation[f"relax_{v}"] = relaxed
            update = beta[:, None, None] * (own + mean[:, :, None]) + (1 - beta)[:, None, None] * np.eye(m)
            new = centre + ((x - centre)[:, None, :] @ update)[:, 0]
            keep = (beta == 0) | (points.p[js] < setup.moist_top if v in setup.moist else np.zeros(len(js), bool))
            out[v] = np.where(keep[:, None], x, new).ravel()
    first = sums[0]
    adapted = np.array([adapted_factor(*(first[c][j] for c in ("p1", "p2", "p3")), infl[j]) for j in range(len(js))])
    repeat = lambda a, kind: np.repeat(a, m).astype(kind)
    place = {c: repeat(getattr(points, c)[js], _KINDS[t].to_pandas_dtype()) for c, t in zip(("gi", "gj", "k"), setup.place, strict=True)}
    return pa.table({**place, "mem": points.mems[js].ravel().astype(np.int32), **{v: out[v] for v in setup.names}, "n_obs": repeat(counts, np.int32), "infl": repeat(adapted, float), **{f"relax_{v}": repeat(relaxation[f"relax_{v}"], float) for v in setup.names}})


AT_ONCE_BYTES = 64 << 20  # of the matrices of points that are worked on together


def _slices(n: int, members: int) -> Iterator[np.ndarray]:
    step = max(1, AT_ONCE_BYTES // (8 * members * members))
    for a in range(0, n, step):
        yield np.arange(a, min(n, a + step))


_KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}


def _empty(setup: _Setup) -> pa.Table:
    return pa.table({c: pa.array([], _KINDS[t]) for c, t in (part.split() for part in setup.schema().split(", "))})


def _whole_tile(setup: _Setup):
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        """The analysis of a tile whose observations are in one place."""
        if not len(left):
            return _empty(setup)
        points = _Points(left, setup)
        m = points.mems.shape[1]
        felt = _Felt(right, m)
        taken: list = [None] * points.n
        for j, mine, nd2 in felt.of(points, setup):
            taken[j] = (mine, nd2)
        parts = []
        for js in _slices(points.n, m):
            own = [taken[j] for j in js]
            parts.append(_finished(points, js, setup, [_sums(felt, m, own, pattern) for pattern, _ in setup.patterns], np.array([len(t[0]) for t in own])))
        return pa.concat_tables(parts)

    return work


PARTIAL = "{} pattern int, square array<double>, pull array<double>, n_used double, p1 double, p2 double, p3 double, n_obs long"


def _partial_sums(setup: _Setup):
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        """Sums of a part of a tile's observations for each point that feels any of them."""
        points = _Points(left, setup) if len(left) else None
        m = points.mems.shape[1] if points else 1
        felt, upper = _Felt(right, m), np.triu_indices(m)
        kinds = dict(zip(("gi", "gj", "k"), setup.place, strict=True)) | {"pattern": "int", "n_obs": "long"}
        rows: dict[str, list] = {c.split()[0]: [] for c in setup.partial().split(", ")}
        taken = {j: (mine, nd2) for j, mine, nd2 in felt.of(points, setup) if len(mine)} if points else {}
        for js in _slices(len(taken), m):
            at = [list(taken)[k] for k in js]
            for number, (pattern, _) in enumerate(setup.patterns):
                told = _sums(felt, m, [taken[j] for j in at], pattern)
                for c in ("gi", "gj", "k"):
                    rows[c].append(getattr(points, c)[at])
                rows["pattern"].append(np.full(len(at), number, np.int32))
                rows["square"].append(told["square"][:, upper[0], upper[1]])
                rows["n_obs"].append(np.array([len(taken[j][0]) for j in at]))
                for c in SUMS[1:]:
                    rows[c].append(told[c])
        flat = lambda parts: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([p.shape[1] for p in parts for _ in range(len(p))])).astype(np.int32)), pa.array(np.concatenate([p.ravel() for p in parts]) if parts else np.zeros(0)))
        return pa.table({c: flat(v) if c in ("square", "pull") else pa.array(np.concatenate(v) if v else np.zeros(0)).cast(_KINDS[kinds.get(c, "double")]) for c, v in rows.items()})

    return work


def _added_up(setup: _Setup):
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        """The analysis of a column from the sums of all parts."""
        if not len(left):
            return _empty(setup)
        points = _Points(left, setup)
        m = points.mems.shape[1]
        upper = np.triu_indices(m)
        place = {int(k): j for j, k in enumerate(points.k)}
        sums = [{"square": np.zeros((points.n, m, m)), "pull": np.zeros((points.n, m)), **{c: np.zeros(points.n) for c in SUMS[2:]}} for _ in setup.patterns]
        counts = np.zeros(points.n, np.int64)
        if len(right):
            at = np.array([place.get(int(k), -1) for k in tiles.values(right, "k")])
            pattern, told = tiles.values(right, "pattern"), {c: tiles.values(right, c) for c in SUMS[2:]}
            square, pull, n_obs = tiles.matrix(right, "square"), tiles.matrix(right, "pull"), tiles.values(right, "n_obs")
            for r in np.lexsort((told["p1"], pattern, at)):  # an order of their own, so that sums do not hang on that of the rows
                if at[r] < 0:
                    continue
                own = sums[pattern[r]]
                own["square"][at[r]][upper] += square[r]
                own["pull"][at[r]] += pull[r]
                for c in SUMS[2:]:
                    own[c][at[r]] += told[c][r]
                counts[at[r]] += n_obs[r] if pattern[r] == 0 else 0
        for own in sums:
            own["square"] = own["square"] + np.triu(own["square"], 1).swapaxes(1, 2)
        return _finished(points, np.arange(points.n), setup, sums, counts)

    return work


def _pruned(setup: _Setup):
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        """Those of a part's observations that are among the best of their class for some point of the tile."""
        right = right.sort_by("obs_id")
        wanted = np.zeros(len(right), bool)
        if len(left) and len(right):
            points = _Points(left, setup)
            for _, mine, _ in _Felt(right, points.mems.shape[1]).of(points, setup):
                wanted[mine] = True
        return right.filter(pa.array(wanted)).drop_columns(["part"])

    return work


def analysis_by_tile(
    state: DataFrame, variables: Sequence[str], obs: DataFrame, weights: Mapping[str, Mapping[int, float]] | None = None, widest: float = 1.0, dx: float = 1.0, tile: int = 8, most: int | None = None,
    inflation: float = 1.0, least_inflation: float = 0.0, rtpp: float = 0.0, rtps: float = 0.0, moist: Sequence[str] = (), moist_top: float = 0.0, rain_base: float = RAIN_BASE, adaptive: bool = False, order: str = "distance", relaxation: bool = False, of_a_task: int = tiles.OBS_OF_A_TASK,
) -> DataFrame:
    """(gi, gj, k, mem, variables, n_obs): the localized analysis of every point, level and variable.

    ``state`` (gi, gj, k, mem, p, variables; gi and gj may lie between points of a grid; and where given heights ``z``, a field ``infl`` of inflation by point and ``beta``, the taper of its
    update); ``obs`` (obs_id, elm, typ, ri, rj, lev, dat, err, dep, hori_loc, vert_loc, y) with the centred members ``y`` in the order of
    ``mem``. ``weights`` gives, by variable, the weight of elements other than 1; variables with equal weights share a
    transform. At most ``most`` observations of a class (element and type, both reflectivities of a radar being one) count,
    the nearest ones, or by ``order`` those of the largest weight (``weight``) or of the least variance over weight (``error``). ``moist`` variables are left as they are where the mean pressure is below ``moist_top``, all are where ``beta`` is 0.
    With ``adaptive``, a further column ``infl`` has each point's factor after one adaptive update by the observations of its first variable; with
    ``relaxation``, columns ``relax_`` of each variable have the factors by which its spread was relaxed.

    Points and observations meet tile by tile: an observation is sent once to each tile of ``tile`` x ``tile`` columns within
    reach of it, members with it, and a tile's points choose from it there. Its matrices are decomposed together, some of them at a time.
    A tile with more than ``of_a_task`` observations is worked on in parts: with ``most``, each part keeps what is among the best of some
    point, and these meet; without, each part sums up its observations for every point, and sums are added before they are decomposed.
    Observations are written to the shared folder first, since tiles are counted before they are worked on.
    Vertical places are those of ``with_vertical_place``, radar's being heights, which need ``z``; ``vert_loc`` 0 means any level.
    Without observations a point keeps its inflated prior.
    """
    if order not in ORDERS:
        raise ValueError(f"order is one of {tuple(ORDERS)}")
    names, reach = list(variables), widest * CUTOFF / dx
    fields = [c for c in ("infl", "beta") if c in state.columns]
    members = F.array_sort(F.collect_list(F.struct("mem", *names)))
    heights = F.avg("z") if "z" in state.columns else F.lit(None).cast("double")
    points = state.groupBy("gi", "gj", "k").agg(members.alias("s"), F.avg("p").alias("p"), heights.alias("z"), *[F.first(c).alias(c) for c in fields])
    points = points.select(tiles.tile_of(F.col("gi"), tile).alias("ti"), tiles.tile_of(F.col("gj"), tile).alias("tj"), "gi", "gj", "k", "p", "z", *[F.col("s").getField(v).alias(v) for v in names], F.col("s").getField("mem").alias("mems"), *fields)
    over = lambda c, n: F.explode(F.sequence(F.floor((F.col(c) - reach - 1) / tile).cast("int"), F.floor((F.col(c) + reach - 1) / tile).cast("int"))).alias(n)
    placed = with_vertical_place(states.kept(obs, "felt"), rain_base)
    columns = ["ti", "tj", "obs_id", "elm", "typ", "ri", "rj", "base", "by_height", "err", "dep", "hori_loc", "vert_loc", "y"]
    sent = placed.select("*", over("ri", "ti")).select("*", over("rj", "tj")).select(*columns)
    patterns: dict[tuple, list[str]] = {}
    for v in names:
        patterns.setdefault(tuple(sorted(((weights or {}).get(v) or {}).items())), []).append(v)
    setup = _Setup(tuple(names), tuple((p, tuple(v)) for p, v in patterns.items()), tuple(fields), most, dx, inflation, least_inflation, rtpp, rtps, tuple(moist), moist_top, tuple(dict(state.dtypes)[c].replace("bigint", "long") for c in ("gi", "gj", "k")), order)
    crowded = sent.groupBy("ti", "tj").count().filter(F.col("count") > of_a_task).select("ti", "tj", F.ceil(F.col("count") / of_a_task).cast("int").alias("parts"))
    shared = sent.join(crowded, ["ti", "tj"], "left")
    dense = shared.filter("parts is not null").withColumn("part", F.pmod(F.hash("obs_id"), F.col("parts")))
    copied = points.join(crowded, ["ti", "tj"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    split = lambda work, schema: copied.groupBy(*tiles.KEYS).cogroup(dense.select(*columns, "part").groupBy(*tiles.KEYS)).applyInArrow(work, schema)
    at = ["ti", "tj"]
    few = shared.filter("parts is null").select(*columns)
    if most is not None:
        kept = few.unionByName(split(_pruned(setup), few.schema))
        out = points.groupBy(*at).cogroup(kept.groupBy(*at)).applyInArrow(_whole_tile(setup), setup.schema())
    else:
        sparse = points.join(crowded, at, "left_anti").groupBy(*at).cogroup(few.groupBy(*at)).applyInArrow(_whole_tile(setup), setup.schema())
        whole = points.join(crowded.select(*at), at, "left_semi")
        summed = whole.groupBy("gi", "gj").cogroup(split(_partial_sums(setup), setup.partial()).groupBy("gi", "gj")).applyInArrow(_added_up(setup), setup.schema())
        out = sparse.unionByName(summed)
    return out.drop(*([] if adaptive else ["infl"]), *([] if relaxation else [f"relax_{v}" for v in names]))


def analysis_at_observations(targets: DataFrame, hx: DataFrame, obs: DataFrame, **settings) -> DataFrame:
    """(obs_id, mem, xa, n_obs): the analysis in observation space, of each target's simulated values, by the observations around it.

    ``targets`` (obs_id, ri, rj, p, and where radar observations count z) are the places, ``hx`` (obs_id, mem, hx) the members' values
    there, ``obs`` and ``settings`` as for ``analysis_by_tile``. A target that is itself in ``obs`` feels itself too; one without simulated values has no row.
    """
    places = targets.select(F.col("obs_id").cast("long").alias("k"), F.col("ri").cast("double").alias("gi"), F.col("rj").cast("double").alias("gj"), "p", *(["z"] if "z" in targets.columns else []))
    state = places.join(hx.select(F.col("obs_id").alias("k"), "mem", F.col("hx").alias("xa")), "k")
    return analysis_by_tile(state, ["xa"], obs, **settings).select(F.col("k").alias("obs_id"), "mem", "xa", "n_obs")
