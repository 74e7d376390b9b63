"""Departures and members without rows of members, against those by rows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohyet.operators import gridded, inflation, localization
from isohyet.operators import observations as ob
from isohyet.plans import QUERIES

SF = "/root/testdata/sf0.001"


def rows_of_members(df):
    """Whether anything in the plan is grouped by observation and member."""
    return re.search(r"Aggregate \[obs_id#\d+L?, mem#", df._jdf.queryExecution().optimizedPlan().toString()) is not None


def made(spark, whole=False, repeated=True):
    """A grid of 4 x 4 points and 5 members with gaps and nulls, and observations at nodes, beside points, with codes, without an id or value, and with ids that occur twice."""
    rng = np.random.default_rng(7)
    cells = [(i, j, m, float(v)) for (i, j, m), v in zip([(i, j, m) for i in range(1, 5) for j in range(1, 5) for m in range(1, 6)], rng.normal(50, 5, 80), strict=True)]
    if not whole:
        cells = [c for c in cells if c[:3] not in ((2, 2, 3), (3, 3, 1)) and c[:2] != (4, 4)]
        cells = [(i, j, m, None if (i, j, m) == (1, 2, 5) else v) for i, j, m, v in cells]
    grid = spark.createDataFrame(cells, "gi int, gj int, mem int, x double")
    obs = [(n, 1, 1, float(a), float(b), float(d), 1.0 + n % 3, 97 if n % 9 == 0 else 0) for n, (a, b, d) in enumerate(zip(rng.uniform(1, 4, 60).round(1), rng.uniform(1, 4, 60).round(1), rng.normal(50, 8, 60), strict=True))]
    obs += [(100, 1, 1, 1.0, 1.0, 50.0, 1.0, 0), (101, 1, 1, 4.0, 4.0, 50.0, 1.0, 0), (102, 1, 1, 2.0, 2.5, None, 1.0, 0), (None, 1, 1, 2.5, 2.5, 50.0, 1.0, 0), (None, 1, 1, 2.5, 2.5, 50.0, 1.0, 0), (103, 1, 1, None, 2.5, 50.0, 1.0, 0)]
    if repeated:
        obs += [(7, 1, 1, 3.2, 1.7, 49.0, 1.0, 0), (11, 1, 1, 2.5, 2.5, 49.0, 40.0, 0), (11, 1, 1, 1.5, 3.5, 49.0, 40.0, 97)]
    return spark.createDataFrame(obs, "obs_id long, elm int, typ int, ri double, rj double, dat double, err double, qc int"), grid


def told(df, columns):
    return sorted([tuple(None if v is None else round(v, 8) for v in r) for r in df.select(*columns).collect()], key=str)


@pytest.mark.parametrize("whole,repeated", [(True, False), (False, False), (False, True)])
def test_departures_as_by_rows(spark, whole, repeated):
    obs, grid = made(spark, whole, repeated)
    hx = ob.interpolated(obs.filter("qc = 0"), grid)
    columns = ["obs_id", "ri", "dat", "qc", "dep", "hx_mean", "hx_sprd"]
    new = gridded.Simulated(obs, grid)
    assert told(new.departures(), columns) == told(ob.departures(obs, hx), columns)
    assert repeated or not rows_of_members(new.departures())
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("mem", "hx"))), lambda s: s.hx)
    want = {r.obs_id: np.array(r.h) - np.mean(r.h) for r in hx.filter("hx is not null").groupBy("obs_id").agg(ordered.alias("h")).collect() if r.obs_id is not None}
    got = {r.obs_id: r.y for r in new.members(obs.filter("qc = 0")).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in got)


def test_inflation_by_pairs_that_bring_their_departures(spark):
    assert not rows_of_members(QUERIES["departure_stats"](spark, SF))
    for repeated in (False, True):
        obs, grid = made(spark, repeated=repeated)
        new = gridded.Simulated(obs, grid)
        dep, points = new.departures(20.0), grid.select("gi", "gj").distinct()
        local = localization.local_observations(points, dep.filter("qc = 0").select("obs_id", "err", "ri", "rj"), 0.4)
        prior = points.withColumn("infl", 1 + F.col("gi") / 10)
        got = inflation.adapted_at(points, new.seen(dep, ["obs_id", "err", "ri", "rj"]), 0.4, prior)
        assert told(got, got.columns) == told(inflation.adapted(local, dep, prior), got.columns)


def test_serial_updates_by_very_many_observations():
    """The same as one by one, by work that grows with their number alone: with its square, the large case takes minutes."""
    import time

    from isohyet.operators.kernels import serial

    rng = np.random.default_rng(3)
    x, y, r = rng.normal(size=16), rng.normal(size=(100, 16)), rng.uniform(0.5, 4, 60_000)
    want, own = x - x.mean(), y.copy()
    for k in range(100):
        seen, total = own[k].copy(), own[k] @ own[k] / 15 + r[k]
        factor = 1 / (15 * total * (1 + np.sqrt(r[k] / total)))
        want = want - factor * (want @ seen) * seen
        own[k + 1 :] -= factor * np.outer(own[k + 1 :] @ seen, seen)
    assert np.allclose(serial(x, y, r[:100]), want) and np.allclose(serial(x, y[:0], r[:0]), x - x.mean())
    began = time.time()
    assert np.isfinite(serial(x, rng.normal(size=(60_000, 16)), r)).all() and time.time() - began < 40


def test_members_of_the_best_alone(spark):
    """The analysis with a limit is the same when members are simulated only for what some point can take."""
    from isohyet.operators.volume import analysis_by_tile

    obs, grid = made(spark, whole=True, repeated=False)
    new = gridded.Simulated(obs, grid)
    good = new.departures(20.0).filter("qc = 0").select("obs_id", "elm", "typ", "ri", "rj", "dat", "err", "dep")
    points, scale = grid.select("gi", "gj").distinct(), 0.4
    rest = {"lev": F.lit(1.0e5), "hori_loc": F.lit(scale), "vert_loc": F.lit(0.0)}
    every, some = (new.felt(good, points, scale, most).withColumns(rest) for most in (None, 1))
    assert some.count() <= 16 < every.count() and not rows_of_members(some)
    state = grid.withColumns({"k": F.lit(1), "p": F.lit(1.0e5)})
    a, b = (analysis_by_tile(state, ["x"], o, widest=scale, most=1).select("gi", "gj", "mem", "x", "n_obs") for o in (every, some))
    assert told(a, a.columns) == told(b, b.columns)


@pytest.mark.parametrize("name", ["letkf_adaptive_infl", "omb_oma_pairs", "departure_stats_range", "departure_stats", "bilinear_interp"])
def test_no_row_of_a_member(spark, name):
    assert not rows_of_members(QUERIES[name](spark, SF))


def test_only_observations_named_by_a_point_are_simulated(spark):
    from isohyet.plans.queries import _at_points

    dep, hx, grid = _at_points(spark, SF)
    points = grid.select("obs_id").distinct()
    assert 0 < dep.count() <= points.count() < 1000 and hx.join(points, "obs_id", "left_anti").isEmpty()


def test_a_cycle_simulates_only_what_points_take(spark, monkeypatch):
    from isohyet.operators import cycling, volume

    obs, grid = made(spark, whole=True, repeated=False)
    seen, analysis = [], volume.analysis_by_tile
    monkeypatch.setattr(volume, "analysis_by_tile", lambda state, names, felt, **settings: seen.append(felt) or analysis(state, names, felt, **settings))
    earlier = grid.withColumn("infl", F.lit(1.2))
    out = cycling.assimilated(obs, grid, earlier, 0.4, most=1, threshold=20.0)
    assert out.count() == 80 and 0 < seen[0].count() <= 16 and not rows_of_members(seen[0])


@pytest.mark.parametrize("name", ["local_topk_class_rloc", "local_topk_class_dist", "local_topk_rdiag", "local_topk_rloc"])
def test_good_observations_without_rows_of_members(spark, monkeypatch, name):
    from isohyet.sources import states

    tables, kept = {}, states.kept
    monkeypatch.setattr(states, "kept", lambda df, of: tables.setdefault(of, df) and kept(df, of))
    QUERIES[name](spark, SF)
    assert not rows_of_members(tables["good"])
