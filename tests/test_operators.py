from statistics import NormalDist

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from isohyet.operators import kernels
from isohyet.sources.observations import CONVENTIONAL, packed, read_members, read_radar, read_records, unpacked, write_members
from isohyet.sources.reports import filled


def ensemble(seed, p, m=8):
    r = np.random.default_rng(seed)
    y = r.normal(size=(p, m))
    return y - y.mean(axis=1, keepdims=True), r.normal(size=p), r.uniform(0.5, 2, p)


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 1000), st.integers(1, 6))
def test_kernel_against_the_kalman_gain(seed, p):
    y, d, r = ensemble(seed, p)
    m = y.shape[1]
    w, mean, cov = kernels.transform(y, d, r)
    gain = y.T @ np.linalg.inv(y @ y.T / (m - 1) + np.diag(r)) / (m - 1)
    assert np.allclose(mean, gain @ d)
    assert np.allclose(w @ w.T, cov * (m - 1))
    assert np.allclose(w.sum(axis=1), 1)  # perturbations keep a zero sum


def test_no_observation_leaves_the_guess():
    x = np.arange(8.0)
    assert np.allclose(kernels.analysed(x, np.zeros((0, 8)), np.zeros(0), np.zeros(0), 1.0), x)


def test_permuted_members_permute_the_analysis():
    y, d, r = ensemble(3, 4)
    x, order = np.random.default_rng(1).normal(size=8), np.random.default_rng(2).permutation(8)
    assert np.allclose(kernels.analysed(x, y, d, r, 1.2)[order], kernels.analysed(x[order], y[:, order], d, r, 1.2))


def test_huge_error_leaves_the_guess():
    y, d, r = ensemble(5, 4)
    x = np.random.default_rng(1).normal(size=8)
    assert np.allclose(kernels.analysed(x, y, d, r * 1e12, 1.0), x, atol=1e-6)


def test_records_round_trip(spark, tmp_path):
    rows = np.random.default_rng(0).normal(size=(5, 8)).astype(np.float32)
    (tmp_path / "a.dat").write_bytes(packed(rows))
    (tmp_path / "ragged.dat").write_bytes(b"123")
    assert (unpacked(packed(rows), 8) == rows).all()
    got = read_records(spark, str(tmp_path)).orderBy("idx").toPandas()
    assert len(got) == 5 and np.allclose(got[list(CONVENTIONAL)].to_numpy(), rows)


def test_stream_hands_late_rows_over(spark, tmp_path):
    from isohyet.streaming.cycle import run_cycles

    columns = "obs_id long, ri double, rj double, dif double"
    spark.createDataFrame([(1, 5.0, 5.0, 0.0), (2, 5.0, 5.0, 9e4), (3, 99.0, 5.0, 0.0)], columns).write.parquet(str(tmp_path / "in"))
    seen = {}
    stream = spark.readStream.schema(columns).parquet(str(tmp_path / "in"))
    query = run_cycles(stream, str(tmp_path / "cp"), lambda df, k: seen.update(used=[r.obs_id for r in df.orderBy("obs_id").collect()]), lambda df, k: seen.update(late=[r.obs_id for r in df.collect()]), 25, 20, 3, 23)
    query.awaitTermination()
    assert seen == {"used": [1, 3], "late": [2]}


def test_spread_relaxation_restores_the_prior_spread():
    y, d, r = ensemble(7, 3)
    x = np.random.default_rng(4).normal(size=8)
    new = kernels.analysed(x, y, d, r, 1.0, rtps=1.0)
    assert np.isclose(new.std(), x.std())
    both = kernels.analysed(x, y, d, r, 1.3, rtpp=0.5, rtps=0.9)
    assert np.allclose(both, kernels.analysed(x, y, d, r, 1.3, rtpp=0.5))
    assert np.allclose(kernels.analysed(x, y, d, r, 1.3, beta=0.0), x)


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 1000), st.integers(1, 12))
def test_both_inverses_give_one_gain(seed, p):
    y, _, r = ensemble(seed, p)
    x = np.random.default_rng(seed + 1).normal(size=(3, 8))
    x -= x.mean(axis=1, keepdims=True)
    assert np.allclose(kernels.gain_inverse(x, y, r), x @ y.T @ np.linalg.inv(y @ y.T + np.diag(r) * 7))


def test_one_sided_transform_has_the_analysis_covariance():
    y, _, r = ensemble(2, 3)
    x = np.random.default_rng(4).normal(size=8)
    new, pert = kernels.one_sided(x, y, r), x - x.mean()
    _, _, cov = kernels.transform(y, np.zeros(3), r)
    assert np.isclose(new @ new / 7, pert @ cov @ pert)


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 1000), st.integers(1, 5))
def test_eigenspace_against_the_kalman_filter(seed, p):
    rng = np.random.default_rng(seed)
    x, h, d, r = rng.normal(size=(6, 10)), rng.normal(size=(p, 6)), rng.normal(size=p), rng.uniform(0.5, 2, p)
    pert = x - x.mean(axis=1, keepdims=True)
    cov = pert @ pert.T / 9
    gain = cov @ h.T @ np.linalg.inv(h @ cov @ h.T + np.diag(r))
    new = kernels.eigenspace_analysis(x, h @ pert, d, r)
    assert np.allclose(new.mean(axis=1), x.mean(axis=1) + gain @ d)
    assert np.allclose(np.cov(new), cov - gain @ h @ cov)
    wider = kernels.eigenspace_analysis(x, h @ pert, d, r, delta=0.1)
    assert np.isclose(np.trace(np.cov(wider)), 1.1 * np.trace(np.cov(new)))


def test_dimension_of_equal_and_single_directions():
    assert np.isclose(kernels.dimension(np.eye(4)), 4)
    assert np.isclose(kernels.dimension(np.outer(np.arange(3.0), [1, -1, 0])), 1)
    assert kernels.dimension(np.zeros((3, 4))) == 0


def test_radar_files(spark, tmp_path):
    rows = np.random.default_rng(0).normal(size=(4, 7)).astype(np.float32)
    head = packed(np.array([[135.0], [34.5], [60.0]], np.float32))
    (tmp_path / "r.dat").write_bytes(head + packed(rows))
    (tmp_path / "ragged.dat").write_bytes(head + b"1")
    got = read_radar(spark, str(tmp_path)).orderBy("idx").toPandas()
    assert len(got) == 4 and list(got.meta[0]) == [135.0, 34.5, 60.0]
    assert np.allclose(got[["elm", "lon", "lat", "lev", "dat", "err"]].to_numpy(), rows[:, :6])
    assert set(got.typ) == {22.0} and set(got.dif) == {0.0}


def test_members_round_trip(spark, tmp_path):
    e = spark.createDataFrame([(1, 1, m, float(m * m)) for m in range(1, 5)], "gi int, gj int, mem int, x double")
    write_members(e, str(tmp_path / "e"))
    assert sorted((r.mem, r.x) for r in read_members(spark, str(tmp_path / "e")).collect()) == [(m, float(m * m)) for m in range(1, 5)]
    assert spark.read.parquet(str(tmp_path / "e")).filter("mem = 0").first().x == 7.5


def test_leap_second(spark):
    from isohyet.functions import clock

    utc, second = clock.tai_to_utc(F.col("t"))
    got = spark.createDataFrame([(15638399.5,), (15638400.5,), (15638401.5,)], "t double").orderBy("t").select(utc.alias("u"), second.alias("s")).collect()
    first = clock.EPOCH + 15638400  # 1 July 1993
    assert [(r.u - first, r.s) for r in got] == [(-0.5, 59.5), (-0.5, 60.5), (0.5, 0.5)]


def test_precipitation_observation_scale(spark):
    from isohyet.functions import precipitation

    df = spark.createDataFrame([(0.0,), (0.05,), (3.0,), (99.0,), (None,)], "pp double").withColumn("cdf", F.array(*[F.lit(float(k)) for k in range(11)]))
    df = df.withColumns({"dry": F.lit(0.3), "no_rain_model": F.lit(0.2), "dry_share": F.lit(0.5), "mean": F.lit(0.1), "sd": F.lit(2.0)})
    got = [r.y for r in precipitation.with_gaussian_observation(df.withColumnRenamed("dry", "zero"), "y", "pp", "cdf", "zero").collect()]
    z = lambda p: NormalDist().inv_cdf(p)
    assert np.allclose(got[:4], [0.1 + 2 * z(0.15 / 0.2 * 0.5)] * 2 + [z(0.3), z(0.999)], atol=1e-6)
    assert got[4] is None


def test_paths():
    assert filled("a/<member>/<member>.d<domain>", "0001", 2) == "a/0001/<member>.d02"


def test_nulls_stay_null(spark):
    from isohyet.functions import geometry, physics, precipitation
    from isohyet.operators import model

    x = F.col("x")
    row = spark.createDataFrame([(None, 4001, 0)], "x double, elm int, qc int")
    values = [physics.great_circle(x, x, x, x), physics.radar_preprocessed(x)[1], physics.boundary_taper(x, x, 5, 5, 1.0, 1.0, 2.0), precipitation.without_tails(x), precipitation.log_amount(x), precipitation.inverse_normal(x), geometry.beam(x, x, x, (x, x, x))[0]]
    assert set(row.select(*[v.alias(f"v{k}") for k, v in enumerate(values)]).first()) == {None}
    made = model.simulated_radar(row.select("elm", "qc", x.alias("ref"), F.lit(1.0).alias("vr"))).first()
    assert made.hx is None and made.qc == 99


def test_empty_tables(spark):
    from isohyet.operators import cyclones, localization, series

    points = spark.createDataFrame([(1, 1)], "gi int, gj int")
    none = spark.createDataFrame([], "obs_id long, ri double, rj double, err double")
    assert [tuple(r) for r in localization.counted(localization.local_observations(points, none, 1.0)).collect()] == [(1, 1, 0, None)]
    field = spark.createDataFrame([], "gi int, gj int, x double")
    storms = spark.createDataFrame([(1, 2.0, 2.0)], "storm_id int, ri double, rj double")
    assert [tuple(r) for r in cyclones.centres(storms, cyclones.smoothed(field), 3.0).collect()] == [(1, None, None, None)]
    knots = spark.createDataFrame([], "series int, x double, y double")
    assert [r.y for r in series.akima(knots, spark.createDataFrame([(1, 0.5)], "series int, x double")).collect()] == [None]


def test_bracket_by_height(spark):
    from isohyet.functions import geometry
    from isohyet.operators.vertical import bracketed

    profile = spark.createDataFrame([(i, j, k, 100.0 * k * k) for i in (1, 2) for j in (1, 2) for k in (1, 2, 3)], "gi int, gj int, k int, x double")
    obs = spark.createDataFrame([(1, 2819, 250.0), (2, 2819, 400.0), (3, 2819, 900.0), (4, 2819, 950.0), (5, 2819, 50.0), (6, 14593, 7.0)], "obs_id long, elm int, lev double").selectExpr("*", "1.5D ri", "1.5D rj", "0 qc")
    got = {r.obs_id: (r.qc, r.rk) for r in bracketed(obs, profile, ascending=True).collect()}
    assert got == {1: (0, 1.5), 2: (0, 2.0), 3: (0, 3.0), 4: (20, None), 5: (21, None), 6: (0, 7.0)}
    east, north = geometry.rotated(F.lit(3.0), F.lit(4.0), F.lit(0.0), F.lit(1.0))
    assert tuple(spark.range(1).select(east, north).first()) == (-4.0, 3.0)


def test_limit_counts_elements_of_a_type_apart(spark):
    from isohyet.operators import localization

    points = spark.createDataFrame([(1, 1), (9, 9)], "gi int, gj int")
    rows = [(1, 2819, 1), (2, 2820, 1), (3, 2819, 1), (4, 2819, 2), (5, 4001, 22), (6, 4004, 22), (7, 4002, 22), (8, 4001, 1), (9, 4004, 1)]
    obs = spark.createDataFrame([(i, elm, typ, 1.0, 1.0, 1.0 + i / 100) for i, elm, typ in rows], "obs_id long, elm int, typ int, ri double, rj double, err double")
    local = localization.local_observations(points, obs, 0.4).withColumn("limit_group", localization.limit_group(F.col("elm"), F.col("typ")))
    for order in localization.ORDERS:
        got = localization.limited(local, 1, order).collect()
        assert sorted(r.obs_id for r in got if r.gi == 1) == [1, 2, 4, 5, 7, 8, 9]
        assert [r.obs_id for r in got if r.gi == 9] == [None]


def grown(spark, folder, vectors=1010, members=64):
    values = np.random.default_rng(3).normal(0, 0.125, (vectors, members)).astype(np.float32)
    spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(values)], "vec_id long, embedding array<float>").repartition(2).write.parquet(f"{folder}/embeddings.parquet")
    return 50 + 40 * values.astype(float)


def test_grid_and_members_grow_with_the_table(spark, tmp_path):
    from isohyet.plans import QUERIES, fixtures

    x = grown(spark, tmp_path)
    grid, rows = fixtures.whole_ensemble(spark, str(tmp_path))
    assert rows == 40 and grid.count() == x.size
    assert grid.filter("gi = 10 and gj = 41 and mem = 64").first().x == x[1009, 63]
    got = {(r.gi, r.gj): r.edim for r in QUERIES["edim"](spark, str(tmp_path)).collect()}
    assert len(got) == 52
    patch = x[[25 * j + i for i in range(5) for j in range(36, 40)]]
    assert np.isclose(got[1, 10], kernels.dimension(patch - patch.mean(axis=1, keepdims=True)), atol=1e-5)


@pytest.fixture(scope="module")
def dense(spark, tmp_path_factory):
    """A folder with an ensemble and events whose ids are beyond 400, and by brute force: members, and observations by point."""
    folder = tmp_path_factory.mktemp("dense")
    x = grown(spark, folder, 500, 12)
    spark.sql("select 1000 + id event_id, timestamp_ntz'2024-01-05 12:00:00' ts, id user_id, 'click' event_type, 46D + id % 9 value from range(60)").write.parquet(f"{folder}/events.parquet")
    near = {}
    for i in range(1000, 1060):
        ri, rj, err = i * 37 % 270 / 10, i * 53 % 220 / 10, 1.0 + i % 5
        if not (1 <= ri <= 25 and 1 <= rj <= 20):
            continue
        a, b = min(int(ri), 24), min(int(rj), 19)
        u, v = ri - a, rj - b
        h = sum(w * x[(b - 1 + q) * 25 + a - 1 + p] for p, q, w in ((0, 0, (1 - u) * (1 - v)), (1, 0, u * (1 - v)), (0, 1, (1 - u) * v), (1, 1, u * v)))
        d = 46.0 + (i - 1000) % 9 - h.mean()
        for k in range(500) if abs(d) <= 5 * err else ():
            nd2 = ((k % 25 + 1 - ri) ** 2 + (k // 25 + 1 - rj) ** 2) / 0.16
            if nd2 <= 13.33333333:
                near.setdefault((k % 25 + 1, k // 25 + 1), []).append((h - h.mean(), d, err * err * np.exp(nd2 / 2)))
    assert max(map(len, near.values())) > 1
    return str(folder), x, {point: tuple(map(np.array, zip(*o, strict=True))) for point, o in near.items()}


def test_analyses_use_all_local_observations(spark, dense):
    from isohyet.plans import QUERIES

    folder, x, near = dense
    point = max(near, key=lambda p: (len(near[p][1]), p))
    prior, (y, d, r) = x[(point[1] - 1) * 25 + point[0] - 1], near[point]
    pert, m = prior - prior.mean(), len(prior)
    at = f"gi = {point[0]} and gj = {point[1]}"
    told = lambda name, c, by="mem": [q[c] for q in QUERIES[name](spark, folder).filter(at).orderBy(by).collect()]
    gain = pert @ y.T @ np.linalg.inv(y @ y.T + np.diag(r) * (m - 1))
    inflated = np.sqrt(1.69) * pert @ (np.sqrt(1.69) * y).T @ np.linalg.inv(1.69 * y @ y.T + np.diag(r) * (m - 1))
    assert np.isclose(np.mean(told("letkf_members_local", "xa")), prior.mean() + inflated @ d, atol=1e-4)
    assert np.isclose(told("letkf_det_update_local", "xa", "gi")[0], prior.mean() + 1 + inflated @ (d - 1), atol=1e-4)
    after = 1.69 * pert @ pert - (m - 1) * inflated @ (y @ y.T / (m - 1) * 1.69 + np.diag(r)) @ inflated
    members = np.array(told("letkf_members_local", "xa"))
    assert np.isclose(np.sum((members - members.mean()) ** 2), after, atol=1e-3)
    relaxed = np.array(told("letkf_rtpp_local", "xa"))
    assert np.allclose(relaxed - relaxed.mean(), 0.2 * (members - members.mean()) + 0.8 * np.sqrt(1.69) * pert, atol=1e-4)
    spread = np.array(told("letkf_rtps_local", "xa"))
    assert np.isclose(spread.std(), 0.95 * np.sqrt(1.69) * prior.std() + 0.05 * members.std(), atol=1e-4)
    assert np.allclose(told("enkf_gain_local", "gain", "k"), gain, atol=1e-6)
    assert np.allclose(told("enkf_bias_gain_local", "gain", "k"), 0.25 * pert @ y.T @ np.linalg.inv(1.25 * y @ y.T + np.diag(r) * (m - 1)), atol=1e-6)
    left = pert @ pert - gain @ y @ pert
    assert np.isclose(told("etkf_local", "sprd", "gi")[0], np.sqrt(left / (m - 1)), atol=1e-5)
    serial = np.array(told("enkf_serial_update_local", "xa_pert"))
    assert np.isclose(serial @ serial, left, atol=1e-3) and np.isclose(serial.sum(), 0, atol=1e-3)
    beta = min(1, max(0, min(2 * min(point[0], 26 - point[0]), 2 * min(point[1], 21 - point[1])) / 9))
    assert np.allclose(told("boundary_taper_local", "xa"), prior * (1 - beta) + members * beta, atol=1e-4)


def test_patches_use_all_their_observations_and_stay_without_any(spark, tmp_path):
    from isohyet.plans import QUERIES

    x = grown(spark, tmp_path, 500, 12)
    where = lambda i: (i * 37 % 270 / 10, i * 53 % 220 / 10)
    ids = [i for i in range(1000, 40000) if 2 <= where(i)[0] <= 5 and 1 <= where(i)[1] <= 4][:9]
    spark.createDataFrame([(i,) for i in ids], "id long").selectExpr("id event_id", "timestamp_ntz'2024-01-05 12:00:00' ts", "id user_id", "'click' event_type", "51D value").write.parquet(f"{tmp_path}/events.parquet")
    got = {}
    for q in QUERIES["lekf"](spark, str(tmp_path)).collect():
        got.setdefault((q.gi, q.gj), np.zeros((20, 12)))[q.point - 1, q.mem - 1] = q.xa
    assert len(got) == 25
    state = lambda p, q: np.array([x[(j - 1) * 25 + i - 1] for i in range(5 * p - 4, 5 * p + 1) for j in range(4 * q - 3, 4 * q + 1)])
    y, d, r = [], [], []
    for i in ids:
        ri, rj = where(i)
        a, b = max(int(np.ceil(ri)) - 1, 1), max(int(np.ceil(rj)) - 1, 1)
        u, v = ri - a, rj - b
        at = lambda p, q: x[(q - 1) * 25 + p - 1]
        h = (1 - u) * (1 - v) * at(a, b) + u * (1 - v) * at(a + 1, b) + (1 - u) * v * at(a, b + 1) + u * v * at(a + 1, b + 1)
        if abs(51 - h.mean()) <= 5 * (1 + i % 5):
            y.append(h - h.mean())
            d.append(51 - h.mean())
            r.append((1.0 + i % 5) ** 2)
    assert len(y) > 5
    assert np.allclose(got[1, 1], kernels.eigenspace_analysis(state(1, 1), np.array(y), np.array(d), np.array(r), 0.05), atol=1e-4)
    assert np.allclose(got[3, 2].mean(axis=1), state(3, 2).mean(axis=1), atol=1e-4)


def test_analysis_by_tile_against_loops(spark):
    """Limits by class, weights, relaxation of spread, moisture up to a level and tapers, against one point after the other."""
    from isohyet.operators import volume

    r = np.random.default_rng(8)
    m, nx, ny = 6, 7, 5
    points = [(i, j, k) for i in range(1, nx + 1) for j in range(1, ny + 1) for k in (1, 2)]
    pressure, height = {1: 90000.0, 2: 40000.0}, {1: 1000.0, 2: 7000.0}
    u, q = r.normal(size=(len(points), m)), r.normal(size=(len(points), m))
    rows = [(*p, e + 1, pressure[p[2]], float(u[n, e]), float(q[n, e]), 0.0 if p[0] == 1 else 0.5 if p[0] == 2 else 1.0, 1.2 + 0.1 * p[2], height[p[2]]) for n, p in enumerate(points) for e in range(m)]
    state = spark.createDataFrame(rows, "gi int, gj int, k int, mem int, p double, u double, q double, beta double, infl double, z double").repartition(5)
    y = r.normal(size=(60, m))
    y -= y.mean(axis=1, keepdims=True)
    kind = [(2819, 1), (3330, 1), (4001, 22), (4004, 22), (14593, 1), (19999, 2)]
    obs = [(n, *kind[n % 6], float(r.uniform(1, nx)), float(r.uniform(1, ny)), float(r.uniform(30000, 100000) if n % 6 not in (2, 3) else r.uniform(0, 9000)), 1.0 + n % 3, float(r.normal()), 0.4 + 0.1 * (n % 2), 0.0 if n % 5 == 0 else 1500.0 if n % 6 in (2, 3) else 0.5, y[n].tolist()) for n in range(60)]
    table = spark.createDataFrame(obs, "obs_id long, elm int, typ int, ri double, rj double, lev double, err double, dep double, hori_loc double, vert_loc double, y array<double>").withColumn("dat", F.lit(87000.0))
    by_kind = set()
    weights = {"q": {2819: 0.0, 4001: 0.5}}
    settings = dict(widest=0.5, tile=2, least_inflation=1.35, rtps=0.7, moist=["q"], moist_top=50000.0)
    got = volume.analysis_by_tile(state, ["u", "q"], table, weights, most=2, **settings).collect()
    parts = volume.analysis_by_tile(state, ["u", "q"], table, weights, most=2, of_a_task=9, **settings).collect()
    assert sorted(got) == sorted(parts)  # of crowded tiles, each part keeps what may count
    whole, summed = ({(x.gi, x.gj, x.k, x.mem): (x.u, x.q, x.n_obs, x.infl) for x in volume.analysis_by_tile(state, ["u", "q"], table, weights, adaptive=True, of_a_task=n, **settings).collect()} for n in (1000, 9))
    assert whole.keys() == summed.keys() and all(np.allclose(whole[x], summed[x], rtol=0, atol=1e-9) for x in whole) and len({v[3] for v in whole.values()}) > 10
    found = {(x.gi, x.gj, x.k, x.mem): (x.u, x.q, x.n_obs) for x in got}
    felt = 0
    for n, (i, j, k) in enumerate(points):
        near = {}
        for o in obs:
            h = np.hypot(i - o[3], j - o[4]) / o[8]
            apart = abs(o[5] - height[k]) if o[2] == 22 else abs(np.log({14593: 87000.0, 19999: 85000.0}.get(o[1], o[5])) - np.log(pressure[k]))
            v = apart / o[9] if o[9] else 0.0
            if h <= 3.651483717 and v <= 3.651483717 and h * h + v * v <= 13.33333333:
                near.setdefault((4001 if o[1] == 4004 else o[1], o[2]), []).append((h * h + v * v, o))
        taken = [x for group in near.values() for x in sorted(group, key=lambda x: (x[0], x[1][0]))[:2]]
        felt += len(taken)
        by_kind |= {o[1] for _, o in taken}
        beta = 0.0 if i == 1 else 0.5 if i == 2 else 1.0
        for name, x in (("u", u[n]), ("q", q[n])):
            use = [(d, o, weights.get(name, {}).get(o[1], 1.0)) for d, o in taken]
            use = [(d, o, w) for d, o, w in use if w > 0]
            new = kernels.analysed(x, np.array([o[10] for _, o, _ in use]).reshape(-1, m), np.array([o[7] for _, o, _ in use]), np.array([o[6] ** 2 / (w * np.exp(-0.5 * d)) for d, o, w in use]), max(1.2 + 0.1 * k, 1.35), rtps=0.7 if use else 0.0, beta=beta)
            if beta == 0 or (name == "q" and k == 2):
                new = x
            for e in range(m):
                assert abs(found[i, j, k, e + 1][("u", "q").index(name)] - new[e]) < 1e-9
        assert found[i, j, k, 1][2] == len(taken)
    assert felt > 100 and by_kind == {2819, 3330, 4001, 4004, 14593, 19999}


def test_removal_and_merging_at_edges(spark):
    from isohyet.operators import superob

    rows = [(1, 14593, 1, 3.0, 3.0, 99.0), (2, 3073, 8, 3.0, 3.0, 99.0), (3, 3073, 1, 3.0, 3.0, 99.0), (4, 3073, 1, 25.9, 3.0, 0.2), (5, 3073, 1, 3.0, 1.0, 2.0), (6, 2819, 3, 3.0, 3.0, 2.0), (7, 3073, 30, 3.0, 3.0, 2.0)]
    obs = spark.createDataFrame(rows, "obs_id long, elm int, typ int, ri double, rj double, rk double")
    coded = superob.placed(superob.removal_codes(obs, 20, 9, [(3, 2819)], (1, 24)), 25)
    got = {x.obs_id: (x.qc, x.ci, x.cj, x.ck) for x in coded.collect()}
    assert got == {1: (0, 3, 3, 0), 2: (0, 3, 3, 0), 3: (3, 3, 3, 99), 4: (0, 1, 3, 1), 5: (2, 3, 1, 2), 6: (4, 3, 3, 2), 7: (5, 3, 3, 2)}
    near = spark.createDataFrame([(1, 3.1, 3.0, 2.4, 1.0, 10.0), (2, 3.2, 3.0, 2.0, 1.0, 20.0), (3, 3.0, 3.0, 2.0, 2.0, 30.0)], "obs_id long, ri double, rj double, rk double, err double, dat double")
    pick = lambda ck: superob.merged(near.withColumns({"ci": F.lit(3), "cj": F.lit(3), "ck": F.lit(ck)}), ["ci", "cj", "ck"], 1).first().dat
    assert pick(2) == 20.0 and pick(0) == 10.0


def test_sets_by_format(spark, tmp_path):
    from isohyet.sources import observations as so
    from isohyet.sources import states

    rows = np.array([[3073, 1, 2, 500, 280, 1, 1, 0], [99993, 1, 2, 990, 950, 3, 20, 60]], np.float32)
    (tmp_path / "conventional").write_bytes(so.packed(rows))
    place = np.array([[12, 0, 12], [12, 0, 12], [12, 0, 12]], "<i4").astype("<f4")
    (tmp_path / "radar").write_bytes(place.tobytes() + so.packed(np.array([[4001, 1, 2, 800, 30, 5, 22]], np.float32)))
    (tmp_path / "ragged").write_bytes(so.packed(rows)[:-4])
    got = states.read_sets(spark, [("RECORDS", str(tmp_path / "conventional")), ("RECORDS", str(tmp_path / "none")), ("RADAR", str(tmp_path / "radar"))]).orderBy("set_id", "idx").collect()
    assert [(x.set_id, x.idx, x.elm, x.lev, x.dat, x.err) for x in got] == [(1, 1, 3073.0, 50000.0, 280.0, 1.0), (1, 2, 99993.0, 99000.0, 95000.0, 300.0), (3, 1, 4001.0, 800.0, 30.0, 5.0)]
    with pytest.raises(Exception, match="whole number of records"):
        states.read_sets(spark, [("RECORDS", str(tmp_path / "ragged"))]).collect()
    with pytest.raises(KeyError):
        states.read_sets(spark, [("OTHER", "x")])


def test_sets_and_departures_are_written(spark, tmp_path):
    from isohyet.sources import observations as so

    obs = spark.createDataFrame([("a", 1, 3073, 1.0), ("b", 1, 3073, None), ("b", 2, 2819, 2.0)], "set_id string, idx long, elm int, dat double")
    so.write_sets(obs, str(tmp_path / "all"))
    so.write_sets(obs, str(tmp_path / "some"), missing=False)
    assert spark.read.parquet(str(tmp_path / "all")).count() == 3 and spark.read.parquet(str(tmp_path / "some")).count() == 2
    dep = spark.createDataFrame([("a", 1, 0, 0.5, 0.2), ("b", 2, 5, 9.0, 8.0)], "set_id string, idx long, qc int, omb double, oma double")
    so.write_departures(obs, dep, str(tmp_path / "dep"))
    assert sorted((x.set_id, x.idx, x.qc, x.omb) for x in spark.read.parquet(str(tmp_path / "dep")).collect()) == [("a", 1, 0, 0.5), ("b", 2, 5, 9.0)]
    bt = spark.createDataFrame([(8800, 23, 1.0, 2.0, [float(k) for k in range(10)])], "elm int, typ int, lon double, lat double, bt array<double>")
    assert [(x.lev, x.dat) for x in so.unpivoted_channels(bt).orderBy("lev").collect()] == [(k + 7.0, float(k)) for k in range(10)]


def test_leap_seconds():
    from isohyet.functions import clock

    assert len(clock.LEAPS) == 10 and clock.LEAPS[-1].year == 2017


def test_legacy_reports_up_to_a_ragged_end(spark, tmp_path):
    from isohyet.sources.observations import read_legacy

    rows = np.array([[2819, 130, 34, 500, 7, 1], [3331, 130, 34, 500, 80, 10], [14593, 130, 34, 20, 1000, 1], [3074, 130, 34, 500, 280, 1]], np.float32)
    (tmp_path / "a.dat").write_bytes(packed(rows) + b"12345")
    got = [(r.lev, round(r.dat, 6), round(r.err, 6)) for r in read_legacy(spark, str(tmp_path)).orderBy("idx").collect()]
    assert got == [(50000, 7, 1), (50000, 0.8, 0.1), (20, 100000, 100), (500, 280, 1)]


def test_percentiles_and_mask(spark, tmp_path):
    from isohyet.sources.reports import masked, read_percentiles

    fields = np.random.default_rng(2).normal(size=(2 * (4 + 2), 3, 5)).astype("<f4")
    (tmp_path / "cdf.dat").write_bytes(fields.tobytes())
    got = read_percentiles(spark, str(tmp_path), 5, 3, 4)
    rows = {(r.i, r.j): r for r in got.collect()}
    assert len(rows) == 15 and all(np.allclose(r.cdf, fields[:5, j - 1, i - 1]) and np.isclose(r.zero, fields[-1, j - 1, i - 1]) for (i, j), r in rows.items())
    assert masked(got, None).filter("mask = 1e10").count() == 15
    assert masked(got, spark.createDataFrame([(1, 1, 0.5)], "i int, j int, mask double")).filter("mask is not null").count() == 1


def test_containing_cell_of_odd_places(spark):
    from isohyet.operators.localization import containing_positions

    points = spark.createDataFrame([(i, j, 130 + i * 0.5, 30 + j * 0.5) for i in range(1, 5) for j in range(1, 4)], "i int, j int, lon double, lat double")
    obs = spark.createDataFrame([(1, 131.0, 31.0), (2, None, 31.0), (3, 140.0, 31.0), (4, 131.25, 30.75)], "obs_id int, lon double, lat double")
    got = {r.obs_id: (r.oi, r.oj) for r in containing_positions(obs, points, 0.6).collect()}
    assert np.allclose(got[1], (2, 2), atol=1e-6) and got[2] == got[3] == (None, None) and np.allclose(got[4], (2.5, 1.5), atol=1e-2)
    assert containing_positions(obs.limit(0), points, 0.6).count() == 0 and containing_positions(obs, points.limit(0), 0.6).filter("oi is null").count() == 4


def test_surface_pressure_of_radar_type(spark):
    """By default it lies at its value, as in the reference; the query's SQL puts every report of radar type at its height."""
    import oracle
    from isohyet.functions import codes
    from isohyet.operators.localization import local_observations_3d
    from isohyet.plans import ORACLES, QUERIES

    oracle.compare(spark, "local_obs_3d", QUERIES["local_obs_3d"], ORACLES["local_obs_3d"], "/root/testdata/sf0.01")
    points = spark.createDataFrame([(1, 1, 1, 8e4, 1000.0)], "gi int, gj int, k int, p double, z double")
    kinds = [(1, codes.ID["PS"], 22, 9e5), (2, codes.ID["PS"], 1, 9e5), (3, codes.ID["PRC"], 22, 9e5), (4, codes.ID["T"], 22, 1.0), (5, codes.ID["T"], 22, 9e5)]
    obs = spark.createDataFrame([(n, e, t, 1.0, 1.0, lev, 8e4, 1.0, 1.0, 300.0 if t == 22 else 0.1, 1.0) for n, e, t, lev in kinds], "obs_id int, elm int, typ int, ri double, rj double, lev double, dat double, err double, hori_loc double, vert_loc double, weight double")
    near = lambda **rule: {r.obs_id for r in local_observations_3d(points, obs, 1.0, **rule).collect()}
    assert near() == {1, 2, 3, 4} and near(at_height=F.col("typ") == 22) == {2, 4}


def test_places_at_a_corner_as_by_sql(spark, tmp_path):
    """At no distance from a corner the SQL divides by 0, which gives no number; the operator's default stays the corner's own place."""
    import shutil

    import duckdb
    import oracle
    from isohyet.plans import ORACLES, QUERIES

    shutil.copy("/root/testdata/sf0.001/embeddings.parquet", tmp_path / "embeddings.parquet")
    duckdb.connect().execute(f"copy (select range s_suppkey from range(6000)) to '{tmp_path}/supplier.parquet' (format parquet)")
    oracle.compare(spark, "containing_positions", QUERIES["containing_positions"], ORACLES["containing_positions"], str(tmp_path))
    assert QUERIES["containing_positions"](spark, str(tmp_path)).filter("isnan(oi)").count() > 0
