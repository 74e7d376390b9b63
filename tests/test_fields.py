"""Perturbed fields, satellite channels, the global grid and analyses at observations, against NumPy and loops."""

import numpy as np
from pyspark.sql import functions as F

from isohyet.functions import satellite
from isohyet.operators import globalgrid, kernels, perturbation, volume


def test_band_of_waves(spark):
    """No power outside the band, unit spread, other phases for each member, the same in every run; tapers end at the edge and the top."""
    nx, ny, nz, dx, height = 24, 18, 6, 2.0, 30.0
    longest, shortest = 20.0, 7.0
    told = perturbation.band_field(spark, (nx, ny, nz), dx, height, longest, shortest, [1, 2], 5)
    again = perturbation.band_field(spark, (nx, ny, nz), dx, height, longest, shortest, [2], 5).toPandas()
    table = told.toPandas()
    fields = {}
    for mem, rows in table.groupby("mem"):
        field = np.zeros((nz, ny, nx))
        field[rows.k - 1, rows.gj - 1, rows.gi - 1] = rows.noise
        fields[mem] = field
        assert len(rows) == nx * ny * nz and np.isclose(field.std(), 1)
        power = np.abs(np.fft.fftn(field)) ** 2
        c, b, a = (np.minimum(x, n - x) for x, n in zip(np.indices(power.shape), power.shape))
        number = np.sqrt(a**2 + (b * nx / ny) ** 2 + (c * nx * dx / height) ** 2)
        inside = (number >= dx * nx / longest - 1e-9) & (number <= dx * nx / shortest + 1e-9)
        assert power[~inside].sum() < 1e-18 * power.sum() and (power[inside] > 0).mean() > 0.9
    assert abs(np.corrcoef(fields[1].ravel(), fields[2].ravel())[0, 1]) < 0.5
    other = np.zeros((nz, ny, nx))
    other[again.k - 1, again.gj - 1, again.gi - 1] = again.noise
    assert np.allclose(other, fields[2])
    state = told.filter("mem = 1").select("gi", "gj", "k", "mem", F.lit(300.0).alias("t"))
    new = perturbation.perturbed(state, "t", told, 0.5, (nx, ny, nz), edge=4, top=2).toPandas()
    at = {(r.gi, r.gj, r.k): r.t for r in new.itertuples()}
    assert all(v == 300.0 for (i, j, k), v in at.items() if i in (1, nx) or j in (1, ny) or k == nz)
    assert np.isclose(at[12, 9, 2], 300 + 0.5 * fields[1][1, 8, 11]) and np.isclose(at[3, 9, 2], 300 + 0.25 * fields[1][1, 8, 2]) and np.isclose(at[12, 9, 5], 300 + 0.25 * fields[1][4, 8, 11])
    assert perturbation.band_field(spark, (8, 8, 2), 1.0, 8.0, 0.2, 0.1, [1], 1).count() == 0


def test_channels(spark):
    rows = [(1, [0.1, 0.2, 0.9, 1.0], [1000.0, 900.0, 800.0, 700.0]), (2, [0.9, 0.2, 0.3, 0.4], [1000.0, 900.0, 800.0, 700.0]), (3, [0.1, 0.3, 0.5, 0.7], [1000.0, 900.0, 800.0, 700.0]), (4, [0.1, None, 0.5, 0.7], [1000.0, 900.0, 800.0, 700.0]), (5, [0.1], [1000.0]), (6, None, [1000.0])]
    made = spark.createDataFrame(rows, "id long, tr array<double>, pr array<double>")
    got = {r.id: r.lev for r in made.select("id", satellite.channel_level(F.col("tr"), F.col("pr")).alias("lev")).collect()}
    assert got[1] == 850 and got[2] == 950 and got[3] in (950, 850, 750) and got[4] is None and got[5] is None and got[6] is None
    place = spark.createDataFrame([(140.7, 0.0), (140.7, 45.0), (60.7, 0.0)], "lon double, lat double").select(satellite.zenith_angle(F.col("lon"), F.col("lat"), 140.7).alias("a")).collect()
    assert abs(place[0].a) < 1e-5 and 51 < place[1].a < 54 and 88 < place[2].a < 91
    sky = spark.range(1).select(satellite.signed_by_sky(F.lit(250.0), F.lit(256.0), 5.0), satellite.signed_by_sky(F.lit(250.0), F.lit(254.0), 5.0), satellite.cloud_fraction(F.lit(-1.0), F.lit(0.2), 0.5), satellite.cloud_fraction(F.lit(None).cast("double"), F.lit(0.2)))
    assert list(sky.first()) == [-250.0, 250.0, 0.4, None]


def test_global_grid(spark):
    lats = [-80.0, -50.0, -10.0, 5.0, 60.0, 85.0]
    columns = spark.createDataFrame([(i, j, [1e5 * (1 + 0.01 * (i + j)) * float(np.exp(-k / 2)) for k in range(4)]) for i in range(1, 9) for j in range(1, 7)], "i int, j int, p array<double>")
    obs = [(1, 3073, 0.0, 0.0, 9e4), (2, 3073, 360.0, 0.0, 9e4), (3, 3073, 350.0, 0.0, 9e4), (4, 3073, 100.0, -85.0, 9e4), (5, 3073, 100.0, 86.0, 9e4), (6, 3073, 100.0, 30.0, 1.6e5), (7, 3073, 100.0, 30.0, 1e3), (8, 14593, 100.0, 30.0, 5.0), (9, 3073, -5.0, 0.0, 9e4), (10, 3073, None, 0.0, 9e4), (11, 3073, 45.0, -50.0, 7e4), (12, 3073, 100.0, 30.0, 1e7)]
    got = {r.obs_id: r for r in globalgrid.global_places(spark.createDataFrame(obs, "obs_id long, elm int, lon double, lat double, lev double"), columns, lats, 8, below=3).collect()}
    assert len(got) == len(obs) and all(got[n].ri is None and got[n].rk is None for n in (4, 5, 9, 10))
    assert got[1].ri == got[2].ri == 9.0 and np.isclose(got[3].ri, 350 / 45 + 1) and np.isclose(got[1].rj, 3 + 10 / 15) and np.isclose(got[11].rj, 2.0)
    assert got[7].rk is None and got[8].rk == 0.0 and 1 < got[6].rk < 4 and got[12].rk < 1

    def place(n):
        r, (_, _, _, _, lev) = got[n], obs[n - 1]
        level = np.zeros(7)
        for a in (0, 1):
            for b in (0, 1):
                i, j = int(np.ceil(r.ri)) - 1 + a, int(np.ceil(r.rj)) - 1 + b
                w = abs(1 - a - (r.ri - np.ceil(r.ri) + 1)) * abs(1 - b - (r.rj - np.ceil(r.rj) + 1))
                p = [1e5 * (1 + 0.01 * ((i - 1) % 8 + 1 + j)) * np.exp(-k / 2) for k in range(4)]
                level += w * np.log([p[0] + m * (p[0] - p[1]) for m in (3, 2, 1)] + p)
        k = next(k for k in range(1, 7) if level[k] < np.log(lev))
        return k + (np.log(lev) - level[k - 1]) / (level[k] - level[k - 1])

    assert all(np.isclose(got[n].rk, place(n)) for n in (1, 2, 3, 6, 11, 12))


def test_analysis_at_observations_against_loops(spark):
    r = np.random.default_rng(11)
    m, n = 5, 40
    places = [(k, float(r.uniform(1, 6)), float(r.uniform(1, 5)), float(r.uniform(4e4, 1e5))) for k in range(n)]
    values = r.normal(size=(n, m))
    y = values - values.mean(axis=1, keepdims=True)
    dep, err = r.normal(size=n), 1.0 + r.integers(0, 3, n)
    obs = [(k, 3073, 1, ri, rj, lev, 0.0, float(err[k]), float(dep[k]), 0.4, 0.6, y[k].tolist()) for k, ri, rj, lev in places if k % 3]
    schema = "obs_id long, elm int, typ int, ri double, rj double, lev double, dat double, err double, dep double, hori_loc double, vert_loc double, y array<double>"
    targets = spark.createDataFrame(places, "obs_id long, ri double, rj double, p double")
    hx = spark.createDataFrame([(k, e + 1, float(values[k, e])) for k in range(n) for e in range(m)], "obs_id long, mem int, hx double")
    for of_a_task in (1000, 7):
        got = {(x.obs_id, x.mem): (x.xa, x.n_obs) for x in volume.analysis_at_observations(targets, hx, spark.createDataFrame(obs, schema), widest=0.4, tile=3, inflation=1.1, of_a_task=of_a_task).collect()}
        assert len(got) == n * m
        for k, ri, rj, lev in places:
            near = [(o, np.hypot(ri - o[3], rj - o[4]) / 0.4, abs(np.log(lev) - np.log(o[5])) / 0.6) for o in obs]
            near = [(o, h * h + v * v) for o, h, v in near if h <= 3.651483717 and v <= 3.651483717 and h * h + v * v <= 13.33333333]
            want = kernels.analysed(values[k], np.array([o[11] for o, _ in near]).reshape(-1, m), np.array([o[8] for o, _ in near]), np.array([o[7] ** 2 / np.exp(-0.5 * d) for o, d in near]), 1.1)
            assert got[k, 1][1] == len(near) and np.allclose([got[k, e + 1][0] for e in range(m)], want)


def test_leading_modes_against_the_kalman_filter():
    """With as few modes as explain a share of the variance, the mean is that of a Kalman filter with their covariance, and the rest of the perturbations stays."""
    for seed in range(8):
        r = np.random.default_rng(seed)
        x = (r.normal(size=(12, 9)) * np.geomspace(5, 0.1, 12)[:, None]) + 3
        mean = x.mean(axis=1, keepdims=True)
        h, variance, d = r.normal(size=(6, 12)), r.uniform(0.5, 2, 6), r.normal(size=6)
        values, vectors = np.linalg.eigh((x - mean) @ (x - mean).T / 8)
        values, vectors = values[::-1], vectors[:, ::-1]
        for share in (0.5, 0.9, 1.0):
            kept = 8 if share == 1 else int(np.searchsorted(np.cumsum(values) / values.sum(), share)) + 1
            q = vectors[:, :kept]
            prior = (q * values[:kept]) @ q.T
            gain = prior @ h.T @ np.linalg.inv(h @ prior @ h.T + np.diag(variance))
            new = kernels.eigenspace_analysis(x, h @ (x - mean), d, variance, share=share)
            assert np.allclose(new.mean(axis=1), mean[:, 0] + gain @ d)
            after, rest = (new - new.mean(axis=1, keepdims=True)), np.eye(12) - q @ q.T
            assert np.allclose(rest @ after, rest @ (x - mean))
            assert np.allclose(q.T @ after @ after.T @ q / 8, q.T @ (prior - gain @ h @ prior) @ q)
            error = r.normal(size=12)
            fit, *_ = np.linalg.lstsq(q, error, rcond=None)
            assert np.isclose(kernels.explained(x - mean, error, share), 1 - ((error - q @ fit) ** 2).sum() / (error**2).sum())
    assert kernels.explained(np.zeros((3, 4)), np.ones(3)) == 0 and np.isnan(kernels.explained(np.ones((3, 4)), np.zeros(3)))
