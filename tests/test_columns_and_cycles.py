"""Columns at observations, impacts, pruned limits and cycles with a versioned state, against loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohyet.functions import codes
from isohyet.operators import impact, localization, tiles, volume
from isohyet.plans import cycle_queries, fixtures as fx
from isohyet.sources import records
from isohyet.sources.observations import CONVENTIONAL, read_radar, read_records
from isohyet.sources.versions import StateTable
from isohyet.streaming.cycle import carry_on, run_state_cycles

SF = "/root/testdata/sf0.001"


def test_pruned_limit_equals_the_whole_join(spark):
    r = np.random.default_rng(3)
    rows = [(k, int(r.integers(1, 4)), int(r.integers(1, 3)) if k % 9 else 22, float(r.integers(1, 4)), float(x), float(y)) for k, (x, y) in enumerate(np.concatenate([r.uniform(1, 12, (600, 2)), r.normal(5, 0.3, (900, 2)), np.full((12, 2), 7.0)]))]
    obs = spark.createDataFrame(rows, "obs_id long, elm int, typ int, err double, ri double, rj double").withColumn("limit_group", localization.limit_group(F.col("elm"), F.col("typ")))
    points = spark.createDataFrame([(i, j) for i in range(1, 15) for j in range(1, 13)], "gi int, gj int")
    for order in ("distance", "weight", "error"):
        for most in (1, 4):
            whole = localization.local_observations(points, obs, 0.4).withColumns({c: F.round(c, 9) for c in ("nd2", "rloc", "rdiag")})
            columns = ["gi", "gj", "obs_id", "elm", "typ", "nd2", "rdiag", "rank"]
            want = sorted((tuple(x) for x in localization.limited(whole, most, order).select(columns).collect()), key=str)
            pruned = localization.best_local(points, obs, 0.4, most, order)
            assert sorted((tuple(x) for x in pruned.select(columns).collect()), key=str) == want
    pairs = localization.best_local(points, obs.withColumn("one", F.lit(1)), 0.4, 1, "distance", "one", ranked=False).count()
    assert 4 * pairs < whole.filter("obs_id is not null").count()
    assert localization.best_local(points, obs.limit(0), 0.4, 2).filter("obs_id is null").count() == points.count()


def small_state(spark, wide=6, deep=5, levels=4, members=3):
    r = np.random.default_rng(8)
    rows = [(i, j, k, m, float(1e5 * np.exp(-(k - 1) / 2) * (1 + 0.001 * r.normal())), *map(float, r.normal(size=2)), 290 - 8.0 * k + float(r.normal()), 0.005 + 0.001 * float(r.uniform()), 10.0 * i + j) for i in range(1, wide + 1) for j in range(1, deep + 1) for k in range(1, levels + 1) for m in range(1, members + 1)]
    return spark.createDataFrame(rows, "gi int, gj int, k int, mem int, p double, u double, v double, t double, q double, topo double"), rows


def test_columns_at_observations(spark):
    state, rows = small_state(spark)
    at = {(x[0], x[1], x[2], x[3]): x for x in rows}
    places = [(1, 1.0, 1.0), (2, 6.0, 5.0), (3, 2.5, 3.25), (4, 6.2, 3.0), (5, 0.9, 3.0), (6, 3.0, 5.5), (7, 5.999, 4.001), (8, 4.0, 2.5)]
    levels = [np.log(9.9e4), np.log(5e4), np.log(7e4), np.log(6e4), np.log(6e4), np.log(6e4), np.log(2e4), np.log(1.2e5)]
    obs = spark.createDataFrame([(n, x, y, float(a)) for (n, x, y), a in zip(places, levels)], "obs_id long, ri double, rj double, at double")
    lp = state.withColumn("lp", F.ln("p"))
    for tile, of_a_task in ((8, 20_000), (2, 2)):
        got = {(x.obs_id, x.mem): x for x in tiles.columns_at(obs, lp, "lp", ["u", "t"], True, tile, of_a_task).collect()}
        assert {n for n, _ in got} == {1, 2, 3, 7, 8} and len(got) == 15
        for (n, m), x in got.items():
            _, ri, rj = places[n - 1]
            i, j = max(int(np.ceil(ri)) - 1, 1), max(int(np.ceil(rj)) - 1, 1)
            mixed = lambda f: [sum(w * f(at[a, b, k, m]) for a, b, w in ((i, j, (1 - ri + i) * (1 - rj + j)), (i + 1, j, (ri - i) * (1 - rj + j)), (i, j + 1, (1 - ri + i) * (rj - j)), (i + 1, j + 1, (ri - i) * (rj - j))) if w) for k in range(1, 5)]  # noqa: E731, B023
            axis, t = mixed(lambda s: np.log(s[4])), mixed(lambda s: s[7])
            assert x.inside == (-1 if levels[n - 1] > axis[0] else 1 if levels[n - 1] < axis[-1] else 0)
            assert np.isclose(x.t, np.interp(-levels[n - 1], -np.array(axis), t)) and np.isclose(x.t_1, t[0])


def test_every_element_has_a_value_or_a_code(spark):
    state, _ = small_state(spark)
    rows = [(1, codes.ID["RH"], 2.5, 2.5, 7e4), (2, codes.ID["PS"], 2.5, 2.5, 60.0), (3, codes.ID["PS"], 2.5, 2.5, 900.0), (4, codes.ID["Tv"], 2.5, 2.5, 7e4), (5, codes.ID["RH"], 6.5, 2.5, 7e4), (6, codes.ID["PRC"], 2.5, 2.5, 0.0), (7, codes.ID["Q"], 2.5, 2.5, 2e5)]
    obs = spark.createDataFrame([(*x, 0) for x in rows], "obs_id long, elm int, ri double, rj double, lev double, qc int")
    told = volume.observed(obs, state).groupBy("obs_id").agg(F.min("qc").alias("qc"), F.max("qc").alias("most"), F.count("hx").alias("n"), F.avg("hx").alias("hx")).collect()
    got = {x.obs_id: x for x in told}
    assert {n: x.qc for n, x in got.items()} == {1: 0, 2: 0, 3: codes.TERRAIN, 4: 0, 6: codes.UNUSED, 7: codes.BELOW_MODEL} and all(x.qc == x.most for x in told)
    assert {n: x.n for n, x in got.items()} == {1: 3, 2: 3, 3: 0, 4: 3, 6: 0, 7: 0}
    assert 0 < got[1].hx < 2 and 9e4 < got[2].hx < 1.01e5


@pytest.mark.parametrize("method", [1, 2, 3])
def test_radar_columns(spark, method):
    state, _ = small_state(spark)
    particles = state.withColumns({"z": 400.0 * (F.col("k") - 1) + F.col("gi"), "w": F.lit(0.5), "qc": F.lit(0.0), "qi": F.lit(0.0), "qr": F.lit(1e-3), "qs": F.lit(1e-4), "qg": F.lit(1e-4)})
    rows = [(1, codes.ID["REF"], 2.5, 2.5, 500.0), (2, codes.ID["Vr"], 2.5, 2.5, 500.0), (3, codes.ID["REF"], 2.5, 2.5, 5000.0), (4, codes.ID["Vr"], 2.5, 2.5, 0.5), (5, codes.ID["REF"], 2.5, 7.0, 500.0)]
    obs = spark.createDataFrame([(*x, 130.0 + 0.01 * x[2], 34.0 + 0.01 * x[3], 0) for x in rows], "obs_id long, elm int, ri double, rj double, lev double, lon double, lat double, qc int")
    got = {}
    for x in volume.observed_radar(obs, particles, (130.2, 34.2, 10.0), method).collect():
        got.setdefault(x.obs_id, []).append((x.qc, x.hx))
    assert set(got) == {1, 2, 3, 4} and all(len(v) == 3 for v in got.values())
    assert all(q == 0 and 30 < h < 60 for q, h in got[1]) and all(q == 0 and abs(h) < 12 for q, h in got[2])
    assert all((q, h) == (codes.ABOVE_MODEL, None) for q, h in got[3]) and all((q, h) == (codes.BELOW_MODEL, None) for q, h in got[4])


def test_three_terms_against_loops(spark):
    r = np.random.default_rng(4)
    members = 5
    points = [(i, j, k, i + float(r.normal(0, 0.2)), j + float(r.normal(0, 0.2)), float(1e5 * np.exp(-k / 3)), 700.0 * k) for i in range(1, 7) for j in range(1, 6) for k in (1, 2)]
    products = [(*p[:3], *[r.normal(size=members).tolist() for _ in range(3)]) for p in points if p[0] != 3]
    kinds = [(codes.ID["T"], 1), (codes.ID["PS"], 1), (codes.ID["PRC"], 2), (codes.ID["REF"], codes.RADAR_TYPE)]
    obs = []
    for n in range(60):
        elm, typ = kinds[n % 4]
        lev, vert = (float(r.uniform(300, 1500)), 600.0) if typ == codes.RADAR_TYPE else (float(r.uniform(4e4, 1e5)), 0.5 if n % 8 else 0.0)
        obs.append((n, elm, typ, float(r.uniform(0.5, 7)), float(r.uniform(0.5, 6)), lev, 8e4, 1.0 + n % 3, float(r.normal()), 0.5, vert, r.normal(size=members).tolist()))
    base = {codes.ID["PS"]: np.log(8e4), codes.ID["PRC"]: np.log(85000.0)}
    want = {}
    for n, elm, typ, ri, rj, lev, _, err, dep, hori, vert, y in obs:
        sums = np.zeros(3)
        for p in products:
            x = next(q for q in points if q[:3] == p[:3])
            if elm == codes.ID["REF"]:
                apart = abs(lev - x[6])
            else:
                apart = abs(base.get(elm, np.log(lev)) - np.log(x[5]))
            h, v = np.hypot(x[3] - ri, x[4] - rj) / hori, apart / vert if vert else 0.0
            if h <= localization.CUTOFF and v <= localization.CUTOFF and h * h + v * v <= localization.LIMIT2:
                sums += np.exp(-0.5 * (h * h + v * v)) * np.array([np.dot(e, y) for e in p[3:]]) * dep / err**2
        want[n] = sums
    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    schema = "obs_id long, elm int, typ int, ri double, rj double, lev double, dat double, err double, dep double, hori_loc double, vert_loc double, y array<double>"
    for tile, of_a_task in ((8, 20_000), (2, 3)):
        got = impact.three_term_impact(made(points, "gi int, gj int, k int, xi double, xj double, p double, z double"), made(products, "gi int, gj int, k int, ke array<double>, pe array<double>, me array<double>"), made(obs, schema), 0.5, tile=tile, of_a_task=of_a_task).collect()
        assert len(got) == len(obs) and all(np.allclose((x.ke, x.pe, x.me), want[x.obs_id]) for x in got)
    assert sum(abs(w).sum() > 0 for w in want.values()) > 30


def test_killed_and_restarted_cycles_equal_a_batch_run(spark, tmp_path):
    """Three cycles as a stream that fails before, in and after its second one's commit; a replay changes nothing."""
    first = fx.ensemble(spark, SF).filter("mem <= 6").withColumn("infl", F.lit(1.2))
    cycles = {n: cycle_queries.cycle_observations(spark, SF, n) for n in (1, 2, 3)}
    batch = StateTable(spark, str(tmp_path / "batch"))
    batch.write(first, 0)
    for n, obs in cycles.items():
        carry_on(batch, obs, n, cycle_queries.step, lag=2)
        (obs.coalesce(1).write.mode("append").parquet(str(tmp_path / "in")))
    table = StateTable(spark, str(tmp_path / "stream"))
    table.write(first, 0)
    fails = {"step": 1, "commit": 1, "after": 1}

    def step(obs, prior, earlier, cycle):
        if cycle == 2 and fails["step"]:
            fails["step"] = 0
            raise RuntimeError("killed before the analysis")
        out = cycle_queries.step(obs, prior, earlier, cycle)
        if cycle == 2 and fails["commit"]:
            fails["commit"] = 0
            out.write.parquet(f"{table.path}/cycle-{cycle:09d}-left-behind")
            raise RuntimeError("killed before the commit")
        if cycle == 2 and fails["after"]:
            fails["after"] = 0
            table.write(out, cycle)
            raise RuntimeError("killed after the commit")
        return out

    runs = 0
    for _ in range(5):
        runs += 1
        stream = spark.readStream.schema(cycles[1].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = run_state_cycles(stream, str(tmp_path / "checkpoint"), table, step, lag=2)
        try:
            query.awaitTermination()
            break
        except Exception as e:  # noqa: BLE001
            assert "killed" in str(e)
    assert runs == 4 and table.cycles() == [0, 1, 2, 3]
    rows = lambda t, n: [(x.gi, x.gj, x.mem, round(x.x, 9), round(x.infl, 9)) for x in t.read(n).orderBy("gi", "gj", "mem").collect()]
    assert all(rows(table, n) == rows(batch, n) for n in (1, 2, 3))
    before = rows(table, 3)
    carry_on(table, cycles[3].limit(0), 3, step)
    assert rows(table, 3) == before
    assert table.sweep() == 1 and table.sweep(keep=2) == 2 and table.cycles() == [2, 3] and rows(table, 3) == before
    with pytest.raises(ValueError):
        table.read(1)
    assert not table.commit(3, "cycle-other") and rows(table, 3) == before


def test_a_file_in_many_ranges(spark, tmp_path):
    """Equal to the file as a whole, whatever the split; ragged ends and records of another length by their rules."""
    r = np.random.default_rng(2)
    rows = r.normal(size=(1000, 8)).astype(np.float32)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.dat").write_bytes(records.packed(rows))
    (folder / "b.dat").write_bytes(records.packed(rows[:7]))
    (folder / "ragged.dat").write_bytes(records.packed(rows[:3])[:-4])
    (folder / "empty.dat").write_bytes(b"")
    (folder / "_hidden.dat").write_bytes(records.packed(rows[:7]))
    for split in (1, 40, 4000, 1 << 26):
        got = read_records(spark, str(folder), split=split)
        assert got.rdd.getNumPartitions() == {1: 1007, 40: 1007, 4000: 11, 1 << 26: 2}[split]
        if split > 40:
            table = got.orderBy("set_id", "idx").toPandas()
            assert table.set_id.tolist() == ["a.dat"] * 1000 + ["b.dat"] * 7 and table.idx.tolist() == [*range(1, 1001), *range(1, 8)]
            assert (table[list(CONVENTIONAL)].to_numpy() == np.concatenate([rows, rows[:7]])).all()
    assert read_records(spark, str(folder), whole=True).filter("set_id = 'ragged.dat'").count() == 2
    with pytest.raises(Exception, match="no whole number"):
        read_records(spark, str(folder), strict=True).count()
    (tmp_path / "six.dat").write_bytes(records.packed(rows[:20, :6]))
    with pytest.raises(Exception, match="another length"):
        read_records(spark, str(tmp_path / "six.dat"), strict=True).count()
    assert read_records(spark, "file:" + str(tmp_path / "six.dat"), CONVENTIONAL[:6]).count() == 20
    assert records.splittable("/x/y") and records.splittable("s3://b/x") and not records.splittable("viewfs://s/x") and not records.splittable("/x/*.dat")
    out = str(tmp_path / "out")
    made = spark.createDataFrame([(float(k), None if k == 3 else 1.5) for k in range(50)], "a double, b double").repartition(3)
    records.write(made, out, head=(1.0, 2.0, 3.0))
    records.write(made.limit(0), out)
    back = records.scan(spark, out, ("a", "b"), head_values=3, split=50, ragged="error")
    assert sorted(x.a for x in back.collect()) == [float(k) for k in range(50)] and back.filter("meta = array(1D, 2D, 3D)").count() == 50 and back.filter("isnan(b)").count() == 1
    records.write(made.limit(4), out, mode="overwrite")
    assert records.scan(spark, out, ("a", "b")).count() == 4
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]
    assert read_radar(spark, str(tmp_path / "six.dat")).count() == 0


@pytest.mark.parametrize("name", ["efso", "efso_by_region"])
def test_impact_queries_against_sql(spark, name):
    import duckdb

    import oracle
    from isohyet.plans import QUERIES, impact_queries

    sql = {"efso": impact_queries.EFSO_SQL, "efso_by_region": impact_queries.EFSO_BY_REGION_SQL}[name]
    for attempt in range(8):
        try:
            return oracle.compare(spark, name, QUERIES[name], sql, SF)
        except duckdb.InternalException:  # of the engine, not of the values
            if attempt == 7:
                raise
