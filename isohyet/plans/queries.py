"""The registered queries and, where SQL can express them, their equivalents in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isohyet.functions import codes, physics
from isohyet.operators import bias, gridded, inflation, kernels, localization, superob, volume
from isohyet.operators import observations as ob
from isohyet.plans import fixtures as fx
from isohyet.plans.registry import register, rounded
from isohyet.sources import states

OBS = f"with obs as ({fx.duck_obs()}), ens as ({fx.ENS_DUCK}),\n"
CODED = f"""coded as (select *, cast(ceil(dif / 3600 - 0.5) as int) + 13 slot,
  case when not (ri between 1 and 25 and rj between 1 and {fx.ROWS}) then 98
       when not (cast(ceil(dif / 3600 - 0.5) as int) + 13 between 3 and 23) then 97 else 0 end qc from obs),
"""
HX = """corner as (select obs_id, greatest(cast(ceil(ri) as int) - 1, 1) i, greatest(cast(ceil(rj) as int) - 1, 1) j, ri, rj from coded where qc = 0),
hx as (select c.obs_id, e.mem, sum((1 - abs(c.ri - e.gi)) * (1 - abs(c.rj - e.gj)) * e.x) hx from corner c
  join ens e on e.gi in (c.i, c.i + 1) and e.gj in (c.j, c.j + 1) group by 1, 2),
st as (select obs_id, avg(hx) hx_mean, stddev_samp(hx) hx_sprd from hx group by 1),
dep as (select c.obs_id, c.elm, c.typ, c.err, c.dat, c.ri, c.rj, s.hx_sprd, c.dat - s.hx_mean dep,
  case when c.qc = 0 and abs(c.dat - s.hx_mean) > 5 * c.err then 5 else c.qc end qc from coded c left join st s using (obs_id))
"""


def _simulated(spark: SparkSession, sf_dir: str) -> gridded.Simulated:
    coded = ob.position_code(fx.observations(spark, sf_dir), fx.NX, fx.rows(spark, sf_dir), fx.FIRST_SLOT, fx.LAST_SLOT)
    return gridded.Simulated(coded, fx.ensemble(spark, sf_dir))


def _departures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    told = _simulated(spark, sf_dir)
    return told.departures(), ob.interpolated(told.obs.filter("qc = 0"), told.grid)


_STATS = """, s as (select * from dep where abs(dif) <= 14400)
select case elm when 3074 then 3073 when 4004 then 4001 else elm end elm, qc, count(*) n, round(avg(dep), 6) bias, round(sqrt(avg(dep * dep)), 6) rmse, round(avg(hx_sprd), 6) sprd from s group by 1, 2"""


@register(OBS + CODED + HX.replace("c.elm, c.typ", "c.elm, c.dif, c.typ") + _STATS)
def departure_stats_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of observations within four hours of the analysis."""
    return ob.departure_stats(ob.within(_departures(spark, sf_dir)[0], 14400.0))


@register(OBS + CODED + HX + """select case elm when 3074 then 3073 when 4004 then 4001 else elm end elm, qc, count(*) n, round(avg(dep), 6) bias,
  round(sqrt(avg(dep * dep)), 6) rmse, round(avg(hx_sprd), 6) sprd from dep group by 1, 2""")
def departure_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ob.departure_stats(_departures(spark, sf_dir)[0])


@register(OBS + CODED + HX + ", n as (select 1) select obs_id, elm, qc, round(dep, 6) dep, round(hx_sprd, 6) hx_sprd from dep, n")
def bilinear_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_departures(spark, sf_dir)[0].select("obs_id", "elm", "qc", "dep", "hx_sprd"))


@register(OBS + CODED + "n as (select 1) select slot, qc, count(*) n_obs from coded group by 1, 2")
def slot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = ob.position_code(fx.observations(spark, sf_dir), fx.NX, fx.rows(spark, sf_dir), fx.FIRST_SLOT, fx.LAST_SLOT)
    return coded.groupBy("slot", "qc").agg(F.count("*").alias("n_obs"))


@register(OBS + "n as (select 1) select typ, elm, count(*) n_obs from obs group by cube (typ, elm)")
def obs_counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.observations(spark, sf_dir).cube("typ", "elm").agg(F.count("*").alias("n_obs"))


@register(OBS + """c as (select obs_id, elm, case when elm = 14593 then lev else lev * 100 end lev, case elm when 14593 then dat * 100 when 3331 then dat * 0.01 else dat end dat from obs)
select obs_id, elm, round(lev, 6) lev, round(dat, 6) dat, cast(1 as boolean) same from c""")
def unit_convert_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = fx.observations(spark, sf_dir)
    si = ob.to_si(obs)
    back = ob.from_si(si.withColumnsRenamed({"lev": "lev_si", "dat": "dat_si"}).withColumns({"lev": F.col("lev_si"), "dat": F.col("dat_si")})).withColumnsRenamed({"lev": "lev_b", "dat": "dat_b"})
    same = (F.abs(back.lev_b * F.when(F.col("elm") == codes.ID["PS"], 1).otherwise(100) - back.lev_si) < 1e-6) & (F.abs(back.dat_b - back.dat_si / F.when(F.col("elm") == codes.ID["PS"], 100).otherwise(1)) < 1e-6)
    return rounded(back.select("obs_id", "elm", F.col("lev_si").alias("lev"), F.col("dat_si").alias("dat"), same.alias("same")))


@register(OBS + "n as (select 1) select gi, gj, round(avg(x), 6) mean, round(stddev_samp(x), 6) sprd from ens group by 1, 2")
def ens_mean_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.ensemble(spark, sf_dir).groupBy("gi", "gj").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_samp("x"), 6).alias("sprd"))


@register("""select round(avg(o_totalprice), 4) mean_x, round(stddev_samp(c_acctbal), 6) sd_y, round(covar_samp(o_totalprice, c_acctbal), 2) cov,
  round(corr(o_totalprice, c_acctbal), 8) r, round(sum((o_totalprice - 1000) * (c_acctbal - 1000)) / sqrt(sum((o_totalprice - 1000) * (o_totalprice - 1000)) * sum((c_acctbal - 1000) * (c_acctbal - 1000))), 8) anomaly_r,
  round(sqrt(sum(c_acctbal * c_acctbal)), 4) norm_y, round(sqrt(avg(c_acctbal * c_acctbal)), 6) rms_y
from (select cast(o_totalprice as double) o_totalprice, cast(c_acctbal as double) c_acctbal from orders join customer on o_custkey = c_custkey)""")
def stats_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = fx.read(spark, sf_dir, "orders").join(fx.read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    p = joined.select(F.col("o_totalprice").cast("double").alias("x"), F.col("c_acctbal").cast("double").alias("y"))
    a, b = F.col("x") - 1000, F.col("y") - 1000
    return p.agg(
        F.round(F.avg("x"), 4).alias("mean_x"), F.round(F.stddev_samp("y"), 6).alias("sd_y"), F.round(F.covar_samp("x", "y"), 2).alias("cov"), F.round(F.corr("x", "y"), 8).alias("r"),
        F.round(F.sum(a * b) / F.sqrt(F.sum(a * a) * F.sum(b * b)), 8).alias("anomaly_r"), F.round(F.sqrt(F.sum(F.col("y") * F.col("y"))), 4).alias("norm_y"), F.round(F.sqrt(F.avg(F.col("y") * F.col("y"))), 6).alias("rms_y"),
    )


POINTS = "select s_suppkey id, cast((s_suppkey * 37) % 360 - 180 as double) lon1, cast((s_suppkey * 53) % 179 - 89 as double) lat1, cast((s_suppkey * 71) % 360 - 180 as double) lon2, cast((s_suppkey * 29) % 179 - 89 as double) lat2 from {supplier}"
RAD = "(3.1415926535 / 180)"


@register(f"""with p as ({POINTS.format(supplier='supplier')})
select id, round(acos(least(1.0, greatest(-1.0, sin(lat1*{RAD})*sin(lat2*{RAD}) + cos(lat1*{RAD})*cos(lat2*{RAD})*cos((lon2-lon1)*{RAD})))) * 6371300, 1) distance from p""")
def great_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.sql(POINTS, supplier=fx.read(spark, sf_dir, "supplier"))
    return rounded(p.select("id", physics.great_circle(p.lon1, p.lat1, p.lon2, p.lat2).alias("distance")), 1)


@register(f"""with p as ({POINTS.format(supplier='supplier')}), q as (select *, id % 5000 * 1000.0 / 6371300 d, (id * 7 % 360) * {RAD} a, lat1 * {RAD} y from p),
r as (select *, asin(sin(y)*cos(d) + cos(y)*sin(d)*cos(a)) y2 from q)
select id, round(lon1 + atan2(sin(d)*sin(a)*cos(y), cos(d) - sin(y)*sin(y2)) / {RAD}, 6) lon, round(y2 / {RAD}, 6) lat from r""")
def arc_destination(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.sql(POINTS, supplier=fx.read(spark, sf_dir, "supplier"))
    lon, lat = physics.destination(p.lon1, p.lat1, F.col("id") % 5000 * 1000.0, (F.col("id") * 7 % 360).cast("double"))
    return rounded(p.select("id", lon.alias("lon"), lat.alias("lat")))


STATE = """select l_orderkey id, l_linenumber ln, 0.5 + cast(l_discount as double) * 8 rho, cast(l_quantity as double) - 25 u, cast(l_tax as double) * 100 v, cast(l_discount as double) * 10 - 0.5 w,
  230 + cast(l_quantity as double) * 1.5 t, 30000 + cast(l_extendedprice as double) / 105000 * 70000 p, cast(l_tax as double) / 5 qv, cast(l_discount as double) / 50 qr, cast(l_tax as double) / 40 qs from {lineitem}"""
HEAT = (1397.0, 4218.0, 2106.0)


@register(f"""with s as ({STATE.format(lineitem='lineitem')}), g as (select *, 287.05 * (1 - qv - qr - qs) + 461.5 * qv r, 718.65 * (1 - qv - qr - qs) + qv * 1397 + qr * 4218 + qs * 2106 cv from s)
select id, ln, round(p / (r * t), 6) rho, round(p / (r * t) * u, 6) rhou, round(100000 / r * power(p / 100000, cv / (cv + r)), 6) rhot, round(t, 6) t, round(p, 3) p from g""")
def thermo_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State from physical variables, and back again for t and p."""
    s = spark.sql(STATE, lineitem=fx.read(spark, sf_dir, "lineitem"))
    q = [s.qv, s.qr, s.qs]
    made = s.withColumnsRenamed({"rho": "rho0"}).withColumns(physics.physical_to_state(s.u, s.v, s.w, s.t, s.p, q, HEAT))
    q = [made.qv, made.qr, made.qs]
    back = physics.state_to_physical(made.rho, [made.rhou, made.rhov, made.rhow], made.rhot, q, HEAT)
    return made.select("id", "ln", *[F.round(c, 6).alias(c) for c in ("rho", "rhou", "rhot")], F.round(back["t"], 6).alias("t"), F.round(back["p"], 3).alias("p"))


@register(f"""with s as ({STATE.format(lineitem='lineitem')}), e as (select *, t - 273.15 c from s),
x as (select *, 6.11 * exp(17.3 * c / (237.3 + c)) wat, 6.1121 * exp(22.587 * c / (273.86 + c)) ice from e)
select id, ln, round(qv * p * 0.01 / (0.378 * qv + 0.622) / case when c >= 0 then wat when c <= -15 then ice else wat * (15 + c) / 15 - ice * c / 15 end, 6) rh,
  round(p * power((t * (1 + 0.608 * qv) - 0.005 * w * 100) / (t * (1 + 0.608 * qv)), 9.81 / (0.005 * 287.05)), 3) p_adj from x""")
def rel_humidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.sql(STATE, lineitem=fx.read(spark, sf_dir, "lineitem"))
    return s.select("id", "ln", F.round(physics.relative_humidity(s.t, s.qv, s.p), 6).alias("rh"), F.round(physics.pressure_at(s.p, s.w * 100, s.t, s.qv), 3).alias("p_adj"))


@register(f"""with s as ({STATE.format(lineitem='lineitem')}), z as (select *, qr + qs qt,
  case when qr + qs > 0 then 7.2e20 / (power(3.1415926535, 1.75) * power(8e6, 0.75) * power(1000.0, 1.75)) * power(rho * (qr + qs), 1.75) else 0 end ref from s),
f as (select *, case when qt > 0 then 5.4 * power(100000 / p, 0.4) * power(qt, 0.125) else 0 end wt from z)
select id, ln, round(ref, 3) ref, case when ref < 10 then 'RE0' else 'REF' end element, round(case when ref < 10 then 10 when ref < 1e10 then 10 * log10(ref) end, 5) dbz,
  round(u * cos(w * {RAD}) * sin(t * {RAD}) + v * cos(w * {RAD}) * cos(t * {RAD}) + (w - wt) * sin(w * {RAD}), 6) vr from f""")
def radar_ref_m1(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.sql(STATE, lineitem=fx.read(spark, sf_dir, "lineitem"))
    s = s.withColumn("ref", physics.reflectivity_of_total(s.rho, s.qr, s.qs, F.lit(0.0)))
    element, dbz = physics.radar_preprocessed(s.ref)
    vr = physics.radial_velocity(s.u, s.v, s.w, s.t, s.w, physics.terminal_velocity(s.qr + s.qs, s.p))
    return s.select("id", "ln", F.round("ref", 3).alias("ref"), element.alias("element"), F.round(dbz, 5).alias("dbz"), F.round(vr, 6).alias("vr"))


@register("""with d as (select s_suppkey id, (s_suppkey % 400) / cast(100 as double) dist from supplier), b as (select *, dist / sqrt(cast(10 as double) / 3) b from d)
select id, round(case when b <= 1 then 1 - power(b,5)/4 + power(b,4)/2 + power(b,3)*5/8 - b*b*5/3
  when b <= 2 then power(b,5)/12 - power(b,4)/2 + power(b,3)*5/8 + b*b*5/3 - 5*b + 4 - 2/(3*b) else 0 end, 6) weight from b""")
def schur_taper(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.read(spark, sf_dir, "supplier")
    return rounded(s.select(F.col("s_suppkey").alias("id"), physics.taper(F.col("s_suppkey") % 400 / 100.0, 1.0).alias("weight")))


SCALE = 0.4
LOCAL = OBS + CODED + HX + f""", pt as (select distinct gi, gj from ens), ok as (select * from dep where qc = 0),
near as (select p.gi, p.gj, o.obs_id, o.typ, o.err, (power(p.gi - o.ri, 2) + power(p.gj - o.rj, 2)) / {SCALE * SCALE} nd2
  from pt p join ok o on sqrt(power(p.gi - o.ri, 2) + power(p.gj - o.rj, 2)) / {SCALE} <= 3.651483717 and (power(p.gi - o.ri, 2) + power(p.gj - o.rj, 2)) / {SCALE * SCALE} <= 13.33333333),
loc as (select p.gi, p.gj, n.obs_id, n.typ, n.nd2, exp(-0.5 * n.nd2) rloc, n.err * n.err / exp(-0.5 * n.nd2) rdiag from pt p left join near n using (gi, gj))
"""


def _local(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    dep, hx = _departures(spark, sf_dir)
    grid = fx.ensemble(spark, sf_dir)
    good = dep.filter("qc = 0").select("obs_id", "elm", "typ", "err", "ri", "rj")
    return localization.local_observations(grid.select("gi", "gj").distinct(), good, SCALE), dep, hx, grid


def _whole(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Departures, simulated observations, the ensemble of all vectors and values, and the rows of its grid."""
    grid, ny = fx.whole_ensemble(spark, sf_dir)
    dep, hx = _departures(spark, sf_dir)
    return dep, hx, grid, ny


def _at_points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Departures and simulated values of those observations alone whose id names the place of a point, and the ensemble with that id."""
    told = _simulated(spark, sf_dir)
    grid = told.grid.withColumn("obs_id", (F.col("gi") + 25 * F.col("gj")).cast("long"))
    named = told.obs.join(grid.select("obs_id").distinct(), "obs_id", "left_semi")
    hx = ob.interpolated(named.filter("qc = 0"), told.grid)
    return ob.departures(named, hx), hx, grid


@register(LOCAL + "select gi, gj, obs_id, typ, round(nd2, 6) nd2, round(rloc, 6) rloc, round(rdiag, 3) rdiag from loc")
def local_obs_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = _local(spark, sf_dir)[0]
    return local.select("gi", "gj", "obs_id", "typ", F.round("nd2", 6).alias("nd2"), F.round("rloc", 6).alias("rloc"), F.round("rdiag", 3).alias("rdiag"))


@register(LOCAL + "select gi, gj, count(obs_id) n_obs, round(sqrt(max(nd2)), 6) farthest from loc group by 1, 2")
def obs_per_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return localization.counted(_local(spark, sf_dir)[0])


def _points_and_good(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Points and good observations, these as a table, since counts and pairs both read them."""
    good = _simulated(spark, sf_dir).departures().filter("qc = 0").select("obs_id", "elm", "typ", "err", "ri", "rj")
    return fx.ensemble(spark, sf_dir).select("gi", "gj").distinct(), states.kept(good, "good")


def _top(order: str, by: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        points, good = _points_and_good(spark, sf_dir)
        return localization.best_local(points, good, SCALE, 2, order, "typ").select("gi", "gj", "typ", "obs_id", "rank")

    def by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
        points, good = _points_and_good(spark, sf_dir)
        good = good.withColumn("limit_group", localization.limit_group(F.col("elm"), F.col("typ")))
        return localization.best_local(points, good, SCALE, 2, order).select("gi", "gj", "elm", "typ", "obs_id", "rank")

    query.__name__ = "local_topk_" + {"distance": "dist", "weight": "rloc", "error": "rdiag"}[order]
    register(LOCAL + f""", r as (select gi, gj, typ, obs_id, cast(row_number() over (partition by gi, gj, typ order by round({by}, 9) {'desc' if order == 'weight' else 'asc'}, obs_id) as int) rank from loc)
select * from r where rank <= 2""")(query)
    by_class.__name__ = query.__name__.replace("topk", "topk_class")
    register(LOCAL + f""", r as (select l.gi, l.gj, d.elm, l.typ, l.obs_id, cast(row_number() over (partition by l.gi, l.gj, case when l.typ = 22 and d.elm = 4004 then 4001 else d.elm end, l.typ order by round(l.{by}, 9) {'desc' if order == 'weight' else 'asc'}, l.obs_id) as int) rank
  from loc l left join dep d using (obs_id)) select * from r where rank <= 2""")(by_class)


for _order, (_column, _) in localization.ORDERS.items():
    _top(_order, _column)

ONE = OBS + CODED + HX + """, near as (select e.gi, e.gj, o.obs_id, o.err, o.dep from (select distinct gi, gj from ens) e join dep o on o.obs_id = (e.gi + 25 * e.gj) and o.qc = 0),
y as (select n.gi, n.gj, h.mem, h.hx - avg(h.hx) over (partition by n.gi, n.gj) y, n.dep, n.err * n.err r from near n join hx h using (obs_id)),
s as (select gi, gj, sum(y * y) yy, max(dep) d, max(r) r, 63 / cast(1.69 as double) + sum(y * y) / max(r) lam from y group by 1, 2),
x as (select gi, gj, mem, x, avg(x) over (partition by gi, gj) xm from ens),
a as (select x.gi, x.gj, sum((x.x - x.xm) * y.y) xy from x join y using (gi, gj, mem) group by 1, 2)
select x.gi, x.gj, x.mem, round(case when s.lam is null then x.xm + sqrt(cast(1.69 as double)) * (x.x - x.xm)
  else x.xm + sqrt(cast(1.69 as double)) * (x.x - x.xm) + a.xy * (s.d / (s.r * s.lam) + (sqrt(63 / s.lam) - sqrt(cast(1.69 as double))) * y.y / s.yy) end, 5) xa
from x left join y using (gi, gj, mem) left join s using (gi, gj) left join a using (gi, gj)
"""


@register(ONE)
def letkf_one_obs_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter with at most one observation per point, for which there is a closed form."""
    dep, hx = _departures(spark, sf_dir)
    grid = fx.ensemble(spark, sf_dir)
    points = grid.select("gi", "gj").distinct().withColumn("want", F.col("gi") + 25 * F.col("gj"))
    good = dep.filter("qc = 0").select("obs_id", (F.col("err") * F.col("err")).alias("rdiag"))
    local = points.join(good, points.want == good.obs_id, "left").select("gi", "gj", "obs_id", "rdiag")
    packed = kernels.packed_points(grid, local, hx, dep)
    return rounded(kernels.analysis(packed, inflation=1.69), 5)


@register()
def letkf_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Localized analysis of every point with inflation 1.69 and relaxation 0.8."""
    told = _simulated(spark, sf_dir)
    grid = told.grid
    good = states.kept(told.departures().filter("qc = 0").select("obs_id", "elm", "typ", "ri", "rj", "lev", "dat", "err", "dep"), "good")
    felt = told.felt(good, grid.select("gi", "gj").distinct(), SCALE, 10).withColumns({"hori_loc": F.lit(SCALE), "vert_loc": F.lit(0.0)})
    state = grid.withColumns({"k": F.lit(1), "p": F.lit(1.0)})
    out = volume.analysis_by_tile(state, ["x"], felt, widest=SCALE, most=10, inflation=1.69, rtpp=0.8)
    return out.select("gi", "gj", "mem", F.round("x", 5).alias("xa"))


@register(OBS + CODED + HX + """, z as (select e.gi, e.gj, e.mem, e.x, h.hx, o.dep, o.err from ens e join dep o on o.obs_id = (e.gi + 25 * e.gj) and o.qc = 0 join hx h on h.obs_id = o.obs_id and h.mem = e.mem)
select gi, gj, round(covar_samp(x, hx) / (var_samp(hx) + max(err * err)), 6) gain, round(avg(x) + covar_samp(x, hx) / (var_samp(hx) + max(err * err)) * max(dep), 5) xa_mean from z group by 1, 2""")
def enkf_scalar_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    dep, hx, grid = _at_points(spark, sf_dir)
    z = grid.join(dep.filter("qc = 0").select("obs_id", "dep", (F.col("err") * F.col("err")).alias("r")), "obs_id").join(hx, ["obs_id", "mem"])
    told = bias.scalar_gain(z, ["gi", "gj"])
    return told.select("gi", "gj", F.round("gain", 6).alias("gain"), F.round("xa_mean", 5).alias("xa_mean"))


CELLS = OBS + CODED + "c as (select *, cast(round(ri) as int) ci, cast(round(rj) as int) cj from coded where qc = 0),\n"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = ob.position_code(fx.observations(spark, sf_dir), fx.NX, fx.rows(spark, sf_dir), fx.FIRST_SLOT, fx.LAST_SLOT).filter("qc = 0")
    return coded.withColumns({"ci": F.round("ri").cast("int"), "cj": F.round("rj").cast("int")})


@register(CELLS + """r as (select *, row_number() over (partition by elm, ci, cj order by err, sqrt(power(ri - ci, 2) + power(rj - cj, 2)), obs_id) k from c)
select elm, ci, cj, cast(1 as bigint) n_used, ri, rj, dat, err from r where k = 1""")
def superob_m1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superob.merged(_cells(spark, sf_dir), ["elm", "ci", "cj"], 1)


@register(CELLS + "n as (select 1) select elm, ci, cj, count(*) n_used, round(avg(ri), 6) ri, round(avg(rj), 6) rj, round(avg(dat), 6) dat, min(err) err from c group by 1, 2, 3")
def superob_m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superob.merged(_cells(spark, sf_dir), ["elm", "ci", "cj"], 2)


@register(CELLS + """m as (select *, min(err) over (partition by elm, ci, cj) least from c)
select elm, ci, cj, count(*) n_used, round(avg(ri), 6) ri, round(avg(rj), 6) rj, round(avg(dat), 6) dat, min(err) err from m where err = least group by 1, 2, 3""")
def superob_m3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superob.merged(_cells(spark, sf_dir), ["elm", "ci", "cj"], 3)


@register(OBS + CODED + """d as (select *, row_number() over (partition by elm, ri, rj, lev order by abs(slot - 13), slot, obs_id) k from coded where qc = 0)
select obs_id, elm, slot from d where k = 1""")
def superob_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of observations of one element at one place, the one nearest to the base slot stays; the earlier slot wins ties."""
    coded = ob.position_code(fx.observations(spark, sf_dir), fx.NX, fx.rows(spark, sf_dir), fx.FIRST_SLOT, fx.LAST_SLOT).filter("qc = 0")
    return superob.temporal(coded, ["elm", "ri", "rj", "lev"], 13).select("obs_id", "elm", "slot")


@register(OBS + """i as (select elm, typ, case when rj < 10 then 'S' else 'N' end region, dat - 50 * err impact from obs)
select elm, typ, region, count(*) n_obs, round(sum(impact), 4) total, round(100 * avg(case when impact < 0 then 1 else 0 end), 6) percent_negative from i group by rollup (elm, typ, region)""")
def impact_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.observations(spark, sf_dir).withColumn("region", F.when(F.col("rj") < 10, "S").otherwise("N")).withColumn("impact", F.col("dat") - 50 * F.col("err"))
    return o.rollup("elm", "typ", "region").agg(F.count("*").alias("n_obs"), F.round(F.sum("impact"), 4).alias("total"), F.round(100 * F.avg(F.when(F.col("impact") < 0, 1).otherwise(0)), 6).alias("percent_negative"))


MOST_SPREAD = 0.1  # of the mean


@register(OBS + f"""n as (select gi, gj, avg(x) xm, stddev_samp(x) / avg(x) s from ens group by 1, 2)
select gi, gj, mem, round(case when s > {MOST_SPREAD} then xm + (x - xm) * {MOST_SPREAD} / s else x end, 6) x from ens join n using (gi, gj)""")
def q_spread_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perturbations shrunk where the spread, relative to the mean, exceeds its limit."""
    return rounded(inflation.limited_spread(fx.ensemble(spark, sf_dir), ["gi", "gj"], "x", MOST_SPREAD).select("gi", "gj", "mem", "x"))


@register(OBS + CODED + HX + """, z as (select e.gi, e.gj, e.mem, e.x, h.hx, o.err * o.err r from ens e join dep o on o.obs_id = (e.gi + 25 * e.gj) and o.qc = 0 join hx h on h.obs_id = o.obs_id and h.mem = e.mem),
g as (select gi, gj, avg(x) xm, avg(hx) hm, var_samp(hx) v, covar_samp(x, hx) c, max(r) r from z group by 1, 2)
select gi, gj, mem, round(x - xm - c / (v + g.r) / (1 + sqrt(g.r / (v + g.r))) * (hx - hm), 5) xa_pert from z join g using (gi, gj)""")
def enkf_serial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perturbations after a serial square-root update with one observation."""
    dep, hx, grid = _at_points(spark, sf_dir)
    z = grid.join(dep.filter("qc = 0").select("obs_id", (F.col("err") * F.col("err")).alias("r")), "obs_id").join(hx, ["obs_id", "mem"])
    return bias.square_root_update(z, ["gi", "gj"]).select("gi", "gj", "mem", F.round("pert", 5).alias("xa_pert"))
