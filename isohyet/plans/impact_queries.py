"""Queries of the impact of observations on forecasts, and of observations of every kind in the analysis, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isohyet.functions import codes
from isohyet.operators import impact, volume
from isohyet.plans import fixtures as fx
from isohyet.plans.registry import register, rounded
from isohyet.plans.volume_queries import HX3, INFLATION, PLAIN_HEAD, VCODED, _felt, _volume
from isohyet.sources import states

LENGTH = 0.3
#: Grid lines lie a tenth of a degree apart, from 0 and from 30 degrees north; the forecast is one of six hours.
WEST, SOUTH, STEP, HOURS, RATE = 0.0, 30.0, 0.1, 6.0, 0.05
LEVELS, AREA = (1, 3), (0.2, 2.3, 30.2, 33.0)

FORECAST = """select gi, gj, k, mem, u + 0.2e0 * v u, v - 0.1e0 * u v, t + 0.05e0 * u t, q * (1 + 0.001e0 * u) q, p * (1 + 0.0001e0 * (u - 50)) p from {vol}"""
#: Mean forecasts and the verifying analysis, from the mean of the forecast's members.
MEANS = """select gi, gj, k, u + {s} * (gi % 3) u, v - {s} * (gj % 4) v, t + {s} * (k - 2) t, q + {s} * 0.0001e0 * (gi % 2) q, p + {s} * 20 * (gj % 3) p from {mean}"""
RECENT, OLDER, VERIFYING = "0.0e0", "0.7e0", "-0.4e0"


def _places(df: DataFrame) -> DataFrame:
    return df.withColumns({"lon": WEST + (F.col("gi") - 1) * STEP, "lat": SOUTH + (F.col("gj") - 1) * STEP, "share": F.sqrt(F.cos(F.radians(SOUTH + (F.col("gj") - 1) * STEP)) / 500)})


def _impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three terms for every observation that all members can simulate, with its type, element and latitude."""
    obs, state = _volume(spark, sf_dir)
    forecast = spark.sql(FORECAST.format(vol="{vol}"), vol=state)
    averages = [F.avg(c).alias(c) for c in ("u", "v", "t", "q", "p")]
    mean, analysed = forecast.groupBy("gi", "gj", "k").agg(*averages), state.groupBy("gi", "gj", "k").agg(*averages)
    recent, older, verifying = (spark.sql(MEANS.format(s=s, mean="{mean}"), mean=mean) for s in (RECENT, OLDER, VERIFYING))
    products = impact.energy_products(_places(forecast), impact.forecast_error(recent, older, verifying), LEVELS, AREA)
    winds = _places(analysed).join(mean.select("gi", "gj", "k", F.col("u").alias("uf"), F.col("v").alias("vf")), ["gi", "gj", "k"]).withColumnsRenamed({"u": "ua", "v": "va"})
    moved = impact.advected_points(winds, HOURS, RATE)
    points = moved.select("gi", "gj", "k", ((F.col("lon") - WEST) / STEP + 1).alias("xi"), ((F.col("lat") - SOUTH) / STEP + 1).alias("xj"), "p", (8000 * F.ln(100000 / F.col("p"))).alias("z"))
    felt = _felt(obs, state).filter(F.col("elm") != codes.ID["PS"]).withColumns({"hori_loc": F.lit(LENGTH), "vert_loc": F.lit(LENGTH), "typ": F.col("typ") % 20 + 1})
    told = impact.three_term_impact(points, products, felt, LENGTH)
    return told.join(felt.select("obs_id", "elm", "typ", (SOUTH + (F.col("rj") - 1) * STEP - 31).alias("lat")), "obs_id")


SIX = f"{HOURS} * {RATE} * 3600 * 180 / (3.1415926535e0 * 6371300.0e0)"
EFSO = VCODED + HX3 + f""",
fc as ({FORECAST.format(vol="vol")}), fm as (select gi, gj, k, avg(u) u, avg(v) v, avg(t) t, avg(q) q, avg(p) p from fc group by 1, 2, 3), am as (select gi, gj, k, avg(u) u, avg(v) v, avg(p) p from vol group by 1, 2, 3),
ra as ({MEANS.format(s=RECENT, mean="fm")}), oa as ({MEANS.format(s=OLDER, mean="fm")}), va as ({MEANS.format(s=VERIFYING, mean="fm")}),
er as (select gi, gj, k, (r.u + o.u) / 2 - a.u u, (r.v + o.v) / 2 - a.v v, (r.t + o.t) / 2 - a.t t, (r.q + o.q) / 2 - a.q q, (r.p + o.p) / 2 - a.p p from ra r join oa o using (gi, gj, k) join va a using (gi, gj, k)),
la as (select gi, gj, k, p, first_value(p) over w ps, case when k = 1 then p else (lag(p) over w + p) / 2 end - case when k = 4 then 0 else (p + lead(p) over w) / 2 end dp,
  {WEST} + (gi - 1) * {STEP}e0 lon, {SOUTH} + (gj - 1) * {STEP}e0 lat from fm window w as (partition by gi, gj order by k)),
lw as (select *, cos(radians(lat)) / 500 / 15 share from la where k between {LEVELS[0]} and {LEVELS[1]} and lon between {AREA[0]} and {AREA[1]} and lat between {AREA[2]} and {AREA[3]}),
e0 as (select f.gi, f.gj, f.k, f.mem, dp / ps * share * ((f.u - m.u) * e.u + (f.v - m.v) * e.v) ke,
  dp / ps * share * 1005.7e0 / 280 * (f.t - m.t) * e.t + case when f.k = 1 then 287.05e0 * 280 / 1e10 * share * (f.p - m.p) * e.p else 0 end pe, dp / ps * share * 2.5e6 * 2.5e6 / (1005.7e0 * 280) * (f.q - m.q) * e.q me
  from fc f join fm m using (gi, gj, k) join er e using (gi, gj, k) join lw using (gi, gj, k)),
en as (select gi, gj, k, mem, sum(ke) ke, sum(pe) pe, sum(me) me from e0 group by 1, 2, 3, 4),
pl as (select a.gi, a.gj, a.k, a.p, (lon - (a.u + f.u) / 2 / cos(lat * 3.1415926535e0 / 180) * {SIX} - {WEST}) / {STEP}e0 + 1 xi, (lat - (a.v + f.v) / 2 * {SIX} - {SOUTH}) / {STEP}e0 + 1 xj,
  lon - (a.u + f.u) / 2 / cos(lat * 3.1415926535e0 / 180) * {SIX} ulon from am a join fm f using (gi, gj, k) join lw using (gi, gj, k)),
pw as (select gi, gj, k, p, xj, case when ulon < 0 then xi + 360 / {STEP}e0 else xi end xi from pl),
g1 as (select h.obs_id, max(c.dat) - avg(h.hx) dep, max(c.err) err, max(c.ri) ri, max(c.rj) rj, max(c.lev) lev, max(c.elm) elm, max(c.typ) % 20 + 1 typ from hx3 h join cell c using (obs_id) group by 1 having max(h.qc) = 0 and max(c.elm) <> 14593),
y1 as (select h.obs_id, h.mem, h.hx - avg(h.hx) over (partition by h.obs_id) y from hx3 h join g1 using (obs_id)),
d1 as (select pw.gi, pw.gj, pw.k, g1.obs_id, (power(xi - ri, 2) + power(xj - rj, 2)) / {LENGTH * LENGTH} h2, power((ln(lev) - ln(p)) / {LENGTH}, 2) v2 from pw join g1 on abs(xi - ri) < 1.2 and abs(xj - rj) < 1.2),
w0 as (select gi, gj, k, obs_id, exp(-0.5 * (h2 + v2)) rloc from d1 where sqrt(h2) <= 3.651483717 and sqrt(v2) <= 3.651483717 and h2 + v2 <= 13.33333333),
w1 as materialized (select gi, gj, k, obs_id, max(rloc) rloc from w0 group by 1, 2, 3, 4),
ep as materialized (select gi, gj, k, list(ke order by mem) ke, list(pe order by mem) pe, list(me order by mem) me from en group by 1, 2, 3),
yp as materialized (select obs_id, list(y order by mem) y from y1 group by 1),
j1 as materialized (select w1.obs_id, rloc, ke, pe, me from w1 join ep using (gi, gj, k)),
s1 as (select j1.obs_id, sum(rloc * list_dot_product(ke, y)) ke, sum(rloc * list_dot_product(pe, y)) pe, sum(rloc * list_dot_product(me, y)) me from j1 join yp on yp.obs_id = j1.obs_id group by 1),
im as (select g1.obs_id, elm, typ, {SOUTH} + (rj - 1) * {STEP}e0 - 31 lat, coalesce(ke, 0) * dep / (err * err) ke, coalesce(pe, 0) * dep / (err * err) pe, coalesce(me, 0) * dep / (err * err) me from g1 left join s1 on s1.obs_id = g1.obs_id)
"""


#: SQL of ``efso`` and ``efso_by_region``. It isn't registered: one version of DuckDB ends about one run in four of it by an internal error, which spoils the connection for all later SQL. A test compares both, on a connection for each try.
EFSO_SQL = EFSO + "select obs_id, elm, typ, round(ke * 1e6, 4) ke, round(pe * 1e6, 4) pe, round(me * 1e6, 4) me from im"


@register()
def efso(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each observation did to a forecast's error energy in a target area, in three terms (millionths): two forecasts, a verifying analysis, advected localization."""
    told = _impacts(spark, sf_dir)
    return rounded(told.select("obs_id", "elm", "typ", *[(F.col(c) * 1e6).alias(c) for c in impact.TERMS]), 4)


EFSO_BY_REGION_SQL = EFSO + """, e1 as (select typ, elm, lat, term, case term when 1 then ke when 2 then pe when 3 then me else ke + pe + me end impact from im, range(1, 5) n(term)),
r1 as (select *, case when lat > 0.5 then 1 when lat < -0.5 then -1 else 0 end region from e1),
t1 as (select term, typ, region, elm, count(*) n_obs, round(sum(impact) * 1e6, 3) total, round(100 * avg(case when impact < 0 then 1 else 0 end), 6) percent_negative from r1 group by grouping sets ((term, typ, region, elm), (term, typ)))
select case term when 1 then 'ke' when 2 then 'pe' when 3 then 'me' else 'all' end term, typ, case region when 1 then 'NH' when -1 then 'SH' when 0 then 'TR' end region, elm, n_obs, total, percent_negative from t1"""


@register()
def efso_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The impacts of ``efso`` by term, type, region and element."""
    told = impact.report(_impacts(spark, sf_dir), 0.5)
    return told.withColumns({"total": F.round(F.col("total") * 1e6, 3), "percent_negative": F.round("percent_negative", 6)})


#: Kinds of observation by the rule of their vertical place: name, element, report type, what its place is in SQL, and what a point's is.
KINDS = (("pressure", 3073, 1, "ln(lev)", "ln(p)"), ("surface", 14593, 1, "ln(dat)", "ln(p)"), ("rain", 19999, 1, "ln(60000.0e0)", "ln(p)"), ("radar", 4001, 22, "8000 * ln(100000 / lev)", "8000 * ln(100000 / p)"))


def _kind_sql(name: str, elm: int, typ: int, base: str, own: str) -> str:
    scale = 2400.0 if name == "radar" else LENGTH
    return f"""select '{name}' kind, pt.gi, pt.gj, pt.k, g.obs_id, g.dep, g.err, (power(gi - ri, 2) + power(gj - rj, 2)) / {LENGTH * LENGTH} h2, power(({base} - {own}) / {scale}, 2) v2 from pt3 pt join good g on abs(gi - ri) < 1.2 and abs(gj - rj) < 1.2"""


VALUE = "60000 + 80 * dat"
ONE_OF_A_KIND = VCODED.replace(PLAIN_HEAD, "select * exclude (elm, typ, dat), 3073 elm, 1 typ, 250 + dat / 10 val, " + VALUE + " dat,") + HX3 + f""",
good as (select h.obs_id, max(c.val) - avg(h.hx) dep, max(c.err) err, max(c.ri) ri, max(c.rj) rj, max(c.lev) lev, max(c.dat) dat from hx3 h join cell c using (obs_id) group by 1 having max(h.qc) = 0),
y3 as (select h.obs_id, h.mem, h.hx - avg(h.hx) over (partition by h.obs_id) y from hx3 h join good using (obs_id)),
pt3 as (select gi, gj, k, avg(p) p from vol group by 1, 2, 3),
d3 as ({" union all ".join(_kind_sql(*k) for k in KINDS)}),
n3 as (select *, row_number() over (partition by kind, gi, gj, k order by round(h2 + v2, 9), obs_id) r from d3 where sqrt(h2) <= 3.651483717 and sqrt(v2) <= 3.651483717 and h2 + v2 <= 13.33333333),
one as (select kind, gi, gj, k, obs_id, dep, err * err / exp(-0.5 * (h2 + v2)) r from n3 where r = 1),
lam as (select kind, gi, gj, k, one.obs_id, max(dep) dep, max(one.r) r, sum(y * y) yy, 15 / {INFLATION}e0 + sum(y * y) / max(one.r) l from one join y3 using (obs_id) group by 1, 2, 3, 4, 5),
xs as (select kind, gi, gj, k, mem, t, avg(t) over (partition by kind, gi, gj, k) tm from vol, (values ('pressure'), ('surface'), ('rain'), ('radar')) n(kind)),
xy as (select x.kind, x.gi, x.gj, x.k, sum((t - tm) * y) ty from xs x join one using (kind, gi, gj, k) join y3 on y3.obs_id = one.obs_id and y3.mem = x.mem group by 1, 2, 3, 4),
g3 as (select x.*, l.dep, l.r, l.yy, l.l, xy.ty, y3.y from xs x left join lam l using (kind, gi, gj, k) left join xy using (kind, gi, gj, k) left join y3 on y3.obs_id = l.obs_id and y3.mem = x.mem)
select kind, gi, gj, k, mem, case when l is null then 0 else 1 end n_obs, round(tm + sqrt({INFLATION}e0) * (t - tm) + coalesce(ty * (dep / (r * l) + (sqrt(15 / l) - sqrt({INFLATION}e0)) * y / yy), 0), 5) t from g3"""


@register(ONE_OF_A_KIND)
def analysis_3d_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analysis with the nearest observation of each kind in turn: by pressure, by surface pressure's value, by the base of rain, by a radar's height."""
    obs, state = _volume(spark, sf_dir)
    raw = fx.observations(spark, sf_dir).select("obs_id", "lev")
    same = obs.drop("lev").join(raw, "obs_id").withColumns({"elm": F.lit(codes.ID["T"]), "typ": F.lit(1), "dat": 250 + F.col("dat") / 10})
    felt = _felt(same, state).withColumn("dat", 60000 + 80 * (F.col("dat") - 250) * 10).withColumns({"hori_loc": F.lit(LENGTH), "vert_loc": F.lit(LENGTH)})
    state = state.withColumn("z", 8000 * F.ln(100000 / F.avg("p").over(Window.partitionBy("gi", "gj", "k"))))
    out = None
    for name, elm, typ, _, _ in KINDS:
        own = felt.withColumns({"elm": F.lit(elm), "typ": F.lit(typ)})
        if name == "radar":
            own = own.withColumns({"lev": 8000 * F.ln(100000 / F.col("lev")), "vert_loc": F.lit(2400.0)})
        told = volume.analysis_by_tile(state, ["t"], own, widest=LENGTH, most=1, inflation=INFLATION, rain_base=60000.0).select(F.lit(name).alias("kind"), "gi", "gj", "k", "mem", "n_obs", F.round("t", 5).alias("t"))
        out = told if out is None else out.unionByName(told)
    return out


WITHHELD = VCODED.replace(PLAIN_HEAD, "select * exclude (elm, typ, dat), 3073 elm, 1 typ, 250 + dat / 10 dat,") + HX3 + f""",
good as (select h.obs_id, max(c.dat) - avg(h.hx) dep, max(c.err) err, max(c.ri) ri, max(c.rj) rj, max(c.lev) lev from hx3 h join cell c using (obs_id) group by 1 having max(h.qc) = 0),
y3 as (select h.obs_id, h.mem, h.hx, avg(h.hx) over (partition by h.obs_id) hm from hx3 h join good using (obs_id)),
d3 as (select t.obs_id target, g.obs_id, g.dep, g.err, (power(t.ri - g.ri, 2) + power(t.rj - g.rj, 2)) / {LENGTH * LENGTH} h2, power((ln(t.lev) - ln(g.lev)) / {LENGTH}, 2) v2 from good t join good g on t.obs_id % 2 = 1 and g.obs_id % 2 = 0 and abs(t.ri - g.ri) < 1.2 and abs(t.rj - g.rj) < 1.2),
n3 as (select *, row_number() over (partition by target order by round(h2 + v2, 9), obs_id) r from d3 where sqrt(h2) <= 3.651483717 and sqrt(v2) <= 3.651483717 and h2 + v2 <= 13.33333333),
one as (select target, obs_id, dep, err * err / exp(-0.5 * (h2 + v2)) r from n3 where r = 1),
lam as (select target, one.obs_id, max(dep) dep, max(one.r) r, sum((hx - hm) * (hx - hm)) yy, 15 / {INFLATION}e0 + sum((hx - hm) * (hx - hm)) / max(one.r) l from one join y3 using (obs_id) group by 1, 2),
xy as (select x.obs_id, sum((x.hx - x.hm) * (y.hx - y.hm)) xy from one join y3 x on x.obs_id = one.target join y3 y on y.obs_id = one.obs_id and y.mem = x.mem group by 1)
select x.obs_id, x.mem, case when l is null then 0 else 1 end n_obs, round(x.hm + sqrt({INFLATION}e0) * (x.hx - x.hm) + coalesce(xy * (dep / (r * l) + (sqrt(15 / l) - sqrt({INFLATION}e0)) * (y.hx - y.hm) / yy), 0), 5) xa
from y3 x left join lam on target = x.obs_id left join xy on xy.obs_id = x.obs_id left join y3 y on y.obs_id = lam.obs_id and y.mem = x.mem where x.obs_id % 2 = 1"""


@register(WITHHELD)
def letkf_obs_space_withheld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analysis at observations with odd ids by the nearest of those with even ids, as it is held against observations that it has not seen."""
    obs, state = _volume(spark, sf_dir)
    raw = fx.observations(spark, sf_dir).select("obs_id", "lev")
    same = obs.drop("lev").join(raw, "obs_id").withColumns({"elm": F.lit(codes.ID["T"]), "typ": F.lit(1), "dat": 250 + F.col("dat") / 10})
    felt = states.kept(_felt(same, state).withColumns({"hori_loc": F.lit(LENGTH), "vert_loc": F.lit(LENGTH)}), "felt")
    mean = F.col("dat") - F.col("dep")
    targets = felt.filter("obs_id % 2 = 1")
    hx = targets.select("obs_id", F.posexplode("y").alias("m", "y"), mean.alias("hm")).select("obs_id", (F.col("m") + 1).alias("mem"), (F.col("y") + F.col("hm")).alias("hx"))
    told = volume.analysis_at_observations(targets.withColumn("p", F.col("lev")), hx, felt.filter("obs_id % 2 = 0"), widest=LENGTH, most=1, inflation=INFLATION)
    return rounded(told, 5)


FIELDS = WITHHELD.split("d3 as (")[0] + f"""pt3 as (select gi, gj, k, avg(p) p from vol group by 1, 2, 3),
d3 as (select pt3.gi, pt3.gj, pt3.k, g.obs_id, g.dep, g.err, (power(gi - ri, 2) + power(gj - rj, 2)) / {LENGTH * LENGTH} h2, power((ln(lev) - ln(p)) / {LENGTH}, 2) v2 from pt3 join good g on abs(gi - ri) < 1.2 and abs(gj - rj) < 1.2),
n3 as (select *, row_number() over (partition by gi, gj, k order by round(err * err / exp(-0.5 * (h2 + v2)), 9), obs_id) r from d3 where sqrt(h2) <= 3.651483717 and sqrt(v2) <= 3.651483717 and h2 + v2 <= 13.33333333),
one as (select gi, gj, k, obs_id, dep, exp(-0.5 * (h2 + v2)) w, err * err / exp(-0.5 * (h2 + v2)) r from n3 where r = 1),
y1 as (select gi, gj, k, one.obs_id, max(dep) dep, max(r) r, max(w) w, sum((hx - hm) * (hx - hm)) yy from one join y3 using (obs_id) group by 1, 2, 3, 4),
i1 as (select *, {INFLATION}e0 + 0.0016 / (2 / w * power(({INFLATION}e0 * yy / 15 / r + w) / (yy / 15 / r), 2) + 0.0016) * ((dep * dep / r - w) / (yy / 15 / r) - {INFLATION}e0) infl from y1),
xs as (select gi, gj, k, mem, u, u - avg(u) over (partition by gi, gj, k) x from vol),
xy as (select xs.gi, xs.gj, xs.k, sum(x * (hx - hm)) xy, sum(x * x) xx from xs join one using (gi, gj, k) join y3 on y3.obs_id = one.obs_id and y3.mem = xs.mem group by 1, 2, 3),
rl as (select i1.*, xx, ({INFLATION}e0 / 15) * (xx - xy * xy / yy) + xy * xy / yy / (15 / {INFLATION}e0 + yy / r) after from i1 join xy using (gi, gj, k))
select pt3.gi, pt3.gj, pt3.k, case when rl.obs_id is null then 0 else 1 end n_obs, round(coalesce(infl, {INFLATION}e0), 6) infl, round(coalesce(0.95e0 * sqrt(xx * {INFLATION}e0 / (after * 15)) - 0.95e0 + 1, 1), 6) relax_u
from pt3 left join rl using (gi, gj, k)"""


@register(FIELDS)
def inflation_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that an analysis leaves: adapted inflation and the factor of relaxed spread at every point, with the observation of the least variance over weight."""
    obs, state = _volume(spark, sf_dir)
    raw = fx.observations(spark, sf_dir).select("obs_id", "lev")
    same = obs.drop("lev").join(raw, "obs_id").withColumns({"elm": F.lit(codes.ID["T"]), "typ": F.lit(1), "dat": 250 + F.col("dat") / 10})
    felt = _felt(same, state).withColumns({"hori_loc": F.lit(LENGTH), "vert_loc": F.lit(LENGTH)})
    told = volume.analysis_by_tile(state, ["u"], felt, widest=LENGTH, most=1, order="error", inflation=INFLATION, rtps=0.95, adaptive=True, relaxation=True)
    return rounded(told.filter("mem = 1").select("gi", "gj", "k", "n_obs", "infl", "relax_u"))
