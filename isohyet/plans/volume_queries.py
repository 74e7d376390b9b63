"""Queries in three dimensions and of several variables, of processing, sets and cycles, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.functions import clock, codes
from isohyet.operators import impact, inflation, localization, processing, volume
from isohyet.operators import observations as ob
from isohyet.plans import fixtures as fx
from isohyet.plans.queries import LOCAL, OBS, SCALE, _local, _simulated
from isohyet.plans.registry import register, rounded
from isohyet.sources import states

VCODED = f"""with obs as ({fx.duck_obs()}), vol as ({fx.VOLUME_DUCK}),
coded as (select * exclude (lev, elm), case when elm = 3330 and obs_id % 2 = 1 then 3331 else elm end elm, case when elm = 14593 then lev / 900 else lev end lev, 1 + (obs_id * 7 % 31) / cast(10 as double) rk, cast(ceil(dif / 3600 - 0.5) as int) + 13 slot,
  case when not (ri between 1 and 25 and rj between 1 and {fx.ROWS}) then 98 when not (cast(ceil(dif / 3600 - 0.5) as int) + 13 between 3 and 23) then 97 else 0 end qc from obs),
cell as (select *, greatest(cast(ceil(ri) as int) - 1, 1) i, greatest(cast(ceil(rj) as int) - 1, 1) j, greatest(cast(ceil(rk) as int) - 1, 1) l from coded where qc = 0),
"""
#: The observation operator in SQL, over ``cell``.
HX3 = """volr as (select *, q * p * 0.01 / (0.378 * q + 0.622) / case when t >= 273.15e0 then 6.11 * exp(17.3 * (t - 273.15) / (237.3 + t - 273.15)) when t - 273.15 <= -15 then 6.1121 * exp(22.587 * (t - 273.15) / (273.86 + t - 273.15))
  else (6.11 * exp(17.3 * (t - 273.15) / (237.3 + t - 273.15)) * (15 + t - 273.15) - 6.1121 * exp(22.587 * (t - 273.15) / (273.86 + t - 273.15)) * (t - 273.15)) / 15 end rh, 2.0e0 * gi + gj topo from vol),
prof as (select c.obs_id, v.mem, v.k, sum((1 - abs(ri - gi)) * (1 - abs(rj - gj)) * ln(p)) lp, sum((1 - abs(ri - gi)) * (1 - abs(rj - gj)) * u) u, sum((1 - abs(ri - gi)) * (1 - abs(rj - gj)) * v.v) v,
  sum((1 - abs(ri - gi)) * (1 - abs(rj - gj)) * t) t, sum((1 - abs(ri - gi)) * (1 - abs(rj - gj)) * q) q,
  sum((1 - abs(ri - gi)) * (1 - abs(rj - gj)) * rh) rh, sum((1 - abs(ri - gi)) * (1 - abs(rj - gj)) * topo) topo from cell c join volr v on gi in (i, i + 1) and gj in (j, j + 1) group by 1, 2, 3),
near as (select p.obs_id, p.mem, max(case when lp >= ln(c.lev) then p.k end) lo, min(case when lp < ln(c.lev) then p.k end) hi from prof p join cell c using (obs_id) group by 1, 2),
lev2 as (select n.obs_id, n.mem, c.elm, c.lev, a.k ka, b.k kb, coalesce((ln(c.lev) - a.lp) / (b.lp - a.lp), 0) s, a.lp alp, a.u au, a.v av, a.t at_, a.q aq, a.rh ar, coalesce(b.rh, 0) br, f.topo, coalesce(b.u, 0) bu, coalesce(b.v, 0) bv, coalesce(b.t, 0) bt, coalesce(b.q, 0) bq, exp(f.lp) ps, f.t ft, f.q fq
  from near n join cell c using (obs_id) join prof f on f.obs_id = n.obs_id and f.mem = n.mem and f.k = 1 left join prof a on a.obs_id = n.obs_id and a.mem = n.mem and a.k = n.lo left join prof b on b.obs_id = n.obs_id and b.mem = n.mem and b.k = n.hi),
hx3 as (select obs_id, mem, elm, case when elm > 9999 then case when abs(lev - topo) > 100 then 10 else 0 end when ka is null then 21 when kb is null and ln(lev) < alp then 20 else 0 end qc,
  case elm when 2819 then au * (1 - s) + bu * s when 2820 then av * (1 - s) + bv * s when 3073 then at_ * (1 - s) + bt * s when 3330 then aq * (1 - s) + bq * s when 3331 then ar * (1 - s) + br * s
  else ps * power((ft * (1 + 0.608 * fq) - 0.005 * (lev - topo)) / (ft * (1 + 0.608 * fq)), 9.81 / (0.005 * 287.05)) end hx from lev2)
"""


def _volume(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Observations with codes and levels, heights for surface pressure, one half of humidities relative, and the state with its terrain."""
    state, ny = fx.volume(spark, sf_dir)
    state = state.withColumn("topo", 2.0 * F.col("gi") + F.col("gj"))
    humid = F.when((F.col("elm") == codes.ID["Q"]) & (F.col("obs_id") % 2 == 1), codes.ID["RH"]).otherwise(F.col("elm"))
    obs = fx.observations(spark, sf_dir).withColumns({"elm": humid, "lev": F.when(F.col("elm") == codes.ID["PS"], F.col("lev") / 900).otherwise(F.col("lev")), "rk": 1 + (F.col("obs_id") * 7 % 31) / F.lit(10.0)})
    return ob.position_code(obs, fx.NX, ny, fx.FIRST_SLOT, fx.LAST_SLOT), state


@register(VCODED + """n as (select 1) select obs_id, mem, round(sum((1 - abs(ri - gi)) * (1 - abs(rj - gj)) * (1 - abs(rk - k)) * u), 6) u, round(sum((1 - abs(ri - gi)) * (1 - abs(rj - gj)) * (1 - abs(rk - k)) * t), 6) t
from cell join vol on gi in (i, i + 1) and gj in (j, j + 1) and k in (l, l + 1) group by 1, 2""")
def interp_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trilinear values of two variables at all observations in the domain."""
    obs, state = _volume(spark, sf_dir)
    return rounded(volume.interpolated(obs.filter("qc = 0"), state, ["u", "t"]))


@register(VCODED + HX3 + "select obs_id, mem, qc, case when qc = 0 then round(hx, 5) end hx from hx3")
def obs_operator_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated observations of all members, from columns to values, with codes."""
    obs, state = _volume(spark, sf_dir)
    return rounded(volume.observed(obs, state), 5)


#: A radar's place, and a state with vertical wind, particles and heights, of the columns of the volume.
SITE = (130.1, 34.1, 50.0)
PARTICLES = """select gi, gj, k, mem, u, v, t, p, q, (u - 50) / 40 w, 500.0e0 * (k - 1) + 10 * gi + 5 * gj z, 0.0e0 qc, 0.0e0 qi, 0.0010e0 * f qr, 0.0005e0 * f qs, 0.0002e0 * f qg
  from (select *, case when gi % 5 = 0 then 0.001e0 else 1.0e0 end * (1 + (u - 50) / 40) f from {vol}) x"""
_AT = ", ".join(f"sum((1 - abs(ri - gi)) * (1 - abs(rj - gj)) * s.{c}) {c}" for c in ("z", "u", "v", "w", "t", "p", "q", "qr", "qs", "qg"))
_BETWEEN = ", ".join(f"a.{c} * (1 - s) + b.{c} * s {c}" for c in ("u", "v", "w", "t", "p", "q", "qr", "qs", "qg"))
RAD = "3.1415926535e0 / 180"


@register(VCODED + f"""part as ({PARTICLES.format(vol="vol")}), o as (select *, 100 + obs_id * 37 % 2200 height, 130 + 0.01e0 * ri lon, 34 + 0.01e0 * rj lat, case when obs_id % 2 = 0 then 4001 else 4002 end e from cell),
pr as (select o.obs_id, s.mem, s.k, {_AT} from o join part s on gi in (i, i + 1) and gj in (j, j + 1) group by 1, 2, 3),
nr as (select obs_id, mem, max(case when z <= height then k end) lo, min(case when z > height then k end) hi from pr join o using (obs_id) group by 1, 2),
lv as (select n.obs_id, n.mem, coalesce(lo, 1) lo, coalesce(hi, 4) hi, case when lo is null then 21 when hi is null then 20 else 0 end place from nr n),
va as (select l.obs_id, l.mem, place, case when a.k = b.k then 0 else (height - a.z) / (b.z - a.z) end s, a.k ka, b.k kb from lv l join o using (obs_id) join pr a on a.obs_id = l.obs_id and a.mem = l.mem and a.k = lo join pr b on b.obs_id = l.obs_id and b.mem = l.mem and b.k = hi),
vb as (select x.obs_id, x.mem, place, {_BETWEEN} from va x join pr a on a.obs_id = x.obs_id and a.mem = x.mem and a.k = ka join pr b on b.obs_id = x.obs_id and b.mem = x.mem and b.k = kb),
ec as (select *, qr + qs + qg qt, p / ((287.05e0 * (1 - q - qr - qs - qg) + 461.5e0 * q) * t) rho from vb),
rf as (select obs_id, mem, place, u, v, w, 7.2e20 / (power(3.1415926535e0, 1.75) * power(8e6, 0.75) * power(1000.0e0, 1.75)) * power(rho * qt, 1.75) ref, 5.4 * power(100000 / p, 0.4) * power(qt, 0.125) fall from ec),
bm as (select obs_id, e, height, atan2((lon - {SITE[0]}e0) * cos({SITE[1]}e0 * {RAD}), lat - {SITE[1]}e0) az,
  atan2(height - {SITE[2]}e0, 6371300.0e0 * acos(least(1.0, greatest(-1.0, sin(lat * {RAD}) * sin({SITE[1]}e0 * {RAD}) + cos(lat * {RAD}) * cos({SITE[1]}e0 * {RAD}) * cos(({SITE[0]}e0 - lon) * {RAD}))))) el from o)
select obs_id, mem, case when place <> 0 then place when ref < 10 then 11 else 0 end qc,
  case when place = 0 then round(case when e = 4002 then cos(el) * (u * sin(az) + v * cos(az)) + (w - fall) * sin(el) when ref < 10 then 10 else 10 * log10(greatest(ref, 1e-9)) end, 4) end hx from rf join bm using (obs_id)""")
def obs_operator_radar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reflectivity and wind along the beam of all members, at heights: eleven variables between levels, particles' fall taken off."""
    obs, state = _volume(spark, sf_dir)
    particles = spark.sql(PARTICLES.format(vol="{vol}"), vol=state)
    seen = obs.withColumns({"elm": F.when(F.col("obs_id") % 2 == 0, codes.ID["REF"]).otherwise(codes.ID["Vr"]), "lev": 100.0 + F.col("obs_id") * 37 % 2200, "lon": 130 + 0.01 * F.col("ri"), "lat": 34 + 0.01 * F.col("rj")})
    return rounded(volume.observed_radar(seen, particles, SITE, method=1), 4)


@register(VCODED + """n as (select 1) select gi, gj, k, mem, elm, round(case elm when 2819 then u when 3074 then t * (1 + (461.5e0 / 287.05e0 - 1) * q) else p end, 5) hx, 0 qc
from vol, (values (2819), (3074), (14593)) e(elm)""")
def obssim_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would be observed at every grid point of every member."""
    return rounded(volume.simulated_fields(fx.volume(spark, sf_dir)[0], ["U", "Tv", "PS"]), 5)


@register(VCODED + """h as (select *, 20.0e0 * gi + 2 * gj + 300.0e0 * k height from vol), f as (select gi, gj, mem, height, p, u, t from h where k = 1)
select h.gi, h.gj, h.k, h.mem, round(h.t, 6) t, f.height topo, round(f.p, 4) ps, round(f.u, 6) u10, round(f.t, 6) t2, least(greatest(f.height - 350, 0), 1) land from h join f using (gi, gj, mem)""")
def state_to_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics of a state, each level with its column's surface."""
    state = fx.volume(spark, sf_dir)[0].withColumn("height", 20.0 * F.col("gi") + 2 * F.col("gj") + 300.0 * F.col("k"))
    told = volume.to_history(state)
    return told.select("gi", "gj", "k", "mem", F.round("t", 6).alias("t"), "topo", F.round("ps", 4).alias("ps"), F.round("u10", 6).alias("u10"), F.round("t2", 6).alias("t2"), volume.land(F.col("topo") - 340).alias("land"))


@register(VCODED + """n as (select 1) select gi % 3 + 1 slot, gi, gj, round(avg(t), 6) t, count(*) n from vol where gi % 3 + 1 = 2 and mem between 1 and 8 group by 1, 2, 3""")
def history_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history written by slot and member, and one slot of eight members read from it, one variable alone."""
    path = states.scratch(spark, "history")
    states.write_history(fx.volume(spark, sf_dir)[0].withColumn("slot", F.col("gi") % 3 + 1), path)
    read = states.read_history(spark, path, ["t"], slots=[2], members=(1, 8))
    return read.groupBy("slot", "gi", "gj").agg(F.round(F.avg("t"), 6).alias("t"), F.count("*").alias("n"))


THRESHOLDS = {"PRC": 1.0, "REF": 2.0, "PRH": -1.0}
MADE = """select event_id obs_id, case event_id % 6 when 0 then 2819 when 1 then 3073 when 2 then 19999 when 3 then 4001 when 4 then 4002 else 4004 end elm, case when event_id % 11 > 0 then value end dat,
  cast(1 + event_id % 5 as double) err, case when event_id % 13 = 0 then 97 else 0 end qc, value from {events}"""


@register(f"""with o as ({MADE.format(events='events')}), h as (select obs_id, value + (mem - 3) * 2 + (obs_id % 9 - 4) * 3 hx from o, range(1, 6) r(mem)),
s as (select obs_id, avg(hx) m, stddev_samp(hx) s, count(*) filter (where hx > 100 + 1e-6) n from h group by 1)
select o.obs_id, elm, case when qc <> 0 then qc when elm = 4002 then 90 when dat is null then 50 when elm in (4001, 4004) and n < case when dat > 100 + 1e-6 then 2 else 4 end then 12
  when abs(dat - m) > case elm when 19999 then 1 when 4001 then 2 when 4004 then 2 else 3 end * err then 5 else 0 end qc, round(dat - m, 6) dep, round(s, 6) sprd from o join s using (obs_id)""")
def obs_processing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes by switches, missing values, echoes of members and thresholds by element."""
    obs = spark.sql(MADE, events=fx.read(spark, sf_dir, "events"))
    hx = obs.withColumn("mem", F.explode(F.sequence(F.lit(1), F.lit(5)))).select("obs_id", "mem", (F.col("value") + (F.col("mem") - 3) * 2 + (F.col("obs_id") % 9 - 4) * 3).alias("hx"))
    done = processing.processed(obs, hx, 3.0, THRESHOLDS, echo=100.0, wet=2, dry=4, use_wind=False)
    return rounded(done.select("obs_id", "elm", "qc", "dep", F.col("hx_sprd").alias("sprd")))


@register(OBS + """c as (select obs_id, case obs_id % 4 when 0 then 99993 when 1 then 99991 when 2 then 99992 else 3073 end e, dat, err, lev / 100 lev, ri, rj from obs)
select obs_id, e elm, round(lev * 100, 6) lev, round(case e when 99993 then dat * 100 when 99991 then ri * 10 + rj when 99992 then rj * 10 - ri else dat end, 6) dat, case e when 99993 then 500.0e0 when 99991 then 30000.0e0 when 99992 then 20000.0e0 else err end err from c""")
def cyclone_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units, values and errors of cyclone elements when they are read."""
    k = F.col("obs_id") % 4
    raw = fx.observations(spark, sf_dir).withColumns({"elm": F.when(k == 0, codes.ID["TCP"]).when(k == 1, codes.ID["TCX"]).when(k == 2, codes.ID["TCY"]).otherwise(codes.ID["T"]), "lev": F.col("lev") / 100, "lon": F.col("ri"), "lat": F.col("rj")})
    return rounded(ob.to_si(raw, {"TCP": 500.0, "TCX": 30000.0, "TCY": 20000.0}, lambda lon, lat: (lon * 10 + lat, lat * 10 - lon)).select("obs_id", "elm", "lev", "dat", "err"))


@register(OBS + """a as (select 1 set_id, obs_id, elm, lev, dat from obs where obs_id % 2 = 0 union all select 3, obs_id, elm, lev, dat from obs where obs_id % 2 = 1)
select set_id, elm, count(*) n, round(avg(case when elm = 14593 then lev else lev * 100 end), 4) lev, round(avg(case elm when 14593 then dat * 100 else dat end), 4) dat from a group by 1, 2""")
def obs_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets by format, in SI units; the second one is not there."""
    path = states.scratch(spark, "sets")
    raw = fx.observations(spark, sf_dir).select(F.col("obs_id").alias("idx"), "elm", F.col("ri").alias("lon"), F.col("rj").alias("lat"), "lev", "dat", "err", "typ", "dif")
    for name, part in (("even", 0), ("odd", 1)):
        raw.filter(F.col("idx") % 2 == part).write.parquet(f"{path}/{name}")
    read = states.read_sets(spark, [("PARQUET", f"{path}/even"), ("RECORDS", f"{path}/none"), ("PARQUET", f"{path}/odd")])
    return read.groupBy("set_id", F.col("elm").cast("int").alias("elm")).agg(F.count("*").alias("n"), F.round(F.avg("lev"), 4).alias("lev"), F.round(F.avg("dat"), 4).alias("dat"))


@register(OBS + """m as (select obs_id, mem, dat + mem val, case when (obs_id + mem) % 17 = 0 then 20 else 0 end qc from obs, range(1, 6) r(mem))
select cast(1 as int) set_id, obs_id idx, count(*) n, round(avg(val), 6) hx_mean, round(stddev_samp(val), 6) hx_sprd, max(qc) qc from m group by 2""")
def external_hx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated observations of three members, with those of two more from a table made elsewhere."""
    every = fx.observations(spark, sf_dir).withColumn("mem", F.explode(F.sequence(F.lit(1), F.lit(5))))
    hx = every.select(F.lit(1).alias("set_id"), F.col("obs_id").alias("idx"), "mem", (F.col("dat") + F.col("mem")).alias("val"), F.when((F.col("obs_id") + F.col("mem")) % 17 == 0, 20).otherwise(0).alias("qc"))
    path = states.scratch(spark, "external")
    states.write_simulated(hx.filter("mem > 3"), path)
    return rounded(states.with_external(hx.filter("mem <= 3"), states.read_simulated(spark, path)))


INFLATION = 1.3
LENGTH = 0.3
PLAIN_HEAD = "select * exclude (lev, elm), case when elm = 3330 and obs_id % 2 = 1 then 3331 else elm end elm, case when elm = 14593 then lev / 900 else lev end lev,"
ONE_CLASS = VCODED.replace(PLAIN_HEAD, "select * exclude (elm, typ, dat), 3073 elm, 1 typ, 250 + dat / 10 dat,") + HX3 + f""",
good as (select h.obs_id, max(c.dat) - avg(h.hx) dep, max(c.err) err, max(c.ri) ri, max(c.rj) rj, max(c.lev) lev from hx3 h join cell c using (obs_id) group by 1 having max(h.qc) = 0),
y3 as (select h.obs_id, h.mem, h.hx - avg(h.hx) over (partition by h.obs_id) y from hx3 h join good using (obs_id)),
pt3 as (select gi, gj, k, avg(p) p from vol group by 1, 2, 3),
d3 as (select pt3.gi, pt3.gj, pt3.k, g.obs_id, g.dep, g.err, (power(gi - ri, 2) + power(gj - rj, 2)) / {LENGTH * LENGTH} h2, power((ln(lev) - ln(p)) / {LENGTH}, 2) v2 from pt3 join good g on abs(gi - ri) < 1.2 and abs(gj - rj) < 1.2),
n3 as (select *, row_number() over (partition by gi, gj, k order by round(h2 + v2, 9), obs_id) r from d3 where sqrt(h2) <= 3.651483717 and sqrt(v2) <= 3.651483717 and h2 + v2 <= 13.33333333),
one as (select gi, gj, k, obs_id, dep, err * err / exp(-0.5 * (h2 + v2)) r from n3 where r = 1),
lam as (select gi, gj, k, one.obs_id, max(dep) dep, max(one.r) r, sum(y * y) yy, 15 / {INFLATION}e0 + sum(y * y) / max(one.r) l from one join y3 using (obs_id) group by 1, 2, 3, 4),
xs as (select gi, gj, k, mem, u, t, avg(u) over w um, avg(t) over w tm from vol window w as (partition by gi, gj, k)),
xy as (select x.gi, x.gj, x.k, sum((u - um) * y) uy, sum((t - tm) * y) ty from xs x join one using (gi, gj, k) join y3 on y3.obs_id = one.obs_id and y3.mem = x.mem group by 1, 2, 3),
g3 as (select x.*, l.obs_id, l.dep, l.r, l.yy, l.l, xy.uy, xy.ty, y3.y from xs x left join lam l using (gi, gj, k) left join xy using (gi, gj, k) left join y3 on y3.obs_id = l.obs_id and y3.mem = x.mem)
select gi, gj, k, mem, case when l is null then 0 else 1 end n_obs,
  round(um + sqrt({INFLATION}e0) * (u - um) + coalesce(uy * (dep / (r * l) + (sqrt(15 / l) - sqrt({INFLATION}e0)) * y / yy), 0), 5) u, round(tm + sqrt({INFLATION}e0) * (t - tm) + coalesce(ty * (dep / (r * l) + (sqrt(15 / l) - sqrt({INFLATION}e0)) * y / yy), 0), 5) t from g3"""


def _felt(obs: DataFrame, state: DataFrame) -> DataFrame:
    """Observations that every member can simulate, with departures and centred members."""
    hx = volume.observed(obs, state)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("mem", "hx"))), lambda s: s.hx)
    stats = hx.groupBy("obs_id").agg(F.max("qc").alias("worst"), F.avg("hx").alias("m"), ordered.alias("h")).filter("worst = 0")
    return obs.join(stats, "obs_id").withColumns({"dep": F.col("dat") - F.col("m"), "y": F.transform("h", lambda h: h - F.col("m"))}).drop("h", "m", "worst")


@register(ONE_CLASS)
def analysis_3d_one_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analysis of two variables at all levels with all observations as one class, of which each point takes its nearest."""
    obs, state = _volume(spark, sf_dir)
    raw = fx.observations(spark, sf_dir).select("obs_id", "lev")
    same = obs.drop("lev").join(raw, "obs_id").withColumns({"elm": F.lit(codes.ID["T"]), "typ": F.lit(1), "dat": 250 + F.col("dat") / 10, "hori_loc": F.lit(LENGTH), "vert_loc": F.lit(LENGTH)})
    return rounded(volume.analysis_by_tile(state, ["u", "t"], _felt(same, state), widest=LENGTH, most=1, inflation=INFLATION), 5)


@register()
def analysis_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole analysis: all observations with lengths of their types, limits of ten by class, weights by variable and element, relaxation, moisture up to a level, and tapers at the edge."""
    obs, state = _volume(spark, sf_dir)
    ny = fx.volume(spark, sf_dir)[1]
    settings = spark.range(1, 25).select(F.col("id").cast("int").alias("typ"), F.when(F.col("id") % 3 == 1, 0.4).otherwise(-1.0).alias("hori"), F.when(F.col("id") % 5 == 1, 0.5).otherwise(-1.0).alias("vert"))
    settled = processing.settled(obs.filter("qc = 0"), settings, {"hori": "hori_loc", "vert": "vert_loc"})
    edge = F.least(F.least(F.col("gi"), fx.NX + 1 - F.col("gi")), F.least(F.col("gj"), ny + 1 - F.col("gj"))) / 2.0
    tapered = state.withColumn("beta", F.greatest(F.least(edge, F.lit(1.0)), F.lit(0.0)))
    weights = {"q": {codes.ID["U"]: 0.0, codes.ID["V"]: 0.0}, "u": {codes.ID["Q"]: 0.0}, "v": {codes.ID["Q"]: 0.0}}
    out = volume.analysis_by_tile(tapered, ["u", "v", "t", "q"], _felt(settled, state), weights, widest=0.4, most=10, inflation=INFLATION, rtps=0.95, moist=["q"], moist_top=30000.0)
    return rounded(out, 8)


@register(LOCAL + """, s as (select cast(ceil(dif / 3600 - 0.5) as int) + 13 slot, obs_id id from obs),
u1 as (select l.gi, l.gj, sum(d.dep * d.dep / l.rdiag) p1, sum(d.hx_sprd * d.hx_sprd / l.rdiag) p2, sum(l.rloc) p3 from pt left join (select loc.* from loc join s on s.id = loc.obs_id where slot < 13) l using (gi, gj) left join dep d using (obs_id) group by 1, 2),
i1 as (select pt.gi, pt.gj, coalesce(case when p2 > 0 and p3 > 0 then 1.69 + 0.0016 / (2 / p3 * power((1.69 * p2 + p3) / p2, 2) + 0.0016) * ((p1 - p3) / p2 - 1.69) end, 1.69) a from pt left join u1 on u1.gi = pt.gi and u1.gj = pt.gj),
u2 as (select l.gi, l.gj, sum(d.dep * d.dep / l.rdiag) p1, sum(d.hx_sprd * d.hx_sprd / l.rdiag) p2, sum(l.rloc) p3 from (select loc.* from loc join s on s.id = loc.obs_id where slot >= 13) l left join dep d using (obs_id) group by 1, 2)
select i1.gi, i1.gj, round(a, 6) first_cycle, round(coalesce(case when p2 > 0 and p3 > 0 then a + 0.0016 / (2 / p3 * power((a * p2 + p3) / p2, 2) + 0.0016) * ((p1 - p3) / p2 - a) end, a), 6) second_cycle from i1 left join u2 using (gi, gj)""")
def cycled_inflation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inflation carried over two cycles: each updates what the one before left, as a table by cycle."""
    told = _simulated(spark, sf_dir)
    points = fx.ensemble(spark, sf_dir).select("gi", "gj").distinct()
    good = states.kept(told.seen(told.departures(), ["obs_id", "err", "ri", "rj", "slot"]), "good")
    path, carried = states.scratch(spark, "cycles"), points.withColumn("infl", F.lit(1.69))
    for cycle, part in enumerate((good.filter("slot < 13"), good.filter("slot >= 13")), 1):
        now = inflation.adapted_at(points, part, SCALE, carried)
        now.write.parquet(f"{path}/cycle={cycle}")
        carried = spark.read.parquet(f"{path}/cycle={cycle}")
    first = spark.read.parquet(f"{path}/cycle=1").withColumnRenamed("infl", "first_cycle")
    return rounded(first.join(carried.withColumnRenamed("infl", "second_cycle"), ["gi", "gj"]))


@register(LOCAL + """, r as (select l.gi, l.gj, case when l.typ = 22 and d.elm = 4004 then 4001 else d.elm end elm, l.typ, l.obs_id, l.nd2,
  row_number() over (partition by l.gi, l.gj, case when l.typ = 22 and d.elm = 4004 then 4001 else d.elm end, l.typ order by round(l.nd2, 9), l.obs_id) k from loc l join dep d using (obs_id))
select gi, gj, elm, typ, count(*) n_obs, round(sqrt(max(nd2)), 6) farthest from r where k <= 2 group by 1, 2, 3, 4""")
def obs_counts_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations that a point takes of each class after the limit, and how far they reach."""
    local = _local(spark, sf_dir)[0].filter("obs_id is not null").withColumn("nd2", F.round("nd2", 9)).withColumn("limit_group", localization.limit_group(F.col("elm"), F.col("typ")))
    taken = localization.limited(local, 2)
    return taken.groupBy("gi", "gj", F.col("limit_group.elm").alias("elm"), F.col("limit_group.typ").alias("typ")).agg(F.count("*").alias("n_obs"), F.round(F.sqrt(F.max("nd2")), 6).alias("farthest"))


@register(OBS + """i as (select elm, typ, (rj - 11) * 8 lat, dat - 50 * err impact from obs), g as (select *, case when lat > 20 then 'NH' when lat < -20 then 'SH' else 'TR' end region from i)
select typ, region, elm, count(*) n_obs, round(sum(impact), 4) total, round(100 * avg(case when impact < 0 then 1 else 0 end), 6) percent_negative from g group by grouping sets ((typ, region, elm), (typ))""")
def impact_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.observations(spark, sf_dir).select("elm", "typ", ((F.col("rj") - 11) * 8).alias("lat"), (F.col("dat") - 50 * F.col("err")).alias("impact"))
    told = impact.by_region(o)
    return told.withColumns({"total": F.round("total", 4), "percent_negative": F.round("percent_negative", 6)})


@register("""with e as (select event_id id, date_trunc('second', ts) ts, cast(epoch(date_trunc('second', ts)) as bigint) t from events),
p as (select *, 1704067200 + cast(floor((t - 1704067200) / 21600e0) as bigint) * 21600 parent from e),
f as (select *, cast(floor((t - parent) / 3600e0) as bigint) skip, parent + cast(floor((t - parent) / 3600e0) as bigint) * 3600 first_step from p),
n as (select *, 7 + skip + case when first_step <> t and first_step + 6 * 3600 < t + 20000 then 1 else 0 end total from f),
k as (select *, greatest(cast(ceil(total / 6e0) as bigint), 1) files from n)
select id, strftime(ts, '%Y-%m-%d %H:%M:%S') plain, strftime(ts, '%Y%m%d-%H%M%S') || '.000' stamp, case when minute(ts) = 0 then strftime(ts, '%H') else strftime(ts, '%H:%M') end || 'Z' || lower(strftime(ts, '%d%b%Y')) grads,
  parent parent_start, first_step, skip skipped, case when files = 1 then total else 6 end steps, files, parent + (files - 1) * 21600 last_file from k""")
def boundary_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats of times, and the boundary files that a forecast from each needs."""
    e = fx.read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"))
    told, b = clock.formatted(F.col("ts")), clock.boundary_times(F.unix_seconds("ts"), 20000, 21600, 3600, F.lit(1704067200))
    return e.select("id", told["plain"].alias("plain"), told["stamp"].alias("stamp"), told["grads"].alias("grads"), b["parent_start"].cast("long").alias("parent_start"), b["first_step"].cast("long").alias("first_step"),
                    b["skipped"].cast("long").alias("skipped"), b["steps"].cast("long").alias("steps"), b["files"].cast("long").alias("files"), F.element_at(b["times"], -1).cast("long").alias("last_file"))
