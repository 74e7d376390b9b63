"""Queries of scalar functions, series, columns and cyclones."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.functions import clock, codes, physics
from isohyet.functions import precipitation as rain
from isohyet.operators import cyclones, series, vertical
from isohyet.operators import observations as ob
from isohyet.plans import fixtures as fx
from isohyet.plans.queries import CODED, OBS, STATE
from isohyet.plans.registry import register, rounded

PI = codes.PI
PARTICLES = f"s as (select *, qr * 0.7 qg from ({STATE.format(lineitem='lineitem')}) x)"


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(STATE, lineitem=fx.read(spark, sf_dir, "lineitem")).withColumn("qg", F.col("qr") * 0.7)


def _falls(n0: tuple[float, float, float], graupel: float, exponent: float) -> str:
    air = "(rho / 1000)"
    return f"""case when qr > 0 then 21.15 * {math.gamma(4.8)!r}::double / 6 / power(power({PI} * {n0[0]!r} / ({air} * qr), 0.25), 0.8) * power(0.001 / {air}, {exponent}) else 0 end wr,
  case when qs > 0 then 1.5293 * {math.gamma(4.25)!r}::double / 6 / power(power({PI} * 0.1 * {n0[1]!r} / ({air} * qs), 0.25), 0.25) * power(0.001 / {air}, {exponent}) else 0 end ws,
  case when qg > 0 then 0.01 * {math.gamma(4.5)!r}::double / 6 * sqrt(4 * 981 * {graupel!r} / (1.8 * {air})) / sqrt(power({PI} * {graupel!r} * {n0[2]!r} / ({air} * qg), 0.25)) else 0 end wg"""


@register(f"""with {PARTICLES}, z as (select *,
  case when qr > 0 then 720e18 * power(rho * qr, 1.75) / (power({PI}, 1.75) * power(8e6, 0.75) * power(1000.0, 1.75)) else 0 end zr,
  case when qs > 0 and t <= 273.16 then 720e18 * 0.176 * power(100.0, 0.25) * power(rho * qs, 1.75) / (power({PI}, 1.75) * 0.93 * power(3e6, 0.75) * 917 * 917)
       when qs > 0 then 720e18 * power(rho * qs, 1.75) / (power({PI}, 1.75) * power(3e6, 0.75) * power(917.0, 1.75)) else 0 end zs,
  case when qg > 0 then power(720e18 / (power({PI}, 1.75) * power(4e4, 0.75) * power(913.0, 1.75)), 0.95) * power(rho * qg, 1.6625) else 0 end zg, {_falls((8e3, 3e3, 40.0), 0.913, 0.25)} from s)
select id, ln, round(log10(zr + zs + zg + 1), 6) log_ref, round(case when zr + zs + zg > 0 then (wr * zr + ws * zs + wg * zg) / (zr + zs + zg) else 0 end, 6) fall from z""")
def radar_ref_m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = physics.with_reflectivity_by_species(_state(spark, sf_dir))
    return s.select("id", "ln", F.round(F.log10(s.ref + 1), 6).alias("log_ref"), F.round("fall", 6).alias("fall"))


@register(f"""with {PARTICLES}, m as (select *, case when qr > 0 and qs > 0 then 0.5 * cbrt(least(qr / qs, qs / qr)) else 0 end fs, case when qr > 0 and qg > 0 then 0.5 * cbrt(least(qr / qg, qg / qr)) else 0 end fg,
  case when qr > 0 and qs > 0 then qr / (qr + qs) else 0 end a, case when qr > 0 and qg > 0 then qr / (qr + qg) else 0 end b from s),
z as (select *, case when (1 - fs - fg) * qr > 0 then 2.53e4 * power(rho * (1 - fs - fg) * qr * 1000, 1.84) else 0 end zr,
  case when (1 - fs) * qs > 0 then 3.48e3 * power(rho * (1 - fs) * qs * 1000, 1.66) else 0 end zs, case when (1 - fg) * qg > 0 then 5.54e3 * power(rho * (1 - fg) * qg * 1000, 1.7) else 0 end zg,
  case when fs * (qr + qs) > 0 then (0.00491 + 5.75 * a - 5.588 * a * a) * 1e5 * power(rho * fs * (qr + qs) * 1000, 1.67 - 0.202 * a + 0.398 * a * a) else 0 end zms,
  case when fg * (qr + qg) > 0 then (0.809 + 10.13 * b - 5.98 * b * b) * 1e5 * power(rho * fg * (qr + qg) * 1000, 1.48 + 0.0448 * b - 0.0313 * b * b) else 0 end zmg, {_falls((8e-2, 3e-2, 4e-4), 0.917, 0.5)} from m)
select id, ln, round(log10(zr + zs + zg + zms + zmg + 1), 6) log_ref, round(case when zr + zs + zg + zms + zmg > 0 then (wr * zr + ws * (zs + zms) + wg * (zg + zmg)) / (zr + zs + zg + zms + zmg) else 0 end, 6) fall from z""")
def radar_ref_m3(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = physics.with_reflectivity_melting(_state(spark, sf_dir))
    return s.select("id", "ln", F.round(F.log10(s.ref + 1), 6).alias("log_ref"), F.round("fall", 6).alias("fall"))


def _poly(x: str, coefficients: tuple[float, ...]) -> str:
    n = len(coefficients) - 1
    return "(" + " + ".join(f"({c!r})::double * power({x}, {n - k})" for k, c in enumerate(coefficients)) + ")"


def _inverse(p: str) -> str:
    """The inverse normal distribution in SQL, with numbers of its own."""
    side = f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    over = _poly(side, (-7.78489400243029e-03, -3.22396458041136e-01, -2.40075827716184e00, -2.54973253934373e00, 4.37466414146497e00, 2.93816398269878e00))
    under = _poly(side, (7.78469570904146e-03, 3.22467129070040e-01, 2.44513413714300e00, 3.75440866190742e00, 1.0))
    square = f"(({p} - 0.5) * ({p} - 0.5))"
    middle = _poly(square, (-3.96968302866538e01, 2.20946098424521e02, -2.75928510446969e02, 1.38357751867269e02, -3.06647980661472e01, 2.50662827745924e00))
    below = _poly(square, (-5.44760987982241e01, 1.61585836858041e02, -1.55698979859887e02, 6.68013118877197e01, -1.32806815528857e01, 1.0))
    return f"case when {p} < 0.02425 then {over} / {under} when {p} > 0.97575 then -{over} / {under} else ({p} - 0.5) * {middle} / {below} end"


@register(f"with d as (select s_suppkey id, (s_suppkey % 997 + 1) / cast(1000 as double) p from supplier) select id, round({_inverse('p')}, 6) z from d")
def invnorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.read(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), F.round(rain.inverse_normal((F.col("s_suppkey") % 997 + 1) / 1000.0), 6).alias("z"))


AMOUNTS = "select l_orderkey id, l_linenumber ln, cast(l_quantity as double) * cast(l_discount as double) pp, 0.05 + l_linenumber * 0.1e0 dry from {lineitem}"
DUCK_CDF = "list_transform(range(0, 21), lambda b: 0.06 + ln * b * b / cast(400 as double))"
SPARK_CDF = "transform(sequence(0, 20), b -> 0.06 + ln * b * b / cast(400 as double))"
PLACED = f"""with a as ({AMOUNTS.format(lineitem='lineitem')}), c as (select *, {DUCK_CDF} cdf from a), n as (select *, len(list_filter(cdf, lambda x: x <= pp)) below from c),
q as (select *, case when pp < 0.06 then dry / 2 when below = 0 then 0 when below > 20 then 1 else (below - 1 + (pp - cdf[below]) / (cdf[below + 1] - cdf[below])) / 20 end place from n),
p as (select *, greatest(cast(0.001 as double), least(cast(0.999 as double), place)) p from q)
"""


def _amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(AMOUNTS, lineitem=fx.read(spark, sf_dir, "lineitem")).withColumn("cdf", F.expr(SPARK_CDF))


@register(f"with a as ({AMOUNTS.format(lineitem='lineitem')}) select id, ln, round(ln(case when pp < 0.06 then 0.6 else pp + 0.6 end), 6) y from a")
def precip_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _amounts(spark, sf_dir).select("id", "ln", F.round(rain.log_amount(F.col("pp")), 6).alias("y"))


@register(PLACED + f"select id, ln, round({_inverse('p')}, 6) y from p")
def precip_gauss(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _amounts(spark, sf_dir)
    return rain.with_gaussian(a, "y", "pp", "cdf", "dry").select("id", "ln", F.round("y", 6).alias("y"))


@register(PLACED + f""", m as (select *, {_inverse('p')} y from p),
e as (select id, count(*) n, sum(case when pp < 0.06 then 0 else y end) / count(*) beta, sum(case when pp < 0.06 then 1 else 0 end) / cast(count(*) as double) p0, min(dry) dry from m group by id),
k as (select *, greatest(cast(0.001 as double), least(cast(0.999 as double), dry)) t, greatest(cast(0.001 as double), least(cast(0.999 as double), p0)) u from e),
v as (select *, {_inverse('t')} y1, {_inverse('u')} y2, - exp(-0.5 * pow({_inverse('u')}, 2)) / sqrt(2 * 3.1415926535) al from k)
select id, n, round((al * y1 + beta * y2) / (al + (1 - p0) * y2), 4) mean, round(((1 - p0) * y1 - beta) / (al + (1 - p0) * y2), 4) sd from v where abs(al + (1 - p0) * y2) > 0.01""")
def precip_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution of dry members, an order's lines being the members; ensembles without a defined split are left out."""
    a = rain.with_gaussian(_amounts(spark, sf_dir), "y", "pp", "cdf", "dry")
    wet = F.when(a.pp < rain.NO_RAIN, 0.0).otherwise(a.y)
    e = a.groupBy("id").agg(F.count("*").alias("n"), F.avg(wet).alias("beta"), F.avg(F.when(a.pp < rain.NO_RAIN, 1.0).otherwise(0.0)).alias("p0"), F.min("dry").alias("dry"))
    y2 = rain.inverse_normal(rain.without_tails(e.p0))
    defined = F.abs(-F.exp(-0.5 * y2 * y2) / math.sqrt(2 * PI) + (1 - e.p0) * y2) > 0.01
    mean, sd = rain.split_at_trace(e.dry, e.p0, e.beta)
    return e.filter(defined).select("id", "n", F.round(mean, 4).alias("mean"), F.round(sd, 4).alias("sd"))


# The leap seconds since 1993, as the day after each (fixed values).
LEAP_SQL = """(case when o_orderdate >= date '1993-07-01' then 1 else 0 end) + (case when o_orderdate >= date '1994-07-01' then 1 else 0 end) + (case when o_orderdate >= date '1996-01-01' then 1 else 0 end)
  + (case when o_orderdate >= date '1997-07-01' then 1 else 0 end) + (case when o_orderdate >= date '1999-01-01' then 1 else 0 end) + (case when o_orderdate >= date '2006-01-01' then 1 else 0 end)
  + (case when o_orderdate >= date '2009-01-01' then 1 else 0 end) + (case when o_orderdate >= date '2012-07-01' then 1 else 0 end) + (case when o_orderdate >= date '2015-07-01' then 1 else 0 end) + (case when o_orderdate >= date '2017-01-01' then 1 else 0 end)"""


@register(f"select o_orderkey id, cast(epoch(cast(o_orderdate as timestamp)) - epoch(timestamp '1993-01-01') + {LEAP_SQL} as bigint) tai, cast(epoch(cast(o_orderdate as timestamp)) as bigint) utc, cast(0 as double) sec from orders")
def tai_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atomic seconds of order dates, and back."""
    o = fx.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("s"))
    o = o.withColumn("tai", clock.utc_to_tai(o.s))
    utc, second = clock.tai_to_utc(o.tai)
    return o.select("id", "tai", utc.alias("utc"), second.alias("sec"))


@register("""with e as (select event_id id, date_trunc('hour', ts) h from events)
select id, cast(year(h) * 1000000 + month(h) * 10000 + day(h) * 100 + hour(h) as bigint) ymdh, cast(day(last_day(h)) as int) mdays,
  cast(epoch(h + interval 6 hour) as bigint) later from e""")
def calendar_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("t"))
    packed = clock.packed_hour(e.t).cast("long")
    later = F.unix_seconds(clock.from_packed_hour(packed) + F.expr("interval 6 hours"))
    return e.select("id", packed.alias("ymdh"), clock.month_days(e.t).alias("mdays"), later.alias("later"))


CUT = 0.8


@register("""with w as (select l, case when l = 0 then 0.8e0 / pi() else sin(0.8e0 * l) / (pi() * l) * sin(pi() * l / 10) * 10 / (pi() * l) end w from range(-10, 11) t(l)), s as (select vec_id series, i, cast(embedding[i + 1] as double) x from embeddings, range(0, 64) r(i))
select s.series, s.i, round(sum(w.w * o.x), 6) x from s join w on true join s o on o.series = s.series and o.i = (s.i + w.l + 64) % 64 group by 1, 2""")
def lanczos(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("series"), F.posexplode("embedding").alias("i", "v"))
    return rounded(series.low_pass(e.select("series", F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("x")), 64, CUT))


@register("""with k as (select vec_id series, i, i + 0.25e0 * (i % 3) x, 50 + 40 * cast(embedding[i + 1] as double) y from embeddings, range(0, 64) r(i)),
s as (select *, (lead(y) over w - y) / (lead(x) over w - x) s0 from k window w as (partition by series order by i)),
g as (select series, x, i - 2 i, s0 from s where i < 63 union all
  select series, null, -3, 2 * a - b from (select series, max(case when i = 0 then s0 end) a, max(case when i = 1 then s0 end) b from s group by 1) union all
  select series, null, -4, 3 * a - 2 * b from (select series, max(case when i = 0 then s0 end) a, max(case when i = 1 then s0 end) b from s group by 1) union all
  select series, null, 61, 2 * a - b from (select series, max(case when i = 62 then s0 end) a, max(case when i = 61 then s0 end) b from s group by 1) union all
  select series, null, 62, 3 * a - 2 * b from (select series, max(case when i = 62 then s0 end) a, max(case when i = 61 then s0 end) b from s group by 1)),
f as (select series, i + 2 i, s0 m3, lag(s0) over w m2, lag(s0, 2) over w m1, lead(s0) over w m4 from g window w as (partition by series order by i)),
t as (select k.*, f.m3, case when abs(m4 - m3) + abs(m2 - m1) = 0 then 0 else (abs(m4 - m3) * m2 + abs(m2 - m1) * m3) / (abs(m4 - m3) + abs(m2 - m1)) end t from k join f using (series, i)),
n as (select *, lead(t) over w t2, lead(x) over w x2 from t window w as (partition by series order by i)),
q as (select vec_id series, 0.5e0 * j x from embeddings, range(0, 127) r(j))
select q.series, q.x, round(case when n.x2 is null then n.y else n.y + (q.x - n.x) * n.t + power(q.x - n.x, 2) * (3 * m3 - 2 * t - t2) / (x2 - n.x) + power(q.x - n.x, 3) * (t + t2 - 2 * m3) / power(x2 - n.x, 2) end, 6) y
from q join n on n.series = q.series and q.x >= n.x and (q.x < n.x2 or (n.x2 is null and q.x = n.x))""")
def akima(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.read(spark, sf_dir, "embeddings")
    k = e.select(F.col("vec_id").alias("series"), F.posexplode("embedding").alias("i", "v"))
    knots = k.select("series", (F.col("i") + 0.25 * (F.col("i") % 3)).alias("x"), (50 + 40 * F.col("v").cast("double")).alias("y"))
    targets = e.select(F.col("vec_id").alias("series"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(126)), lambda j: j * 0.5)).alias("x"))
    out = series.akima(knots, targets)
    return out.select("series", "x", F.round("y", 6).alias("y"))


@register(OBS + CODED + """b as (select obs_id, elm, qc, ln(lev) place, lev, greatest(cast(ceil(ri) as int) - 1, 1) i, greatest(cast(ceil(rj) as int) - 1, 1) j, ri, rj from coded),
c as (select b.obs_id, k, sum((1 - abs(ri - g.gi)) * (1 - abs(rj - g.gj)) * (ln(cast(100000 as double)) - k / cast(8 as double) + 0.001e0 * (g.gi + g.gj))) lp from b
  join (select distinct gi, gj from ens) g on g.gi in (b.i, b.i + 1) and g.gj in (b.j, b.j + 1), range(1, 13) r(k) where b.qc = 0 and b.elm <= 9999 group by 1, 2),
u as (select *, lead(lp) over (partition by obs_id order by k) nx, min(lp) over (partition by obs_id) top, max(lp) over (partition by obs_id) bottom from c),
m as (select u.obs_id, max(case when place < top then 20 when place > bottom then 21 else 0 end) code, max(case when place <= lp and (place > nx or (nx is null and place = lp)) then k + case when nx is null then 0 else (place - lp) / (nx - lp) end end) rk from u join b using (obs_id) group by 1)
select b.obs_id, case when b.qc = 0 then coalesce(m.code, 0) else b.qc end qc, round(case when b.qc <> 0 then null when b.elm > 9999 then b.place when m.code = 0 then m.rk end, 6) rk from b left join m using (obs_id)""")
def vertical_bracket(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = ob.position_code(fx.observations(spark, sf_dir), fx.NX, fx.rows(spark, sf_dir), fx.FIRST_SLOT, fx.LAST_SLOT).withColumn("lev", F.ln("lev"))
    grid = fx.ensemble(spark, sf_dir).select("gi", "gj").distinct().select("gi", "gj", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("k"))
    profile = grid.withColumn("x", math.log(100000) - F.col("k") / 8 + 0.001 * (F.col("gi") + F.col("gj")))
    return rounded(vertical.bracketed(coded, profile).select("obs_id", "qc", "rk"))


STORMS = "select s_suppkey storm_id, cast(s_suppkey * 7 % 25 + 1 as double) ri, cast(s_suppkey * 11 % 20 + 1 as double) rj from {supplier}"


@register(f"""with ens as ({fx.ENS_DUCK}), f as (select gi, gj, avg(x) x from ens group by 1, 2),
s as (select c.gi, c.gj, sum(n.x * case greatest(abs(c.gi - n.gi), abs(c.gj - n.gj)) when 0 then 5 when 1 then 3 else 1 end) / 45 x from f c join f n on abs(c.gi - n.gi) <= 2 and abs(c.gj - n.gj) <= 2 group by 1, 2 having count(*) = 25),
g as ({STORMS.format(supplier='supplier')}), d as (select storm_id, gi, gj, round(x, 9) x, row_number() over (partition by storm_id order by round(x, 9), gj, gi) k from g join s on sqrt(power(gi - ri, 2) + power(gj - rj, 2)) <= 4.5)
select g.storm_id, d.gi tcx, d.gj tcy, round(d.x, 6) mslp from g left join d on d.storm_id = g.storm_id and k = 1""")
def tc_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = cyclones.smoothed(fx.ensemble(spark, sf_dir).groupBy("gi", "gj").agg(F.avg("x").alias("x")))
    storms = spark.sql(STORMS, supplier=fx.read(spark, sf_dir, "supplier"))
    return rounded(cyclones.centres(storms, field, 4.5))


@register(f"""with s as ({STATE.format(lineitem='lineitem')}), p as (select *, cast((id * 37) % 3600 as double) / 10 lon, cast((id * 53) % 1799 - 899 as double) / 10 lat, 24.0 * 3600 * 180 / ({PI} * 6371300) deg from s),
m as (select id, ln, lon - u / cos(lat * ({PI} / 180)) * deg x, lat - v * deg y from p),
o as (select id, ln, case when abs(y) > 90 then x + 180 else x end x, case when y > 90 then 180 - y when y < -90 then -180 - y else y end y from m)
select id, ln, round(case when x > 360 or x < 0 then x - 360 * floor(x / 360) else x end, 5) lon, round(y, 5) lat from o""")
def loc_advection(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _state(spark, sf_dir).withColumns({"lon": (F.col("id") * 37 % 3600) / 10.0, "lat": (F.col("id") * 53 % 1799 - 899) / 10.0})
    lon, lat = physics.advected(s.lon, s.lat, s.u, s.v, 24.0)
    return rounded(s.select("id", "ln", lon.alias("lon"), lat.alias("lat")), 5)


@register(f"""with s as ({STATE.format(lineitem='lineitem')}), e as (select ln, 0.02 * (u * u + v * v) ke, 0.02 * 1005.7 / 280 * (t - 270) * (t - 270) pe, 0.02 * 2.5e6 * 2.5e6 / (1005.7 * 280) * qv * qv me from s)
select ln, round(avg(ke), 6) ke, round(avg(pe), 6) pe, round(avg(me), 4) me from e group by ln""")
def energy_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _state(spark, sf_dir)
    terms = physics.energy_terms(s.u, s.v, s.t - 270, s.qv, F.lit(0.02), F.lit(1.0))
    return s.select("ln", *[c.alias(n) for n, c in terms.items()]).groupBy("ln").agg(F.round(F.avg("ke"), 6).alias("ke"), F.round(F.avg("pe"), 6).alias("pe"), F.round(F.avg("me"), 4).alias("me"))


@register(f"with s as ({STATE.format(lineitem='lineitem')}) select id, ln, round((18000 - p / 100) / 18000 * (t * 10) + p / 100, 6) z from s")
def terrain_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _state(spark, sf_dir)
    return s.select("id", "ln", F.round(physics.terrain_height(s.p / 100, s.t * 10, 18000.0), 6).alias("z"))
