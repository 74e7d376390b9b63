"""Queries of perturbed fields, satellite channels and the global grid, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.functions import codes, physics, satellite
from isohyet.operators import observations as ob
from isohyet.operators import globalgrid, perturbation, superob
from isohyet.plans import fixtures as fx
from isohyet.plans.registry import register, rounded

SEED, DX, HEIGHT, LONGEST, SHORTEST, SIZE = 7, 1.0, 8.0, 12.0, 4.0, 0.5
MEMBERS, LEVELS = 16, 4

BAND = f"""with vol as ({fx.VOLUME_DUCK}), nj as (select max(gj)::int n from vol),
wv as (select a::int a, b::int b, c::int c, n from nj, range(0, {fx.NX}) x(a), range(0, (select n from nj)) y(b), range(0, {LEVELS // 2 + 1}) z(c)),
bw as (select *, sqrt(power(least(a, {fx.NX} - a), 2) + power(least(b, n - b) * {fx.NX}e0 / n, 2) + power(c * {fx.NX} * {DX}e0 / {HEIGHT}e0, 2)) w from wv),
ph as (select a, b, c, n, m.m mem, cast('0x' || substr(md5('{SEED}:' || m.m || ':' || a || ':' || b || ':' || c), 1, 8) as bigint) / 4294967296e0 * 2 * pi() phi from bw, range(1, {MEMBERS + 1}) m(m) where w between {DX * fx.NX / LONGEST} and {DX * fx.NX / SHORTEST}),
pn as (select i::int gi, j::int gj, k::int k from range(1, {fx.NX + 1}) x(i), range(1, (select n + 1 from nj)) y(j), range(1, {LEVELS + 1}) z(k)),
fl as (select gi, gj, k, mem, sum(cos(2 * pi() * (a * (gi - 1) / {fx.NX}e0 + b * (gj - 1) / n::double + c * (k - 1) / {LEVELS}e0) + phi)) wave from pn, ph group by 1, 2, 3, 4),
sd as (select mem, stddev_pop(wave) s from fl group by 1)
select vol.gi, vol.gj, vol.k, vol.mem, round(t + {SIZE}e0 * greatest(0, least(1, least(gi - 1, {fx.NX} - gi, gj - 1, n - gj) / 3e0, ({LEVELS} - k) / 2e0)) * wave / s, 5) t
from vol join fl using (gi, gj, k, mem) join sd using (mem), nj"""


@register(BAND)
def spectral_perturbation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every member's temperature with waves of a band of lengths added, tapered at the edge and the top."""
    state, _ = fx.volume(spark, sf_dir)
    deep = state.agg(F.max("gj")).first()[0] or 0
    shape = (fx.NX, deep, LEVELS)
    noise = perturbation.band_field(spark, shape, DX, HEIGHT, LONGEST, SHORTEST, range(1, MEMBERS + 1), SEED)
    told = perturbation.perturbed(state.select("gi", "gj", "k", "mem", "t"), "t", noise, SIZE, shape, edge=3, top=2)
    return rounded(told, 5)


SEEN = """with c as (select vec_id * 4 + ch obs_id, list_transform(embedding[(ch * 16 + 1)::int:(ch * 16 + 16)::int], lambda x: x::double) e from embeddings, range(0, 4) r(ch)),
p as (select obs_id, e, 265 + 40 * e[8] dat, list_transform(range(0, 16), lambda k: 1 - exp(-(k + 1) / 4e0) * (1 + 0.3 * e[k + 1])) tr, list_transform(range(0, 16), lambda k: 100000 * exp(-k / 6e0)) pr from c),
w as (select obs_id, k, case when k = 1 then abs((tr[k + 1] - tr[k]) / abs(pr[k + 1] - pr[k])) else (tr[k + 1] - tr[k]) / abs(pr[k + 1] - pr[k]) end w, (pr[k + 1] + pr[k]) / 2 mid from p, range(1, 16) r(k)),
l as (select obs_id, mid lev from w qualify row_number() over (partition by obs_id order by w desc, k) = 1),
m as (select obs_id, n, 265 + 30 * e[n] a, 265 + 30 * e[n] + 20 * e[n + 3] clr from p, range(1, 4) r(n)),
x as (select obs_id, case when abs(a - clr) > 5 then -a else a end x from m)
"""


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four channels of every vector: transmittances of 16 levels and their pressures."""
    rows = fx.read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("ch"))
    rows = rows.select((F.col("vec_id") * 4 + F.col("ch")).alias("obs_id"), F.transform(F.slice("embedding", F.col("ch") * 16 + 1, F.lit(16)), lambda x: x.cast("double")).alias("e"))
    levels = F.transform("e", lambda x, k: F.struct((1 - F.exp(-(k + 1) / F.lit(4.0)) * (1 + 0.3 * x)).alias("tr"), (100000 * F.exp(-k / F.lit(6.0))).alias("pr")))
    return rows.withColumn("s", levels).select("obs_id", "e", (265 + 40 * F.get("e", 7)).alias("dat"), F.col("s.tr").alias("tr"), F.col("s.pr").alias("pr"))


@register(SEEN + """, s as (select p.obs_id, dat, lev, avg(abs(x)) mean, count(*) filter (x < 0) cloudy from p join l using (obs_id) join x using (obs_id) group by 1, 2, 3)
select obs_id, round(lev, 4) lev, cast(case when lev < 30000 then 50 when abs(dat - mean) > case when cloudy < 2 then 1 else 3 end * 2 or dat < 255 then 5 else 0 end as int) qc, cloudy, round(dat - mean, 6) omb from s""")
def satellite_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level that each channel sees most of, skies of members by their clear brightness, and the codes that follow from both."""
    rows = _channels(spark, sf_dir).withColumn("lev", satellite.channel_level(F.col("tr"), F.col("pr")))
    seen = rows.select("obs_id", "lev", "dat", F.lit(2.0).alias("err"), "e", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("n"))
    bright, clear = 265 + 30 * F.get("e", F.col("n")), 265 + 30 * F.get("e", F.col("n")) + 20 * F.get("e", F.col("n") + 3)
    members = seen.select("obs_id", "lev", "dat", "err", satellite.signed_by_sky(bright, clear, 5.0).alias("x"))
    told = ob.satellite_codes(members, 30000.0, 2, 3.0, 255.0)
    return told.join(rows.select("obs_id", F.round("lev", 4).alias("lev")), "obs_id").select("obs_id", "lev", F.col("qc").cast("int").alias("qc"), "cloudy", F.round("omb", 6).alias("omb"))


RAD = "3.1415926535e0 / 180"


@register(f"""with p as (select s_suppkey id, 100 + (s_suppkey * 37 % 800) / 10e0 lon, -60 + (s_suppkey * 53 % 1200) / 10e0 lat, (s_suppkey % 7) / 10e0 w, (s_suppkey % 5) / 20e0 i from supplier),
g as (select *, atan(0.993305616e0 * tan(lat * {RAD})) c from p), r as (select *, 6356752.3e0 / sqrt(1 - 0.00669438444e0 * cos(c) * cos(c)) r from g),
v as (select *, r * cos(c) * cos((lon - 140.7e0) * {RAD}) x from r)
select id, round(acos((42164000e0 * x - r * r) / (r * sqrt(42164000e0 * 42164000e0 - 2 * 42164000e0 * x + r * r))) / ({RAD}), 5) zenith, round(least((w + i) / 0.5, 1), 6) cover, case when w + i > 0.3 then 1e0 else 0e0 end cloud from v""")
def satellite_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zenith angles of a geostationary satellite, and clouds' shares of layers in proportion and by a threshold."""
    k = F.col("s_suppkey")
    p = fx.read(spark, sf_dir, "supplier").select(k.alias("id"), (100 + k * 37 % 800 / 10.0).alias("lon"), (-60 + k * 53 % 1200 / 10.0).alias("lat"), (k % 7 / 10.0).alias("w"), (k % 5 / 20.0).alias("i"))
    angle = satellite.zenith_angle(F.col("lon"), F.col("lat"), 140.7)
    return p.select("id", F.round(angle, 5).alias("zenith"), F.round(satellite.cloud_fraction(F.col("w"), F.col("i"), 0.5), 6).alias("cover"), satellite.cloud_fraction(F.col("w"), F.col("i"), least=0.3).alias("cloud"))


NLON, NLEV = 36, 6
#: A global grid of which a vector is a column; it has as many rows as the table has whole ones.
PLACES = f"""with obs as ({fx.duck_obs()}), o as (select obs_id, elm, typ, dat, err, (obs_id * 37 % 3600) / 10e0 lon, -88 + (obs_id * 53 % 1760) / 10e0 lat, lev * 1.15 lev from obs),
nj as (select cast(floor((max(vec_id) + 1) / 36) as int) n from embeddings),
la as (select j::int j, -90 + 180 * (j - 0.5) / n + 0.5e0 * sin(j) lat from nj, range(1, (select n + 1 from nj)) r(j)),
h0 as (select o.*, n, case when lon = 0 then 37 else lon / 360 * 36 + 1 end ri, (select count(*) from la where la.lat <= o.lat)::int b from o, nj),
h1 as (select h0.*, case when b between 1 and n - 1 then b + (h0.lat - x.lat) / (y.lat - x.lat) end rj0 from h0 left join la x on x.j = b left join la y on y.j = b + 1),
h as (select obs_id, elm, typ, dat, err, lev, case when ceil(ri) between 2 and 37 and ceil(rj0) >= 2 then ri end ri, case when ceil(ri) between 2 and 37 then case when ceil(rj0) >= 2 then rj0 end end rj from h1),
pk as (select cast(vec_id % 36 as int) + 1 i, cast(floor(vec_id / 36) as int) + 1 j, k, 100000 * (1 + 0.02e0 * embedding[1]::double) * exp(-(k - 1) / 3e0) p from embeddings, range(1, {NLEV + 1}) r(k)),
ex as (select i, j, k + 10 k, p from pk union all select a.i, a.j, 11 - m, a.p + m * (a.p - b.p) from pk a join pk b on b.i = a.i and b.j = a.j and a.k = 1 and b.k = 2, range(1, 11) r(m)),
cn as (select obs_id, ln(lev) z, (ceil(ri)::int - 2 + a) % 36 + 1 i, ceil(rj)::int - 1 + b j, abs(1 - a - (ri - ceil(ri) + 1)) * abs(1 - b - (rj - ceil(rj) + 1)) w from h, range(0, 2) x(a), range(0, 2) y(b) where elm <= 9999 and ri is not null),
lv as (select obs_id, z, k, sum(w * ln(p)) lp, sum(w) whole from cn join ex using (i, j) where w > 0 group by 1, 2, 3 having abs(sum(w) - 1) < 1e-9),
ft as (select obs_id, min(k) k from lv where k >= 2 and lp < z group by 1),
vk as (select ft.obs_id, a.k + (a.z - a.lp) / (b.lp - a.lp) rk from ft join lv a on a.obs_id = ft.obs_id and a.k = ft.k - 1 join lv b on b.obs_id = ft.obs_id and b.k = ft.k),
pl as (select h.*, case when ri is not null and elm > 9999 then 0 else rk end rk from h left join vk using (obs_id))
"""


@register(PLACES + """select obs_id, round(ri, 6) ri, round(rj, 6) rj, round(rk, 6) rk, cast(case when floor(ri + 0.5) > 36 then floor(ri + 0.5) - 36 when floor(ri + 0.5) < 1 then floor(ri + 0.5) + 36 else floor(ri + 0.5) end as int) ci, cast(floor(rj + 0.5) as int) cj,
  cast(case when typ in (8, 9, 10, 11, 15) or elm > 9999 then 0 else greatest(floor(rk + 0.5), 1) end as int) ck from pl where rk is not null""")
def global_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of observations on a global grid whose levels go on below the surface, and the cells in which thinning puts them."""
    vectors = fx.read(spark, sf_dir, "embeddings").filter("vec_id is not null")
    rows = ((vectors.agg(F.max("vec_id")).first()[0] or 0) + 1) // NLON
    lats = [-90 + 180 * (j - 0.5) / rows + 0.5 * math.sin(j) for j in range(1, rows + 1)]
    ground = 100000 * (1 + F.lit(0.02) * F.get("embedding", 0).cast("double"))
    columns = vectors.select((F.col("vec_id") % NLON).cast("int").alias("i"), F.floor(F.col("vec_id") / NLON).cast("int").alias("j"), F.array(*[ground * F.exp(F.lit(-k / 3.0)) for k in range(NLEV)]).alias("p"))
    columns = columns.select((F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j"), "p")
    k = F.col("obs_id")
    obs = fx.observations(spark, sf_dir).withColumns({"lon": k * 37 % 3600 / 10.0, "lat": -88 + k * 53 % 1760 / 10.0, "lev": F.col("lev") * 1.15}).drop("ri", "rj")
    told = superob.placed(globalgrid.global_places(obs, columns, lats, NLON).filter("rk is not null"), NLON)
    return rounded(told.select("obs_id", "ri", "rj", "rk", "ci", "cj", "ck"))


@register("""with s as (select l_orderkey id, l_linenumber ln, (l_discount - 0.03)::double q, (l_tax - 0.02)::double qr, case l_linenumber % 3 when 0 then 4001 when 1 then 4002 else 4004 end elm, (1 + l_linenumber % 4)::double err from lineitem)
select id, ln, round(greatest(q, 0), 6) q, round(qr, 6) qr, round(greatest(qr, 0), 6) qr_clipped, case elm when 4002 then 3.0e0 else 5.0e0 end err, case elm when 4002 then err else 5.0e0 end err_ref from s""")
def settings_of_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracers without negative amounts by their flags, and errors of radar observations from the settings."""
    s = fx.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("ln"), (F.col("l_discount").cast("double") - 0.03).alias("q"), (F.col("l_tax").cast("double") - 0.02).alias("qr"), (1.0 + F.col("l_linenumber") % 4).alias("err"))
    elm = F.when(F.col("ln") % 3 == 0, codes.ID["REF"]).when(F.col("ln") % 3 == 1, codes.ID["Vr"]).otherwise(codes.ID["RE0"])
    vapour, rain = physics.clipped([s.q, s.qr], vapour=True)
    told = s.select("id", "ln", vapour.alias("q"), rain.alias("qr"), physics.clipped([s.q, s.qr], condensate=True)[1].alias("qr_clipped"), physics.radar_error(elm, s.err, 5.0, 3.0).alias("err"), physics.radar_error(elm, s.err, 5.0).alias("err_ref"))
    return rounded(told)
