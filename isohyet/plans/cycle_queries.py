"""Queries of cycles with a versioned state, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.operators import cycling
from isohyet.operators import observations as ob
from isohyet.plans import fixtures as fx
from isohyet.plans.queries import CODED, OBS, SCALE
from isohyet.plans.registry import register, rounded
from isohyet.sources import states
from isohyet.sources.versions import StateTable
from isohyet.streaming.cycle import carry_on

FIRST_INFLATION = 1.2
#: First slots of the cycles, and the one behind the last.
SLOTS = (3, 10, 17, 24)


def step(obs: DataFrame, prior: DataFrame, earlier: DataFrame, cycle: int) -> DataFrame:
    return cycling.assimilated(obs, prior, earlier, SCALE, most=1)


def cycle_observations(spark: SparkSession, sf_dir: str, cycle: int) -> DataFrame:
    """Observations of one cycle as one class."""
    coded = ob.position_code(fx.observations(spark, sf_dir), fx.NX, fx.rows(spark, sf_dir), fx.FIRST_SLOT, fx.LAST_SLOT)
    return coded.filter(F.col("slot").between(SLOTS[cycle - 1], SLOTS[cycle] - 1)).withColumns({"elm": F.lit(1), "typ": F.lit(1)})


def _cycle_sql(n: int) -> str:
    """Tables of cycle ``n``: x{n} (gi, gj, mem, x) and f{n} (gi, gj, infl), from those of the cycle before."""
    return f"""
c{n} as (select obs_id, ri, rj, dat, err, greatest(cast(ceil(ri) as int) - 1, 1) i, greatest(cast(ceil(rj) as int) - 1, 1) j from coded where qc = 0 and slot between {SLOTS[n - 1]} and {SLOTS[n] - 1}),
h{n} as (select c.obs_id, e.mem, sum((1 - abs(ri - gi)) * (1 - abs(rj - gj)) * x) hx from c{n} c join x{n - 1} e on gi in (i, i + 1) and gj in (j, j + 1) group by 1, 2),
s{n} as (select c.obs_id, ri, rj, err, dat - avg(hx) dep, stddev_samp(hx) sprd from c{n} c join h{n} using (obs_id) group by c.obs_id, ri, rj, err, dat having abs(dat - avg(hx)) <= 5 * err),
y{n} as (select obs_id, mem, hx - avg(hx) over (partition by obs_id) y from h{n} join s{n} using (obs_id)),
l{n} as (select gi, gj, obs_id, dep, sprd, err, (power(gi - ri, 2) + power(gj - rj, 2)) / {SCALE * SCALE} nd2 from f{n - 1} join s{n} on abs(gi - ri) < 1.5 and abs(gj - rj) < 1.5 where sqrt(power(gi - ri, 2) + power(gj - rj, 2)) / {SCALE} <= 3.651483717 and (power(gi - ri, 2) + power(gj - rj, 2)) / {SCALE * SCALE} <= 13.33333333),
u{n} as (select gi, gj, sum(dep * dep / (err * err) * exp(-0.5 * nd2)) p1, sum(sprd * sprd / (err * err) * exp(-0.5 * nd2)) p2, sum(exp(-0.5 * nd2)) p3 from l{n} group by 1, 2),
f{n} as (select f.gi, f.gj, case when p2 > 0 and p3 > 0 then infl + 0.0016 / (2 / p3 * power((infl * p2 + p3) / p2, 2) + 0.0016) * ((p1 - p3) / p2 - infl) else infl end infl from f{n - 1} f left join u{n} using (gi, gj)),
o{n} as (select gi, gj, obs_id, dep, err * err / exp(-0.5 * nd2) r from l{n} qualify row_number() over (partition by gi, gj order by round(nd2, 9), obs_id) = 1),
v{n} as (select gi, gj, obs_id, max(dep) dep, max(r) r, sum(y * y) yy from o{n} join y{n} using (obs_id) group by 1, 2, 3),
m{n} as (select x.gi, x.gj, x.mem, x.x, avg(x.x) over (partition by x.gi, x.gj) xm, infl from x{n - 1} x join f{n - 1} using (gi, gj)),
k{n} as (select m.gi, m.gj, sum((x - xm) * y) xy from m{n} m join o{n} using (gi, gj) join y{n} y on y.obs_id = o{n}.obs_id and y.mem = m.mem group by 1, 2),
x{n} as (select m.gi, m.gj, m.mem, xm + sqrt(infl) * (x - xm) + coalesce(xy * (dep / (r * (63 / infl + yy / r)) + (sqrt(63 / (63 / infl + yy / r)) - sqrt(infl)) * y / yy), 0) x
  from m{n} m left join v{n} v on v.gi = m.gi and v.gj = m.gj left join k{n} k on k.gi = m.gi and k.gj = m.gj left join y{n} y on y.obs_id = v.obs_id and y.mem = m.mem)"""


CHAIN = OBS + CODED + f"x0 as (select * from ens), f0 as (select gi, gj, {FIRST_INFLATION}e0 infl from ens group by 1, 2)," + ",".join(_cycle_sql(n) for n in range(1, len(SLOTS)))


@register(CHAIN + """, every as (select 1 as cycle, * from x1 join f1 using (gi, gj) union all select 2, * from x2 join f2 using (gi, gj) union all select 3, * from x3 join f3 using (gi, gj))
select cycle, gi, gj, mem, round(x, 5) x, round(infl, 6) infl from every""")
def cycled_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three cycles in turn, each from the state that the one before committed: analysis with the nearest observation, and inflation adapted by all local ones."""
    table = StateTable(spark, states.scratch(spark, "cycled"))
    table.write(fx.ensemble(spark, sf_dir).withColumn("infl", F.lit(FIRST_INFLATION)), 0)
    for cycle in range(1, len(SLOTS)):
        carry_on(table, cycle_observations(spark, sf_dir, cycle), cycle, step)
    out = None
    for cycle in range(1, len(SLOTS)):
        told = table.read(cycle).select(F.lit(cycle).alias("cycle"), "gi", "gj", "mem", F.round("x", 5).alias("x"), F.round("infl", 6).alias("infl"))
        out = told if out is None else out.unionByName(told)
    return out
