"""Processing of observations with settings by element: switches, missing values, echoes, gross errors."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.functions import codes

ECHO = (codes.ID["REF"], codes.ID["RE0"])
#: Elements with a threshold of their own; the others share the common one.
OWN_THRESHOLD = {"PRC": (codes.ID["PRC"],), "REF": ECHO, "Vr": (codes.ID["Vr"],), "PRH": (codes.ID["PRH"],), "H08": (codes.ID["H08"],), "TCX": (codes.ID["TCX"],), "TCY": (codes.ID["TCY"],), "TCP": (codes.ID["TCP"],)}


def threshold(common: float, own: Mapping[str, float]) -> Column:
    """Gross-error threshold of a row's element; one that is absent or negative is the common one."""
    elm, out = F.col("elm"), F.lit(common)
    for name, value in own.items():
        if value >= 0:
            out = F.when(elm.isin(*OWN_THRESHOLD[name]), value).otherwise(out)
    return out


def processed(obs: DataFrame, hx: DataFrame, common: float, own: Mapping[str, float], echo: float = 10.0, wet: int = 1, dry: int = 1, use_echo: bool = True, use_wind: bool = True, least_echo: float | None = None) -> DataFrame:
    """Observations (obs_id, elm, dat, err, qc) with hx_mean, hx_sprd, dep and qc; ``hx`` is (obs_id, mem, hx).

    In this order, for rows without a code: switched-off reflectivities and radial winds (90), missing values (50), too few
    members with an echo (12; ``wet`` or ``dry`` by whether the observation has one), gross errors (5), strictly above the
    threshold of the element. An echo is above ``echo``, or above ``least_echo`` if that is more. One aggregate over members and one join.
    """
    bound = max(echo, least_echo if least_echo is not None else echo) + 1e-6
    stats = hx.groupBy("obs_id").agg(F.avg("hx").alias("hx_mean"), F.stddev_samp("hx").alias("hx_sprd"), F.count_if(F.col("hx") > bound).alias("n_echo"))
    dep = obs.join(stats, "obs_id", "left").withColumn("dep", F.col("dat") - F.col("hx_mean"))
    is_echo, is_wind = F.col("elm").isin(*ECHO), F.col("elm") == codes.ID["Vr"]
    few = F.coalesce("n_echo", F.lit(0)) < F.when(F.col("dat") > bound, wet).otherwise(dry)
    qc = (
        F.when(F.col("qc") != codes.GOOD, F.col("qc")).when(is_echo & F.lit(not use_echo), codes.UNUSED).when(is_wind & F.lit(not use_wind), codes.UNUSED)
        .when(F.col("dat").isNull(), codes.BAD_OBS).when(is_echo & few, codes.REF_MEMBERS).when(F.abs("dep") > threshold(common, own) * F.col("err"), codes.GROSS_ERROR).otherwise(codes.GOOD)
    )
    return dep.withColumn("qc", qc).drop("n_echo")


def settled(obs: DataFrame, settings: DataFrame, columns: Mapping[str, str], radar: Mapping[tuple[int, str], Column] | None = None) -> DataFrame:
    """Observations with the settings of their type: ``columns`` names new ones by those of ``settings`` (typ, ...), a table of some dozen rows.

    A negative value is that of type 1; ``radar`` gives columns that replace those of one element.
    """
    first = settings.filter("typ = 1").select(*[F.col(c).alias(f"first_{c}") for c in columns])
    own = settings.join(F.broadcast(first.limit(1)), how="left").select(F.col("typ").alias("of_typ"), *[F.when(F.col(c) < 0, F.col(f"first_{c}")).otherwise(F.col(c)).alias(n) for c, n in columns.items()])
    out = obs.join(F.broadcast(own), F.col("typ") == F.col("of_typ"), "left").drop("of_typ")
    for (element, name), value in (radar or {}).items():
        out = out.withColumn(name, F.when(F.col("elm") == element, value).otherwise(F.col(name)))
    return out
