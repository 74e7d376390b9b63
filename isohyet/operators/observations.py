"""From observations and an ensemble to departures with quality codes."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.functions import codes

HPA_LEVEL = tuple(codes.ID[n] for n in ("U", "V", "T", "Tv", "Q", "RH", "TCP", "TCX", "TCY"))


def to_si(obs: DataFrame, cyclone_errors: Mapping[str, float] | None = None, project: Callable[[Column, Column], tuple[Column, Column]] | None = None) -> DataFrame:
    """Levels of upper-air and cyclone elements to Pa, values of PS and TCP to Pa, RH to a fraction, with their errors.

    Cyclone elements have the errors of ``cyclone_errors`` (by name: TCP, TCX, TCY) where given; ``project`` turns (lon, lat) to
    the place (x, y) that is the value of TCX and TCY.
    """
    out = _scaled(obs, 100.0, 0.01)
    for name, error in (cyclone_errors or {}).items():
        out = out.withColumn("err", F.when(F.col("elm") == codes.ID[name], error).otherwise(F.col("err")))
    if project is not None:
        x, y = project(F.col("lon"), F.col("lat"))
        out = out.withColumn("dat", F.when(F.col("elm") == codes.ID["TCX"], x).when(F.col("elm") == codes.ID["TCY"], y).otherwise(F.col("dat")))
    return out


def from_si(obs: DataFrame) -> DataFrame:
    return _scaled(obs, 0.01, 100.0)


def _scaled(obs: DataFrame, pressure: float, humidity: float) -> DataFrame:
    elm = F.col("elm")
    factor = F.when(elm.isin(codes.ID["PS"], codes.ID["TCP"]), pressure).when(elm == codes.ID["RH"], humidity).otherwise(1.0)
    level = F.when(elm.isin(*HPA_LEVEL), pressure).otherwise(1.0)
    return obs.withColumns({"lev": F.col("lev") * level, "dat": F.col("dat") * factor, "err": F.col("err") * factor})


HEIGHT = 2567
LEGACY_HPA_LEVEL = (*(codes.ID[n] for n in ("U", "V", "T", "Q", "RH")), HEIGHT)


def legacy_to_si(obs: DataFrame) -> DataFrame:
    """Units of six-column reports: levels of heights but not of virtual temperature are in hPa, and there are no cyclone elements."""
    elm = F.col("elm")
    factor = F.when(elm == codes.ID["PS"], 100.0).when(elm == codes.ID["RH"], 0.01).otherwise(1.0)
    level = F.when(elm.isin(*LEGACY_HPA_LEVEL), 100.0).otherwise(1.0)
    return obs.withColumns({"lev": F.col("lev") * level, "dat": F.col("dat") * factor, "err": F.col("err") * factor})


def satellite_codes(members: DataFrame, least_level: float, least_cloudy: int, gross: float, coldest: float) -> DataFrame:
    """obs_id, qc, cloudy and omb of satellite observations, from a row for each member (obs_id, lev, dat, err, x).

    A member's value is negative where it sees cloud. A missing value, or one that stems from above ``least_level``, is bad.
    The departure from the members' mean may be one error with fewer than ``least_cloudy`` cloudy members, else ``gross`` errors;
    brightness below ``coldest`` is a gross error. A level, error or member that is null fails no test.
    """
    seen = members.groupBy("obs_id").agg(
        *[F.first(c).alias(c) for c in ("lev", "dat", "err")], F.count_if(F.col("x") < 0).alias("cloudy"), F.avg(F.abs("x")).alias("mean"),
    ).withColumn("omb", F.col("dat") - F.col("mean"))
    allowed = F.when(F.col("cloudy") < least_cloudy, 1.0).otherwise(gross) * F.col("err")
    bad = F.col("dat").isNull() | (F.col("lev") < least_level)
    far = (F.abs("omb") > allowed) | (F.col("dat") < coldest)
    return seen.select("obs_id", F.when(bad, codes.BAD_OBS).when(far, codes.GROSS_ERROR).otherwise(codes.GOOD).alias("qc"), "cloudy", "omb")


def slot_of(dif: Column, length: float = 3600.0, base: int = 13) -> Column:
    """Tumbling slot whose interval is open below and closed above."""
    return (F.ceil(dif / length - 0.5) + base).cast("int")


def position_code(obs: DataFrame, nx: int, ny: int, first: int, last: int) -> DataFrame:
    """slot and qc: out of domain goes before out of time."""
    slot = slot_of(F.col("dif"))
    inside = F.col("ri").between(1, nx) & F.col("rj").between(1, ny)
    qc = F.when(~inside, codes.OUT_OF_DOMAIN).when(~slot.between(first, last), codes.OUT_OF_TIME).otherwise(codes.GOOD)
    return obs.withColumn("slot", slot).withColumn("qc", qc)


def interpolated(obs: DataFrame, grid: DataFrame) -> DataFrame:
    """(obs_id, mem, hx): bilinear values at observations; a hash join on the four corners of a cell.

    Corners without weight are not looked up, so points on the last row or column are whole.
    """
    i0, j0 = F.ceil("ri") - 1, F.ceil("rj") - 1
    i, j = F.greatest(i0, F.lit(1)).cast("int"), F.greatest(j0, F.lit(1)).cast("int")
    di, dj = F.col("ri") - i, F.col("rj") - j
    corner = F.array(*[F.struct((i + a).alias("gi"), (j + b).alias("gj"), ((di if a else 1 - di) * (dj if b else 1 - dj)).alias("wt")) for a in (0, 1) for b in (0, 1)])
    corners = obs.select("obs_id", F.explode(corner).alias("c")).select("obs_id", "c.gi", "c.gj", "c.wt").filter("wt <> 0")
    return corners.join(grid, ["gi", "gj"]).groupBy("obs_id", "mem").agg(F.sum(F.col("wt") * F.col("x")).alias("hx"))


def departures(obs: DataFrame, hx: DataFrame, threshold: float = 5.0) -> DataFrame:
    """Observations with mean, spread, departure, and the gross-error code; rows with another code keep it."""
    stats = hx.groupBy("obs_id").agg(F.avg("hx").alias("hx_mean"), F.stddev_samp("hx").alias("hx_sprd"))
    return coded_departures(obs.join(stats, "obs_id", "left"), threshold)


def coded_departures(obs: DataFrame, threshold: float = 5.0) -> DataFrame:
    """``obs`` with mean and spread (hx_mean, hx_sprd), its departure, and the gross-error code."""
    dep = obs.withColumn("dep", F.col("dat") - F.col("hx_mean"))
    qc = F.when((F.col("qc") == 0) & F.col("dat").isNull(), codes.BAD_OBS).when((F.col("qc") == 0) & (F.abs("dep") > threshold * F.col("err")), codes.GROSS_ERROR).otherwise(F.col("qc"))
    return dep.withColumn("qc", qc)


def departure_stats(dep: DataFrame) -> DataFrame:
    """Count, bias and RMSE by element and code; Tv counts as T and RE0 as REF."""
    elm = F.when(F.col("elm") == codes.ID["Tv"], codes.ID["T"]).when(F.col("elm") == codes.ID["RE0"], codes.ID["REF"]).otherwise(F.col("elm"))
    return dep.groupBy(elm.alias("elm"), "qc").agg(
        F.count("*").alias("n"), F.round(F.avg("dep"), 6).alias("bias"), F.round(F.sqrt(F.avg(F.col("dep") * F.col("dep"))), 6).alias("rmse"), F.round(F.avg("hx_sprd"), 6).alias("sprd"),
    )


def within(dep: DataFrame, seconds: float) -> DataFrame:
    """Departures of observations within ``seconds`` of the analysis; all of them if that is not positive."""
    return dep.filter(F.abs("dif") <= seconds) if seconds > 0 else dep


def ordered_codes(obs: DataFrame, rules: Sequence[tuple[int, Column]]) -> DataFrame:
    """qc by the first rule that holds, for rows without a code so far; a condition that is null does not hold."""
    code = F.when(F.col("qc") != codes.GOOD, F.col("qc"))
    for value, rule in rules:
        code = code.when(rule, value)
    return obs.withColumn("qc", code.otherwise(codes.GOOD))


def worst_of_members(coded: DataFrame) -> DataFrame:
    """(obs_id, qc): the largest code that any member gave."""
    return coded.groupBy("obs_id").agg(F.max("qc").alias("qc"))


def enough_echo(obs: DataFrame, hx: DataFrame, echo: float, members_wet: int, members_dry: int) -> DataFrame:
    """Reflectivity observations, with code 12 where too few members have an echo; wet and dry observations have their own limits."""
    echoes = hx.groupBy("obs_id").agg(F.count_if(F.col("hx") > echo + 1e-6).alias("n_echo"))
    need = F.when(F.col("dat") > echo + 1e-6, members_wet).otherwise(members_dry)
    rules = [(codes.BAD_OBS, F.col("dat").isNull()), (codes.REF_MEMBERS, F.coalesce("n_echo", F.lit(0)) < need)]
    return ordered_codes(obs.join(echoes, "obs_id", "left"), rules)


def paired_departures(guess: DataFrame, analysis: DataFrame) -> DataFrame:
    """(obs_id, elm, qc, omb, oma): the analysis pass gives the code only where the guess pass found none."""
    after = analysis.select("obs_id", F.col("qc").alias("qc_a"), F.col("dep").alias("oma"))
    qc = F.when(F.col("qc") == codes.GOOD, F.col("qc_a")).otherwise(F.col("qc"))
    return guess.join(after, "obs_id").select("obs_id", "elm", qc.alias("qc"), F.col("dep").alias("omb"), "oma")


def paired_with(dep: DataFrame, mean_after: Column, threshold: float) -> DataFrame:
    """``paired_departures`` of ``dep`` (obs_id, elm, dat, err, qc, dep, ...) and an analysis pass whose simulated mean is ``mean_after`` of the same row."""
    oma = F.col("dat") - mean_after
    qc = F.when((F.col("qc") == codes.GOOD) & (F.abs(oma) > threshold * F.col("err")), codes.GROSS_ERROR).otherwise(F.col("qc"))
    return dep.select("obs_id", "elm", qc.alias("qc"), F.col("dep").alias("omb"), oma.alias("oma"))
