"""Places on a global grid with irregular latitudes, longitudes that close, and levels below the surface."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SURFACE_ELEMENTS = 9999  # elements above it are at the surface
BELOW = 10  # levels below the surface


def horizontal_place(lon: Column, lat: Column, lats: Sequence[float], nlon: int) -> tuple[Column, Column]:
    """Fractional column and row of a place in degrees, from 1; columns are equally far apart from longitude 0 on, and 0 and 360 are one behind the last.

    Rows lie at ``lats`` from south to north. Both are null for longitudes outside [0, 360], south of the first or north of the last row, and for nulls.
    """
    rows = F.array(*[F.lit(float(x)) for x in lats])
    ri = F.when((lon == 0) | (lon == 360), F.lit(nlon + 1.0)).otherwise(lon / 360 * nlon + 1)
    behind = F.size(F.filter(rows, lambda x: x <= lat))
    rj = behind + (lat - F.get(rows, behind - 1)) / (F.get(rows, behind) - F.get(rows, behind - 1))
    inside = (F.ceil(ri) >= 2) & (F.ceil(ri) <= nlon + 1) & (behind >= 1) & (behind < len(lats)) & (F.ceil(rj) >= 2)
    return F.when(inside, ri), F.when(inside, rj)


def extended(pressure: Column, below: int = BELOW) -> Column:
    """An array of pressures from the lowest level up, with ``below`` more in front: each goes on from the lowest two in equal steps."""
    first, second = F.get(pressure, 0), F.get(pressure, 1)
    return F.concat(F.transform(F.sequence(F.lit(below), F.lit(1), F.lit(-1)), lambda n: first + n * (first - second)), pressure)


def global_places(obs: DataFrame, columns: DataFrame, lats: Sequence[float], nlon: int, below: int = BELOW) -> DataFrame:
    """``obs`` (obs_id, elm, lon, lat, lev) with ri, rj and rk, its place among the levels (i, j, p: an array from the lowest up) extended below.

    The four columns around a place are interpolated in the logarithm of pressure, the first column standing behind the last. A place under the lowest of the extended levels
    goes on from the lowest two; above the highest, and where a column is missing, rk is null. At the surface it is 0. Off the grid all three are null.
    """
    ri, rj = horizontal_place(F.col("lon"), F.col("lat"), lats, nlon)
    placed = obs.withColumns({"ri": ri, "rj": rj})
    i, j = F.ceil("ri").cast("int"), F.ceil("rj").cast("int")
    corners = F.array(*[F.struct((F.pmod(i - 2 + a, F.lit(nlon)) + 1).alias("i"), (j - 1 + b).alias("j"), (F.abs(1 - a - (F.col("ri") - i + 1)) * F.abs(1 - b - (F.col("rj") - j + 1))).alias("wt")) for a in (0, 1) for b in (0, 1)])
    upper = placed.filter((F.col("elm") <= SURFACE_ELEMENTS) & F.col("ri").isNotNull())
    around = upper.select("obs_id", F.ln("lev").alias("at"), F.explode(corners).alias("c")).select("obs_id", "at", "c.*").filter("wt > 0")
    logs = columns.select("i", "j", F.transform(extended(F.col("p"), below), lambda x: F.ln(x)).alias("lp"))
    met = around.join(logs, ["i", "j"]).groupBy("obs_id", "at").agg(F.collect_list(F.struct("wt", "lp")).alias("cs"), F.sum("wt").alias("whole")).filter("abs(whole - 1) < 1e-9")  # four columns at most
    level = F.transform(F.get("cs", 0)["lp"], lambda _, k: F.aggregate("cs", F.lit(0.0), lambda s, c: s + c["wt"] * F.get(c["lp"], k)))
    found = met.select("obs_id", "at", level.alias("level")).withColumn("k", F.array_position(F.transform(F.slice("level", F.lit(2), F.size("level") - 1), lambda x: x < F.col("at")), F.lit(True)).cast("int"))
    low, high = F.get("level", F.col("k") - 1), F.get("level", F.col("k"))
    rk = found.filter("k > 0").select("obs_id", (F.col("k") + (F.col("at") - low) / (high - low)).alias("rk"))
    told = placed.join(rk, "obs_id", "left")
    return told.withColumn("rk", F.when(F.col("ri").isNotNull() & (F.col("elm") > SURFACE_ELEMENTS), 0.0).otherwise(F.col("rk")))
