"""Centres of tropical cyclones in fields of sea-level pressure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def smoothed(field: DataFrame) -> DataFrame:
    """(gi, gj, x): 5 x 5 means with weight 5 at the centre, 3 and 1 on the rings; points without a whole box are left out."""
    weight = lambda a, b: 5.0 if a == b == 0 else 3.0 if max(abs(a), abs(b)) == 1 else 1.0
    box = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(weight(a, b) / 45).alias("w")) for a in range(-2, 3) for b in range(-2, 3)])
    sent = field.withColumn("n", F.explode(box)).select((F.col("gi") + F.col("n.a")).alias("gi"), (F.col("gj") + F.col("n.b")).alias("gj"), (F.col("x") * F.col("n.w")).alias("part"))
    return sent.groupBy("gi", "gj").agg(F.sum("part").alias("x"), F.count("*").alias("n")).filter("n = 25").drop("n")


def centres(storms: DataFrame, field: DataFrame, radius: float, places: int = 9) -> DataFrame:
    """(storm_id, tcx, tcy, mslp): the least pressure within ``radius`` of a first guess (ri, rj); ties to the smaller row, then column.

    Field and guesses meet by an equi-join on square buckets as wide as the radius; a storm
    without a point in reach keeps nulls. Pressures are compared after rounding, as sums differ in order.
    """
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    guesses = storms.withColumn("n", F.explode(around)).select("storm_id", "ri", "rj", (F.floor(F.col("ri") / radius) + F.col("n.a")).alias("bi"), (F.floor(F.col("rj") / radius) + F.col("n.b")).alias("bj"))
    cells = field.select(F.floor(F.col("gi") / radius).alias("bi"), F.floor(F.col("gj") / radius).alias("bj"), "gi", "gj", F.round("x", places).alias("x"))
    near = guesses.join(cells, ["bi", "bj"]).filter(F.hypot(F.col("gi") - F.col("ri"), F.col("gj") - F.col("rj")) <= radius)
    best = near.groupBy("storm_id").agg(F.min(F.struct("x", "gj", "gi")).alias("b"))
    return storms.select("storm_id").join(best, "storm_id", "left").select("storm_id", F.col("b.gi").alias("tcx"), F.col("b.gj").alias("tcy"), F.col("b.x").alias("mslp"))
