"""Smoothing and interpolation of keyed series."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TAPS = 10


def lanczos_weight(lag: int, cutoff: float) -> float:
    if lag == 0:
        return cutoff / math.pi
    return math.sin(cutoff * lag) / (math.pi * lag) * math.sin(math.pi * lag / TAPS) * TAPS / (math.pi * lag)


def low_pass(series: DataFrame, length: int, cutoff: float) -> DataFrame:
    """(series, i, x): cyclic low-pass of values at i = 0 .. length - 1; each value is sent to the places it counts for."""
    taps = F.array(*[F.struct(F.lit(k).alias("lag"), F.lit(lanczos_weight(k, cutoff)).alias("w")) for k in range(-TAPS, TAPS + 1)])
    sent = series.withColumn("tap", F.explode(taps)).select("series", F.pmod(F.col("i") - F.col("tap.lag"), F.lit(length)).alias("i"), (F.col("tap.w") * F.col("x")).alias("part"))
    return sent.groupBy("series", "i").agg(F.sum("part").alias("x"))


def akima(knots: DataFrame, targets: DataFrame) -> DataFrame:
    """(series, x, y): locally weighted cubic through knots (series, x, y) at targets (series, x).

    At a knot its own value; before the first and after the last knot, null. Slopes beyond
    the ends go on linearly. A series needs three knots or more; it is sorted as one group.
    """
    along = Window.partitionBy("series").orderBy("x")
    slope = (F.lead("y").over(along) - F.col("y")) / (F.lead("x").over(along) - F.col("x"))
    k = knots.withColumn("s0", slope)
    for name, by in (("sm2", -2), ("sm1", -1), ("sp1", 1), ("sp2", 2)):
        k = k.withColumn(name, F.lead("s0", by).over(along) if by > 0 else F.lag("s0", -by).over(along))
    # at the last knot s0 is missing; the two slopes beyond it and those before the first are linear
    k = k.withColumn("left1", F.coalesce("sm1", 2 * F.col("s0") - F.col("sp1"), F.lit(0.0)))
    k = k.withColumn("right0", F.coalesce("s0", 2 * F.col("sm1") - F.col("sm2")))
    k = k.withColumn("right1", F.coalesce("sp1", 2 * F.col("right0") - F.col("left1")))
    k = k.withColumn("left2", F.coalesce("sm2", 2 * F.col("left1") - F.col("right0")))
    after, before = F.abs(F.col("right1") - F.col("right0")), F.abs(F.col("left1") - F.col("left2"))
    k = k.withColumn("t", F.when(after + before == 0, 0.0).otherwise((after * F.col("left1") + before * F.col("right0")) / (after + before)))
    piece = k.select("series", "x", F.struct(F.col("x").alias("x0"), "y", "s0", "t", F.lead("t").over(along).alias("t2"), (F.lead("x").over(along) - F.col("x")).alias("h")).alias("p"))
    none = piece.select("series", "x", "p").schema["p"].dataType
    both = piece.withColumn("is_target", F.lit(0)).unionByName(targets.select("series", "x", F.lit(None).cast(none).alias("p"), F.lit(1).alias("is_target")))
    upto = Window.partitionBy("series").orderBy("x", "is_target").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("p", F.last("p", ignorenulls=True).over(upto)).filter("is_target = 1")
    return placed.select("series", "x", _cubic(F.col("x") - F.col("p.x0")).alias("y"))


def _cubic(d: Column) -> Column:
    p = lambda c: F.col("p." + c)
    square = (3 * p("s0") - 2 * p("t") - p("t2")) / p("h")
    cube = (p("t") + p("t2") - 2 * p("s0")) / p("h") / p("h")
    return F.when(d == 0, p("y")).otherwise(p("y") + d * (p("t") + d * (square + d * cube)))
