"""Random fields with waves of a band of lengths, by a transform that is separable and so never has a field in one task."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.sources import states

LINE = "array<struct<re:double,im:double>>"
AT_ONCE = 1 << 20  # values of lines that are transformed together


def phase(*keys: Column) -> Column:
    """An angle of keys, uniform in [0, 2 pi): the same however rows are partitioned or retried."""
    digits = F.substring(F.md5(F.concat_ws(":", *[k.cast("string") for k in keys])), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / 2.0**32 * (2 * math.pi)


def _transformed(length: int):
    """Sums of e^(2 pi i a x / length) times the values at ``a``, for x from 0; a line may have gaps."""

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = []
            step = max(1, AT_ONCE // length)
            for a in range(0, len(batch), step):
                some = batch.slice(a, step)
                flat = some.flatten()
                row = np.repeat(np.arange(len(some)), some.value_lengths().to_numpy(zero_copy_only=False))
                line = np.zeros((len(some), length), complex)
                line[row, flat.field("at").to_numpy(zero_copy_only=False)] = flat.field("re").to_numpy(zero_copy_only=False) + 1j * flat.field("im").to_numpy(zero_copy_only=False)
                parts.append(np.fft.ifft(line, axis=1).ravel() * length)
            out = np.concatenate(parts) if parts else np.zeros(0, complex)
            values = pa.StructArray.from_arrays([pa.array(out.real), pa.array(out.imag)], ["re", "im"])
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * length), values)

    work.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(work, LINE)


def _along(rows: DataFrame, keys: Sequence[str], axis: str, length: int) -> DataFrame:
    """``rows`` (keys, axis, re, im) transformed along one axis: a line is one row of arrays, and lines of many keys are worked on together."""
    lines = rows.groupBy(*keys).agg(F.collect_list(F.struct(F.col(axis).alias("at"), "re", "im")).alias("line"))
    told = lines.select(*keys, _transformed(length)("line").alias("line"))
    return told.select(*keys, F.posexplode("line").alias(axis, "v")).select(*keys, axis, "v.re", "v.im")


def band_field(spark: SparkSession, shape: tuple[int, int, int], dx: float, height: float, longest: float, shortest: float, members: Sequence[int], seed: int) -> DataFrame:
    """(gi, gj, k, mem, noise): for each member a field of ``shape`` (points along i, along j, levels) with a standard deviation of 1.

    Waves with a number, per width of the domain, between those of the lengths ``longest`` and ``shortest`` have equal amplitudes and random phases, others
    none; a level counts as ``height`` over the number of levels. Phases hang on seed, member and wave alone. Without a wave in the band the noise is null.

    The three axes are transformed in turn, lines by task, and a shuffle turns the field between them.
    """
    nx, ny, nz = shape
    half = nz // 2 + 1
    waves = spark.range(half * ny * nx).select((F.col("id") % nx).cast("int").alias("a"), (F.floor(F.col("id") / nx) % ny).cast("int").alias("b"), F.floor(F.col("id") / (nx * ny)).cast("int").alias("c"))
    folded = lambda w, n: F.least(F.col(w), n - F.col(w))
    number = F.sqrt(F.pow(folded("a", nx), F.lit(2.0)) + F.pow(folded("b", ny) * nx / ny, F.lit(2.0)) + F.pow(F.col("c") * nx * dx / height, F.lit(2.0)))
    band = waves.filter(number.between(dx * nx / longest, dx * nx / shortest)).withColumn("mem", F.explode(F.array(*[F.lit(int(m)) for m in members])))
    angle = phase(F.lit(seed), F.col("mem"), F.col("a"), F.col("b"), F.col("c"))
    rows = band.select("mem", "a", "b", "c", F.cos(angle).alias("re"), F.sin(angle).alias("im"))
    rows = _along(rows, ["mem", "b", "c"], "a", nx)
    rows = _along(rows, ["mem", "a", "c"], "b", ny)
    rows = _along(rows, ["mem", "a", "b"], "c", nz)
    field = states.kept(rows.select((F.col("a") + 1).alias("gi"), (F.col("b") + 1).alias("gj"), (F.col("c") + 1).alias("k"), "mem", F.col("re").alias("noise")), "band")
    size = field.groupBy("mem").agg(F.stddev_pop("noise").alias("size"))
    return field.join(F.broadcast(size), "mem").select("gi", "gj", "k", "mem", (F.col("noise") / F.nullif(F.col("size"), F.lit(0.0))).alias("noise"))  # one row a member


def perturbed(state: DataFrame, variable: str, noise: DataFrame, size: float, shape: tuple[int, int, int], edge: int = 0, top: int = 0) -> DataFrame:
    """``state`` (gi, gj, k, mem, variable) with noise of the standard deviation ``size`` added, less within ``edge`` points of the domain's edge and ``top`` levels of its top, none on them."""
    nx, ny, nz = shape
    ratio = F.lit(1.0)
    if edge > 0:
        ratio = F.least(ratio, F.least(F.col("gi") - 1, nx - F.col("gi"), F.col("gj") - 1, ny - F.col("gj")) / F.lit(float(edge)))
    if top > 0:
        ratio = F.least(ratio, (nz - F.col("k")) / F.lit(float(top)))
    met = state.join(noise, ["gi", "gj", "k", "mem"], "left")
    return met.withColumn(variable, F.col(variable) + size * F.greatest(ratio, F.lit(0.0)) * F.coalesce("noise", F.lit(0.0))).select(*state.columns)
