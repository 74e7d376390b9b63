"""Decoded reports to observation rows: quality marks, units and errors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.functions import codes

ZERO_C = 273.15
WINDOW_HOURS = 3.0


def from_decoded(reports: DataFrame, box: tuple[float, float, float, float], hours: float = WINDOW_HOURS) -> DataFrame:
    """Rows in a box (lon, lat from and to) and ``hours`` of the analysis with marks of level and value in 0..2.

    Moisture is turned from mg/kg to kg/kg, with 15% of the value times its error (at least 1e-7) as error,
    temperature from Celsius to Kelvin. Errors beyond 1e10 are missing ones; their rows go.
    """
    elm = F.col("elm")
    inside = F.col("lon").between(box[0], box[1]) & F.col("lat").between(box[2], box[3]) & (F.abs("hours") <= hours)
    kept = reports.filter(inside & F.col("level_mark").between(0, 2) & F.col("mark").between(0, 2))
    dat = F.when(elm == codes.ID["Q"], F.col("dat") * 1e-6).when(elm == codes.ID["T"], F.col("dat") + ZERO_C).otherwise(F.col("dat"))
    err = F.when(elm == codes.ID["Q"], F.greatest(F.col("dat") * 1e-6 * F.col("err") * 0.15, F.lit(1e-7))).otherwise(F.col("err"))
    return kept.withColumns({"dat": dat, "err": err}).filter(F.col("err") <= 1e10)


def from_rain(grid: DataFrame, share: float = 0.5, least: float = 0.05) -> DataFrame:
    """One observation per cell of a rain field (lon, lat, rain); negative amounts are missing ones."""
    return grid.filter("rain >= 0").select(F.lit(codes.ID["PRC"]).alias("elm"), "lon", "lat", F.col("rain").alias("dat"), F.greatest(F.col("rain") * share, F.lit(least)).alias("err"))


def from_diagnostics(diag: DataFrame, types: DataFrame, other: int, least_inverse: float = 1e-7) -> DataFrame:
    """Observations of analysis diagnostics (code, lon, lat, lev, dat, inv_err, omb, mark).

    ``types`` (code, typ) is a table of some hundred rows at most; codes it lacks are of type ``other``. ``hx`` is
    the value less its departure; ``used`` is false without a usable error or with a mark outside 0..2.
    """
    usable = F.col("inv_err") > least_inverse
    out = diag.join(types, "code", "left").withColumn("typ", F.coalesce("typ", F.lit(other)))
    return out.withColumns({"err": F.when(usable, 1 / F.col("inv_err")), "hx": F.col("dat") - F.col("omb"), "used": usable & F.col("mark").between(0, 2)})


def filled(name: str, member: str = "mean", domain: int = 1) -> str:
    """A path with its first member and domain marks filled in."""
    return name.replace("<member>", member, 1).replace("@@@@", member, 1).replace("<domain>", f"{domain:02d}", 1)


def inherited(settings: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Settings by type (typ, ...): a negative value is that of type 1."""
    first = settings.filter("typ = 1").select(*[F.col(c).alias("first_" + c) for c in columns])
    own: dict[str, Column] = {c: F.when(F.col(c) < 0, F.col("first_" + c)).otherwise(F.col(c)) for c in columns}
    return settings.join(F.broadcast(first.limit(1))).withColumns(own).drop(*["first_" + c for c in columns])


def read_percentiles(spark: SparkSession, path: str, nx: int, ny: int, steps: int) -> DataFrame:
    """name, i, j, cdf (values at the ``steps`` + 1 percentiles) and zero (share without rain) of each file below ``path``.

    A file holds fields of ``nx`` x ``ny`` float32: percentiles first, and the share as the last of twice as many and two more. A file that is shorter is an error.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = np.meshgrid(np.arange(1, nx + 1), np.arange(1, ny + 1))
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fields = np.frombuffer(content, "<f4", nx * ny * 2 * (steps + 2)).reshape(-1, nx * ny).astype(float)
                cdf = pa.ListArray.from_arrays(pa.array(np.arange(nx * ny + 1, dtype=np.int32) * (steps + 1)), pa.array(fields[: steps + 1].T.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[-1]] * (nx * ny)), pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), cdf, pa.array(fields[-1])], ["name", "i", "j", "cdf", "zero"])

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInArrow(work, "name string, i int, j int, cdf array<double>, zero double")


def masked(rain: DataFrame, mask: DataFrame | None, everywhere: float = 1e10) -> DataFrame:
    """Cells (i, j, ...) with the value ``mask`` of a mask table (i, j, mask); without a table, all cells have one that keeps all data."""
    if mask is None:
        return rain.withColumn("mask", F.lit(everywhere))
    return rain.join(mask, ["i", "j"], "left")
