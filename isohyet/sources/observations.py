"""Readers and writers of observation records: sequential unformatted float32 files, and Parquet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.operators import observations as ob
from isohyet.sources import records
from isohyet.sources.records import packed  # noqa: F401

CONVENTIONAL = ("elm", "lon", "lat", "lev", "dat", "err", "typ", "dif")
DEPARTURE = (*CONVENTIONAL, "qc", "omb", "oma")
LEGACY = CONVENTIONAL[:6]


def unpacked(content: bytes, columns: int, strict: bool = False, whole: bool = False) -> np.ndarray:
    """Rows of a file whose records are ``columns`` float32 between two record lengths.

    A ragged file has no rows, or is an error if ``strict``; if ``whole``, its whole records are read and the rest is left.
    """
    words = columns + 2
    if whole:
        content = content[: len(content) // (4 * words) * (4 * words)]
    if len(content) % (4 * words):
        if strict:
            raise ValueError(f"a file of {len(content)} bytes is no whole number of records of {columns} values")
        return np.zeros((0, columns), np.float32)
    return np.frombuffer(content, "<f4").reshape(-1, words)[:, 1:-1]


def read_records(spark: SparkSession, path: str, columns: tuple[str, ...] = CONVENTIONAL, strict: bool = False, whole: bool = False, split: int = records.SPLIT) -> DataFrame:
    """set_id (file name), idx (from 1) and the columns of each record of the files below ``path``; ragged files are passed over unless ``strict`` or ``whole``.

    A large file is read by many tasks, ``split`` bytes each, where Arrow can open the path; elsewhere one task reads a file.
    """
    if records.splittable(path):
        return records.scan(spark, path, columns, "error" if strict else "whole" if whole else "skip", split=split)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = unpacked(content, len(columns), strict, whole)
                data = [pa.array(rows[:, k].astype(float)) for k in range(len(columns))]
                yield pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[-1]] * len(rows), pa.string()), pa.array(np.arange(1, len(rows) + 1)), *data], ["set_id", "idx", *columns])

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInArrow(work, "set_id string, idx long, " + ", ".join(f"{c} double" for c in columns))


def read_legacy(spark: SparkSession, path: str) -> DataFrame:
    """Records of six columns in SI units, up to a ragged end."""
    return ob.legacy_to_si(read_records(spark, path, LEGACY, whole=True))


def unpivoted_channels(profiles: DataFrame) -> DataFrame:
    """One row per channel of satellite profiles (elm, typ, lon, lat, bt array); the level is the channel plus 6."""
    return profiles.select("elm", "typ", "lon", "lat", F.posexplode("bt").alias("k", "dat")).withColumn("lev", (F.col("k") + 7).cast("double")).drop("k")


def write_sets(obs: DataFrame, path: str, missing: bool = True) -> None:
    """Parquet by set; without ``missing``, rows whose value is null are left out."""
    (obs if missing else obs.filter("dat is not null")).write.mode("append").partitionBy("set_id").parquet(path)


RADAR = ("elm", "lon", "lat", "lev", "dat", "err", "typ")
RADAR_TYPE = 22


def unpacked_radar(content: bytes, timed: bool, strict: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The radar's place (lon, lat, z; a record each) and its rows, with their time differences if ``timed``."""
    head, columns = 9, len(RADAR) + timed
    if len(content) < 4 * head:
        if strict:
            raise ValueError("a file without the radar's place")
        return np.zeros(3, np.float32), np.zeros((0, columns), np.float32)
    return np.frombuffer(content[: 4 * head], "<f4").reshape(3, 3)[:, 1], unpacked(content[4 * head :], columns, strict)


def read_radar(spark: SparkSession, path: str, timed: bool = False, strict: bool = False, split: int = records.SPLIT) -> DataFrame:
    """set_id, idx, the radar's place as ``meta`` and the columns of each record; typ is that of radars, dif 0 unless ``timed``; ragged files are passed over unless ``strict``. Files are split as by ``read_records``."""
    if records.splittable(path):
        columns = (*RADAR, "dif") if timed else RADAR
        rows = records.scan(spark, path, columns, "error" if strict else "skip", 3, split)
        return rows.withColumns({"typ": F.lit(float(RADAR_TYPE)), "dif": F.col("dif") if timed else F.lit(0.0)})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                meta, rows = unpacked_radar(content, timed, strict)
                n = len(rows)
                values = [pa.array(rows[:, k].astype(float)) for k in range(len(RADAR) - 1)]
                dif = rows[:, len(RADAR)].astype(float) if timed else np.zeros(n)
                place = pa.array([meta.astype(float).tolist()] * n, pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.rsplit("/", 1)[-1]] * n, pa.string()), pa.array(np.arange(1, n + 1)), place, *values, pa.array(np.full(n, float(RADAR_TYPE))), pa.array(dif)],
                    ["set_id", "idx", "meta", *RADAR, "dif"],
                )

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInArrow(work, "set_id string, idx long, meta array<double>, " + ", ".join(f"{c} double" for c in (*RADAR, "dif")))


def write_departures(obs: DataFrame, departures: DataFrame, path: str) -> None:
    """Observations with code, guess and analysis departures, by set."""
    obs.join(departures.select("set_id", "idx", "qc", "omb", "oma"), ["set_id", "idx"]).write.mode("append").partitionBy("set_id").parquet(path)


def write_members(ensemble: DataFrame, path: str) -> None:
    """An ensemble by member, with its mean (member 0) and spread (member -1)."""
    keys = [c for c in ensemble.columns if c not in ("mem", "x")]
    stats = ensemble.groupBy(*keys).agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sprd"))
    both = [stats.select(*keys, F.lit(m).alias("mem"), F.col(c).alias("x")) for m, c in ((0, "mean"), (-1, "sprd"))]
    ensemble.select(*keys, "mem", "x").unionByName(both[0]).unionByName(both[1]).write.mode("overwrite").partitionBy("mem").parquet(path)


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """The members alone; the partitions of mean and spread are not read."""
    return spark.read.parquet(path).filter("mem > 0")
