"""States and diagnostics of ensembles as partitioned Parquet, simulated observations made elsewhere, and sets by format."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isohyet.operators.observations import to_si
from isohyet.sources.observations import CONVENTIONAL, read_radar, read_records

SET_COLUMNS = ("idx", *CONVENTIONAL)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder of ``spark.checkpoint.dir``, removed when the driver's JVM ends; a temporary folder in local mode alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table below the shared folder, for what is read more than once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def write_history(state: DataFrame, path: str) -> None:
    """A state or its diagnostics (slot, mem, gi, gj, ...) by slot and member."""
    state.write.mode("overwrite").partitionBy("slot", "mem").parquet(path)


def read_history(spark: SparkSession, path: str, variables: Sequence[str], slots: Sequence[int] | None = None, members: tuple[int, int] | None = None) -> DataFrame:
    """(slot, mem, gi, gj, k, variables): only the named variables are read, and only the folders of the slots and members asked for."""
    out = spark.read.parquet(path)
    if slots is not None:
        out = out.filter(F.col("slot").isin(*slots))
    if members is not None:
        out = out.filter(F.col("mem").between(*members))
    return out.select("slot", "mem", *[c for c in ("gi", "gj", "k") if c in out.columns], *variables)


def write_simulated(hx: DataFrame, path: str) -> None:
    """Simulated observations (set_id, idx, mem, val, qc) by member."""
    hx.select("set_id", "idx", "mem", "val", "qc").write.mode("overwrite").partitionBy("mem").parquet(path)


def read_simulated(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("set_id", "idx", "mem", "val", "qc")


def with_external(computed: DataFrame, external: DataFrame) -> DataFrame:
    """(set_id, idx, n, hx_mean, hx_sprd, qc) of both tables' members together; the worst code of a member is the observation's."""
    both = computed.select("set_id", "idx", "mem", "val", "qc").unionByName(external)
    return both.groupBy("set_id", "idx").agg(F.count("*").alias("n"), F.avg("val").alias("hx_mean"), F.stddev_samp("val").alias("hx_sprd"), F.max("qc").alias("qc"))


def _conventional(spark: SparkSession, path: str) -> DataFrame:
    return to_si(read_records(spark, path, strict=True))


def _parquet(spark: SparkSession, path: str) -> DataFrame:
    return to_si(spark.read.parquet(path))


FORMATS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"RECORDS": _conventional, "RADAR": lambda spark, path: read_radar(spark, path, strict=True), "PARQUET": _parquet}


def read_sets(spark: SparkSession, sets: Sequence[tuple[str, str]]) -> DataFrame:
    """(set_id from 1, idx, the conventional columns) of sets, each a format of ``FORMATS`` and a path, in SI units. A path that is not there gives no rows; an unknown format and a ragged file are errors."""
    schema = "set_id int, idx long, " + ", ".join(f"{c} double" for c in CONVENTIONAL)
    out = spark.createDataFrame([], schema)
    for number, (kind, path) in enumerate(sets, 1):
        reader = FORMATS[kind]
        if exists(spark, path):
            rows = reader(spark, path)
            out = out.unionByName(rows.select(F.lit(number).alias("set_id"), F.col("idx").cast("long").alias("idx"), *[F.col(c).cast("double").alias(c) for c in CONVENTIONAL]))
    return out
