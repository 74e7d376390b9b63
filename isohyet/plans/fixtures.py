"""Observations and an ensemble as views over the event and embedding tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

OBS = """
select event_id obs_id,
  case event_type when 'click' then 2819 when 'view' then 2820 when 'purchase' then 3073 when 'signup' then 3330 else 14593 end elm,
  cast(user_id % 24 + 1 as int) typ,
  ((event_id*37) % 270)/cast(10 as double) ri, ((event_id*53) % 220)/cast(10 as double) rj,
  (1000 - (event_id*13) % 900)*cast(100 as double) lev,
  ({micros} % 86400000000)/cast(1000000 as double) - 43200 dif,
  value dat, cast(1 + event_id % 5 as double) err
from {events}"""
SPARK_MICROS, DUCK_MICROS = "unix_micros(cast(ts as timestamp))", "epoch_us(ts)"

ENS_SPARK = """
select cast(vec_id % 25 as int)+1 gi, cast(floor(vec_id/25) as int)+1 gj, m+1 mem, 50+40*cast(v as double) x
from {embeddings} lateral view posexplode(embedding) t as m, v where vec_id is not null"""
ENS_DUCK = """
select cast(vec_id % 25 as int)+1 gi, cast(floor(vec_id/25) as int)+1 gj, cast(m as int) mem, 50+40*cast(embedding[m] as double) x
from embeddings, range(1, 65) t(m) where vec_id is not null"""
ROWS = "(select cast(floor((max(vec_id) + 1) / 25) as int) from embeddings)"  # full rows of the grid

NX, FIRST_SLOT, LAST_SLOT = 25, 3, 23


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(OBS.format(micros=SPARK_MICROS, events="{events}"), events=read(spark, sf_dir, "events"))


def rows(spark: SparkSession, sf_dir: str) -> int:
    """Full rows of the grid, which grows with the table. A last row that is not full holds points of the analysis, but lies outside the domain of observations."""
    last = read(spark, sf_dir, "embeddings").agg({"vec_id": "max"}).first()[0]
    return 0 if last is None else (last + 1) // NX


def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as points of a grid ``NX`` wide, with all their values as members."""
    return spark.sql(ENS_SPARK, embeddings=read(spark, sf_dir, "embeddings"))


def whole_ensemble(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    return ensemble(spark, sf_dir), rows(spark, sf_dir)


VOLUME = """
select cast(vec_id % 25 as int)+1 gi, cast(floor(vec_id/25) as int)+1 gj, cast(c % 4 as int)+1 k, cast(floor(c/4) as int)+1 mem, 50+40*v u, 10-20*v v, 280-6*(c % 4)+5*v t,
  0.01e0*exp(-(c % 4))*(1+0.2e0*v) q, 100000*exp(-(c % 4)/2.0e0)*(1+0.001e0*v) p
from ({long}) s"""
VOLUME_DUCK = VOLUME.format(long="select vec_id, c, cast(embedding[c + 1] as double) v from embeddings, range(0, 64) r(c) where vec_id is not null")


def volume(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """All vectors as columns of a grid that grows with the table, their 64 values as 4 levels of 16 members; and the grid's full rows."""
    long = "select vec_id, c, cast(x as double) v from {embeddings} lateral view posexplode(embedding) e as c, x where vec_id is not null"
    return spark.sql(VOLUME.format(long=long), embeddings=read(spark, sf_dir, "embeddings")), rows(spark, sf_dir)


def duck_obs() -> str:
    return OBS.format(micros=DUCK_MICROS, events="events")
