"""Columns of a grid and observations meeting tile by tile, in parts of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OBS_OF_A_TASK = 20_000
KEYS = ["ti", "tj", "part"]


def tile_of(place: Column, tile: int) -> Column:
    return F.floor((place - 1) / tile).cast("int")


def in_parts(points: DataFrame, obs: DataFrame, of_a_task: int = OBS_OF_A_TASK) -> tuple[DataFrame, DataFrame]:
    """``points`` and ``obs`` (obs_id), both with (ti, tj), with the further key ``part``: a tile's observations are dealt to as many parts as keep each to about ``of_a_task``, its points go to all of them.

    Tiles without observations, and observations of tiles without points, have rows on their own side alone.
    """
    shares = obs.groupBy("ti", "tj").count().select("ti", "tj", F.ceil(F.col("count") / of_a_task).cast("int").alias("parts"))
    dealt = obs.join(shares, ["ti", "tj"]).withColumn("part", F.pmod(F.hash("obs_id"), F.col("parts"))).drop("parts")
    copied = points.join(shares, ["ti", "tj"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return copied, dealt


def together(points: DataFrame, obs: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str, of_a_task: int = OBS_OF_A_TASK) -> DataFrame:
    """What ``work`` makes of each tile's points and one part of its observations."""
    left, right = in_parts(points, obs, of_a_task)
    return left.groupBy(*KEYS).cogroup(right.groupBy(*KEYS)).applyInArrow(work, schema)


def values(table: pa.Table, column: str) -> np.ndarray:
    return table[column].combine_chunks().to_numpy(zero_copy_only=False)


def matrix(table: pa.Table, column: str) -> np.ndarray:
    """A column of equally long lists as rows."""
    flat = table[column].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    if len(table) and len(flat) % len(table):
        raise ValueError(f"lists of {column} differ in length")
    return flat.reshape(len(table), -1) if len(table) else np.zeros((0, 0))


def columns_at(obs: DataFrame, state: DataFrame, axis: str, variables: Sequence[str], downward: bool, tile: int = 8, of_a_task: int = OBS_OF_A_TASK) -> DataFrame:
    """(obs_id, mem, inside, variables, and each with ``_1`` behind its name): every member's column above an observation, at its place on the vertical axis.

    ``obs`` (obs_id, ri, rj, at) and ``state`` (gi, gj, k, mem, ``axis``, variables) with the lowest level first; the axis falls with the level if
    ``downward``. Columns are interpolated between the four around the observation, then between the two levels around ``at``. ``inside`` is 0
    between levels, -1 below the lowest, 1 above the highest, where values are those of the nearest level; names with ``_1`` are values at the
    lowest level. Observations beside the grid, of which a corner is not there, have no row; one on the last row or column has.

    A column goes to the tiles of the cells that it is a corner of, packed as arrays, an observation to the one of its cell; they meet there.
    """
    names = [axis, *variables]
    packed = state.groupBy("gi", "gj", "mem").agg(F.array_sort(F.collect_list(F.struct("k", *names))).alias("s"))
    tiles = lambda c: F.explode(F.array_distinct(F.array(tile_of(F.col(c), tile), tile_of(F.greatest(F.col(c) - 1, F.lit(1)), tile))))
    columns = packed.select("gi", "gj", "mem", *[F.col("s").getField(v).alias(v) for v in names], tiles("gi").alias("ti")).select("*", tiles("gj").alias("tj"))
    cell = lambda c: F.greatest(F.ceil(c) - 1, F.lit(1)).cast("int")
    sent = obs.select("obs_id", "ri", "rj", F.col("at").cast("double").alias("at"), cell("ri").alias("i"), cell("rj").alias("j")).select("*", tile_of(F.col("i"), tile).alias("ti"), tile_of(F.col("j"), tile).alias("tj"))
    told = [*variables, *[f"{v}_1" for v in names]]
    schema = "obs_id long, mem int, inside int, " + ", ".join(f"{v} double" for v in told)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"obs_id": pa.array([], pa.int64()), "mem": pa.array([], pa.int32()), "inside": pa.array([], pa.int32()), **{v: pa.array([], pa.float64()) for v in told}})
        if not len(left) or not len(right):
            return empty
        gi, gj, members = (values(left, c) for c in ("gi", "gj", "mem"))
        mems, m = np.unique(members, return_inverse=True)
        i0, j0 = int(gi.min()), int(gj.min())
        wide, deep = int(gi.max()) - i0 + 1, int(gj.max()) - j0 + 1
        levels = matrix(left, axis).shape[1]
        there = np.zeros((wide * deep, len(mems)), bool)
        there[(gi - i0) * deep + gj - j0, m] = True
        grid = {}
        for v in names:
            grid[v] = np.zeros((wide * deep, len(mems), levels))
            grid[v][(gi - i0) * deep + gj - j0, m] = matrix(left, v)
        ids, ri, rj, at, i, j = (values(right, c) for c in ("obs_id", "ri", "rj", "at", "i", "j"))
        parts = []
        for a in range(0, len(ids), 256):
            some = slice(a, a + 256)
            di, dj = ri[some] - i[some], rj[some] - j[some]
            corner, weight, whole = [], [], np.repeat(((di >= 0) & (dj >= 0))[:, None], len(mems), axis=1)
            for x in (0, 1):
                for y in (0, 1):
                    w = (di if x else 1 - di) * (dj if y else 1 - dj)
                    p, q = i[some] + x - i0, j[some] + y - j0
                    known = (p >= 0) & (p < wide) & (q >= 0) & (q < deep)
                    c = np.where(known, p * deep + q, 0)
                    whole &= (w == 0)[:, None] | known[:, None] & there[c]
                    corner.append(c)
                    weight.append(w)
            height = sum(w[:, None, None] * grid[axis][c] for w, c in zip(weight, corner, strict=True))
            passed = height >= at[some][:, None, None] if downward else height <= at[some][:, None, None]  # levels at or below the place
            count = passed.sum(axis=2)
            lo, hi = np.maximum(count - 1, 0), np.minimum(count, levels - 1)
            pick = lambda v, k: sum(w[:, None] * np.take_along_axis(grid[v][c], k[:, :, None], 2)[:, :, 0] for w, c in zip(weight, corner, strict=True))  # noqa: E731, B023
            below, above = pick(axis, lo), pick(axis, hi)
            share = np.where(above != below, (at[some][:, None] - below) / np.where(above != below, above - below, 1.0), 0.0)
            share = np.where((count == 0) | (count == levels), 0.0, share)
            beyond = (below > at[some][:, None]) if downward else (below < at[some][:, None])
            inside = np.where(count == 0, -1, np.where((count == levels) & beyond, 1, 0))
            ground = np.zeros_like(lo)
            out = {v: (1 - share) * pick(v, lo) + share * pick(v, hi) for v in variables} | {f"{v}_1": pick(v, ground) for v in names}
            keep = whole.ravel()
            parts.append(pa.table({"obs_id": np.repeat(ids[some], len(mems))[keep], "mem": np.tile(mems, len(di)).astype(np.int32)[keep], "inside": inside.ravel().astype(np.int32)[keep], **{v: x.ravel()[keep] for v, x in out.items()}}))
        return pa.concat_tables(parts)

    return together(columns, sent, work, schema, of_a_task)
