"""Near duplicates among vectors by an index of pivot permutations.

Reference points (pivots) are drawn from the vectors, at most ``MOST_PIVOTS`` and none
close to another. A vector is described by its ``NEAREST`` pivots in order. Inverted lists
are kept for a few pivots together: a vector is on the list of every ``met`` of its
``first`` nearest ones, so that a list holds the vectors which all its pivots' lists have
in common. Two vectors of a list are candidates if they share at least ``shared`` of all
pivots that describe them; candidates are verified by their cosine in double precision. A
pair is judged in the first list that both are on, so no link counts twice.

How many pivots make a list depends on their number and on how the vectors lie: of the
``RULES``, in order of their work, that one is taken by which sampled vectors and
others at the least cosine from them, in directions that vectors themselves have, meet
in a list in ``RECALL`` of cases.

Equal vectors become one class first. Lists with one class are left out before any vector
is sent to a list; many short lists make one group. Long lists are dealt to chunks of about
``CHUNK`` classes, and each two chunks of a list meet in one task, which returns one row per class.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import joined_by_key, materialise
from isohyet.llm.components import components

PER_PIVOT = 24  # classes for each pivot, about, until MOST_PIVOTS is reached
MOST_PIVOTS = 4096
LEAST_PIVOTS = 16
#: Of pivots closer than this only one stays; the next bound is taken if less than a quarter is left, as where all vectors are much alike.
CLOSE = (0.8, 0.9, 0.95, 0.98)
NEAREST = 16
RULES = ((6, 3), (8, 3), (9, 3), (10, 3), (12, 3), (6, 2), (8, 2), (12, 2), (16, 2), (6, 1), (16, 1))  # first, met
RECALL, SAMPLE = 0.98, 1024
MOST_SHARED = 6
CHUNK = 4096
SHORT = 64  # classes of a list whose pairs are worked on with those of other lists
OF_A_GROUP = 20_000  # rows of short lists in one group, about
AT_ONCE = 512  # rows of a chunk whose shared pivots are counted at a time
LEAST_COSINE = 0.95


def usable(vector: Column | str) -> Column:
    """True for vectors without null or non-finite components; an empty one counts as zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & good if isinstance(vector, str) else vector.isNotNull() & good, F.lit(False))


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors as rows, the shorter ones filled up with zeros."""
    ends = np.append(0, np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
    sizes = np.diff(ends)
    out = np.zeros((len(column), width or int(sizes.max(initial=1))))
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(row)) - np.repeat(ends[:-1], sizes)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _units(x: np.ndarray) -> np.ndarray:
    scaled = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return scaled / np.maximum(np.linalg.norm(scaled, axis=1, keepdims=True), 1e-300)


def _pivots(classes: DataFrame, n: int, width: int) -> tuple[np.ndarray, tuple[int, int, int]]:
    """Pivots, and the rule (first, met, shared) that finds neighbours by them."""
    want = int(min(MOST_PIVOTS, max(LEAST_PIVOTS, n // PER_PIVOT)))
    drawn = classes.select("vector", F.xxhash64("vector").alias("draw")).orderBy("draw", "vector").limit(max(want, SAMPLE)).collect()  # MOST_PIVOTS vectors at most
    units = _units(_matrix(pa.array([r.vector for r in drawn], pa.list_(pa.float64())), width))
    kept: list[int] = []
    for close in CLOSE:
        kept.clear()
        for k in range(min(want, len(units))):
            if not kept or (units[kept] @ units[k]).max() < close:
                kept.append(k)
        if 4 * len(kept) >= min(want, len(units)):
            break
    pivots = units[kept].astype(np.float32)
    return pivots, _rule(units[-SAMPLE:], pivots)


def nearest(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The NEAREST pivots of each vector in order."""
    cosine = units.astype(np.float32) @ pivots.T
    n = min(NEAREST, len(pivots))
    top = np.argpartition(-cosine, n - 1, axis=1)[:, :n]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(cosine, top, axis=1), axis=1, kind="stable"), axis=1).astype(np.int32)


def _in_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of rows, which pivots of ``a`` are among those of ``b``."""
    return (a[:, :, None] == b[:, None, :]).any(axis=2)


def _rule(units: np.ndarray, pivots: np.ndarray) -> tuple[int, int, int]:
    if len(pivots) < 2 or len(units) < 2:
        return 1, 1, 1
    other = np.roll(units, 1, axis=0)
    other = other - (other * units).sum(axis=1, keepdims=True) * units
    norm = np.linalg.norm(other, axis=1, keepdims=True)
    some = norm[:, 0] > 1e-9
    a, side = units[some], (other / np.maximum(norm, 1e-300))[some]
    if not len(a):
        return 1, 1, 1
    x, y = nearest(a, pivots), nearest(LEAST_COSINE * a + np.sqrt(1 - LEAST_COSINE**2) * side, pivots)
    shared = _in_common(x, y).sum(axis=1)
    fits = (r for r in RULES if r[0] <= len(pivots) and (_in_common(x[:, : r[0]], y[:, : r[0]]).sum(axis=1) >= r[1]).mean() >= RECALL)
    first, met = next(fits, (min(NEAREST, len(pivots)), 1))
    return first, met, max([met, *(s for s in range(1, min(MOST_SHARED, x.shape[1]) + 1) if (shared >= s).mean() >= (1 + RECALL) / 2)])


def _keys(named: np.ndarray, rule: tuple[int, int, int]) -> np.ndarray:
    """A number for every ``met`` of the ``first`` pivots of each row."""
    first, met, _ = rule
    ranked = np.sort(named[:, :first].astype(np.int64), axis=1)
    picks = np.array(list(combinations(range(ranked.shape[1]), met)))
    out = np.zeros((len(named), len(picks)), np.int64)
    for k in range(met):
        out = out * MOST_PIVOTS + ranked[:, picks[:, k]]
    return out


def candidates(named: np.ndarray, key: int, rule: tuple[int, int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that share at least ``shared`` pivots and whose first common list is ``key``, block by block."""
    nearest_few, met, least = rule
    unique, place = np.unique(named, return_inverse=True)
    place = place.reshape(named.shape)
    every, first = np.zeros((2, len(named), len(unique)), np.float32)
    np.put_along_axis(every, place, 1, axis=1)
    np.put_along_axis(first, place[:, :nearest_few], 1, axis=1)
    below = first[:, unique < key % MOST_PIVOTS]  # a pair's first list is that of its least common pivots; the last of a key is its greatest
    for at in range(0, len(named), AT_ONCE):
        shared = every[at : at + AT_ONCE] @ every.T >= least
        shared &= below[at : at + AT_ONCE] @ below.T == met - 1
        i, j = np.nonzero(shared)
        yield i[i + at < j] + at, j[i + at < j]


def short_candidates(named: np.ndarray, keys: np.ndarray, rule: tuple[int, int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for rows of many lists, sorted by their keys: pairs of rows one place apart, then two, and so on."""
    nearest_few, met, least = rule
    greatest = (keys % MOST_PIVOTS)[:, None]
    for step in range(1, len(keys)):
        at = np.flatnonzero(keys[step:] == keys[:-step])
        if not len(at):
            break
        for part in range(0, len(at), 1 << 14):
            i = at[part : part + (1 << 14)]
            j = i + step
            few = named[i, :nearest_few]
            good = (_in_common(few, named[j, :nearest_few]) & (few < greatest[i])).sum(axis=1) == met - 1
            i, j = i[good], j[good]
            good = _in_common(named[i], named[j]).sum(axis=1) >= least
            yield i[good], j[good]


def _meeting(rule: tuple[int, int, int]):
    def meet(table: pa.Table) -> pa.Table:
        """Links and least class of the classes of a group: many short lists, or two chunks of a long one."""
        table = table.sort_by([("key", "ascending"), ("class", "ascending")]).combine_chunks()
        keys, chunk, weight = (table[c].to_numpy() for c in ("key", "chunk", "n"))
        ids, row = np.unique(table["class"].to_numpy(), return_inverse=True)
        units = _units(_matrix(table["vector"].combine_chunks()))
        named = table["pivots"].combine_chunks().flatten().to_numpy().reshape(len(row), -1)
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        between = bool(table["left"][0].as_py() != table["right"][0].as_py())
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        length = np.diff(np.append(starts, len(keys)))
        short = np.repeat(length <= SHORT, length)

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            few = np.flatnonzero(short)
            for i, j in short_candidates(named[few], keys[few], rule):
                yield few[i], few[j]
            for a, n in zip(starts[length > SHORT].tolist(), length[length > SHORT].tolist(), strict=True):
                for i, j in candidates(named[a : a + n], int(keys[a]), rule):
                    yield i + a, j + a

        for i, j in pairs():
            if between:  # pairs inside one chunk meet where that chunk meets itself
                i, j = i[chunk[i] != chunk[j]], j[chunk[i] != chunk[j]]
            for at in range(0, len(i), 1 << 15):
                x, y = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
                good = np.einsum("nd,nd->n", units[x], units[y]) >= LEAST_COSINE
                x, y = x[good], y[good]
                np.add.at(links, row[x], weight[y])
                np.add.at(links, row[y], weight[x])
                a, b = row[x], row[y]
                while (root[a] != root[b]).any():  # the smaller root wins, until all these pairs agree
                    low = np.minimum(root[a], root[b])
                    np.minimum.at(root, root[a], low)
                    np.minimum.at(root, root[b], low)
                    while (root[root] != root).any():
                        root = root[root]
        some = np.flatnonzero(links)
        return pa.table({"class": ids[some], "links": links[some], "least": ids[root[some]]})

    return meet


def near_duplicate_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors``.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with
    nothing: their component is their own id. Vectors of unequal length are compared as if
    filled up with zeros. Equal vectors link with one another. Rows with a null id take
    part in links; a component's id is the smallest id in it, null where it has none;
    ``kept`` is false where that is unknown. An empty table gives no rows; further columns
    are not read.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    nonzero = F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("vector", F.when(usable("vector") & nonzero, F.col("vector")))
    classes = materialise(
        rows.filter("vector is not null").groupBy("vector").agg(F.count("*").alias("n"), F.min("vec_id").alias("least_id")).withColumn("class", F.monotonically_increasing_id()),
        "vectordup-classes",
    )
    n, width = classes.agg(F.count("*"), F.max(F.size("vector"))).first()
    drawn, rule = _pivots(classes, n, width or 1)
    pivots = classes.sparkSession.sparkContext.broadcast(drawn)  # MOST_PIVOTS vectors at most

    def describe(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            p = pivots.value
            near = np.zeros((len(batch), min(NEAREST, len(p))), np.int32)
            for at in range(0, len(batch), 4096):
                near[at : at + 4096] = nearest(_units(_matrix(batch.slice(at, 4096), p.shape[1])), p)
            columns = [pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (near, _keys(near, rule))]
            yield pa.StructArray.from_arrays(columns, ["pivots", "keys"])

    describe.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    described = classes.select("class", "n", "vector", F.arrow_udf(describe, "pivots array<int>, keys array<long>")("vector").alias("d"))
    indexed = materialise(described.select("class", "n", "vector", "d.pivots", "d.keys"), "vectordup-index")
    listed = indexed.select("class", F.explode("keys").alias("key"))
    lengths = materialise(listed.groupBy("key").agg(F.count("*").alias("length")).filter("length > 1").withColumn("chunks", F.ceil(F.col("length") / CHUNK).cast("int")), "vectordup-lists")
    short = lengths.filter("chunks = 1").agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    groups = int(short // OF_A_GROUP) + 1
    met_in = joined_by_key(listed, lengths, "key", "length", n * comb(rule[0], rule[1])).select("class", "key", "chunks")
    dealt = met_in.join(indexed.select("class", "n", "vector", "pivots"), "class").withColumn("chunk", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("group", F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("key"), F.lit(groups))).otherwise(-1 - F.col("key")))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    paired = dealt.withColumn("other", other).withColumn("left", F.least("chunk", "other")).withColumn("right", F.greatest("chunk", "other"))
    met = materialise(paired.select("group", "key", "left", "right", "class", "n", "vector", "pivots", "chunk").groupBy("group", "left", "right").applyInArrow(_meeting(rule), "class long, links long, least long"), "vectordup-met")
    counted = met.groupBy("class").agg(F.sum("links").alias("links"))
    group = components(met.select(F.col("class").alias("a"), F.col("least").alias("b")))
    label = classes.join(counted, "class", "left").join(group.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("component", "class"))
    least = label.groupBy("label").agg(F.min("least_id").alias("component_id"))
    told = label.join(least, "label").select("vector", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id", F.lit(True).alias("linked"))
    out = rows.join(told, "vector", "left")
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
