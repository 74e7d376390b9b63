"""Exact top-k search by inner product, block at a time.

Documents are integer vectors, terms their components. Documents are put in an order that
brings like ones together (the signs of a few fixed random projections) and cut into
ranges of ``BLOCK``; each block has a forward index (its vectors, row by row) and every
term's maximum and minimum. For a query, the sum over terms of the larger of weight times
maximum and weight times minimum bounds every score in a block. Blocks are visited by
falling bound, and scored through their forward index, until the bound falls below the
query's k-th score so far.

Blocks are held in shards of bounded size. Queries are dealt to groups of bounded size.
Each group first searches the shard that holds its queries' own neighbourhood, which gives
every query a k-th score to start from; then each group meets each other shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isohyet.llm.common import materialise
from isohyet.llm.vectordup import usable

BLOCK = 64
SHARD = 8192
GROUP = 2048
SIGNS = 16
ROWS_OF_A_PART = 32768


def quantised(vector: str) -> F.Column:
    """floor(256 * x) of each component as double; null where a component is null or not finite."""
    return F.when(usable(vector), F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * 256).cast("long")))


def _stack(column: pa.Array, width: int) -> np.ndarray:
    ends = np.append(0, np.cumsum(column.value_lengths().to_numpy()))
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), np.diff(ends))
    out[row, np.arange(len(row)) - np.repeat(ends[:-1], np.diff(ends))] = column.flatten().to_numpy()
    return out


def _place(width: int):
    planes = np.random.default_rng(41).normal(size=(width, SIGNS))

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            signs = _stack(batch, width) @ planes > 0
            yield pa.array(signs @ (1 << np.arange(SIGNS - 1, -1, -1)), pa.int64())

    work.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(work, "long")


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores of each query; ties go to smaller ids."""
    order = np.lexsort((ids, -score, query))
    first = np.flatnonzero(np.diff(query[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return order[rank < k]


def search_blocks(queries: np.ndarray, own: np.ndarray, floor: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Query numbers, ids and scores of the best k in ``blocks`` not below ``floor``; and how many blocks were scored."""
    high = np.stack([v.max(axis=0) for _, v in blocks])
    low = np.stack([v.min(axis=0) for _, v in blocks])
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    bound = plus @ high.T + minus @ low.T
    order = np.argsort(-bound, axis=1, kind="stable")
    kth = floor.copy()
    found = [np.zeros(0, np.int64)] * 3
    visited = 0
    alive = np.arange(len(queries))
    for step in range(len(blocks)):
        at = order[alive, step]
        go = bound[alive, at] >= kth[alive]
        alive, at = alive[go], at[go]
        if not len(alive):
            break
        visited += len(alive)
        new = []
        for b in np.unique(at).tolist():
            who = alive[at == b]
            ids, vectors = blocks[b]
            score = queries[who] @ vectors.T
            i, j = np.nonzero((score >= kth[who][:, None]) & (ids[None, :] != own[who][:, None]))
            new.append((who[i], ids[j], score[i, j]))
        q, d, s = (np.concatenate([f, *[n[c] for n in new]]) for c, f in enumerate(found))
        best = _best(q, d, s, k)
        found = [q[best], d[best], s[best]]
        full = np.flatnonzero(np.bincount(found[0], minlength=len(queries)) >= k)
        least = np.full(len(queries), np.iinfo(np.int64).max)
        np.minimum.at(least, found[0], found[2])
        kth[full] = np.maximum(kth[full], least[full])
    return found[0], found[1], found[2], visited


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each query row the ``k`` highest inner products over all other ids.

    Ties go to the smaller vec_id. Vectors that are null or hold null or non-finite
    components take no part, nor do rows with a null id; shorter vectors count as filled
    up with zeros. Candidates with the query's own id are left out. Of repeated rows, each
    is a candidate and each asks for itself, so ranks then repeat under one query_id. An
    empty table gives no rows. Other columns are not read.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), quantised(vector_column).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    rows = rows.filter("vec_id is not null and vector is not null")
    n, width = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    width = max(width or 1, 1)
    parts = max(1, -(-n // ROWS_OF_A_PART))
    placed = rows.withColumn("place", _place(width)("vector")).repartitionByRange(parts, "place", "vec_id").sortWithinPartitions("place", "vec_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per block of consecutive documents of a partition."""
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), 0, None
        for last, batch in _with_last(batches):
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            whole = len(held) if last else len(held) // BLOCK * BLOCK
            pieces = [held.slice(at, BLOCK) for at in range(0, whole, BLOCK)]
            held = held.slice(whole)
            if pieces:
                ids = [np.array(p["vec_id"].to_pylist(), np.int64) for p in pieces]
                asked = [np.array(p["asked"].to_pylist(), bool).tobytes() for p in pieces]
                forward = [_stack(p["vector"].combine_chunks(), width).tobytes() for p in pieces]
                shards = [(part << 32) | ((number + i) * BLOCK // SHARD) for i in range(len(pieces))]
                number += len(pieces)
                yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(asked, pa.binary()), pa.array(forward, pa.binary())], ["shard", "ids", "asked", "forward"])

    blocks = materialise(placed.select("vec_id", "vector", "asked").mapInArrow(cut, "shard long, ids binary, asked binary, forward binary"), "topk-blocks")
    shards = blocks.select("shard").distinct()

    def asked_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, bytes]] = []
            for shard, ids, asked, forward in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                vectors = np.frombuffer(forward, np.int64).reshape(-1, width)
                who = np.flatnonzero(np.frombuffer(asked, bool))
                out += [(shard, int(np.frombuffer(ids, np.int64)[w]), vectors[w].tobytes()) for w in who]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary())], ["shard", "query_id", "vector"])

    queries = blocks.select("shard", "ids", "asked", "forward").mapInArrow(asked_of, "shard long, query_id long, vector binary")
    queries = materialise(queries.select(F.col("shard").alias("home"), "query_id", "vector", F.monotonically_increasing_id().alias("query")), "topk-queries")

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        held = [(np.frombuffer(i, np.int64), np.frombuffer(f, np.int64).reshape(-1, width)) for i, f in zip(left["ids"].to_pylist(), left["forward"].to_pylist(), strict=True)]
        numbers, own = np.array(right["query"].to_pylist(), np.int64), np.array(right["query_id"].to_pylist(), np.int64)
        floor = np.array([np.iinfo(np.int64).min if f is None else f for f in right["floor"].to_pylist()], np.int64)
        if not held or not len(numbers):
            return pa.table({c: pa.array([], pa.int64()) for c in ("query", "query_id", "vec_id", "score")})
        asked = np.frombuffer(b"".join(right["vector"].to_pylist()), np.int64).reshape(len(numbers), width)
        q, d, s, _ = search_blocks(asked, own, floor, held, k)
        return pa.table({"query": numbers[q], "query_id": own[q], "vec_id": d, "score": s})

    schema = "query long, query_id long, vec_id long, score long"
    grouped = lambda f: F.pmod(F.xxhash64("query"), f).cast("int").alias("part")
    sizes = queries.groupBy("home").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    at_home = queries.join(sizes, "home").select("query", "query_id", "vector", F.col("home").alias("shard"), grouped(F.col("groups")), F.lit(None).cast("long").alias("floor"))
    parts_of = sizes.select(F.col("home").alias("shard"), F.explode(F.sequence(F.lit(0), (F.col("groups") - 1).cast("int"))).alias("part"))
    forward = blocks.select("shard", "ids", "forward")
    first = materialise(forward.join(parts_of, "shard").groupBy("shard", "part").cogroup(at_home.groupBy("shard", "part")).applyInArrow(meet, schema), "topk-first")
    start = first.groupBy("query").agg(F.min("score").alias("least"), F.count("*").alias("n")).select("query", F.when(F.col("n") >= k, F.col("least")).alias("floor"))
    groups = max(1, -(-queries.count() // GROUP))
    asked = queries.join(start, "query", "left").select("home", "query", "query_id", "vector", grouped(F.lit(groups)), "floor")
    number = shards.count()
    listed = materialise(shards.select("shard", (F.row_number().over(Window.orderBy("shard")) - 1).alias("turn")), "topk-shards")  # one row per SHARD vectors
    # The stated queries against all rows: every group of queries is sent to every shard, by keys.
    sent = asked.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(max(number, 1) - 1)))).join(listed, "turn").filter("shard <> home").select("query", "query_id", "vector", "shard", "part", "floor")
    every = forward.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    second = every.groupBy("shard", "part").cogroup(sent.groupBy("shard", "part")).applyInArrow(meet, schema)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = first.union(second).withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _with_last(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    held = None
    for b in batches:
        if held is not None:
            yield False, held
        held = b
    if held is not None:
        yield True, held
