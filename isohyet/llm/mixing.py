"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame and SQL operations.

A source with target/size ratio ``r`` needs ``r`` copies of each of its documents on
average: ``floor(r)`` are certain, the rest is a fractional copy. A fractional copy is
counted as mass in words (fraction x size, in units of 2^-20 word). Two documents at a
time meet; mass moves from one to the other, in a random direction chosen so that both
keep their expectation, until one of them is empty or full. Mass is only moved, so a
source's words stay what they were; the one document left open at the end is rounded at
random, and the words taken differ from the target by less than one document.

Meetings run in chunks of about ``CHUNK`` documents of one source, each leaving at most
one open document; those are dealt to chunks again, level by level, until one is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isohyet.llm.common import materialise

CHUNK = 200
UNIT = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"

_OPEN = "struct<k:bigint,s:bigint,m:bigint>"
_MEET = f"""
aggregate(items,
  named_struct('open', cast(null as {_OPEN}), 'done', cast(array() as array<struct<k:bigint,s:bigint,c:int>>)),
  (acc, b) -> if(acc.open is null, named_struct('open', b, 'done', acc.done),
    element_at(transform(transform(transform(array(named_struct(
          'ab', least(acc.open.m, b.s - b.m), 'ba', least(b.m, acc.open.s - acc.open.m),
          'coin', pmod(xxhash64({{seed}}, {{level}}, acc.open.k, acc.open.s, b.k, b.s), 9007199254740992) / 9007199254740992D)),
        t -> if(t.coin * (t.ab + t.ba) < t.ba, t.ab, -t.ba)),
      move -> named_struct('a', acc.open.m - move, 'b', b.m + move)),
    now -> if(now.a > 0 and now.a < acc.open.s,
        named_struct('open', named_struct('k', acc.open.k, 's', acc.open.s, 'm', now.a),
                     'done', concat(acc.done, array(named_struct('k', b.k, 's', b.s, 'c', if(now.b > 0, 1, 0))))),
        named_struct('open', if(now.b > 0 and now.b < b.s, named_struct('k', b.k, 's', b.s, 'm', now.b), null),
                     'done', if(now.b > 0 and now.b < b.s,
                        concat(acc.done, array(named_struct('k', acc.open.k, 's', acc.open.s, 'c', if(now.a > 0, 1, 0)))),
                        concat(acc.done, array(named_struct('k', acc.open.k, 's', acc.open.s, 'c', if(now.a > 0, 1, 0)),
                                               named_struct('k', b.k, 's', b.s, 'c', if(now.b > 0, 1, 0)))))))), 1)))
"""


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, n, source_size and target, from rows of (source, size): one row per source.

    The window without partitions runs over that aggregate, one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.orderBy("limit_level", F.col("source").asc_nulls_last())
    sums = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = sums.withColumn("weight", weight).withColumn("limit", F.col("source_size") * most).withColumn("limit_level", F.col("limit") / F.col("weight"))
    below, here_on = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("limit").over(below), F.lit(0.0))) / F.sum("weight").over(here_on)
    levels = ranked.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("limit_level"))
    common = F.min_by(F.when(F.col("fits"), F.col("level")), F.when(F.col("fits"), F.col("limit_level"))).over(everything)
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.col("limit"), F.col("weight") * common))
    return levels.select("source", "n", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, copies: one row per row of ``docs``.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` times all
    words; a target stops at ``most`` times its source's size and the excess goes to the
    others by weight. ``taken = copies * size``, and copies are the ratio of target to size
    rounded down or up. A null or empty text has size 0 and takes 0 words; a source of
    such texts alone has target 0. Null sources form one source, null ids are kept, and of
    repeated rows each is decided by itself (which of them gets the copy is not told
    apart). An empty table gives no rows. Only doc_id, text and source are read. Reruns
    agree whatever the partitioning: coins are hashes of ids, and chunks depend on counts.
    """
    sizes = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    targets = materialise(source_targets(sizes, weights, share, most), "mix-targets")
    t = targets.withColumnRenamed("source", "t_source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    start = sizes.join(t, F.col("source").eqNullSafe(F.col("t_source"))).select(
        "doc_id", "source", "size", "n",
        F.round((ratio - F.floor(ratio)) * F.col("size") * UNIT).cast("long").alias("mass"),
    )
    full = F.col("size") * UNIT
    settled = start.filter((F.col("mass") <= 0) | (F.col("mass") >= full)).select("source", F.col("doc_id").alias("k"), F.col("size").alias("s"), F.when(F.col("mass") > 0, 1).otherwise(0).alias("c"))
    items = start.filter((F.col("mass") > 0) & (F.col("mass") < full)).select(
        "source", F.ceil(F.col("n") / CHUNK).cast("long").alias("chunks"),
        F.xxhash64("doc_id", "size").alias("deal"),
        F.struct(F.col("doc_id").cast("long").alias("k"), full.alias("s"), F.col("mass").alias("m")).alias("item"),
    )
    decided = [settled]
    widest = targets.agg(F.max("n")).first()[0] or 0
    level = 0
    while True:
        grouped = items.groupBy("source", "chunks", F.pmod("deal", "chunks").alias("chunk")).agg(F.sort_array(F.collect_list("item")).alias("items"))
        met = materialise(grouped.select("source", "chunks", "chunk", F.expr(_MEET.format(seed=f"{seed}L", level=f"{level}")).alias("met")), f"mix-level{level}")
        decided.append(met.select("source", F.explode("met.done").alias("d")).select("source", F.col("d.k"), (F.col("d.s") / UNIT).cast("long").alias("s"), F.col("d.c")))
        left = met.filter("met.open is not null").select("source", "chunks", F.xxhash64(F.lit(level), "chunk").alias("deal"), F.col("met.open").alias("item"))
        widest = -(-widest // CHUNK)
        level += 1
        if widest <= 1:
            break
        items = left.withColumn("chunks", F.ceil(F.col("chunks") / CHUNK).cast("long"))
    coin = F.pmod(F.xxhash64(F.lit(seed), F.lit(-1), "item.k", "item.s"), F.lit(UNIT)) / F.lit(float(UNIT))
    decided.append(left.select("source", F.col("item.k"), (F.col("item.s") / UNIT).cast("long").alias("s"), F.when(coin * F.col("item.s") < F.col("item.m"), 1).otherwise(0).alias("c")))
    union = decided[0]
    for d in decided[1:]:
        union = union.unionByName(d)
    joined = union.join(t, F.col("source").eqNullSafe(F.col("t_source")))
    copies = (F.floor(ratio) + F.col("c")).cast("int")
    return joined.select(
        F.col("k").alias("doc_id"), F.col("s").alias("size"), "source_size", "target",
        (F.col("s") * copies).alias("taken"), "source", copies.alias("copies"),
    )


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs``, each repeated as often as ``mix`` takes it; all columns as they are, whatever their names.

    Rows with one doc_id (null included) share the copies that ``mix`` gives them evenly,
    the first ones by bucket and text getting what is left over. Null and empty texts take no words and go. An
    empty table gives no rows. Rows of a repeated id are ranked in buckets of about ``CHUNK`` rows, by
    the hash of their text, so that no id is sorted as a whole; equal rows share a bucket. Where no id
    is repeated, nothing is ranked.
    """
    plan = materialise(mix(docs, **parameters).groupBy("doc_id").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")), "mix-plan")
    carried = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    planned = carried.join(plan.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("doc_id"))).drop("doc_id")
    repeat = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")
    if not plan.filter("rows > 1").limit(1).count():
        return planned.select("row", repeat).select("row.*")  # else texts are shuffled a second time, for no rows
    bucket = F.pmod("hash", F.ceil(F.col("rows") / CHUNK))
    repeated = planned.filter("rows > 1").withColumn("bucket", bucket)
    before = Window.partitionBy("id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = repeated.groupBy("id", "bucket").agg(F.count("*").alias("n")).select(F.col("id").alias("of"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = repeated.withColumn("nth", F.row_number().over(Window.partitionBy("id", "bucket").orderBy("row.text"))).join(sizes, F.col("id").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("b")))
    share = F.floor(F.col("copies") / F.col("rows")) + (F.col("nth") + F.col("offset") <= F.col("copies") % F.col("rows")).cast("int")
    each = planned.filter("rows = 1").select("row", "copies").unionByName(ranked.select("row", share.alias("copies")))
    return each.select("row", repeat).select("row.*")
