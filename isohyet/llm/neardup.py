"""Near duplicates by b-bit minwise hashing.

Minima of ``MINIMA`` hash functions are taken over each document's word shingles. Full
minima only make band keys; of each one, ``BITS`` low bits are retained and packed into
64-bit words. Equal sets become one class. Classes that share a band key are candidates;
their resemblance is estimated from the packed words by bit counts, corrected for the
chance that unlike minima agree in their low bits, and what may reach the threshold is
confirmed on the full shingle sets.

No bucket is paired off: its classes meet its smallest one only, and only while it holds
more than one component; the first bands go before the others, as most groups are joined
by them. What is still in different components afterwards meets in
chunks of its bucket, two at a time, where the estimate and the full sets are compared
without a row for each pair, and only links come out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.llm import textcodes
from isohyet.llm.common import free_name, give_back, materialise
from isohyet.llm.components import components

SHINGLE = 5
ROWS, BANDS = 5, 40
MINIMA = ROWS * BANDS
STEPS = (1, 6)  # bands are taken up to the first of these, then up to the next, then all
BITS = 4
PACKED = -(-MINIMA * BITS // 64)
CHUNK = 256
SALTS = 32
NUM, DEN = 75, 100  # link where DEN * intersection >= NUM * union
DOUBT = 4.5  # standard deviations that an estimate may fall short of the threshold
SETS_KEPT = 2000

_random = np.random.default_rng(97)
_FACTOR = _random.integers(0, 1 << 32, MINIMA, np.uint32) | np.uint32(1)
_FLIP = _random.integers(0, 1 << 32, MINIMA, np.uint32)
_NIBBLES = 0x1111111111111111


def shingle_sets(texts: list[bytes], width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle codes of each text; with fewer words, the whole sequence as one."""
    codes, per_text = textcodes.word_codes(texts)
    runs = textcodes.sequence_codes(codes, width)
    out, at = [], 0
    for n in per_text.tolist():
        if n >= width:
            out.append(textcodes.distinct(runs[at : at + n - width + 1]))
        else:
            out.append(textcodes.sequence_codes(codes[at : at + n], n) if n else runs[:0])
        at += n
    return out


def _described(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Set sizes, two set codes, band keys and packed low bits."""
    sets = shingle_sets(texts)
    sizes = np.array([len(s) for s in sets], np.int64)
    some = np.flatnonzero(sizes)
    one, two = np.zeros((2, len(texts)), np.int64)
    keys, packed = np.zeros((len(texts), BANDS), np.int64), np.zeros((len(texts), PACKED), np.int64)
    if len(some):
        every = np.concatenate([sets[k] for k in some.tolist()])
        starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
        one[some] = np.add.reduceat(textcodes.mix(every ^ np.uint64(0x5851F42D4C957F2D)), starts).view(np.int64)
        two[some] = np.bitwise_xor.reduceat(textcodes.mix(every * np.uint64(0xD1342543DE82EF95)), starts).view(np.int64)
        short = (every >> np.uint64(32)).astype(np.uint32)
        minima = np.empty((len(some), MINIMA), np.uint32)
        for k in range(MINIMA):
            minima[:, k] = np.minimum.reduceat((short ^ _FLIP[k]) * _FACTOR[k], starts)
        banded = minima.reshape(len(some), BANDS, ROWS).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), banded.shape[:2])
        for j in range(ROWS):
            key = textcodes.mix(key * np.uint64(0x9E3779B97F4A7C15) + banded[:, :, j])
        keys[some] = key.view(np.int64)
        low = np.zeros((len(some), PACKED * 64 // BITS), np.uint64)
        low[:, :MINIMA] = minima & np.uint32((1 << BITS) - 1)
        shifts = np.arange(0, 64, BITS, dtype=np.uint64)
        packed[some] = np.bitwise_or.reduce(low.reshape(len(some), PACKED, -1) << shifts, axis=2).view(np.int64)
    return sizes, one, two, keys, packed


def _signatures(docs: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in textcodes.chunks(textcodes.encoded(batch.column(2))):
                sizes, one, two, keys, packed = _described(texts)
                n = len(texts)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (keys, packed)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), *map(pa.array, (sizes, one, two)), *lists], ["doc_id", "text_hash", "n_shingles", "one", "two", "bands", "packed"])
                at += n

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(work, "doc_id long, text_hash long, n_shingles long, one long, two long, bands array<long>, packed array<long>")


def unlike(a: Column, b: Column) -> Column:
    """Number of minima whose retained bits differ."""
    words = []
    for k in range(PACKED):
        x = a.getItem(k).bitwiseXOR(b.getItem(k))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        words.append(F.bit_count(x.bitwiseAND(F.lit(_NIBBLES))))
    return reduce(lambda p, q: p + q, words)


def resemblance(differing: Column) -> Column:
    """Estimate from the share of unlike low bits; 2^-BITS of unlike minima agree in them by chance."""
    chance = 1 / (1 << BITS)
    return ((1 - differing / MINIMA) - chance) / (1 - chance)


def most_unlike() -> int:
    """Differing minima above which a pair is out: DOUBT standard deviations below the threshold."""
    chance, j = 1 / (1 << BITS), NUM / DEN
    agree = chance + (1 - chance) * j
    low = agree - DOUBT * (agree * (1 - agree) / MINIMA) ** 0.5
    return int((1 - low) * MINIMA)


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows (a, b, x, y) whose classes a and b have full shingle sets that pass the threshold."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            ids = [batch.column(k).to_pylist() for k in (0, 1)]
            sides = [textcodes.encoded(batch.column(k)) for k in (4, 5)]
            good = []
            for a, b, ta, tb in zip(*ids, *sides, strict=True):
                if len(kept) > SETS_KEPT:
                    kept.clear()
                for k, t in ((a, ta), (b, tb)):
                    if k not in kept:
                        kept[k] = shingle_sets([t])[0]
                x, y = kept[a], kept[b]
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(DEN * both >= NUM * (len(x) + len(y) - both))
            yield batch.select(["a", "b", "x", "y"]).filter(pa.array(good, pa.bool_()))

    left = texts.select(F.col("class").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("class").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y", "text_a", "text_b").mapInArrow(work, "a long, b long, x long, y long")


def _meet(key: tuple, table: pa.Table) -> pa.Table:
    """Links between components (a, b) that two chunks of one bucket hold; every pair is judged in the first bucket it shares."""
    bucket, left, right = (k.as_py() for k in key)
    label, chunk = np.array(table["label"].to_pylist(), np.int64), np.array(table["chunk"].to_pylist())
    packed = np.array(table["packed"].to_pylist(), np.int64).view(np.uint64)
    bands = np.array(table["bands"].to_pylist(), np.int64)
    texts = textcodes.encoded(table["text"].combine_chunks())
    near = np.triu(label[:, None] != label[None, :])
    if left != right:
        near &= chunk[:, None] != chunk[None, :]
    differing = np.zeros(near.shape, np.int32)
    for k in range(PACKED):
        x = packed[:, k][:, None] ^ packed[:, k][None, :]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        differing += np.bitwise_count(x & np.uint64(_NIBBLES))
    i, j = np.nonzero(near & (differing <= most_unlike()))
    same = bands[i] == bands[j]
    first = bands[i, same.argmax(axis=1)] == bucket if len(i) else np.zeros(0, bool)
    sets: dict[int, np.ndarray] = {}
    root = {x: x for x in label.tolist()}
    links = []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in zip(i[first].tolist(), j[first].tolist(), strict=True):
        p, q = top(int(label[a])), top(int(label[b]))
        if p == q:
            continue
        for k in (a, b):
            if k not in sets:
                sets[k] = shingle_sets([texts[k]])[0]
        both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        if DEN * both >= NUM * (len(sets[a]) + len(sets[b]) - both):
            root[max(p, q)] = min(p, q)
            links.append((p, q))
    return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, group_id, component_id, kept: one row per row of ``docs``.

    Words are lower-cased (A-Z); sets, links and the threshold are those of the constants
    above. Null, empty and blank texts have no shingles, link with nothing and are kept.
    Rows with a null id take part in links; a component's id is the smallest id in it, null
    where it has none, and ``group_id`` its number in this run; ``kept`` is ``doc_id = component_id`` and false where that is
    unknown. Repeated rows get equal results. Texts are read whole. Only doc_id and text
    are read, so further columns do no harm; an empty table gives no rows.
    """
    signed = materialise(_signatures(docs), "neardup-signed")
    classes = materialise(
        signed.filter("n_shingles > 0").groupBy("one", "two").agg(
            F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "text_hash")).alias("example"), F.first("bands").alias("bands"), F.first("packed").alias("packed"),
        ).withColumn("class", F.monotonically_increasing_id()), "neardup-classes",
    )
    keyed = classes.select("class", F.posexplode("bands").alias("band", "key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    buckets = materialise(keyed.join(shared, "key"), "neardup-buckets")
    packed_a = classes.select(F.col("class").alias("a"), F.col("packed").alias("packed_a"))
    packed_b = classes.select(F.col("class").alias("b"), F.col("packed").alias("packed_b"))
    wanted = buckets.select("class").distinct().join(classes.select("class", "example"), "class").select("class", F.col("example.doc_id").alias("w_id"), F.col("example.text_hash").alias("w_hash"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    found = rows.join(wanted, (F.col("text_hash") == F.col("w_hash")) & F.col("doc_id").eqNullSafe(F.col("w_id")))
    texts = materialise(found.groupBy("class").agg(F.first("text").alias("text")), "neardup-texts")

    def apart(rows: DataFrame) -> DataFrame:
        """Rows of the buckets that hold more than one component, with their smallest class and its component."""
        ends = [F.min("class").alias("low"), F.min_by("label", "class").alias("low_label")]
        labelled = rows.select("key", "class").join(members, "class")
        mixed = labelled.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h"), *ends).filter("l < h").drop("l", "h")
        salted = mixed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a bucket's rows go to so many tasks
        return labelled.withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"]).drop("salt")

    def extended(pairs: DataFrame, name: str) -> None:
        """Confirm the pairs (a, b) of components (x, y) that are new, and join the components of those that link."""
        nonlocal tested
        new = pairs.distinct() if tested is None else pairs.distinct().join(tested, ["a", "b"], "left_anti")
        near = new.join(packed_a, "a").join(packed_b, "b").filter(unlike(F.col("packed_a"), F.col("packed_b")) <= most_unlike())
        new = materialise(near.select("a", "b", "x", "y"), f"neardup-likely-{name}")
        tested = new.select("a", "b") if tested is None else tested.union(new.select("a", "b"))
        join_components(_confirmed(new, texts).select(F.col("x").alias("a"), F.col("y").alias("b")), name)

    def join_components(links: DataFrame, name: str) -> None:
        nonlocal members
        joined = components(links, f"neardup-components-{name}").withColumnRenamed("node", "label")
        members = materialise(members.join(joined, "label", "left").select("class", F.coalesce("component", "label").alias("label")), f"neardup-members-{name}")
        give_back(docs.sparkSession)  # this is the step with the most queries

    def star(rows: DataFrame) -> DataFrame:
        """Pairs of each class with its bucket's smallest one, unless they are in one component."""
        return rows.filter("label <> low_label").select(F.col("low").alias("a"), F.col("class").alias("b"), F.col("label").alias("x"), F.col("low_label").alias("y"))

    tested = None
    members = materialise(buckets.select("class").distinct().withColumn("label", F.col("class")), "neardup-members")
    still = None
    for first, last in zip((0, *STEPS), (*STEPS, BANDS), strict=True):
        rows = materialise(apart(buckets.filter((F.col("band") >= first) & (F.col("band") < last))), f"neardup-open-{first}")
        still = rows if still is None else still.union(rows)
        extended(star(rows), f"{first}")
    rest = materialise(apart(still).select("key", "class", "label"), "neardup-rest")
    sizes = rest.groupBy("key").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    dealt = rest.join(sizes, "key").join(classes.select("class", "bands", "packed"), "class").join(texts, "class").withColumn("chunk", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("left", F.least("chunk", "other")).withColumn("right", F.greatest("chunk", "other"))
    met = paired.select("key", "left", "right", "class", "label", "bands", "packed", "text", "chunk").groupBy("key", "left", "right").applyInArrow(_meet, "a long, b long")
    join_components(met, "rest")
    label = classes.select("class", "one", "two", "least_id").join(members, "class", "left").withColumn("label", F.coalesce("label", "class"))
    least = label.groupBy("label").agg(F.min("least_id").alias("component_id"))
    told = label.join(least, "label").select("one", "two", F.col("label").alias("group_id"), "component_id")
    out = signed.select("doc_id", "text_hash", "n_shingles", "one", "two").join(told, ["one", "two"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", "group_id", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of near duplicates, all columns as they are.

    It is a row with the group's smallest id; a group without any id keeps one row too.
    Rows without shingles are in no group and all stay, unless they repeat an id and a text.
    """
    told = near_duplicates(docs)
    s_id, s_hash, n = (free_name(docs, c) for c in ("s_id", "s_hash", "count"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first")
    grouped = told.filter("n_shingles > 0").groupBy("group_id").agg(first).select("first.doc_id", "first.text_hash")
    stays = grouped.union(told.filter("n_shingles = 0").select("doc_id", "text_hash").distinct())
    copies = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash")).agg(F.count("*").alias(n)).filter(F.col(n) > 1)
    key = [F.col("doc_id").cast("long").eqNullSafe(F.col(s_id)), F.xxhash64("text") == F.col(s_hash)]
    kept = docs.join(stays.select(F.col("doc_id").alias(s_id), F.col("text_hash").alias(s_hash)), key, "left_semi")
    if copies.limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept
