"""Phrases of words that occur together more often than their parts would lead one to expect.

Identical pieces of text become one row with a multiplicity. Weighted n-grams are summed in tasks, chunk by chunk,
and sent to hash buckets as compressed Arrow tables; each bucket's sums are made in DuckDB, which
spills to the task's own disk beyond its memory. An n-gram can only be frequent if its parts are: pairs are sent if
both words are frequent, longer ones if all their pairs are, as a filter of hash bits tells. The filter never denies a
frequent part, so that sums are exact; its size is bounded by ``MOST_BITS``, and with more keys it lets more n-grams pass.
The counts of a candidate's parts lie in other buckets: it sends a request for each to where they lie, by a join.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isohyet.llm import textcodes
from isohyet.llm.common import materialise

LEAST = 30  # occurrences of a candidate
LONGEST = 4  # words of a candidate
SCALE = 2_000_000
REPORTED = 2_000  # phrases of a language
INSIDE_PERCENT = 80
CHUNK = 8 << 20  # bytes of pieces that a task sums at a time
MOST_BITS = 1 << 27
SHARDS = 64
MEMORY = "256MB"  # of DuckDB, in each task that sums a bucket
SALTS = 64

_U = np.uint64
_POWERS = np.random.default_rng(21).integers(1, 1 << 64, 4096, dtype=_U) | _U(1)
_BYTES = np.random.default_rng(22).integers(1, 1 << 64, 256, dtype=_U)


def pieces_of(docs: DataFrame) -> DataFrame:
    """lang, piece, times, words: distinct pieces with at least one word, their words parted by one space each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.ascii_lower(pc.fill_null(batch.column(1), ""))
            cut = pc.split_pattern_regex(text, r"[.,;:!?\n\x0B\x0C\r]")
            piece = pc.ascii_trim(pc.replace_substring_regex(cut.flatten(), r"[ \t]+", " "), " ")
            lang = pc.fill_null(batch.column(0), "und").take(pc.list_parent_indices(cut))
            some = pc.greater(pc.binary_length(piece), 0)
            rows = pa.table({"lang": lang.filter(some), "piece": piece.filter(some)}).group_by(["lang", "piece"]).aggregate([([], "count_all")])
            yield from rows.rename_columns(["lang", "piece", "times"]).combine_chunks().to_batches()

    rows = docs.select(F.col("lang").cast("string"), "text").mapInArrow(work, "lang string, piece string, times long")
    return rows.groupBy("lang", "piece").agg(F.sum("times").alias("times")).withColumn("words", F.size(F.split("piece", " ")))


def _codes(strings: pa.Array) -> np.ndarray:
    """64-bit codes of strings without nulls."""
    raw = pa.concat_arrays([strings.cast(pa.large_binary())])
    _, offsets, data = raw.buffers()
    at = np.frombuffer(offsets, np.int64)[raw.offset : raw.offset + len(raw) + 1]
    if not len(raw):
        return np.zeros(0, _U)
    long = np.diff(at)
    out = np.zeros(len(raw), _U)
    if int(at[-1] - at[0]):
        body = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
        place = np.arange(len(body)) - np.repeat(at[:-1] - at[0], long)
        some = long > 0
        out[some] = np.add.reduceat(_BYTES[body] * _POWERS[place & 4095] + (place >> 12).astype(_U), (at[:-1] - at[0])[some])
    return textcodes.mix(out + long.astype(_U))


def _sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and the sums of their weights, in whole numbers."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights[order], first) if len(keys) else weights


class Filter:
    """Two hash bits a key; ``has`` is true for every key and for few others."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.mask = _U(len(bits) * 8 - 1)

    @staticmethod
    def places(codes: np.ndarray, mask) -> tuple[np.ndarray, np.ndarray]:
        return codes & mask, (codes >> _U(32)) & mask

    def has(self, codes: np.ndarray) -> np.ndarray:
        told = np.ones(len(codes), bool)
        for p in self.places(codes, self.mask):
            told &= (self.bits[p >> _U(3)] >> (p & _U(7)).astype(np.uint8) & 1).astype(bool)
        return told


class Chunk:
    """Words of many pieces as numbers, with what n-grams need of them."""

    def __init__(self, lang: pa.Array, piece: pa.Array, times: np.ndarray):
        lang = lang.dictionary_encode()
        cut = pc.split_pattern(piece, " ")
        words = cut.flatten().dictionary_encode()
        self.piece = pc.list_parent_indices(cut).to_numpy(zero_copy_only=False)
        self.times = times[self.piece]
        langs = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[self.piece]
        both = langs * len(words.dictionary) + words.indices.to_numpy(zero_copy_only=False)
        self.unique, self.word = np.unique(both, return_inverse=True)
        self.lang_of, self.text_of = lang.dictionary.take(pa.array(self.unique // max(1, len(words.dictionary)))), words.dictionary.take(pa.array(self.unique % max(1, len(words.dictionary))))
        codes = _codes(lang.dictionary)[self.unique // max(1, len(words.dictionary))] * _POWERS[7] + _codes(words.dictionary)[self.unique % max(1, len(words.dictionary))]
        self.code = textcodes.mix(codes)
        same = self.piece[1:] == self.piece[:-1]
        self.pair = np.append(same, False) if len(self.piece) else np.zeros(0, bool)  # a pair starts here

    def gram_codes(self, *words: np.ndarray) -> np.ndarray:
        return gram_codes([self.code[w] for w in words])

    def table(self, words: list[np.ndarray], sums: np.ndarray) -> tuple[pa.Table, np.ndarray]:
        """Rows of n-grams, given by the numbers of their words, and their codes."""
        parts = [self.text_of.take(pa.array(w)) for w in words]
        phrase = parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, " ")
        return pa.table({"lang": self.lang_of.take(pa.array(words[0])), "phrase": phrase, "times": pa.array(sums)}), self.gram_codes(*words)

    def singles(self) -> list[tuple[pa.Table, np.ndarray]]:
        key, sums = _sums(self.word, self.times)
        return [self.table([key], sums)]

    def pairs(self, words: Filter) -> list[tuple[pa.Table, np.ndarray]]:
        good = words.has(gram_codes([self.code]))[self.word]
        at = np.flatnonzero(self.pair[:-1] & good[:-1] & good[1:]) if len(good) else np.zeros(0, np.int64)
        n = len(self.unique)
        key, sums = _sums(self.word[at] * n + self.word[at + 1], self.times[at])
        return [self.table([key // n, key % n], sums)] if len(key) else []

    def longer(self, pairs: Filter) -> list[tuple[pa.Table, np.ndarray]]:
        at = np.flatnonzero(self.pair)
        n = len(self.unique)
        good = np.zeros(len(self.word) + LONGEST, bool)
        good[at] = pairs.has(self.gram_codes(self.word[at], self.word[at + 1]))
        out = []
        for width in range(3, LONGEST + 1):
            at = np.flatnonzero(good[: len(self.word)])
            for k in range(1, width - 1):
                at = at[good[at + k]]
            if not len(at):
                break
            head = self.word[at] * n + self.word[at + 1]
            pair, which = np.unique(head, return_inverse=True)
            tail = [self.word[at + 2]] if width == 3 else [self.word[at + 2] * n + self.word[at + 3]]
            ends, end_of = np.unique(tail[0], return_inverse=True)
            key, sums = _sums(which * len(ends) + end_of, self.times[at])
            first, last = pair[key // len(ends)], ends[key % len(ends)]
            out.append(self.table([first // n, first % n, *([last] if width == 3 else [last // n, last % n])], sums))
        return out


def gram_codes(words: list[np.ndarray]) -> np.ndarray:
    total = np.full(len(words[0]), len(words), _U)
    for k, w in enumerate(words):
        total = total + w * _POWERS[k]
    return textcodes.mix(total)


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _counted(pieces: DataFrame, kind: str, allowed: Filter | None = None) -> DataFrame:
    """lang, phrase, a of the n-grams of one kind (a method of Chunk) that occur LEAST times or more."""
    spark = pieces.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = spark.sparkContext.broadcast(allowed.bits) if allowed else None  # MOST_BITS at most

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = (Filter(sent.value),) if sent else ()
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            chunk = Chunk(rows["lang"].combine_chunks(), rows["piece"].combine_chunks(), rows["times"].to_numpy())
            for table, codes in getattr(chunk, kind)(*told):
                bucket = (codes >> _U(17)) % _U(buckets)
                order = np.argsort(bucket, kind="stable")
                names, first = np.unique(bucket[order], return_index=True)
                table = table.take(pa.array(order)).combine_chunks()
                ends = [*first[1:].tolist(), len(order)]
                blobs = [_packed(table.slice(a, b - a)) for a, b in zip(first.tolist(), ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "rows"])

        size = 0
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                held.append(part)
                size += pc.sum(pc.binary_length(part.column(1))).as_py() or 0
                if size >= CHUNK:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with tempfile.TemporaryDirectory() as spill, duckdb.connect(config={"threads": "1", "memory_limit": MEMORY, "temp_directory": spill, "preserve_insertion_order": "false"}) as con:
            con.execute("create table grams (lang varchar, phrase varchar, times bigint)")
            held: list[pa.Table] = []

            def store() -> None:
                con.register("part", pa.concat_tables(held))
                con.execute("insert into grams select lang, phrase, times from part")
                con.unregister("part")
                held.clear()

            for batch in batches:
                for blob in batch.column(1):
                    held.append(pa.ipc.open_stream(pa.py_buffer(blob.as_py())).read_all())
                    if sum(map(len, held)) >= 1 << 18:
                        store()
            if held:
                store()
            out = con.execute(f"select lang, phrase, cast(sum(times) as bigint) as a from grams group by lang, phrase having sum(times) >= {LEAST}")
            while rows := out.fetchmany(4096):
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "phrase", "a"])

    dealt = pieces.select("lang", "piece", "times").mapInArrow(split, "bucket int, rows binary").repartitionById(buckets, "bucket")
    return materialise(dealt.select("bucket", "rows").mapInArrow(add_up, "lang string, phrase string, a long"), f"phrases_{kind}")


def _filter(grams: DataFrame) -> Filter:
    """Hash bits of all ``grams``, set in SHARDS parts by tasks; what the driver gets does not grow beyond MOST_BITS."""
    bits = 1 << min(max(16, (16 * grams.count()).bit_length()), MOST_BITS.bit_length() - 1)
    of_shard = bits // SHARDS

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            phrase = batch.column(1)
            cut = pc.split_pattern(phrase, " ")
            flat, parent = cut.flatten(), pc.list_parent_indices(cut).to_numpy(zero_copy_only=False)
            lang = _codes(batch.column(0))[parent]
            word = textcodes.mix(lang * _POWERS[7] + _codes(flat))
            first = np.searchsorted(parent, np.arange(len(batch)))
            width = np.diff(np.append(first, len(parent)))
            codes = np.zeros(len(batch), _U)
            for n in np.unique(width).tolist():
                some = np.flatnonzero(width == n)
                codes[some] = gram_codes([word[first[some] + k] for k in range(n)])
            at = np.concatenate(Filter.places(codes, _U(bits - 1))).astype(np.int64)
            shard = at // of_shard
            order = np.argsort(shard, kind="stable")
            names, starts = np.unique(shard[order], return_index=True)
            blobs = [(at[order[a:b]] % of_shard).astype(np.uint32).tobytes() for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(at)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), pa.array(blobs, pa.binary())], ["shard", "places"])

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                flags = kept.setdefault(shard, np.zeros(of_shard, bool))
                flags[np.frombuffer(blob.as_py(), np.uint32)] = True
        yield pa.RecordBatch.from_arrays([pa.array(kept.keys(), pa.int32()), pa.array([np.packbits(f, bitorder="little").tobytes() for f in kept.values()], pa.binary())], ["shard", "bits"])

    parts = grams.select("lang", "phrase").mapInArrow(places, "shard int, places binary").repartition(8, "shard").mapInArrow(set_bits, "shard int, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.collect():  # SHARDS rows
        out[r.shard * (of_shard // 8) : (r.shard + 1) * (of_shard // 8)] = np.frombuffer(r.bits, np.uint8)
    return Filter(out)


def _scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """Candidates with l, r and score of their lowest-scoring cut; parts' counts come by requests to where they lie."""
    words = F.split("phrase", " ")
    cuts = candidates.select("lang", "phrase", "a", words.alias("w"), F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k"))
    sides = F.array(F.struct(F.lit("l").alias("side"), F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("part")), F.struct(F.lit("r").alias("side"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("part")))
    asked = cuts.select("lang", "phrase", "a", "k", F.explode(sides).alias("s")).select("lang", "phrase", "a", "k", "s.side", "s.part")
    told = asked.join(counts.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")), ["lang", "part"])
    of = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f")))
    rows = told.groupBy("lang", "phrase", "a").agg(*[of(k, s).alias(f"{s}{k}") for k in range(1, LONGEST) for s in "lr"])
    cut = [
        F.when(F.col(f"l{k}").isNotNull(), F.struct(F.expr(f"cast({SCALE} * cast(a as decimal(27, 0)) div (cast(l{k} as decimal(28, 0)) + r{k}) as long)").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        for k in range(1, LONGEST)
    ]
    return rows.withColumn("cut", F.array_min(F.array_compact(F.array(*cut)))).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def _inside(candidates: DataFrame) -> DataFrame:
    """lang, phrase, most: how often the most frequent longer candidate occurs in which the phrase lies."""
    words = F.split("phrase", " ")
    rows = candidates.select("lang", "a", words.alias("w")).filter(F.size("w") > 2)
    each = [F.when(F.size("w") >= max(at + n - 1, n + 1), F.array_join(F.slice("w", at, n), " ")) for n in range(2, LONGEST) for at in range(1, LONGEST - n + 2)]
    return rows.select("lang", "a", F.explode(F.array_distinct(F.array_compact(F.array(*each)))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("most"))


def collocations(docs: DataFrame) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first REPORTED phrases.

    A null language is ``und``. Null, empty and blank texts have no pieces; repeated rows count each; texts, pieces and words of any
    length are read whole; an empty table gives no rows. Ties end with the phrase in byte order. Only lang and text are read.
    """
    pieces = materialise(pieces_of(docs), "phrases_pieces")
    words = _counted(pieces, "singles")
    pairs = _counted(pieces, "pairs", _filter(words))
    longer = _counted(pieces, "longer", _filter(pairs))
    candidates = pairs.unionByName(longer)
    kept = _scored(candidates, words.unionByName(candidates)).join(_inside(candidates), ["lang", "phrase"], "left")
    kept = kept.filter(F.col("most").isNull() | (100 * F.col("most").cast("decimal(28, 0)") < INSIDE_PERCENT * F.col("a").cast("decimal(28, 0)")))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salt = F.pmod(F.hash("phrase"), F.lit(SALTS))  # a language's order is cut to its head in parts before it meets in one task
    head = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).filter(F.col("rank") <= REPORTED)
    ranked = head.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= REPORTED)
    n = pieces.groupBy("lang").agg(F.sum(F.col("times") * F.col("words")).alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
