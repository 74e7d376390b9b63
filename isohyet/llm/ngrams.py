"""Language-model scores from a log-frequency Bloom filter.

Words, pairs, runs of four and runs of five words are counted over all training texts. A
count is quantised to a level, and a filter holds the keys (run, 1) to (run, level): the
count comes back from membership probes with rising level until one fails. Counts up to
``EXACT`` have a level each, larger ones share eight levels an octave. The filter has no
false negatives; a false positive raises a count by a level. A run counts as unseen if a
shorter run inside it is, and never more often than its context.

With ``lo`` and ``up`` for the ends of a level, ``c(h)`` for the count of a context and
``V`` for the number of distinct words, a word ``w`` has the probability

* ``P1(w) = (lo(w) + V / (V + 1)) / (S + V)``, ``S`` being the sum of ``lo`` over all words;
  an unknown word has ``lo = 0``, and all of them together are one further word;
* ``P2(w | v) = (lo(v w) + m P1(w)) / (up(v) + m)``, ``m = PAIR_MASS * sqrt(up(v))``;
* ``P5(w | h) = (lo(h w) + RUN_MASS * P2(w | v)) / (up(h) + RUN_MASS)`` for the four words ``h`` before.

A context that was never seen hands the word to the shorter one. ``m`` depends on the
context alone and the followers' counts add up to the context's, so P2 and P5 sum to one
over all words, or to a little less where quantised counts are rounded apart; false
positives apart they never sum to more. The first word of a text follows an end.

The text is cut into chunks. Each chunk's distinct runs go to shards by their hash, with
their counts in training texts. A shard adds up counts and builds its part of the filter.
While the whole filter is sure to fit into ``MOST_BYTES``, its parts are broadcast and each
chunk probes them; beyond that each shard probes its own part for the runs that a chunk
sent, and the levels travel back. Both ways probe the same parts with the same keys.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.llm import textcodes
from isohyet.llm.common import materialise

BITS_PER_KEY = 12
PROBES = 5
MOST_BYTES = 96 << 20  # of filter that is broadcast
EXACT = 16
PAIR_MASS = 5.0
RUN_MASS = 0.5
LENGTHS = (1, 2, 4, 5)
SHARD_BYTES = 6 << 20  # of text for each shard, about
CHUNK_BYTES = 4 << 20
END = int(textcodes.word_codes([b"\x00end-of-text"])[0][0]) ^ 0x0F0F0F0F0F0F0F0F
_U = np.uint64
_FOLD = (_U(0xA24BAED4963EE407), _U(0x9FB21C651E98DF25))


def _ends_of_levels() -> tuple[np.ndarray, np.ndarray]:
    """Least and largest count of each level; level 0 stands for unseen."""
    low = np.unique(np.concatenate([np.arange(EXACT + 1.0), np.ceil(EXACT * 2 ** (np.arange(1, 8 * 44) / 8))])).astype(np.int64)
    return low.astype(float), np.append(low[1:] - 1, low[-1]).astype(float)


LOW, UP = _ends_of_levels()


def levels(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LOW, counts, side="right") - 1


def _keys(codes: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    return textcodes.mix(codes + np.asarray(level).astype(_U) * _U(0x632BE59BD9B4E019))


def _place(keys: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit word of each key and its ``PROBES`` bits in it."""
    at = ((keys >> _U(32)) * _U(words)) >> _U(32)
    bits = np.zeros(len(keys), _U)
    for k in range(PROBES):
        bits |= _U(1) << ((keys >> _U(6 * k)) & _U(63))
    return at.astype(np.int64), bits


def build(codes: np.ndarray, level: np.ndarray, bits_per_key: int = BITS_PER_KEY) -> np.ndarray:
    """A filter with the keys of every code from level 1 to its own."""
    filled = np.zeros(max(1, -(-int(level.sum()) * bits_per_key // 64)), _U)
    k, order = 0, np.argsort(-level, kind="stable")
    codes, level = codes[order], level[order]
    while n := int(np.searchsorted(-level, -k, side="left")):  # codes with a level above k
        k += 1
        at, bits = _place(_keys(codes[:n], k), len(filled))
        np.bitwise_or.at(filled, at, bits)
    return filled


def probe(filled: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Levels that the filter holds, from repeated membership probes."""
    out = np.zeros(len(codes), np.int64)
    alive = np.arange(len(codes))
    for level in range(1, len(LOW)):
        at, bits = _place(_keys(codes[alive], level), len(filled))
        alive = alive[(filled[at] & bits) == bits]
        if not len(alive):
            break
        out[alive] = level
    return out


class Runs:
    """The runs of a chunk. ``keys[k]`` names the run of ``LENGTHS[k]`` words that ends at each token: its shard and a
    fingerprint of 32 bits in it (words: their code); ``there[k]`` tells where there is one. Runs of four do not end in an end."""

    def __init__(self, texts: list[bytes], skip: np.ndarray, final: np.ndarray, shards: int):
        codes, per_text = textcodes.word_codes(texts)
        self.codes = np.insert(codes, np.cumsum(per_text)[final], _U(END))
        per_text = per_text + final
        self.owner = np.repeat(np.arange(len(texts)), per_text)
        at = np.arange(len(self.codes)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        self.counted = at >= skip[self.owner]
        is_end = np.zeros(len(self.codes), bool)
        is_end[(np.cumsum(per_text) - 1)[final]] = True
        first = at == 0
        pair = self._joined(np.where(first, _U(END), _before(self.codes)), self.codes)
        three = self._joined(_before(pair), self.codes)
        four = self._joined(_before(three), self.codes)
        five = self._joined(_before(four), self.codes)
        self.first, self.there = first, (np.ones(len(at), bool), np.ones(len(at), bool), (at >= 3) & ~is_end, at >= 4)
        low = _U(0xFFFFFFFF)
        self.keys = (self.codes, *[(_shard(x, shards).astype(_U) << _U(32)) | (x & low) for x in (pair, four, five)])

    @staticmethod
    def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return textcodes.mix(a * _FOLD[0] + b * _FOLD[1])


def _before(x: np.ndarray) -> np.ndarray:
    out = np.empty_like(x)
    out[1:], out[:1] = x[:-1], 0
    return out


def _shard(codes: np.ndarray, shards: int) -> np.ndarray:
    return (((codes >> _U(32)) * _U(shards)) >> _U(32)).astype(np.int64)


def _shard_of_keys(kind: int, keys: np.ndarray, shards: int) -> np.ndarray:
    return _shard(keys, shards) if kind == 0 else (keys >> _U(32)).astype(np.int64)


def _named(kind: int, keys: np.ndarray) -> np.ndarray:
    """What the filter knows a run by."""
    return textcodes.mix(keys + _U(LENGTHS[kind]))


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys of one shard: the first one whole, then steps in as few bytes each as the widest one needs."""
    steps = np.diff(keys)
    width = max(1, -(-int(steps.max(initial=0)).bit_length() // 8))
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpacked(body: bytes) -> np.ndarray:
    parts = np.frombuffer(body, np.uint8)[9:].reshape(-1, body[0])
    steps = np.zeros((len(parts) + 1, 8), np.uint8)
    steps[1:, : body[0]] = parts
    steps[0] = np.frombuffer(body[1:9], np.uint8)
    return np.cumsum(steps.view("<u8").ravel().astype(_U))


def squeezed(numbers: np.ndarray) -> bytes:
    """Small numbers, a byte each, and the others, compressed."""
    large = numbers[numbers >= 255].astype("<u8").tobytes()
    body = large + np.minimum(numbers, 255).astype(np.uint8).tobytes()
    return struct.pack("<II", len(large), len(body)) + pa.compress(body, codec="zstd", asbytes=True)


def expanded(body: bytes) -> np.ndarray:
    large, size = struct.unpack_from("<II", body)
    whole = pa.decompress(body[8:], decompressed_size=size, codec="zstd", asbytes=True)
    out = np.frombuffer(whole, np.uint8)[large:].astype(np.int64)
    out[out == 255] = np.frombuffer(whole[:large], "<u8").astype(np.int64)
    return out


CHUNK = "chunk long, raw long, tokens long, rows array<long>, ids array<long>, held array<boolean>, final array<boolean>, skip array<int>, sizes array<int>, body binary"


def pieces(text: bytes, size: int) -> Iterator[tuple[bytes, int, bool]]:
    """A long text in pieces cut at blanks, each after the last four words before it, their number, and whether it is the last."""
    at, before = 0, b""
    while True:
        blank = textcodes.BLANK.search(text, at + size)
        cut = blank.start() if blank else len(text)
        piece = text[at:cut]
        yield before + b" " + piece if before else piece, len(before.split(b" ")) if before else 0, cut >= len(text)
        if cut >= len(text):
            return
        last = textcodes.last_words(before + b" " + piece, 4)
        at, before = cut, b" ".join(last)


def _chunked(docs: DataFrame, held_out: F.Column, size: int) -> DataFrame:
    """The texts in compressed chunks of about ``size`` bytes, each of whole texts or pieces of one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, chunk, row, held, total = TaskContext.get().partitionId(), 0, 0, [], 0

        def told() -> pa.RecordBatch:
            rows, ids, out, final, skip, texts = (list(x) for x in zip(*held, strict=True))
            body = b"".join(texts)
            tokens = sum(len(t) // 2 + 2 for t in texts)  # at most
            values = ((part << 33) + chunk, len(body), tokens, rows, ids, out, final, skip, [len(t) for t in texts], pa.compress(body, codec="zstd", asbytes=True))
            kinds = (*[pa.int64()] * 3, pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in CHUNK.split(", ")])

        for batch in batches:
            for doc_id, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), textcodes.encoded(batch.column(2)), strict=True):
                for piece, skip, final in pieces(text, size):
                    held.append(((part << 40) + row, doc_id, out, final, skip, piece))
                    total += len(piece)
                    if total >= size:
                        yield told()
                        held, total, chunk = [], 0, chunk + 1
                row += 1
        if held:
            yield told()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(work, CHUNK)


def _texts_of(sizes: list[int], body: bytes) -> list[bytes]:
    whole = pa.decompress(body, decompressed_size=sum(sizes), codec="zstd", asbytes=True)
    ends = np.cumsum(sizes).tolist()
    return [whole[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _sent(chunks: DataFrame, shards: int) -> DataFrame:
    """shard, chunk, kind, packed keys and squeezed training counts of each chunk's distinct runs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                chunk, held, final, skip, sizes, body = (batch.column(c)[k].as_py() for c in range(6))
                runs = Runs(_texts_of(sizes, body), np.array(skip), np.array(final), shards)
                train = runs.counted & ~np.array(held)[runs.owner]
                for kind, (keys, there) in enumerate(zip(runs.keys, runs.there, strict=True)):
                    unique = textcodes.distinct(keys[there])
                    known, n = np.unique(keys[there & train], return_counts=True)
                    counts = np.zeros(len(unique), np.int64)
                    counts[np.searchsorted(unique, known)] = n
                    shard = _shard_of_keys(kind, unique, shards)
                    cuts = np.flatnonzero(np.diff(shard, prepend=-1))
                    spans = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(unique)], strict=True)) if len(unique) else []
                    columns = ([int(shard[a]) for a, _ in spans], [chunk] * len(spans), [kind] * len(spans), [packed(unique[a:b]) for a, b in spans], [squeezed(counts[a:b]) for a, b in spans])
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["shard", "chunk", "kind", "keys", "counts"])

    return chunks.select("chunk", "held", "final", "skip", "sizes", "body").mapInArrow(work, "shard long, chunk long, kind int, keys binary, counts binary")


ANSWER = pa.schema([("chunk", pa.int64()), ("shard", pa.int64()), ("kind", pa.int32()), ("levels", pa.binary()), ("counts", pa.binary()), ("tokens", pa.int64()), ("distinct", pa.int64()), ("low", pa.int64()), ("filter", pa.binary())])


def _answered(sent: DataFrame, broadcast: bool, bits_per_key: int) -> DataFrame:
    """For each shard a row with its sums, and its filter if that is to be broadcast; and the answers to each chunk:
    exact counts of words, and levels of all runs unless the chunk can probe the filter by itself."""

    def work(key: tuple, table: pa.Table) -> pa.Table:
        shard, rows = key[0].as_py(), []
        kinds, chunks = np.array(table["kind"].to_pylist()), table["chunk"].to_pylist()
        blobs, numbers = table["keys"], table["counts"]
        found = []
        for kind in range(len(LENGTHS)):
            mine = np.flatnonzero(kinds == kind).tolist()
            keys = [unpacked(blobs[i].as_py()) for i in mine]
            unique, place = np.unique(np.concatenate([np.zeros(0, _U), *keys]), return_inverse=True)
            total = np.bincount(place, weights=np.concatenate([np.zeros(0, np.int64), *(expanded(numbers[i].as_py()) for i in mine)]), minlength=len(unique)).astype(np.int64)
            found.append((mine, [len(x) for x in keys], _named(kind, unique), place, total))
        level = [levels(total) for *_, total in found]
        filled = build(np.concatenate([f[2] for f in found]), np.concatenate(level), bits_per_key)
        words = found[0][4]
        rows.append((None, shard, 0, None, None, int(words.sum()), int((words > 0).sum()), int(LOW[level[0]].sum()), filled.tobytes() if broadcast else None))
        for kind, (mine, sizes, named, place, total) in enumerate(found):
            if broadcast and kind:
                break
            told = probe(filled, named)[place] if not broadcast else None
            exact = total[place] if kind == 0 else None
            ends = np.cumsum(sizes).tolist()
            for i, a, b in zip(mine, [0, *ends], ends):  # noqa: B905
                rows.append((chunks[i], shard, kind, None if told is None else squeezed(told[a:b]), None if exact is None else squeezed(exact[a:b]), None, None, None, None))
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(ANSWER)], schema=ANSWER)

    return sent.groupBy("shard").applyInArrow(work, "chunk long, shard long, kind int, levels binary, counts binary, tokens long, distinct long, low long, filter binary")


def smoothed(level: list[np.ndarray], context: list[np.ndarray], distinct: int, low: float) -> np.ndarray:
    """Probabilities of tokens, from the levels of their runs and of those runs' contexts.

    ``level`` holds those of words, pairs and runs of five, ``context`` those of the word and of the run of four before.
    """
    p = (np.minimum(LOW[level[0]], low) + distinct / (distinct + 1)) / (low + distinct) if distinct else np.ones(len(level[0]))
    for run, before, mass in ((level[1], context[0], lambda c: PAIR_MASS * np.sqrt(c)), (level[2], context[1], lambda c: RUN_MASS)):
        c = UP[before]
        m = np.where(before > 0, mass(c), 1.0)
        p = np.where(before > 0, (np.minimum(LOW[run], c) + m * p) / (c + m), p)
    return p


def consistent(runs: Runs, level: list[np.ndarray], end_level: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Levels of words, pairs and runs of five, and of contexts; runs that hold an unseen part are unseen."""
    one, two, four, five = level
    before = np.where(runs.first, end_level, _before(one))
    two = np.where((one > 0) & (before > 0), np.minimum(two, before), 0)
    seen = two > 0
    four = np.where(runs.there[2] & seen & _before(seen) & _before(_before(seen)), np.minimum(four, two), 0)
    context = np.where(runs.there[3], _before(four), 0)
    return [one, two, np.where(seen & (context > 0), np.minimum(five, context), 0)], [before, context]


SCORED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score_texts(docs: DataFrame, held_out: F.Column, most_bytes: int = MOST_BYTES, chunk_bytes: int = CHUNK_BYTES, shard_bytes: int = SHARD_BYTES, bits_per_key: int = BITS_PER_KEY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs``.

    The model and the counts of the base score are learned from the rows that ``held_out``
    leaves; a null there leaves a row. A null text counts as empty: one end token. Words are lower-cased (A-Z). Null
    ids and repeated rows are kept, each row by itself; without training rows all counts
    are 0 and every score is that of one unknown word, 0. Long texts are worked on in pieces that know the four
    words before them. An empty table gives no rows; only doc_id, text and what ``held_out`` names are read.
    """
    chunks = materialise(_chunked(docs, held_out, chunk_bytes), "ngrams-chunks")
    raw, tokens = chunks.agg(F.sum("raw"), F.sum("tokens")).first()
    shards = max(4, -(-(raw or 0) // shard_bytes))
    # No run has more keys than occurrences, so this bounds the filter whatever the texts are.
    broadcast = (tokens or 0) * len(LENGTHS) * bits_per_key // 8 <= most_bytes
    answers = materialise(_answered(_sent(chunks, shards), broadcast, bits_per_key), "ngrams-answers")
    sums = answers.filter("chunk is null")
    n, v, low = (x or 0 for x in sums.agg(F.sum("tokens"), F.sum("distinct"), F.sum("low")).first())
    filters = {r.shard: bytes(r["filter"]) for r in sums.select("shard", "filter").collect()} if broadcast else {}  # most_bytes at most
    sent = docs.sparkSession.sparkContext.broadcast(filters)
    n_texts = chunks.select(F.explode(F.arrays_zip("held", "final")).alias("x")).filter("x.final and not x.held").count()
    end_level = int(levels(np.array([n_texts]))[0])

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        held = {s: np.frombuffer(b, _U) for s, b in sent.value.items()}
        parts = [told(left.slice(k, 1), right, held) for k in range(len(left))]
        return pa.concat_tables([SCORED.empty_table(), *parts])

    def told(left: pa.Table, right: pa.Table, held: dict[int, np.ndarray]) -> pa.Table:
        rows, ids, out, final, skip, sizes, body = (left[c][0].as_py() for c in ("rows", "ids", "held", "final", "skip", "sizes", "body"))
        runs = Runs(_texts_of(sizes, body), np.array(skip), np.array(final), shards)
        blobs: list[list[tuple[int, int]]] = [[] for _ in LENGTHS]
        for i, (kind, shard) in enumerate(zip(right["kind"].to_pylist(), right["shard"].to_pylist(), strict=True)):
            blobs[kind].append((shard, i))
        level, count = [], None
        for kind, (keys, there) in enumerate(zip(runs.keys, runs.there, strict=True)):
            unique, place = np.unique(keys[there], return_inverse=True)
            order = [i for _, i in sorted(blobs[kind])]
            if broadcast:
                shard, named, known = _shard_of_keys(kind, unique, shards), _named(kind, unique), np.zeros(len(unique), np.int64)
                cuts = np.searchsorted(shard, np.arange(shards + 1))
                for s in np.flatnonzero(np.diff(cuts)).tolist():
                    known[cuts[s] : cuts[s + 1]] = probe(held[s], named[cuts[s] : cuts[s + 1]])
            else:
                known = np.concatenate([np.zeros(0, np.int64), *(expanded(right["levels"][i].as_py()) for i in order)])
            full = np.zeros(len(keys), np.int64)
            full[there] = known[place]
            level.append(full)
            if kind == 0:
                count = np.concatenate([np.zeros(0, np.int64), *(expanded(right["counts"][i].as_py()) for i in order)])[place]
        level, context = consistent(runs, level, end_level)
        score = np.log10(smoothed(level, context, v, low))
        base = np.log10((count + 1) / (n + v + 1))
        mine, k = runs.owner[runs.counted], len(rows)
        total = [np.bincount(mine, weights=x[runs.counted], minlength=k) for x in (np.ones(len(score)), count > 0, base, score)]
        columns = (rows, ids, out, total[0].astype(np.int64), total[1].astype(np.int64), total[2], total[3])
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCORED, strict=True)], schema=SCORED)

    asked = chunks.select("chunk", "rows", "ids", "held", "final", "skip", "sizes", "body")
    given = answers.filter("chunk is not null").select("chunk", "shard", "kind", "levels", "counts")
    scored = asked.groupBy("chunk").cogroup(given.groupBy("chunk")).applyInArrow(work, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    whole = scored.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
