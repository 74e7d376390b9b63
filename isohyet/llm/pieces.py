"""SentencePiece encoding and decoding for merge-type vocabularies.

A text becomes one string of symbols (a space is written U+2581, one is put in front),
and an agenda of adjacent symbol pairs, ordered by the score of the piece they would
form and then by position, is worked off until no pair forms a piece. Symbols without a
piece become byte pieces.

No piece has U+2581 behind another symbol, so pairs never merge across such a border:
a text is cut there into units whose agendas are independent. Units of one length are
worked off side by side: a matrix holds their symbols, another the agenda (rank and
position of each adjacent pair), and each round takes every unit's first pair. Ids of
units seen lately are kept in a bounded cache.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
SHORT = 48
NONE = 1 << 30
UNITS_KEPT = 300_000
TEXTS_AT_ONCE = 512


class Codec:
    """Encoder and decoder over the pieces of one model."""

    def __init__(self, model: bytes, kept: int = UNITS_KEPT):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = lib.get_piece_size()
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        names = {i: lib.id_to_piece(i) for i in plain}
        self.ids = {s: i for i, s in names.items()}
        if any(SPACE in s.lstrip(SPACE) for s in self.ids):
            raise ValueError("a piece holds a space behind another symbol: texts cannot be cut into units")
        order = sorted(plain, key=lambda i: -lib.get_score(i))
        self.rank, last, place = {}, None, -1
        for i in order:  # pieces of equal score rank alike; the leftmost pair then goes first
            if len(names[i]) > 1:
                place += (score := lib.get_score(i)) != last
                last = score
                self.rank[names[i]] = place
        byte_of = {lib.id_to_piece(i): i for i in range(n) if lib.is_byte(i)}
        self.byte = [byte_of[f"<0x{b:02X}>"] for b in range(256)]
        self.bos, self.eos = lib.bos_id(), lib.eos_id()
        self.text_of: list[bytes] = [b""] * n
        for i, s in names.items():
            self.text_of[i] = s.replace(SPACE, " ").encode()
        self.raw_of = {i: b for b, i in enumerate(self.byte)}
        lone = "" if any("\n" in s for s in self.rank) else "\n"
        self.unit = re.compile(f"{SPACE}*[^{SPACE}{lone}]+|{SPACE}+|\n")
        self.kept, self.cache = kept, {}
        self._number_symbols()

    def _number_symbols(self) -> None:
        """Numbers for pieces and their characters, and what each mergeable pair becomes."""
        number = {s: k for k, s in enumerate(self.ids)}
        for c in sorted(set("".join(self.ids))):
            number.setdefault(c, len(number))
        self.size = len(number) + 1
        self.of_char = np.full(0x110000, self.size - 1, np.int32)  # the last number: in no piece
        for s, k in number.items():
            if len(s) == 1:
                self.of_char[ord(s)] = k
        self.id_of = np.full(self.size, -1, np.int64)
        for s, i in self.ids.items():
            self.id_of[number[s]] = i
        pairs = sorted((number[s[:k]] * self.size + number[s[k:]], r, number[s]) for s, r in self.rank.items() for k in range(1, len(s)) if s[:k] in number and s[k:] in number)
        self.pairs = np.array([p for p, _, _ in pairs] + [1 << 62], np.int64)
        self.pair_rank = np.array([r for _, r, _ in pairs] + [NONE // SHORT], np.int32)
        self.made = np.array([m for _, _, m in pairs], np.int32)

    def _agenda(self, left: np.ndarray, right: np.ndarray, at) -> np.ndarray:
        """Rank and position of pairs, in one number; NONE where the pair forms no piece."""
        key = left.astype(np.int64) * self.size + right
        k = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[k] == key, self.pair_rank[k] * np.int32(SHORT) + at, np.int32(NONE))

    def learn(self, units: list[str]) -> None:
        """Put the ids of units into the cache."""
        by_length: dict[int, list[str]] = {}
        for u in units:
            by_length.setdefault(len(u), []).append(u)
        for n, same in by_length.items():
            if n > SHORT:
                for u in same:
                    self.cache[u] = self._bytes_of(self.merged_long(u))
                continue
            symbols = self.of_char[np.frombuffer("".join(same).encode("utf-32-le"), np.uint32)].reshape(-1, n).T.copy()
            agenda = self._agenda(symbols[:-1], symbols[1:], np.arange(n - 1, dtype=np.int32)[:, None])
            rows = np.arange(len(same))
            while True:
                first = agenda.min(axis=0) if len(agenda) else np.full(len(rows), NONE, np.int32)
                done = first == NONE
                if done.any():
                    self._keep(same, rows[done], symbols[:, done])
                    go = ~done
                    rows, symbols, agenda, first = rows[go], symbols[:, go], agenda[:, go], first[go]
                if not len(rows):
                    break
                at, each = first % np.int32(SHORT), np.arange(len(rows))
                key = symbols[at, each].astype(np.int64) * self.size + symbols[at + 1, each]
                symbols[at, each] = self.made[np.searchsorted(self.pairs, key)]
                width = len(symbols) - 1
                step = np.arange(width, dtype=np.int32)[:, None]
                symbols = np.take_along_axis(symbols, step + (step > at), axis=0)
                step = step[:-1]
                moved = step >= at  # pairs behind the merged one move up by one place
                agenda = np.take_along_axis(agenda, step + moved, axis=0)
                agenda -= moved & (agenda != NONE)
                for left in (at - 1, at):
                    some = (left >= 0) & (left < width - 1)
                    p, e = left[some], each[some]
                    agenda[p, e] = self._agenda(symbols[p, e], symbols[p + 1, e], p)

    def _keep(self, units: list[str], rows: np.ndarray, symbols: np.ndarray) -> None:
        ids = self.id_of[symbols]
        plain = (ids >= 0).all(axis=0)
        packed, width = ids.T.astype("<u4").tobytes(), 4 * len(symbols)
        for k, (row, fine) in enumerate(zip(rows.tolist(), plain.tolist(), strict=True)):
            self.cache[units[row]] = packed[k * width : (k + 1) * width] if fine else self._bytes_of(self.merged_long(units[row]))

    def merged_long(self, unit: str) -> list[str]:
        """The symbols left when the agenda, here a heap, is empty; for units of any length."""
        symbols = list(unit)
        rank, n = self.rank, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, symbols[i] + symbols[i + 1]) for i in range(n - 1) if (r := rank.get(symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, piece = heapq.heappop(heap)
            j = after[i]
            if not symbols[i] or j >= n or symbols[i] + symbols[j] != piece:
                continue
            symbols[i], symbols[j] = piece, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(piece + symbols[k])) is not None:
                    heapq.heappush(heap, (r, i, piece + symbols[k]))
            if (h := before[i]) >= 0 and (r := rank.get(symbols[h] + piece)) is not None:
                heapq.heappush(heap, (r, h, symbols[h] + piece))
        return [s for s in symbols if s]

    def _bytes_of(self, symbols: list[str]) -> bytes:
        """Ids as 32-bit integers; a symbol without a piece becomes its bytes."""
        out = array("I")
        for s in symbols:
            i = self.ids.get(s)
            if i is None:
                out.extend(self.byte[b] for b in s.encode())
            else:
                out.append(i)
        return out.tobytes()

    def encode(self, texts: list[str]) -> list[array]:
        cut = [self.unit.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.cache) > self.kept:
            self.cache.clear()
        self.learn([u for u in set().union(*cut) if u not in self.cache])
        out = []
        for units in cut:
            ids = array("I", [self.bos])
            ids.frombytes(b"".join(map(self.cache.__getitem__, units)))
            ids.append(self.eos)
            out.append(ids)
        return out

    def decode(self, ids: array) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD each, one leading space goes."""
        table = self.text_of
        lead = next((table[i] for i in ids if i in self.raw_of or table[i]), b"")
        low, high = self.byte[0], self.byte[-1]
        if high - low == 255 and not any(low <= i <= high for i in ids):
            whole = b"".join([table[i] for i in ids]).decode()
        else:
            parts: list[str] = []
            run, raw = bytearray(), False
            for i in ids:
                b = self.raw_of.get(i)
                if (b is not None) != raw:
                    parts.append(_lenient(run) if raw else run.decode())
                    run, raw = bytearray(), not raw
                if b is None:
                    run += table[i]
                else:
                    run.append(b)
            parts.append(_lenient(run) if raw else run.decode())
            whole = "".join(parts)
        return whole[1:] if lead[:1] == b" " else whole


def _lenient(raw: bytearray) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(raw):
        lead = raw[at]
        width = 1 if lead < 0x80 else 2 if 0xC0 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF8 else 1
        try:
            out.append(raw[at : at + width].decode())
            at += width
        except UnicodeDecodeError:
            out.append("�")
            at += 1
    return "".join(out)


ENCODED = T.StructType([
    T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("decoded", T.StringType()),
])
DIGEST = T.StructType([
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
])


def _codec_udf(spark, model_path: str, digest: bool, check_one_in: int):
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())  # one vocabulary file, fixed size

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(model.value)
        for batch in batches:
            rows = []
            for start in range(0, len(batch), TEXTS_AT_ONCE):
                texts = [t or "" for t in batch.slice(start, TEXTS_AT_ONCE).to_pylist()]
                for text, ids in zip(texts, codec.encode(texts), strict=True):
                    decoded = codec.decode(ids)
                    if check_one_in and zlib.crc32(text.encode()) % check_one_in == 0:
                        told = codec.library.encode(text, add_bos=True, add_eos=True)
                        if told != ids.tolist() or codec.library.decode(told) != decoded:
                            raise ValueError(f"the library encodes this text otherwise: {text[:200]!r}")
                    if digest:
                        rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
                    else:
                        rows.append((ids.tolist(), decoded))
            kinds = (pa.int64(), pa.string(), pa.string()) if digest else (pa.list_(pa.int32()), pa.string())
            names = (DIGEST if digest else ENCODED).names
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.StructArray.from_arrays(columns, names)

    work.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(work, DIGEST if digest else ENCODED)


def encode_documents(docs: DataFrame, model_path: str, digest: bool = False, check_one_in: int = 16) -> DataFrame:
    """One row per row of ``docs``: doc_id, and ids with the decoded text, or their digests.

    Ids carry the begin and end ids. A null or empty text gives just those two and decodes
    to the empty text. Rows with equal ids or texts are encoded each by itself; a null
    doc_id is kept. Texts of any length are encoded whole; only ``doc_id`` and ``text`` are
    read, so further columns of any name do no harm. In each Arrow batch, texts whose
    crc32 is divisible by ``check_one_in`` are also encoded and decoded by the
    sentencepiece library; a difference fails the job (0: no check).
    """
    udf = _codec_udf(docs.sparkSession, model_path, digest, check_one_in)
    out = docs.select("doc_id", udf(F.col("text")).alias("coded"))
    return out.select("doc_id", *[F.col(f"coded.{n}").alias(n) for n in (DIGEST if digest else ENCODED).names])
