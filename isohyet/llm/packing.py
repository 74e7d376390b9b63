"""Packing of token ids into sequences of bounded length with balanced attention cost.

A document's ids (its byte-level BPE ids and one end id) are cut into full sequences; what is
left of it, less than one sequence, is packed. Remainders are dealt to partitions by a digest of
their content, sorted, and packed in windows of ``WINDOW`` at a time: a window of T tokens
gets sequences whose rooms add up to T exactly (T // capacity full ones, and the powers of two
of what is left), so that nothing has to be padded. Remainders are taken in descending order
of estimated cost and go to the sequence of lowest cost that has room; one that fits nowhere is cut
where there is most room, and its rest is put back in its place in the order.

Ids come from the public byte-level vocabulary. A chunk of texts is cut by numpy at places where
the tokenizer's own pattern cuts too; each distinct unit is encoded once and kept, by a 64-bit code,
in a bounded cache. Two of n distinct units of a task share a code with probability below n^2 / 2^64.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.llm import textcodes

CAPACITY = 1024
END_ID = 0
WINDOW = 4096  # remainders that are packed together
#: Estimated cost of a piece of n tokens: LINEAR * n + n * n, in units of one attention product. A layer of width d spends about 6 d such units on each token beside attention.
LINEAR = 6 * 1024
UNITS_KEPT = 1_000_000
SLICE = 1 << 20  # bytes of text that are cut into units at a time
SPECIAL = b"<|"  # texts that hold it are encoded by the library as a whole

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, rest binary, key long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_U = np.uint64
_POWERS = np.random.default_rng(11).integers(1, 1 << 64, 4096, dtype=_U) | _U(1)
_BYTES = np.random.default_rng(12).integers(1, 1 << 64, 256, dtype=_U)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_WIDE = np.zeros(256, bool)
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True  # lead bytes of all further white space
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?)|")] = True
_OPEN = _WHITE | _WIDE


def unit_cuts(raw: np.ndarray) -> np.ndarray:
    """True where a unit starts in UTF-8 bytes: places at which the tokenizer cuts whatever stands around.

    A space or line end between two characters that surely are no white space, and a stop behind a letter.
    """
    before, lead, third = (np.concatenate([np.full(k, 32, np.uint8), raw[:-k]])[: len(raw)] for k in (1, 2, 3))
    after = np.append(raw[1:], np.uint8(32))
    alone = ~_WHITE[before] & (lead != 0xC2) & ~_WIDE[third] & ~(_WHITE[after] | _WIDE[after])
    line = alone & (raw == 10)
    cut = alone & (raw == 32) | line | _STOP[raw] & (_LETTER[before] | (lead == 0xC3) & (before != 0x97) & (before != 0xB7))
    cut[1:] |= line[:-1]
    return cut


class Encoder:
    """Ids of texts, as 16-bit integers; units seen lately are kept as sorted codes with their ids."""

    def __init__(self, path: str, kept: int = UNITS_KEPT):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        self.quick = self._ranked(path)
        self.kept = kept
        self._forget()

    def _ranked(self, path: str):
        """The same vocabulary as ranks for tiktoken, which is some times faster."""
        import json

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        seen = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
        byte_of = {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(seen))}
        special = {t.content for t in self.library.get_added_tokens_decoder().values()}
        ranks = {bytes(byte_of[c] for c in s): i for s, i in vocabulary.items() if s not in special}
        self.width = np.zeros(self.library.get_vocab_size(), np.int64)
        for s, i in ranks.items():
            self.width[i] = len(s)
        return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _forget(self) -> None:
        self.codes, self.at, self.long = np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint16), 0

    def _learn(self, codes: np.ndarray, units: list[bytes]) -> None:
        """Encode new units and keep their ids by their codes, which are in order."""
        ids = self._of_units(units)
        n = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate(ids)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint16)])
        self.ids[self.used : self.used + len(flat)] = flat
        k = np.searchsorted(self.codes, codes)
        self.at = np.insert(self.at, k, self.used + np.cumsum(n) - n)
        self.long = np.insert(self.long, k, n)
        self.codes = np.insert(self.codes, k, codes)
        self.used += len(flat)

    def _of_units(self, units: list[bytes]) -> list[np.ndarray]:
        """Ids of each unit. Units of a space, then dark characters, stay apart when they are joined: they are encoded as one text, in which the widths of pieces tell where a unit ends."""
        out: list[np.ndarray] = []
        plain = []
        for k, u in enumerate(units):
            if len(u) > 1 and u[0] == 32 and not _OPEN[u[1]] and (u[-1] < 0x80 and not _OPEN[u[-1]] or u[-2] == 0xC3):
                plain.append(k)
                out.append(None)
            else:
                out.append(np.array(self.quick.encode_ordinary(u.decode()), np.uint16))
        if plain:
            ids = np.array(self.quick.encode_ordinary(b"".join([units[k] for k in plain]).decode()), np.int64)
            ends = np.cumsum([len(units[k]) for k in plain])
            cuts = (np.searchsorted(np.cumsum(self.width[ids]), ends) + 1).tolist()
            ids = ids.astype(np.uint16)
            for k, a, b in zip(plain, [0, *cuts], cuts):
                out[k] = ids[a:b]
        return out

    def _of_slice(self, texts: list[bytes]) -> list[np.ndarray]:
        joined = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(joined, np.uint8)
        between = np.cumsum([len(t) + 1 for t in texts]) - 1
        cut = unit_cuts(raw)
        cut[0] = cut[between] = True
        cut[between[:-1] + 1] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(raw))
        place = np.arange(len(raw)) - np.repeat(starts, ends - starts)
        codes = textcodes.mix(np.add.reduceat(_BYTES[raw] * _POWERS[place & 4095] + (place >> 12).astype(_U), starts) + (ends - starts).astype(_U))
        inside = np.ones(len(starts), bool)
        inside[np.searchsorted(starts, between)] = False
        starts, ends, codes = starts[inside], ends[inside], codes[inside]
        if not len(starts):
            return [np.zeros(0, np.uint16) for _ in texts]
        unique, first, which = np.unique(codes, return_index=True, return_inverse=True)
        k = np.minimum(np.searchsorted(self.codes, unique), max(len(self.codes) - 1, 0))
        new = self.codes[k] != unique if len(self.codes) else np.ones(len(unique), bool)
        if new.any():
            if len(self.codes) + int(new.sum()) > self.kept:
                self._forget()
                new[:] = True
            f = first[new]
            self._learn(unique[new], [joined[a:b] for a, b in zip(starts[f].tolist(), ends[f].tolist(), strict=True)])
            k = np.searchsorted(self.codes, unique)
        n, at = self.long[k][which], self.at[k][which]
        upto = np.append(0, np.cumsum(n))
        flat = self.ids[np.repeat(at - upto[:-1], n) + np.arange(int(upto[-1]))]
        per_text = upto[np.searchsorted(starts, between)]
        return [flat[a:b] for a, b in zip([0, *per_text[:-1].tolist()], per_text.tolist(), strict=True)]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text, as the tokenizers library gives them without special tokens around."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        parts: list[tuple[int, bytes]] = []
        for k, t in enumerate(texts):
            if SPECIAL in t:
                out[k].append(np.array(self.library.encode(t.decode(), add_special_tokens=False).ids, np.uint16))
            elif len(t) > SLICE:
                starts = np.append(0, np.flatnonzero(unit_cuts(np.frombuffer(t, np.uint8))))
                cuts = np.unique(np.append(starts[np.searchsorted(starts, np.arange(SLICE, len(t), SLICE), "right") - 1], [0, len(t)]))
                parts += [(k, t[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            elif t:
                parts.append((k, t))
        at = 0
        while at < len(parts):
            upto, size = at, 0
            while upto < len(parts) and (upto == at or size + len(parts[upto][1]) <= SLICE):
                size += len(parts[upto][1])
                upto += 1
            for (k, _), ids in zip(parts[at:upto], self._of_slice([p for _, p in parts[at:upto]]), strict=True):
                out[k].append(ids)
            at = upto
        return [np.concatenate(x) if len(x) > 1 else x[0] if x else np.zeros(0, np.uint16) for x in out]


def digest(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def cost(n: int) -> int:
    return LINEAR * n + n * n


def rooms(total: int, capacity: int = CAPACITY) -> list[int]:
    """Rooms of the sequences for ``total`` tokens: full ones, then the powers of two that make up the rest."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(item, start in it, length, sequence, offset) of every piece: descending items to the cheapest sequence with room.

    Items are taken by descending cost, equal ones in the order given. One that fits into no
    sequence whole is cut where there is most room (of equal rooms: the cheapest), and its rest is put back.
    Items of length 0 give no piece. All rooms are filled to the last token.
    """
    room = np.array(rooms(sum(lengths), capacity), np.int64)
    size, spent = room.copy(), np.zeros(len(room))
    todo = [(-n, k, 0) for k, n in enumerate(lengths) if n]
    heapq.heapify(todo)
    out = []
    while todo:
        n, k, at = heapq.heappop(todo)
        n = -n
        fits = room >= n
        if fits.any():
            s, take = int(np.argmin(np.where(fits, spent, np.inf))), n
        else:
            take = int(room.max())
            s = int(np.argmin(np.where(room == take, spent, np.inf)))
            heapq.heappush(todo, (take - n, k, at + take))
        out.append((k, at, take, s, int(size[s] - room[s])))
        room[s] -= take
        spent[s] += cost(take)
    return out


def tokenise(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Full pieces with their digests, and remainders with their ids, of all documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary_path)
        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), textcodes.encoded(batch.column(1))
            for at in range(0, len(texts), 256):
                rows = []
                for doc, ids in zip(ids_of[at : at + 256], encoder.encode(texts[at : at + 256]), strict=True):
                    ids = np.append(ids, np.uint16(END_ID))
                    whole = zlib.crc32(ids.tobytes(), zlib.crc32(str(doc).encode()))
                    full = len(ids) // CAPACITY * CAPACITY
                    rows += [(doc, s, CAPACITY, digest(ids[s : s + CAPACITY]), len(ids), None, whole) for s in range(0, full, CAPACITY)]
                    if full < len(ids):
                        rows.append((doc, full, len(ids) - full, None, len(ids), ids[full:].tobytes(), whole))
                kinds = [pa.int64()] * 5 + [pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "rest", "key"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(work, PIECES)


_KEPT: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    if path not in _KEPT:
        _KEPT[path] = Encoder(path)
    return _KEPT[path]


def pack_documents(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every row of ``docs`` is a document: ids of its text, then END_ID; a null or empty text has END_ID alone.
    Rows of one id or text are packed each by itself; a null id is kept. An empty table gives no rows.
    Texts of any length are encoded whole; only doc_id and text are read. Sequences are numbered by partition
    and place in it, so numbers are unique and not dense; which documents meet depends on their content alone.
    A task holds WINDOW remainders at a time, however many there are.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        held: list[tuple] = []

        def flush() -> list[tuple]:
            nonlocal number
            rows = []
            for k, at, n, s, offset in pack([r[2] for r in held]):
                doc, start, _, _, tokens, rest = held[k]
                ids = np.frombuffer(rest, np.uint16)[at : at + n]
                rows.append((doc, start + at, n, digest(ids), tokens, number + s, offset))
            number += len(rooms(sum(r[2] for r in held)))
            held.clear()
            return rows

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            names = [c.split()[0] for c in PACKED.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names)

        for batch in batches:
            rows = []
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[5] is None:
                    rows.append((*r[:5], number, 0))
                    number += 1
                else:
                    held.append(r[:6])
                    if len(held) == WINDOW:
                        rows += flush()
            yield batch_of(rows)
        yield batch_of(flush())

    pieces = tokenise(docs, vocabulary_path).repartition("key").sortWithinPartitions("key", "doc_id", "start")
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rest").mapInArrow(work, PACKED)
