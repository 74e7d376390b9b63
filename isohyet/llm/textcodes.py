"""Vectorised tokens: whole batches of texts become arrays of 64-bit word codes.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D of the UTF-8 text. A word's
code is a polynomial over a random byte table, taken from prefix sums over slices of the
batch, then mixed. Two of ``n`` distinct words share a code with probability below
n^2 / 2^64.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C1B  # 3 modulo 8
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 64, 256, dtype=_U) | _U(1)
BLANKS = b" \t\n\x0b\x0c\r"
BLANK = re.compile(b"[" + BLANKS + b"]")
_SPACE = np.zeros(256, bool)
_SPACE[list(BLANKS)] = True
_MULTIPLIERS = np.random.default_rng(5).integers(1, 1 << 64, 64, dtype=_U) | _U(1)
SLICE = 1 << 17  # bytes that are worked on at a time


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on all input bits."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x ^= x >> _U(27)
    x *= _U(0x81DADEF4BC2DD44D)
    x ^= x >> _U(33)
    return x


def _powers_of(base: int) -> np.ndarray:
    out = np.full(SLICE + 1, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers_of(_BASE), _powers_of(_INVERSE)


def words(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """Codes of all words in order, words per text, the joined bytes, and where words start and end in them.

    The bytes are walked in slices; a word that crosses into the next slice carries its sum along,
    so that beside the results no memory grows with the texts.
    """
    joined = b"\n".join(texts) + b"\n"
    if lower:
        joined = joined.lower()
    raw = np.frombuffer(joined, np.uint8)
    codes, starts, ends = [], [], []
    began, partial = -1, 0  # start and sum of the word that is open
    for at in range(0, len(raw), SLICE):
        part = raw[at : at + SLICE]
        edges = np.flatnonzero(np.diff(_SPACE[part], prepend=began < 0))
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum(_BYTES[part] * _UP[: len(part)], out=sums[1:])
        if began >= 0:
            upto = int(edges[0]) if len(edges) else len(part)
            partial = (partial + pow(_BASE, at - began, 1 << 64) * int(sums[upto])) % (1 << 64)
            if not len(edges):
                continue
            codes.append(np.array([partial], _U) + _U(at + upto - began))
            starts.append(np.array([began]))
            ends.append(edges[:1] + at)
            edges, began = edges[1:], -1
        s, e = edges[0::2], edges[1::2]
        if len(s) > len(e):
            began, s = at + int(s[-1]), s[:-1]
            partial = (int(sums[-1]) - int(sums[began - at])) * int(_DOWN[began - at]) % (1 << 64)
        codes.append((sums[e] - sums[s]) * _DOWN[s] + (e - s).astype(_U))
        starts.append(s + at)
        ends.append(e + at)
    codes, starts, ends = mix(np.concatenate(codes)), np.concatenate(starts), np.concatenate(ends)
    upto = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
    return codes, np.diff(upto, prepend=0), joined, starts, ends


def last_words(text: bytes, n: int) -> list[bytes]:
    """The last ``n`` words, found from the end."""
    raw = text.rstrip(BLANKS)
    out: list[bytes] = []
    while raw and len(out) < n:
        at = max(raw.rfind(b, 0) for b in (bytes([x]) for x in BLANKS))
        out.append(raw[at + 1 :])
        raw = raw[: at + 1].rstrip(BLANKS)
    return out[::-1]


def word_codes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words in order, and the number of words of each text."""
    return words(texts, lower)[:2]


def chunks(texts: Iterable[bytes], size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Runs of texts of about ``size`` bytes together; a longer text stands alone."""
    held: list[bytes] = []
    total = 0
    for t in texts:
        held.append(t)
        total += len(t)
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order, by sorting."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def sequence_codes(codes: np.ndarray, width: int) -> np.ndarray:
    """Codes of all runs of ``width`` consecutive words; shorter by ``width - 1``."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = codes[:n] * _MULTIPLIERS[0]
    for j in range(1, width):
        out += codes[j : j + n] * _MULTIPLIERS[j]
    return mix(out + _U(width))


def encoded(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null becomes empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
