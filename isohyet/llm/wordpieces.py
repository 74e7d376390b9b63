"""Counts of greedy word pieces from a linear longest-match automaton; no piece is built.

The trie of the vocabulary gets a failure link for every node ``v``: the node to go on
from when ``v`` has no child for the next byte, and the number of pieces that the step
pops. Reading a word costs time linear in its length, and its piece count is the sum of
popped counts. All new words of a chunk step through the automaton side by side.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from isohyet.llm import textcodes

WORDS_KEPT = 1_000_000
SCHEMA = "doc_id long, n_words long, n_tokens long, n_unknown long"


def vocabulary(path: str, word_end: str = "</w>") -> list[bytes]:
    """Pieces as bytes, from a byte-level vocabulary file; the mark of word ends is taken off."""
    with open(path, encoding="utf-8") as f:
        names = json.load(f)["model"]["vocab"]
    seen = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    byte_of = {chr(b): b for b in seen}
    byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(seen))}
    out = set()
    for name in names:
        name = name.removesuffix(word_end)
        if name and all(c in byte_of for c in name):
            out.add(bytes(byte_of[c] for c in name))
    return sorted(out)


class Automaton:
    """State 0 is the root; ``fail`` is -1 where no piece can be popped."""

    def __init__(self, pieces: list[bytes]):
        children: list[dict[int, int]] = [{}]
        whole = [False]
        for p in pieces:
            at = 0
            for b in p:
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    whole.append(False)
                at = children[at][b]
            whole[at] = True
        fail, pops = [-1] * len(children), [0] * len(children)
        queue = [0]
        for at in queue:
            for b, v in children[at].items():
                queue.append(v)
                if whole[v]:
                    fail[v], pops[v] = 0, 1
                    continue
                z, popped = fail[at], pops[at]
                while z != -1 and b not in children[z]:
                    popped += pops[z]
                    z = fail[z]
                if z != -1:
                    fail[v], pops[v] = children[z][b], popped
        self.fail, self.pops = np.array(fail, np.int64), np.array(pops, np.int64)
        keys = sorted((s * 256 + b, t) for s, c in enumerate(children) for b, t in c.items())
        self.keys = np.array([k for k, _ in keys] + [1 << 62], np.int64)
        self.to = np.array([t for _, t in keys] + [-1], np.int64)

    def counts(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of each word ``raw[start:end]``; -1 where greedy matching gets stuck."""
        order = np.argsort(starts - ends, kind="stable")
        starts, lengths = starts[order], (ends - starts)[order]
        state, total = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        alive = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(order) else 0), side="left")
        for t, n in enumerate(alive.tolist()):
            todo = np.flatnonzero(state[:n] >= 0)
            byte = raw[starts[todo] + t].astype(np.int64)
            while len(todo):
                s = state[todo]
                key = s * 256 + byte
                k = np.searchsorted(self.keys, key)
                hit = self.keys[k] == key
                state[todo[hit]] = self.to[k[hit]]
                todo, byte, s = todo[~hit], byte[~hit], s[~hit]
                total[todo] += self.pops[s]
                state[todo] = self.fail[s]
                on = self.fail[s] >= 0
                todo, byte = todo[on], byte[on]
        todo = np.flatnonzero(state > 0)
        while len(todo):
            s = state[todo]
            total[todo] += self.pops[s]
            state[todo] = self.fail[s]
            todo = todo[self.fail[s] > 0]
        out = np.empty(len(order), np.int64)
        out[order] = np.where(state < 0, -1, total)
        return out


class Counter:
    """Counts by word code; the words of the vocabulary seen lately are kept, up to a bound."""

    def __init__(self, automaton: Automaton, kept: int = WORDS_KEPT):
        self.automaton, self.kept = automaton, kept
        self.codes, self.known = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def of_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes, per_text, joined, starts, ends = textcodes.words(texts)
        unique, first, place = np.unique(codes, return_index=True, return_inverse=True)
        if len(self.codes) > self.kept:
            self.codes, self.known = self.codes[:0], self.known[:0]
        k = np.searchsorted(self.codes, unique)
        have = np.zeros(len(unique), bool)
        inside = k < len(self.codes)
        have[inside] = self.codes[k[inside]] == unique[inside]
        counts = np.empty(len(unique), np.int64)
        counts[have] = self.known[k[have]]
        new = first[~have]
        counts[~have] = self.automaton.counts(np.frombuffer(joined, np.uint8), starts[new], ends[new])
        self.codes, self.known = np.insert(self.codes, k[~have], unique[~have]), np.insert(self.known, k[~have], counts[~have])
        each = counts[place]
        bounds = np.concatenate([[0], np.cumsum(per_text)])
        unknown = np.concatenate([[0], np.cumsum(each < 0)])
        pieces = np.concatenate([[0], np.cumsum(np.abs(each))])
        return per_text, np.diff(pieces[bounds]), np.diff(unknown[bounds])


def count_tokens(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown: one row per row of ``docs``.

    Words are runs of bytes outside 0x20 and 0x09-0x0D with A-Z lower-cased; each is cut
    greedily into the longest pieces of the vocabulary. A word with a byte that no piece
    covers counts as one unknown token. Null, empty and blank texts have 0 words and
    tokens; null ids and repeated rows are kept; texts of any length are read whole; an
    empty table gives no rows. Only doc_id and text are read.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(vocabulary(vocabulary_path))  # one vocabulary file, fixed size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or Counter(Automaton(pieces.value))
            parts = [counter.of_texts(c) for c in textcodes.chunks(textcodes.encoded(batch.column(1)))]
            columns = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(work, SCHEMA)
