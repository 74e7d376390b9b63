"""Quality by nearest-neighbour voting among labelled documents in a latent-semantic space.

The terms of a text are its words, hashed to ``TERMS`` numbers, and signs of its form: how
often classes of bytes follow one another (letters by case, digits, blanks, every ASCII
sign), and how much its words repeat. Terms are weighted by how rare they are among the
labelled documents; the labelled term-document matrix is projected on its leading
singular directions. The labelled vectors are broadcast; every document is compared with
all of them by exact blocked cosine products, and its nearest ones vote with weights that
grow with similarity.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.llm import textcodes
from isohyet.llm.common import free_name, remainder

SAMPLE = 4096  # labelled documents at most, about; the only rows that a model is fitted on
TERMS = 1 << 16
DIMENSIONS = 64
WORDS, FORM = 1.0, 1.0  # length of the words' part of a row of the matrix, and factor of the part for its form
ROUNDS = 4  # of the iteration that finds the singular directions
NEIGHBOURS = 15
POWER = 8
BLOCK = 2048
AT_ONCE = 1 << 14  # entries of the sparse matrix that are multiplied at a time
SLICE = 1 << 20  # bytes whose form is counted at a time

_CLASS = np.zeros(256, np.int64)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 0 if _b >= 0x80 or _c.islower() else 1 if _c.isupper() else 2 if _c.isdigit() else 3 if _c == " " else 4 if _c in "\n\r" else 5 if _b < 0x21 or _b == 0x7F else 0
_SIGNS = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
_CLASS[_SIGNS] = 6 + np.arange(len(_SIGNS))
_CLASSES = 6 + len(_SIGNS)
_EXTRA = 4
WIDTH = _CLASSES * _CLASSES + _EXTRA


def _pairs(texts: list[bytes]) -> np.ndarray:
    """How often classes of bytes follow one another in each text; the text's end counts as a line end."""
    n, kinds = len(texts), _CLASSES * _CLASSES
    if sum(map(len, texts)) <= SLICE:
        classes = _CLASS[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        owner = np.repeat(np.arange(n), [len(t) + 1 for t in texts])
        return np.bincount(owner[:-1] * kinds + classes[:-1] * _CLASSES + classes[1:], minlength=n * kinds).reshape(n, -1)
    out = np.zeros((n, kinds), np.int64)
    for k, t in enumerate(texts):
        for at in range(0, len(t), SLICE):
            classes = _CLASS[np.frombuffer(t[at : at + SLICE + 1] + b"\n", np.uint8)]
            out[k] += np.bincount(classes[:-1] * _CLASSES + classes[1:], minlength=kinds) - (np.arange(kinds) == classes[-2] * _CLASSES + classes[-1]) * (at + SLICE < len(t))
    return out


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each text a row of form (square roots of class-pair frequencies, then four measures of repetition);
    and for all texts the owner, term and number of occurrences of each distinct term."""
    codes, per_text, _, starts, ends = textcodes.words(texts)
    out = np.zeros((len(texts), WIDTH), np.float32)
    out[:, :-_EXTRA] = np.sqrt(_pairs(texts) / np.maximum([len(t) for t in texts], 1)[:, None])
    who = np.repeat(np.arange(len(texts)), per_text)
    n = np.maximum(per_text, 1)
    order = np.lexsort((codes, who))
    new = np.append(True, (codes[order][1:] != codes[order][:-1]) | (who[1:] != who[:-1]))[: len(who)]
    same = (codes[1:] == codes[:-1]) & (who[1:] == who[:-1])
    out[:, -4] = 1 - np.bincount(who[new], minlength=len(texts)) / n
    out[:, -3] = np.bincount(who[1:][same], minlength=len(texts)) / n
    out[:, -2] = np.bincount(who, weights=ends - starts, minlength=len(texts)) / n / 20
    out[:, -1] = np.minimum(1, np.log1p(per_text) / 10)
    pairs, counts = np.unique(who * TERMS + (codes % np.uint64(TERMS)).astype(np.int64), return_counts=True)
    return out, pairs // TERMS, pairs % TERMS, counts


def _rows(owner: np.ndarray, term: np.ndarray, value: np.ndarray, n: int, table: np.ndarray) -> np.ndarray:
    """The sparse matrix (owner, term, value) times ``table``; owners are in order."""
    out = np.zeros((n, table.shape[1]), np.float32)
    for at in range(0, len(owner), AT_ONCE):
        o = owner[at : at + AT_ONCE]
        first = np.flatnonzero(np.diff(o, prepend=-1))
        out[o[first]] += np.add.reduceat(table[term[at : at + AT_ONCE]] * value[at : at + AT_ONCE, None], first, axis=0)
    return out


class Model:
    """Projection and labelled vectors; ``scores`` needs nothing but texts."""

    def __init__(self, form: np.ndarray, owner: np.ndarray, term: np.ndarray, counts: np.ndarray, labels: np.ndarray):
        n = len(form)
        keep = (form[:, :-_EXTRA] > 0).mean(axis=0) if n else np.zeros(WIDTH - _EXTRA)
        self.form_weight = FORM * np.concatenate([np.where(keep > 0, np.log(1 + 1 / np.maximum(keep, 1e-9)), 0), np.ones(_EXTRA)]).astype(np.float32)
        held = np.bincount(term, minlength=TERMS)
        self.weight = np.where(held > 0, np.log((n + 1) / np.maximum(held, 1)), 0).astype(np.float32)
        self.labels = labels.astype(np.float64)
        form = form * self.form_weight
        self.centre = form.mean(axis=0) if n else np.zeros(WIDTH, np.float32)
        form -= self.centre
        self.words_basis, self.form_basis = np.zeros((TERMS, 1), np.float32), np.zeros((WIDTH, 1), np.float32)
        value = self._values(owner, term, counts, n)
        if n:
            self._decompose(form, owner, term, value)
        self.known = self._placed(form, owner, term, value)

    def _values(self, owner: np.ndarray, term: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
        """Weighted terms, each text's part scaled to the length ``WORDS``."""
        value = (1 + np.log(counts)) * self.weight[term]
        return (value * (WORDS / np.maximum(np.sqrt(np.bincount(owner, weights=value * value, minlength=n)), 1e-9))[owner]).astype(np.float32)

    def _decompose(self, form: np.ndarray, owner: np.ndarray, term: np.ndarray, value: np.ndarray) -> None:
        """Leading right singular directions of the matrix (words, form), by subspace iteration."""
        order = np.argsort(term, kind="stable")
        start = np.random.default_rng(17).normal(size=(len(form), min(DIMENSIONS + 16, len(form)))).astype(np.float32)
        left = np.linalg.qr(start)[0]
        for _ in range(ROUNDS):
            words, shape = _rows(term[order], owner[order], value[order], TERMS, left), form.T @ left
            left = np.linalg.qr(_rows(owner, term, value, len(form), words) + form @ shape)[0]
        words, shape = _rows(term[order], owner[order], value[order], TERMS, left), form.T @ left
        size, turn = np.linalg.eigh(words.T @ words + shape.T @ shape)
        turn = turn[:, ::-1][:, :DIMENSIONS] / np.sqrt(np.maximum(size[::-1][:DIMENSIONS], 1e-9))
        self.words_basis, self.form_basis = (words @ turn).astype(np.float32), (shape @ turn).astype(np.float32)

    def latent(self, form: np.ndarray, owner: np.ndarray, term: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Unit vectors of texts in the latent space."""
        return self._placed(form * self.form_weight - self.centre, owner, term, self._values(owner, term, counts, len(form)))

    def _placed(self, form: np.ndarray, owner: np.ndarray, term: np.ndarray, value: np.ndarray) -> np.ndarray:
        z = form @ self.form_basis + _rows(owner, term, value, len(form), self.words_basis)
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        out = np.empty(len(texts))
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(texts), BLOCK):
            cosine = self.latent(*features(texts[at : at + BLOCK])) @ self.known.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            w = np.clip((1 + np.take_along_axis(cosine, near, axis=1).astype(np.float64)) / 2, 1e-6, 1) ** POWER
            out[at : at + BLOCK] = (w * self.labels[near]).sum(axis=1) / w.sum(axis=1)
        return out


DESCRIBED = [("doc_id", pa.int64()), ("quality", pa.int32()), ("form", pa.binary()), ("terms", pa.binary()), ("counts", pa.binary())]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most about ``sample`` labelled rows outside the held-out fold, chosen by a hash of their ids."""
    usable = labels.filter("quality is not null and doc_id is not null").filter(remainder("doc_id", 3) != 1).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = usable.count()
    cut = int(min(1.0, sample / max(n, 1)) * (1 << 31))
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < cut)
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")  # about ``sample`` rows of two integers

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for texts in textcodes.chunks(textcodes.encoded(batch.column(1))):
                form, owner, term, counts = features(texts)
                cuts = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
                rows += [(f.tobytes(), term[a:b].astype(np.uint16).tobytes(), counts[a:b].astype(np.uint32).tobytes()) for f, a, b in zip(form, cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), *[pa.array([r[k] for r in rows], pa.binary()) for k in range(3)]], ["doc_id", "quality", "form", "terms", "counts"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), pa.schema(DESCRIBED)).sort_by([(c, "ascending") for c in ("doc_id", "form", "terms", "counts")])
        held = lambda c, t: np.frombuffer(b"".join(table[c].to_pylist()), t)
        sizes = [len(x) // 2 for x in table["terms"].to_pylist()]
        model = Model(held("form", np.float32).reshape(-1, WIDTH), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), held("terms", np.uint16).astype(np.int32), held("counts", np.uint32), table["quality"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    described = joined.mapInArrow(describe, "doc_id long, quality int, form binary, terms binary, counts binary")
    told = described.repartition(1).mapInArrow(train, "model binary").collect()  # about ``sample`` rows in one task, which returns the model alone
    if told:
        return pickle.loads(told[0].model)
    return Model(np.zeros((0, WIDTH), np.float32), *np.zeros((3, 0), np.int32), np.zeros(0))


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The columns of ``docs`` with ``quality_score`` (0 to 1): one row per row, extra columns kept.

    Null texts count as empty ones, and empty ones are scored like all others. Texts are
    read whole. Without any usable label every score is 0.5. Repeated rows get equal
    scores; an empty table gives no rows. Only the text enters a score. Of labelled vectors that
    are equally near, any may vote. If ``docs`` has a column quality_score, the new one gets a free name (``common.free_name``).
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))  # (SAMPLE + TERMS) x DIMENSIONS numbers at most

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [model.value.scores(c) for c in textcodes.chunks(textcodes.encoded(batch))]
            yield pa.array(np.concatenate(parts) if parts else [], pa.float64())

    score.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(free_name(docs, "quality_score"), F.arrow_udf(score, "double")(F.col("text")))
