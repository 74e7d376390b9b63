"""Language identification with a byte convolutional network trained in numpy.

A text is cut into windows of ``WINDOW`` bytes, the last one filled up with zeros. Bytes
are embedded, filters of several widths run over each window, the maximum of every
filter is kept, and a softmax layer gives the languages' probabilities. A text's
probabilities are the mean over all its windows, weighted by their bytes.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.llm import textcodes
from isohyet.llm.common import free_name, remainder

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDED = 8
SAMPLE = 400  # documents per language that the network is fitted on, about
WINDOWS_OF_A_DOCUMENT = 6
EPOCHS = 12
BATCH = 64
AT_ONCE = 256  # windows
UNKNOWN = "und"


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts, each one's text number and its bytes in use."""
    lengths = np.array([len(t) for t in texts], np.int64)
    n = -(-lengths // WINDOW)
    owner = np.repeat(np.arange(len(texts)), n)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    padded = np.frombuffer(b"".join(t.ljust(k * WINDOW, b"\0") for t, k in zip(texts, n.tolist(), strict=True)), np.uint8)
    return padded.reshape(-1, WINDOW), owner, np.minimum(lengths[owner] - within * WINDOW, WINDOW)


class Network:
    """Embedding, filters of several widths held as one kernel, and a softmax layer."""

    def __init__(self, languages: list[str], seed: int = 11):
        r = np.random.default_rng(seed)
        self.languages, self.reach = languages, max(WIDTHS)
        wide = FILTERS * len(WIDTHS)
        self.mask = np.zeros((self.reach, EMBEDDED, wide), np.float32)
        for k, w in enumerate(WIDTHS):
            self.mask[:w, :, k * FILTERS : (k + 1) * FILTERS] = 1
        self.mask = self.mask.reshape(-1, wide)
        self.p = {
            "embed": r.normal(0, 0.5, (256, EMBEDDED)).astype(np.float32),
            "kernel": (r.normal(0, 0.25, (self.reach * EMBEDDED, wide)) * self.mask).astype(np.float32),
            "shift": np.zeros(wide, np.float32),
            "dense": r.normal(0, 0.2, (wide, len(languages))).astype(np.float32),
            "bias": np.zeros(len(languages), np.float32),
        }

    def columns(self, rows: np.ndarray) -> np.ndarray:
        """Embedded bytes of every filter position, side by side."""
        e = self.p["embed"][rows]
        out = rows.shape[1] - self.reach + 1
        return np.concatenate([e[:, j : j + out] for j in range(self.reach)], axis=2)

    def pooled(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.columns(rows)
        return x, (x.reshape(-1, x.shape[2]) @ self.p["kernel"]).reshape(x.shape[0], x.shape[1], -1)

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty((len(rows), len(self.languages)), np.float32)
        for at in range(0, len(rows), AT_ONCE):
            top = self.pooled(rows[at : at + AT_ONCE])[1].max(axis=1) + self.p["shift"]
            z = np.maximum(top, 0) @ self.p["dense"] + self.p["bias"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[at : at + AT_ONCE] = z / z.sum(axis=1, keepdims=True)
        return out

    def gradients(self, rows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        x, conv = self.pooled(rows)
        at = conv.argmax(axis=1)
        top = np.take_along_axis(conv, at[:, None], axis=1)[:, 0] + self.p["shift"]
        hidden = np.maximum(top, 0)
        z = hidden @ self.p["dense"] + self.p["bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        z[np.arange(len(rows)), labels] -= 1
        z /= len(rows)
        back = (z @ self.p["dense"].T) * (top > 0)
        picked = x[np.arange(len(rows))[:, None], at]  # what each filter saw where it was highest
        embed = np.zeros_like(self.p["embed"])
        seen = (back[:, :, None] * (self.p["kernel"] * self.mask).T[None]).reshape(*back.shape, self.reach, EMBEDDED)
        for j in range(self.reach):
            np.add.at(embed, rows[np.arange(len(rows))[:, None], at + j], seen[:, :, j])
        return {"embed": embed, "kernel": np.einsum("nf,nfd->df", back, picked) * self.mask, "shift": back.sum(axis=0), "dense": hidden.T @ z, "bias": z.sum(axis=0)}

    def train(self, rows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 3) -> None:
        """Adam over shuffled batches, with a rate that falls to zero."""
        r = np.random.default_rng(seed)
        mean, square = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        steps, step = epochs * -(-len(rows) // BATCH), 0
        for _ in range(epochs):
            order = r.permutation(len(rows))
            for at in range(0, len(rows), BATCH):
                pick = order[at : at + BATCH]
                step += 1
                for k, g in self.gradients(rows[pick], labels[pick]).items():
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.999 * square[k] + 0.001 * g * g
                    now = rate * (1 - step / (steps + 1))
                    self.p[k] -= (now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def of_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of the likeliest language and its probability, for each text."""
        total = np.zeros((len(texts), len(self.languages)))
        for at in range(0, len(texts), 512):
            rows, owner, used = windows(texts[at : at + 512])
            np.add.at(total, owner + at, self.probabilities(rows) * used[:, None])
        mass = total.sum(axis=1)
        return total.argmax(axis=1), np.where(mass > 0, total.max(axis=1) / np.where(mass > 0, mass, 1), 0.0)


def has_letter(text: Column | str) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Network:
    """A network from about ``sample`` documents of each language outside the held-out fold, chosen by a hash of their ids.

    Of each such document at most ``WINDOWS_OF_A_DOCUMENT`` windows, spread over it, are used.
    """
    usable = docs.filter("lang is not null and text is not null").filter(F.coalesce(remainder("doc_id", 4) != 2, F.lit(True))).filter(has_letter("text"))
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    languages = sorted(counts)
    network = Network(languages)
    if not languages:
        return network
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, int(min(1.0, sample / counts[lang]) * (1 << 31)))])
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 31)) < share[F.col("lang")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, text in zip(batch.column(0).to_pylist(), textcodes.encoded(batch.column(1)), strict=True):
                rows = windows([text])[0]
                for k in sorted({int(x) for x in np.linspace(0, len(rows) - 1, WINDOWS_OF_A_DOCUMENT)}) if len(rows) else []:
                    out.append((lang, rows[k].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.binary())], ["lang", "bytes"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(x for batch in batches for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        number = {lang: k for k, lang in enumerate(languages)}
        network.train(np.frombuffer(b"".join(b for _, b in found), np.uint8).reshape(-1, WINDOW), np.array([number[x] for x, _ in found], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(network)], pa.binary())], ["network"])

    sampled = chosen.select("lang", "text").mapInArrow(cut, "lang string, bytes binary")
    told = sampled.repartition(1).mapInArrow(train, "network binary").collect()  # the windows of about ``sample`` documents a language in one task, which returns the network alone
    return pickle.loads(told[0].network)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The columns of ``docs`` with lang_pred and lang_score (0 to 1): one row per row, extra columns kept.

    ``und`` with score 0 where the text is null or empty or has no letter, or where no labelled row
    could be learned from. Texts are read whole, in windows. Repeated rows get equal
    predictions; an empty table gives no rows. Only the text enters a prediction. Of equally likely
    languages the first by name is told. If ``docs`` has columns of these names, the new ones get free names (``common.free_name``).
    """
    network = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))  # a few thousand numbers

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            names = np.array(network.value.languages or [UNKNOWN], object)
            parts = [network.value.of_texts(c) if network.value.languages else (np.zeros(len(c), int), np.zeros(len(c))) for c in textcodes.chunks(textcodes.encoded(batch))]
            which = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, int)
            score = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0)
            yield pa.StructArray.from_arrays([pa.array(names[which], pa.string()), pa.array(score, pa.float64())], ["lang", "score"])

    work.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    held, lang, score = (free_name(docs, c) for c in ("lang_told", "lang_pred", "lang_score"))
    told = docs.withColumn(held, F.arrow_udf(work, "lang string, score double")(F.col("text")))
    known = has_letter("text")
    return told.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.when(known, F.col(held).lang).otherwise(UNKNOWN).alias(lang),
        F.when(known, F.col(held).score).otherwise(0.0).alias(score),
    )
