"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages, each of some consecutive words. Every passage
is encoded; gated attention (tanh times sigmoid) weighs the passages, and the
weighted passage representation is scored. Only documents carry labels, so the
attention learns by itself which passages decide.

The model is fitted in numpy on a bounded sample of labelled rows
(``sample``), and scores every whole text. Null and empty texts count as one
empty passage; a very long text has as many passages as it needs. Labels that
are null are no labels; of several labels of a document the smallest counts.
Without labels of both kinds every score is the share of label 1, or 0.5, as
it is where the labelled documents are missing or the tables empty. Repeated
rows and null ids each get a score; equal texts get equal ones. Other columns
are never looked at, and ``keep_good`` passes them on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Words, clean, in_small_batches, steps

PASSAGE_WORDS = 64
# bytes: control, each printable ASCII character, lead and trail bytes of others
_CLASS = np.zeros(256, np.int64)
_CLASS[32:127] = np.arange(1, 96)
_CLASS[128:] = 96
_CLASS[10] = 97
N_CLASSES = 98
N_FEATURES = N_CLASSES + 6


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and where each text's passages begin (one more at the end)."""
    words = Words(data, offsets)
    n_words = np.diff(words.first)
    count = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    first = np.r_[0, np.cumsum(count)]
    total = int(first[-1])
    text_of = np.repeat(np.arange(len(count)), n_words)
    # passage of each word, and the passage in which each byte lies
    passage = first[text_of] + (np.arange(len(text_of)) - words.first[text_of]) // PASSAGE_WORDS
    opens = np.r_[True, passage[1:] != passage[:-1]] if len(passage) else np.zeros(0, bool)
    begin = np.full(total + 1, -1, np.int64)
    begin[passage[opens]] = words.start[opens]
    begin[first[:-1]] = offsets[:-1]
    begin[-1] = len(data)
    size = np.diff(begin)
    where = np.repeat(np.arange(total), size)
    chars = np.bincount(where * N_CLASSES + _CLASS[data], minlength=total * N_CLASSES).reshape(total, N_CLASSES)
    out = np.zeros((total, N_FEATURES), np.float32)
    out[:, :N_CLASSES] = np.sqrt(chars / np.maximum(size, 1)[:, None])
    if len(passage):
        length = (words.end - words.start).astype(np.float64)
        n = np.bincount(passage, minlength=total)
        safe = np.maximum(n, 1)
        mean = np.bincount(passage, length, total) / safe
        h = words.hashes()
        same = np.r_[False, (h[1:] == h[:-1]) & (passage[1:] == passage[:-1])]
        key = h + passage.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(key)
        again = np.r_[False, key[order][1:] == key[order][:-1]]
        out[:, -6] = n / PASSAGE_WORDS
        out[:, -5] = np.log1p(mean)
        out[:, -4] = np.log1p(np.sqrt(np.maximum(0, np.bincount(passage, length**2, total) / safe - mean**2)))
        out[:, -3] = np.bincount(passage, same, total) / safe
        out[:, -2] = np.bincount(passage[order], again, total) / safe
        out[:, -1] = np.log1p(np.maximum.reduceat(length, np.flatnonzero(opens)))[np.cumsum(np.isin(np.arange(total), passage)) - 1] * (n > 0)
    return out, first


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        w = self.weights
        z = np.tanh(x @ w["E"] + w["e"])
        t, g = np.tanh(z @ w["V"]), 1 / (1 + np.exp(-(z @ w["U"])))
        a = (t * g) @ w["a"]
        size = np.diff(first)
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, first[:-1]), size))
        a /= np.repeat(np.add.reduceat(a, first[:-1]), size)
        bag = np.add.reduceat(z * a[:, None], first[:-1])
        return 1 / (1 + np.exp(-(bag @ w["c"] + w["b"]))), {"z": z, "t": t, "g": g, "a": a, "bag": bag}

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant)
        return self.forward((x - self.mean) / self.scale, first)[0].astype(np.float64)


def gradient(model: Model, x: np.ndarray, first: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the documents' mean logistic loss, written out."""
    w = model.weights
    p, k = model.forward(x, first)
    err = ((p - labels) / len(labels)).astype(x.dtype)
    size = np.diff(first)
    each = np.repeat(err, size)
    z, t, g, a = k["z"], k["t"], k["g"], k["a"]
    back = z @ w["c"]  # what each passage adds to the bag's logit
    da = a * (back - np.repeat(np.add.reduceat(a * back, first[:-1]), size)) * each
    dt, dg = da[:, None] * w["a"] * g * (1 - t * t), da[:, None] * w["a"] * t * g * (1 - g)
    dz = (a * each)[:, None] * w["c"] + dt @ w["V"].T + dg @ w["U"].T
    dh = dz * (1 - z * z)
    return {"E": x.T @ dh, "e": dh.sum(0), "V": z.T @ dt, "U": z.T @ dg, "a": (t * g).T @ da, "c": k["bag"].T @ err, "b": err.sum()}


def fit(bags: list[np.ndarray], labels: np.ndarray, *, hidden: int = 24, gate: int = 12, epochs: int = 10, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 0) -> Model:
    """Adam on the logistic loss of documents."""
    none = Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), {}, float(labels.mean()) if len(labels) else 0.5)
    if len(set(labels.tolist())) < 2:
        return none
    every = np.concatenate(bags)
    mean, scale = every.mean(0), every.std(0) + 0.02
    bags = [((b - mean) / scale).astype(np.float32) for b in bags]
    r = np.random.default_rng(seed)
    d = every.shape[1]
    w = {
        "E": r.normal(0, d**-0.5, (d, hidden)), "e": np.zeros(hidden), "V": r.normal(0, hidden**-0.5, (hidden, gate)),
        "U": r.normal(0, hidden**-0.5, (hidden, gate)), "a": r.normal(0, gate**-0.5, gate), "c": r.normal(0, hidden**-0.5, hidden), "b": np.zeros(()),
    }
    w = {k: v.astype(np.float32) for k, v in w.items()}
    model = Model(mean, scale, w)
    m = {k: np.zeros_like(v) for k, v in w.items()}
    s = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    for epoch in range(epochs):
        order = r.permutation(len(bags))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            x = np.concatenate([bags[i] for i in pick])
            size = np.array([len(bags[i]) for i in pick])
            first = np.r_[0, np.cumsum(size)]
            grad = gradient(model, x, first, labels[pick])
            step += 1
            lr = rate * (1 - epoch / epochs)
            for n in w:
                q = grad[n] + decay * w[n]
                m[n] = 0.9 * m[n] + 0.1 * q
                s[n] = 0.999 * s[n] + 0.001 * q * q
                w[n] = (w[n] - lr * (m[n] / (1 - 0.9**step)) / (np.sqrt(s[n] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, label, text) to (doc_id, label, features of all passages)."""
    for batch in batches:
        for a, b, data, offsets in steps(batch.column(2)):
            x, first = passages(data, offsets)
            rows = [x[p:q].tobytes() for p, q in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(rows, pa.binary())], names=["doc_id", "label", "x"])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 2500, seed: int = 0) -> Model:
    """Fit on all passages of ``sample`` labelled documents at most, chosen by a digest of the id.

    Of several texts with one id the one with the smallest digest is fitted.
    """
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("doc_id"))
        .agg(F.min(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
        .limit(sample)
    )
    # at most ``sample`` rows
    rows = clean(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text"))
    got = sorted(rows.mapInArrow(_encode, "doc_id long, label int, x binary").collect(), key=lambda r: r.doc_id)
    bags = [np.frombuffer(r.x, np.float32).reshape(-1, N_FEATURES) for r in got]
    return fit(bags, np.array([r.label for r in got], np.float32), seed=seed)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in steps(batch.column(1)):
                x, first = passages(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(sent.value.score(x, first), pa.float64())], names=["doc_id", "score"])

    return clean(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, least: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, whose text scores ``least`` or more; the text is read once, in place."""
    in_small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in steps(batch.column(at)):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(sent.value.score(*passages(data, offsets)) >= least))

    return docs.mapInArrow(run, docs.schema)


def is_held_out(id_col: str = "doc_id"):
    """The fold that is never learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
