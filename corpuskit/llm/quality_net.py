"""Quality classifier: random-indexing word vectors, pooled per document, into a small network.

Every word form hashes to one of ``SLOTS`` slots and every slot has a fixed sparse random
index vector.  A slot's context vector is the sum of the index vectors of the neighbours that
its words have within ``REACH`` places, counted over all documents; the word vector is the
normalised context vector plus the slot's own index vector.  A document is the mean and the
spread of its word vectors.  A two-layer network in numpy is fitted on a bounded sample of
labelled documents (``train_rows``, at most 20,000 by default, outside the held-out fold);
a temperature fitted on rows the network did not see makes its output a probability.

Only texts enter a score.  Defined cases: null and empty texts have the zero vector and get a
score like any other; without labelled rows of both classes every score is the share of label
1, or one half without any label; repeated rows score alike; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.shared import held_out, logistic, training_rows

SLOTS = 16_384
DIMS = 32
REACH = 2
FORMS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
KNOWN_FORMS = 300_000  # forms remembered per task; beyond it the memory starts anew


class Slots(dict):
    """Slot of a word form; upper-case words differ from lower-case ones, digits count by length."""

    def __missing__(self, form: str) -> int:
        if len(self) >= KNOWN_FORMS:
            self.clear()
        key = "^" + form.lower() if len(form) > 1 and form.isupper() else "0" * min(len(form), 20) if form.isdigit() else form.lower()
        slot = self[form] = zlib.crc32(key.encode()) % SLOTS
        return slot

    def of(self, text: str | None) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, FORMS.findall(text or "")), np.int64)


def index_vectors(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places and signs per slot; the extra last slot (a text's edge) has sign 0."""
    rng = np.random.default_rng(seed)
    places, signs = rng.integers(0, DIMS, (SLOTS + 1, 2)), rng.choice([-1.0, 1.0], (SLOTS + 1, 2))
    signs[SLOTS] = 0
    return places, signs


def context_sums(docs: DataFrame, seed: int) -> np.ndarray:
    """Sum of the neighbours' index vectors for every slot, over all documents."""
    places, signs = index_vectors(seed)

    def run(batches):
        total, slots = np.zeros((SLOTS + 1) * DIMS), Slots()

        def add(run_of_slots: list[np.ndarray]) -> None:
            w = np.concatenate(run_of_slots)
            for step in range(1, REACH + 1):
                for a, b in ((w[:-step], w[step:]), (w[step:], w[:-step])):
                    for j in (0, 1):
                        total[:] += np.bincount(a * DIMS + places[b, j], signs[b, j], len(total))

        edge = np.full(REACH, SLOTS)
        for b in batches:
            held, size = [edge], 0
            for text in b.column("text"):
                held += [slots.of(text.as_py()), edge]
                size += len(held[-2])
                if size > 500_000:
                    add(held)
                    held, size = [edge], 0
            add(held)
        sums = total.reshape(-1, DIMS)[:SLOTS].astype(np.int64)
        used = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(sums[used, i]) for i in range(DIMS))], names=["slot", *(f"c{i}" for i in range(DIMS))])

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "slot int, " + ", ".join(f"c{i} long" for i in range(DIMS)))
    rows = parts.groupBy("slot").agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(DIMS))).toArrow()  # at most SLOTS rows
    out = np.zeros((SLOTS, DIMS))
    if rows.num_rows:
        out[rows["slot"].to_numpy()] = np.stack([rows[f"c{i}"].to_numpy() for i in range(DIMS)], axis=1)
    return out


def word_vectors(sums: np.ndarray, seed: int) -> np.ndarray:
    """Normalised context plus own index vector; float32."""
    places, signs = index_vectors(seed)
    vectors = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    for j in (0, 1):
        np.add.at(vectors, (np.arange(SLOTS), places[:SLOTS, j]), signs[:SLOTS, j])
    return vectors.astype(np.float32)


def pooled(texts, vectors: np.ndarray, slots: Slots) -> np.ndarray:
    """Mean and standard deviation of the word vectors of every text."""
    out = np.zeros((len(texts), 2 * DIMS), np.float32)
    for i, text in enumerate(texts):
        w = slots.of(text)
        mean, square = np.zeros(DIMS), np.zeros(DIMS)
        for at in range(0, len(w), 100_000):
            v = vectors[w[at : at + 100_000]]
            mean += v.sum(0, dtype=np.float64)
            square += np.einsum("ij,ij->j", v, v, dtype=np.float64)
        if len(w):
            mean, square = mean / len(w), square / len(w)
            out[i] = np.concatenate([mean, np.sqrt(np.maximum(square - mean**2, 0))])
    return out


@dataclass(frozen=True)
class Net:
    """Two dense layers behind a standardised input, and the temperature of the logit."""

    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.shift) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return logistic(self.logits(x) / self.temperature)


def fit_net(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4, seed: int = 11) -> Net:
    """Adam on the log loss over four fifths of the rows; the rest sets the temperature."""
    share = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or share in (0.0, 1.0):
        flat = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        return Net(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros(1), flat)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    rest, fit = order[: len(y) // 5], order[len(y) // 5 :]
    shift, scale = x[fit].mean(0), x[fit].std(0) + 1e-3
    z = (x - shift) / scale
    p = [rng.standard_normal((x.shape[1], hidden)) / np.sqrt(x.shape[1]), np.zeros(hidden), rng.standard_normal(hidden) / np.sqrt(hidden), np.zeros(1)]
    first, second, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(epochs):
        for at in np.array_split(rng.permutation(fit), max(1, len(fit) // 256)):
            h = np.tanh(z[at] @ p[0] + p[1])
            d = (logistic(h @ p[2] + p[3]) - y[at]) / len(at)
            dh = np.outer(d, p[2]) * (1 - h**2)
            t += 1
            for i, g in enumerate([z[at].T @ dh + decay * p[0], dh.sum(0), h.T @ d + decay * p[2], d.sum(keepdims=True)]):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g**2
                p[i] = p[i] - rate * (1 - epoch / epochs) * first[i] / (1 - 0.9**t) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    net = Net(shift, scale, p[0], p[1], p[2], float(p[3][0]))
    if not len(rest):
        return net
    logits, grid = net.logits(x[rest]), np.exp(np.linspace(np.log(0.25), np.log(8), 120))
    loss = [np.mean(np.logaddexp(0, logits / s) - y[rest] * logits / s) for s in grid]
    return Net(shift, scale, p[0], p[1], p[2], float(p[3][0]), float(grid[int(np.argmin(loss))]))


def fitted(docs: DataFrame, labels: DataFrame, train_rows: int, seed: int) -> tuple[np.ndarray, Net]:
    """Word vectors over all documents and the network over the labelled sample."""
    vectors = word_vectors(context_sums(docs, seed), seed)

    def featured(batches):
        slots = Slots()
        for b in batches:
            x = pooled(b.column("text").to_pylist(), vectors, slots)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(list(x), pa.list_(pa.float32()))], names=["doc_id", "y", "x"])

    fit = training_rows(docs, labels, "quality", train_rows).mapInArrow(featured, "doc_id long, y int, x array<float>").toArrow()  # bounded by train_rows
    order = np.argsort(fit["doc_id"].to_numpy(), kind="stable")
    x = np.array(fit["x"].to_pylist(), dtype=np.float64).reshape(-1, 2 * DIMS)[order]
    return vectors, fit_net(x, fit["y"].to_numpy().astype(float)[order])


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, train_rows: int = 20_000, seed: int = 5) -> DataFrame:
    """doc_id, held_out, score (probability of label 1) and predicted for every document."""
    vectors, net = fitted(docs, labels, train_rows, seed)

    def run(batches):
        slots = Slots()
        for b in batches:
            score = net.score(pooled(b.column("text").to_pylist(), vectors, slots))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, train_rows: int = 20_000, seed: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is predicted to have label 1."""
    vectors, net = fitted(docs, labels, train_rows, seed)
    at = docs.columns.index("text")

    def run(batches):
        slots = Slots()
        for b in batches:
            texts = b.column(at).to_pylist()
            yield b.filter(pa.array(net.score(pooled(texts, vectors, slots)) >= threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
