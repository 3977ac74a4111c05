"""Toxic passages as maximum-scoring segments over token log-odds.

Tokens get the log-odds of toxic against clean text with an informative Dirichlet prior (the
words' shares in both classes together), counted once per class and pair of neighbours.  A word whose log-odds are a stated number of
standard errors above zero, and a stated part of what a word can reach that clean text never
holds, keeps them as its score; every other token costs a constant.  A
linear-time scan finds all maximal scoring segments of a text; a segment's score is turned
into a p-value by the extreme-value law of local scores, whose decay solves the usual moment
equation and whose size constant is fitted on clean documents.  A document's score combines
its best and its summed significant segments in a logistic curve.

The model is fitted on a bounded sample of labelled documents (``train_rows``, at most 20,000
by default, outside the held-out fold).  A lexicon word must stand between as many different
pairs of neighbours as ``min_share`` of the toxic sample has documents; copies of one passage
are one such pair, and the lexicon's size is bounded by the mean length of a toxic document
over that share, whatever the number of documents.  Only texts enter a score.

Defined cases: null and empty texts have no segment and get the score of such texts; without
labelled rows of both classes every score is the share of label 1, or 0 without any label;
repeated rows score alike; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.shared import held_out, logistic, training_rows
from corpuskit.session import checkpointed

WORDS = re.compile(r"[^\W\d_]+")


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float, prior_tokens: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds under a Dirichlet prior of ``prior_tokens`` pseudo-counts shared out by the pooled frequencies, and their z-scores."""
    prior = (toxic + clean) / max(n_toxic + n_clean, 1) * prior_tokens
    a, b = toxic + prior, clean + prior
    delta = np.log(a / np.maximum(n_toxic + prior_tokens - a, 1e-9)) - np.log(b / np.maximum(n_clean + prior_tokens - b, 1e-9))
    return delta, delta / np.sqrt(1 / a + 1 / b)


def maximal_segments(places: list[int], scores: list[float], cost: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last + 1, score) of a text, in linear time.

    Only the positive tokens are given, by place and score; each of the others costs
    ``cost``.  A segment starts and ends with a positive token, scores more than any part of
    itself, and cannot be widened; the stack holds for each candidate its running sums.
    """
    stack: list[list] = []  # first, last, sum before, sum through, previous candidate with a smaller sum before
    total, seen = 0.0, 0
    for place, score in zip(places, scores):
        total -= cost * (place - seen)
        seen = place + 1
        item = [place, place + 1, total, total + score, -1]
        total += score
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= item[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= item[3]:
                item[4] = j
                stack.append(item)
                break
            item = [stack[j][0], item[1], stack[j][2], item[3], -1]
            del stack[j:]
    return [(s[0], s[1], s[3] - s[2]) for s in stack]


def decay(scores: np.ndarray, shares: np.ndarray, cost: float) -> float:
    """The positive root of sum(share * exp(x * score)) = 1, the other tokens scoring -cost."""

    def moment(x: float) -> float:
        return float((shares * np.exp(np.minimum(x * scores, 600))).sum() + (1 - shares.sum()) * np.exp(-x * cost) - 1)

    low, high = 1e-6, 1.0
    while moment(high) < 0 and high < 1e3:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if moment(mid) < 0 else (low, mid)
    return high


@dataclass(frozen=True)
class Model:
    scores: dict[str, float]
    cost: float
    decay: float
    size: float  # log of the size constant of the extreme-value law
    level: float  # p-value that makes a segment significant
    curve: np.ndarray  # intercept, weight of the best and of the summed evidence

    def segments(self, text: str | None) -> tuple[list[tuple[int, int, float]], int]:
        """Maximal segments as (first word, last word + 1, evidence) and the number of words; evidence is -log of the expected number of such segments."""
        words = WORDS.findall((text or "").lower())
        found = [(i, s) for i, s in enumerate(map(self.scores.get, words)) if s is not None]
        if not found:
            return [], len(words)
        base = self.size + np.log(len(words))
        return [(a, b, self.decay * s - base) for a, b, s in maximal_segments(*map(list, zip(*found)), self.cost)], len(words)

    def p_value(self, evidence: float) -> float:
        return float(-np.expm1(-np.exp(min(-evidence, 40.0))))

    def significant(self, segments) -> list[tuple[int, int, float]]:
        return [s for s in segments if self.p_value(s[2]) <= self.level]

    def features(self, text: str | None) -> tuple[float, float]:
        segments, _ = self.segments(text)
        return max((s[2] for s in segments), default=-8.0), float(np.log1p(sum(max(s[2], 0) for s in self.significant(segments))))

    def score(self, features: np.ndarray) -> np.ndarray:
        return logistic(self.curve[0] + np.asarray(features, float).reshape(-1, 2) @ self.curve[1:])


def fit_curve(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, rounds: int = 100) -> np.ndarray:
    """Logistic regression by Newton steps, halved until the penalised loss falls."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])

    def loss(v: np.ndarray) -> float:
        z = a @ v
        return float(np.logaddexp(0, z).sum() - (y * z).sum() + penalty * (v**2).sum() / 2)

    for _ in range(rounds):
        p = logistic(a @ w)
        slope = a.T @ (p - y) + penalty * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty * np.eye(len(w)), slope)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > now - 1e-4 * size * float(slope @ step):
            size /= 2
        if size <= 1e-6:
            break
        w = w - size * step
    return w


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = 20_000, min_share: float = 0.002, z_min: float = 4.0, prior_share: float = 0.1, strength: float = 0.75, cost: float = 0.5, level: float = 0.05) -> Model:
    sample = training_rows(docs, labels, "toxic", train_rows)
    sizes = {r["y"]: r["docs"] for r in sample.groupBy("y").agg(F.count("*").alias("docs")).collect()}
    docs_1, docs_0 = sizes.get(1, 0), sizes.get(0, 0)
    if not docs_1 or not docs_0:
        share = docs_1 / (docs_1 + docs_0) if docs_1 + docs_0 else 0.0
        return Model({}, cost, 1.0, 0.0, level, np.array([np.log((share + 1e-9) / (1 - share + 1e-9)), 0.0, 0.0]))
    # A word counts once per pair of neighbours and class: copies and repeated lines say nothing new.
    listed = sample.select("y", F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)).alias("w"))
    placed = F.transform("w", lambda x, i: F.struct(x.alias("word"), F.xxhash64(F.get("w", i - 1), F.get("w", i + 1)).alias("between")))
    words = listed.select("y", F.explode(placed).alias("p")).select("y", "p.word", "p.between")
    places = words.groupBy("word", "between").agg(F.max("y").alias("toxic"), F.max(1 - F.col("y")).alias("clean"))
    counts = checkpointed(places.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    tokens_1, tokens_0 = (float(x or 0) for x in counts.agg(F.sum("toxic"), F.sum("clean")).first())
    common = counts.filter(F.col("toxic") >= max(3, min_share * docs_1)).toPandas()  # bounded, see above
    prior_tokens = prior_share * (tokens_1 + tokens_0)
    delta, z = log_odds(common["toxic"].to_numpy(float), common["clean"].to_numpy(float), tokens_1, tokens_0, prior_tokens)
    most = np.log((1 + prior_share) / prior_share) + np.log((tokens_0 + prior_tokens) / (tokens_1 + prior_tokens))  # of a word that clean text never holds
    chosen = (z >= z_min) & (delta >= strength * most)
    scores = dict(zip(common["word"][chosen], delta[chosen]))
    if not scores:
        share = docs_1 / (docs_1 + docs_0)
        return Model({}, cost, 1.0, 0.0, level, np.array([np.log(share / (1 - share)), 0.0, 0.0]))
    clean_share = (common["clean"].to_numpy(float)[chosen] + 0.5) / (tokens_0 + 1)
    values = np.array(list(scores.values()))
    cost = max(cost, 1.5 * float((clean_share * values).sum()))  # local scores need a negative mean on clean text
    model = Model(scores, cost, decay(values, clean_share, cost), 0.0, level, np.zeros(3))

    def measured(model):
        def run(batches):
            for b in batches:
                texts = b.column("text").to_pylist()
                got = [model.features(t) for t in texts]
                found = [model.segments(t) for t in texts]
                columns = [[g[0] for g in got], [g[1] for g in got], [float(n) for _, n in found], [float(len(f)) for f, _ in found]]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), *(pa.array(c, pa.float64()) for c in columns)], names=names)

        names = ["doc_id", "y", "best", "summed", "words", "segments"]
        rows = sample.mapInArrow(run, "doc_id long, y int, best double, summed double, words double, segments double").toPandas()  # bounded by train_rows
        return rows.sort_values(["doc_id", "y"])

    # Size constant: the law's expected number of segments in the clean documents is the number found there (and half a one).
    clean = measured(model)
    clean = clean[clean["y"] == 0]
    size = float(np.log((clean["segments"].sum() + 0.5) / (clean["words"].sum() + 1)) + model.decay * values.min())
    model = Model(scores, cost, model.decay, size, level, np.zeros(3))
    rows = measured(model)
    curve = fit_curve(rows[["best", "summed"]].to_numpy(), rows["y"].to_numpy(float))
    return Model(scores, cost, model.decay, size, level, curve)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """doc_id, held_out, score, predicted, and the significant passages as array of (first_word, end_word, evidence)."""
    model = fit(docs, labels, **options)

    def run(batches):
        for b in batches:
            found, features = [], []
            for t in b.column("text").to_pylist():
                segments, _ = model.segments(t)
                features.append(model.features(t) if segments else (-8.0, 0.0))
                found.append([{"first_word": s[0], "end_word": s[1], "evidence": float(s[2])} for s in model.significant(segments)])
            kind = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("evidence", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(features), pa.float64()), pa.array(found, kind)], names=["doc_id", "score", "passages"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(run, "doc_id long, score double, passages array<struct<first_word: long, end_word: long, evidence: double>>")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that are not predicted toxic."""
    model = fit(docs, labels, **options)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            yield b.filter(pa.array(model.score([model.features(t) for t in texts]) < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
