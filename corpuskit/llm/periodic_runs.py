"""Periodic runs of words, found with minimizers at several scales.

A run is a stretch of words with smallest period q (words q apart are equal), of at least
``max(min_words, min_repeats * q)`` words, that neither neighbouring word extends.

* **Short periods** (up to 8) are scanned directly: equal words at that lag, stretch by stretch.
* **Scales.** Scale j looks for periods in (K[j-1], K[j]], where K grows by half.  Grams of
  K[j] words are hashed; a gram is a minimizer if it is smallest in some window of
  ``2 * (K[j-1] + 1) - K[j] + 1`` gram places.  A run of three periods holds such a window
  together with its copy one period on, so its minimizer is chosen twice.  A gram is as long
  as the period, so inside the run it repeats at multiples of the period only: the two are
  neighbours among the equal minimizers, and that pair seeds the run.
* **Extension.** Seeds are stretched to both sides at their lag by binary search over prefix
  hashes; what is long enough is then compared word by word, so hashes decide nothing alone.
* A stretch that was found at several periods is a run of the smallest of them.

Many texts are worked on together, longest first, separated by marks that occur once; a scale
only looks at the beginning that holds texts long enough for it.  Memory is bounded by
``CHUNK`` words and the longest single text; texts are never cut and no row leaves its task.

Defined cases: null, empty and blank texts have no word and no run; a null doc_id is a row like
any other; repeated rows give equal rows; of several longest runs the one with the smallest
start, then period, is reported; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORT = 8  # periods scanned directly
CHUNK = 300_000  # words searched together
BASE = 0x9E3779B97F4A7C15 | 1
RUN = "array<struct<start: long, length: long, period: long>>"


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers without visible order."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sliding(op, a: np.ndarray, width: int) -> np.ndarray:
    """``op`` over all windows of ``width`` places, by doubling."""
    size = 1
    while size < width:
        step = min(size, width - size)
        a = op(a[:-step], a[step:])
        size += step
    return a


def minimizers(grams: np.ndarray, width: int) -> np.ndarray:
    """Places whose gram is the smallest of some window of ``width`` places (all ties)."""
    least = sliding(np.minimum, grams, width)
    edge = np.zeros(width - 1, grams.dtype)
    return np.flatnonzero(sliding(np.maximum, np.concatenate([edge, least, edge]), width) == grams)


class Hashes:
    """Prefix hashes of a sequence of codes."""

    def __init__(self, codes: np.ndarray):
        powers = np.full(len(codes) + 1, BASE, np.uint64)
        powers[0] = 1
        self.powers = np.multiply.accumulate(powers)
        inverse = np.full(len(codes) + 1, pow(BASE, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        self.inverse = np.multiply.accumulate(inverse)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(mixed(codes.astype(np.uint64)) * self.powers[:-1], out=self.sums[1:])

    def grams(self, size: int, end: int) -> np.ndarray:
        """Hash of the gram at every place before ``end - size + 1``."""
        return mixed((self.sums[size : end + 1] - self.sums[: end + 1 - size]) * self.inverse[: end + 1 - size])

    def equal(self, a: np.ndarray, lag: np.ndarray, size: np.ndarray) -> np.ndarray:
        b = a + lag
        return (self.sums[a + size] - self.sums[a]) * self.powers[lag] == self.sums[b + size] - self.sums[b]

    def stretch(self, a: np.ndarray, lag: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest [start, end) around place ``a`` in the text [first, last) where words ``lag`` apart are equal."""
        low, high = np.zeros_like(a), last - a - lag  # words to the right that are surely equal, at most equal
        while (low < high).any():
            mid = (low + high + 1) // 2
            ok = self.equal(a, lag, mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        right = low
        low, high = np.zeros_like(a), a - first
        while (low < high).any():
            mid = (low + high + 1) // 2
            ok = self.equal(a - mid, lag, mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return a - low, a + lag + right


def plain_stretch(x: np.ndarray, a: int, lag: int, first: int, last: int) -> tuple[int, int]:
    """As ``Hashes.stretch`` for one place, word by word."""
    same = x[first : last - lag] == x[first + lag : last]
    at = a - first
    if not same[at]:
        return a, a
    before, after = np.flatnonzero(~same[:at]), np.flatnonzero(~same[at:])
    return first + (before[-1] + 1 if len(before) else 0), first + (at + after[0] if len(after) else len(same)) + lag


def find_runs(texts: list[np.ndarray], min_words: int = 24, min_repeats: int = 3) -> list[list[tuple[int, int, int]]]:
    """All runs (start, length, period) of every list of non-negative word codes, by start, then period."""
    if min_repeats < 3 or min_words < 2 * SHORT:
        raise ValueError(f"scales are made for at least 3 repeats and {2 * SHORT} words")
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    order = sorted((i for i, t in enumerate(texts) if len(t) >= min_words), key=lambda i: -len(texts[i]))
    if not order:
        return out
    lengths = np.array([len(texts[i]) for i in order])
    firsts = np.cumsum(lengths + 1) - lengths - 1
    total = int(lengths.sum()) + len(order)
    x = np.empty(total, np.int64)
    for i, first, n in zip(order, firsts.tolist(), lengths.tolist()):
        x[first : first + n] = texts[i]
    x[firsts + lengths] = -1 - np.arange(len(order))  # marks that occur once
    found: dict[tuple[int, int], int] = {}

    def add(start: int, end: int, period: int) -> None:
        if end - start >= max(min_words, min_repeats * period):
            found[start, end] = min(period, found.get((start, end), period))

    for q in range(1, SHORT + 1):
        breaks = np.concatenate([[-1], np.flatnonzero(x[:-q] != x[q:]), [total - q]])
        for j in np.flatnonzero(np.diff(breaks) > max(min_words, min_repeats * q) - q).tolist():
            add(int(breaks[j]) + 1, int(breaks[j + 1]) + q, q)

    hashes = Hashes(x) if lengths[0] >= min_repeats * (SHORT + 1) else None
    low = SHORT + 1
    while min_repeats * low <= lengths[0]:
        high = low + (low - 1) // 2 - 1
        texts_here = int(np.searchsorted(-lengths, -min_repeats * low, side="right"))
        end = int(firsts[texts_here - 1] + lengths[texts_here - 1])
        grams = hashes.grams(high, end)
        width = 2 * low - high + 1
        if len(grams) >= width:
            at = minimizers(grams, width)
            values = grams[at]
            by_value = np.argsort(values, kind="stable")
            at, values = at[by_value], values[by_value]
            lag = at[1:] - at[:-1]
            seeds = np.flatnonzero((values[1:] == values[:-1]) & (lag >= low) & (lag <= high))
            a, lag = at[seeds], lag[seeds]
            text = np.searchsorted(firsts, a, side="right") - 1
            inside = a + lag + high <= (firsts + lengths)[text]
            a, lag, text = a[inside], lag[inside], text[inside]
            starts, ends = hashes.stretch(a, lag, firsts[text], (firsts + lengths)[text])
            enough = ends - starts >= np.maximum(min_words, min_repeats * lag)
            rows = np.column_stack([starts, ends, lag])[enough]
            rows, one = np.unique(rows, axis=0, return_index=True)
            for (s, e, q), seed in zip(rows.tolist(), np.flatnonzero(enough)[one].tolist()):
                if not np.array_equal(x[s : e - q], x[s + q : e]):  # two grams with one hash
                    first = int(firsts[text[seed]])
                    s, e = plain_stretch(x, int(a[seed]), q, first, first + int(lengths[text[seed]]))
                add(s, e, q)
        low = high + 1

    for (s, e), q in found.items():
        t = int(np.searchsorted(firsts, s, side="right")) - 1
        out[order[t]].append((s - int(firsts[t]), e - s, q))
    return [sorted(r, key=lambda v: (v[0], v[2])) for r in out]


def longest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period; ties to the smallest start, then period."""
    best = None
    for run in runs:  # sorted by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run repeats: of every run its first period stays."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist()) if not g]


def repeat_tail(words: list, doc_id: int | None) -> list:
    """Planted runs: of every tenth document (by hash) the words from some place on repeat a beginning of themselves."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def find(docs: DataFrame, edit: Callable[[list, int | None], list] | None = None, with_text: bool = False, min_words: int = 24, min_repeats: int = 3) -> DataFrame:
    """Per row: doc_id, n_runs, the run that repeats most (start, length, period, exponent_milli), all runs, and the text without repeats.

    ``runs_sha256`` hashes the lines ``start,length,period``, ``collapsed_sha256`` the kept
    words joined by one space; ``with_text`` adds that text itself as ``collapsed``.  ``edit``
    may change the words of a document before they are searched.
    """
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs"]
    names += ["collapsed"] if with_text else []
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs " + RUN
    schema += ", collapsed string" if with_text else ""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    types = [*[pa.int64()] * 6, pa.string(), pa.string(), kind, pa.string()]

    def searched(keys: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        codes: dict[bytes, int] = defaultdict(count().__next__)
        rows = []
        for key, words, runs in zip(keys, texts, find_runs([np.fromiter(map(codes.__getitem__, t), np.int64, len(t)) for t in texts], min_words, min_repeats)):
            top = longest(runs)
            figures = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
            lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
            kept = b" ".join(collapsed(words, runs))
            listed = [{"start": s, "length": n, "period": q} for s, n, q in runs]
            row = (key, len(runs), *figures, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), listed)
            rows.append((*row, kept.decode()) if with_text else row)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches):
        for b in batches:
            keys, texts, size = [], [], 0
            for key, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary())):
                words = (text.as_py() or b"").split()  # ASCII white space
                words = edit(words, key) if edit else words
                keys.append(key)
                texts.append(words)
                size += len(words)
                if size >= CHUNK:
                    yield searched(keys, texts)
                    keys, texts, size = [], [], 0
            if keys:
                yield searched(keys, texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)
