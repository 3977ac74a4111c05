"""Sampled segmentations over the piece lattice, by forward filtering and backward sampling.

The lattice of a text has a node between any two characters and an edge for every vocabulary
piece that fits.  No piece of the vocabulary goes on from a letter, digit or sign into a space,
or from a letter into a punctuation sign (checked when it is loaded), so a text falls into
segments whose lattices are independent; the forward sums of a segment are computed once per
distinct segment of a chunk.  The backward pass samples all segments of a
chunk together: an edge into the current node is drawn in proportion to its forward weight.

The draws are a counter-based hash of the seed, the row key, the segment's number in the text
and the step, so a row's segmentation depends on nothing but its key and text.  Vocabularies
of merge type hold ranks, not probabilities; a piece of rank r weighs (r + 2) ** -alpha.
Characters without a piece of their own become byte pieces, also the character that marks
spaces inside pieces, so decoding gives back the text to the last byte.

Defined cases: null and empty texts have no pieces; a null key draws as key 0; equal keys and
texts give equal pieces; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections import defaultdict
from itertools import chain, count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTERS = r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]"
SEGMENT = re.compile(rf"\n| *{LETTERS}++(?=[^\w\s])| *[^ \n]+| +")
CHUNK = 800_000  # segments sampled together
LONG = 2_000  # characters from which a segment is walked place by place


class Pieces:
    """Vocabulary of a sentencepiece model: ids and log weights by text, bytes by id."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, tuple[int, float]] = {}
        self.size = model.get_piece_size()
        self.raw: list[bytes] = [b""] * self.size
        self.byte_id = [model.unk_id()] * 256
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                text = piece.replace("▁", " ")
                if re.search(rf"[^ ] |{LETTERS}[^\w\s]", text):
                    raise ValueError(f"piece {text!r} crosses segments: they would not be independent")
                self.ids[text] = (i, -alpha * float(np.log(2 - model.get_score(i))))
                self.raw[i] = text.encode()
        self.longest = max(map(len, self.ids))
        self.fallback = -alpha * float(np.log(self.size + 2))
        # Sorted hashes of all beginnings of pieces, the piece that each one is (-1: none), its log weight, and whether longer ones exist.
        stems = sorted({text[:i] for text in self.ids for i in range(1, len(text) + 1)})
        hashes = np.array([self.hashed(s) for s in stems], np.uint64)
        order = np.argsort(hashes)
        self.keys = hashes[order]
        if (np.diff(self.keys) == 0).any():
            raise ValueError("two beginnings of pieces have the same hash")
        found = [self.ids.get(stems[i], (-1, 0.0)) for i in order]
        self.piece = np.array([f[0] for f in found], np.int64)
        self.log_weight = np.array([f[1] for f in found])
        inner = {text[:i] for text in self.ids for i in range(1, len(text))}
        self.longer = np.array([stems[i] in inner for i in order])

    @staticmethod
    def extend(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
        h = (h ^ codes) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))

    def hashed(self, text: str) -> int:
        h = np.zeros(1, np.uint64)
        for c in text:
            h = self.extend(h, np.array([ord(c) + 1], np.uint64))
        return int(h[0])

    def lattices(self, segments: list[str]):
        """Edges of the segments' lattices, sorted by end node: start place, end node, id (size + code point for byte fallback), cumulated share.

        Node n of segment d has the number ``sum of the lengths before d + d + n``.
        """
        lengths = np.fromiter(map(len, segments), np.int64)
        codes = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        segment = np.repeat(np.arange(len(segments)), lengths)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        left = lengths[segment] - place
        at, h, edges = np.arange(len(codes)), self.extend(np.zeros(len(codes), np.uint64), codes), []
        for size in range(1, self.longest + 1):
            i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            known = self.keys[i] == h
            hit = known & (self.piece[i] >= 0)
            edges.append((at[hit], np.full(hit.sum(), size), self.piece[i[hit]], self.log_weight[i[hit]]))
            if size == 1:  # a character without a piece is spelt in bytes
                alone = at[~hit]
                code = codes[alone].astype(np.int64) - 1
                width = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
                edges.append((alone, np.ones(len(alone), np.int64), self.size + code, self.fallback * width))
            on = known & self.longer[i] & (left[at] > size)
            at = at[on]
            if not len(at):
                break
            h = self.extend(h[on], codes[at + size])
        first, size, picked, weight = (np.concatenate(c) for c in zip(*edges))
        start, end = first + segment[first], first + segment[first] + size
        order = np.argsort(end, kind="stable")
        first, size, picked, weight, start, end = (x[order] for x in (first, size, picked, weight, start, end))
        reach = place[first] + size
        # Forward sums, all segments at once, from place to place; long ones one by one.
        forward = np.zeros(len(codes) + len(segments))
        for d in np.flatnonzero(lengths >= LONG).tolist():
            node = int(lengths[:d].sum()) + d
            self.walk(forward, node, *(x[np.searchsorted(end, node) : np.searchsorted(end, node + int(lengths[d]), side="right")] for x in (start, end, weight)))
        short = np.flatnonzero(lengths[segment[first]] < LONG)
        by_reach = short[np.argsort(reach[short], kind="stable")]
        bounds = np.append(0, np.cumsum(np.bincount(reach[short]))) if len(short) else np.zeros(1, np.int64)
        for a, b in zip(bounds[:-1], bounds[1:]):
            if a == b:
                continue
            e = by_reach[a:b]
            value, node = forward[start[e]] + weight[e], end[e]
            heads = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            top = np.maximum.reduceat(value, heads)
            spread = np.repeat(top, np.diff(np.append(heads, len(e))))
            forward[node[heads]] = top + np.log(np.add.reduceat(np.exp(value - spread), heads))
        share = np.exp(forward[start] + weight - forward[end])
        heads = np.flatnonzero(np.append(True, end[1:] != end[:-1]))
        run = np.cumsum(share)
        run -= np.repeat(run[heads] - share[heads], np.diff(np.append(heads, len(end))))
        run[np.append(heads[1:], len(end)) - 1] = 1.0
        return place[first], end, picked, run

    @staticmethod
    def walk(forward: np.ndarray, base: int, start: np.ndarray, end: np.ndarray, weight: np.ndarray) -> None:
        """Forward sums of one segment, whose edges come by end node."""
        sums, values, at = [0.0], [], 1
        for s, e, w in chain(zip((start - base).tolist(), (end - base).tolist(), weight.tolist()), [(0, -1, 0.0)]):
            if e != at:
                top = max(values)
                sums.append(top + math.log(sum(math.exp(v - top) for v in values)))
                values, at = [], e
            values.append(sums[s] + w)
        forward[base : base + len(sums)] = sums

    def decode(self, ids) -> str:
        """The text of a list of ids; lossless for ids made by this module."""
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")[1:]


@functools.lru_cache(maxsize=4)
def pieces(path: str, alpha: float) -> Pieces:
    return Pieces(path, alpha)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def draws(keys: np.ndarray, places: np.ndarray, step: int | np.ndarray, seed: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from row key, segment number and step."""
    mix = lambda x: (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        x = mix(keys + np.uint64(seed * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
        x = mix(x ^ mix(places * np.uint64(0xD1342543DE82EF95) + np.asarray(step + 1).astype(np.uint64)))
        x = mix(x ^ (x >> np.uint64(29)))
    return ((x ^ (x >> np.uint64(32))) >> np.uint64(11)).astype(np.float64) / 2.0**53


def walk_back(first: np.ndarray, starts: np.ndarray, picked: np.ndarray, shares: np.ndarray, u: np.ndarray) -> list[int]:
    """The pieces of one long segment, drawn from its end; ``first`` holds the edges of its nodes."""
    low = int(first[0])
    first = (first - low).tolist()
    starts, picked, shares, out = starts[low : low + first[-1]].tolist(), picked[low : low + first[-1]].tolist(), shares[low : low + first[-1]].tolist(), []
    node, draw = len(first) - 2, iter(u.tolist())
    while node:
        edge, x = first[node], next(draw)
        while shares[edge] <= x:
            edge += 1
        out.append(picked[edge])
        node = starts[edge]
    return out[::-1]


def sample_chunk(vocabulary: Pieces, texts: list[str], keys: list[int], seed: int) -> list[np.ndarray]:
    """Sampled ids of every text."""
    segments = [SEGMENT.findall(" " + t) if t else [] for t in texts]
    number: dict[str, int] = defaultdict(count().__next__)
    which = np.fromiter(map(number.__getitem__, chain.from_iterable(segments)), np.int64, sum(map(len, segments)))
    if not len(which):
        return [np.zeros(0, np.int64) for _ in texts]
    distinct = list(number)
    lengths = np.fromiter(map(len, distinct), np.int64)
    base = np.cumsum(lengths) - lengths + np.arange(len(distinct))
    starts, node_of_edge, picked, shares = vocabulary.lattices(distinct)
    first = np.searchsorted(node_of_edge, np.arange(int(base[-1] + lengths[-1]) + 2))  # edges of a node
    per_row = np.array([len(row) for row in segments])
    row = np.repeat(np.arange(len(texts)), per_row)
    place = (np.arange(len(which)) - np.repeat(np.cumsum(per_row) - per_row, per_row)).astype(np.uint64)
    key = np.array(keys, np.int64).astype(np.uint64)[row]
    drawn = np.zeros(len(which), np.int64)
    walked = {}
    for i in np.flatnonzero(lengths[which] >= LONG).tolist():
        a, n = int(base[which[i]]), int(lengths[which[i]])
        walked[i] = walk_back(first[a : a + n + 2], starts, picked, shares, draws(key[i : i + 1], place[i : i + 1], np.arange(n), seed))
        drawn[i] = len(walked[i])
    active, step, taken = np.flatnonzero(lengths[which] < LONG), 0, []
    node = (base + lengths)[which[active]]
    while len(active):
        edge, u = first[node], draws(key[active], place[active], step, seed)
        more = np.flatnonzero(shares[edge] <= u)
        while len(more):  # the first edge whose cumulated share is above the draw; the last one's is 1
            edge[more] += 1
            more = more[shares[edge[more]] <= u[more]]
        taken.append((active, picked[edge]))
        start = starts[edge]
        more = start > 0
        active, node, step = active[more], base[which[active[more]]] + start[more], step + 1
    # The pieces of a segment were drawn from its end.
    for who, _ in taken:
        drawn[who] += 1
    offset = np.cumsum(drawn)
    ids = np.zeros(int(offset[-1]), np.int64)
    for t, (who, what) in enumerate(taken):
        ids[offset[who] - 1 - t] = what
    for i, what in walked.items():
        ids[offset[i] - len(what) : offset[i]] = what
    ends = np.concatenate([[0], offset])[np.cumsum(per_row)]
    out = []
    for i, end in enumerate(ends):
        part = ids[ends[i - 1] if i else 0 : end]
        if part.size and part.max() >= vocabulary.size:
            part = np.array([x for p in part.tolist() for x in ([p] if p < vocabulary.size else [vocabulary.byte_id[c] for c in chr(p - vocabulary.size).encode()])], np.int64)
        out.append(part)
    return out


def sample(docs: DataFrame, seed: int = 1, alpha: float = 0.5, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row: doc_id, n_ids, ids_crc32 (little-endian 32-bit ids), lossless (decoding gives the text) and, if asked for, ids."""
    path = model_path or default_model()

    def run(batches):
        vocabulary = pieces(path, alpha)

        def emit(ids: list, texts: list[str], keys: list) -> pa.RecordBatch:
            crc = [zlib.crc32(i.astype("<u4").tobytes()) for i in ids]
            whole = [vocabulary.decode(i.tolist()) == t for i, t in zip(ids, texts)]
            columns = [pa.array(keys, pa.int64()), pa.array([len(i) for i in ids], pa.int64()), pa.array(crc, pa.int64()), pa.array(whole)]
            if with_ids:
                columns.append(pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_ids", "ids_crc32", "lossless", "ids"][: len(columns)])

        for b in batches:
            texts, keys, size = [], [], 0
            for key, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                texts.append(text.as_py() or "")
                keys.append(key)
                size += texts[-1].count(" ") + 1
                if size >= CHUNK:
                    yield emit(sample_chunk(vocabulary, texts, [k or 0 for k in keys], seed), texts, keys)
                    texts, keys, size = [], [], 0
            yield emit(sample_chunk(vocabulary, texts, [k or 0 for k in keys], seed), texts, keys)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, lossless boolean" + (", ids array<int>" if with_ids else ""))


def decode(ids: DataFrame, ids_col: str = "ids", model_path: str | None = None) -> DataFrame:
    """``ids`` with the column ``text`` that its lists of ids stand for."""
    path = model_path or default_model()

    @F.pandas_udf("string")
    def text(lists: pd.Series) -> pd.Series:
        vocabulary = pieces(path, 1.0)
        return lists.map(lambda x: None if x is None else vocabulary.decode([int(i) for i in x]))

    return ids.withColumn("text", text(F.col(ids_col)))
