"""Packing by deficit round-robin over source queues.

Every source is a queue of token ids; its target share of a window is its share of all
tokens (or a given weight).  A round gives every queue a quantum of ``window`` x share
tokens; a queue serves whole grains of its stream as its credit allows and carries the rest,
its deficit, to the next round.  The rounds follow each other without gaps and are cut into
sequences of ``window`` tokens, so only the last one is padded.

The credit of a queue after k rounds is ``k * quantum + start``, hence the deficit that any
window begins with is known without walking through the windows before it: every partition
places its own documents, and only the token totals of the queues are shared.

Up to ``max_queues`` sources the totals of all queues are sent to the tasks, and ids are never
shuffled.  With more sources Spark adds up the turns: every document knows the rounds of its
own queue, the turns (round, queue, tokens) are summed in order, and each run of ids is joined
to the offset of its turn.  Both ways give the same pieces; every source has its own deficit
and weight.

Defined cases: a null text is empty, and an empty document is the end id alone; a null source
is a source of its own; repeated rows are packed once per row; a document without an id keeps
a null doc_id; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.llm.shared import default_ranks, encode, stored

FINE = 4096  # quanta are counted in 1/4096 token


class Rounds:
    """Closed form of the rounds: how much every queue has served after round k."""

    def __init__(self, totals: list[int], weights: list[float] | None, window: int, grain: int):
        self.totals = np.array(totals, np.int64)
        share = self.totals / max(1, self.totals.sum()) if weights is None else np.array(weights, float) / sum(weights)
        self.quantum = np.maximum(1, np.ceil(share * window * FINE)).astype(np.int64)
        self.start = (np.arange(len(totals), dtype=np.int64) * 2_654_435_761 % 4096) * grain * FINE // 4096  # spreads the turns of equal queues
        self.grain = grain

    @classmethod
    def of_one(cls, total: int, quantum: int, start: int, grain: int) -> Rounds:
        """A single queue with a known quantum and start."""
        out = cls([total], None, 1, grain)
        out.quantum, out.start = np.array([quantum], np.int64), np.array([start], np.int64)
        return out

    def round_of(self, queue: int, grains: np.ndarray) -> np.ndarray:
        """The round (from 1) that serves a queue's n-th grain (from 1)."""
        need = grains * (self.grain * FINE) - self.start[queue]
        return -(-need // self.quantum[queue])

    def served(self, k: int) -> np.ndarray:
        return np.minimum(self.totals, (k * self.quantum + self.start) // (self.grain * FINE) * self.grain) if k > 0 else np.zeros_like(self.totals)

    def turns(self, queue: int, first: int, length: int):
        """(round, from, to) of the parts of a run of ``length`` tokens at ``first`` in the queue, by position in the queue."""
        grains = np.arange(first // self.grain, (first + length - 1) // self.grain + 1, dtype=np.int64)
        rounds = self.round_of(queue, grains + 1)
        heads = np.flatnonzero(np.append(True, rounds[1:] != rounds[:-1]))
        edges = np.append(np.maximum(first, grains[heads] * self.grain), first + length)
        for i, head in enumerate(heads):
            yield int(rounds[head]), int(edges[i]), int(edges[i + 1])

    def places(self, queue: int, first: int, length: int):
        """(start in the run, length, global offset) of the parts of a run of ``length`` tokens at ``first`` in the queue."""
        for k, lo, hi in self.turns(queue, first, length):
            before, after = self.served(k - 1), self.served(k)
            at = int(before.sum() + (after - before)[:queue].sum() + lo - before[queue])
            yield lo - first, hi - lo, at


def tokenized(docs: DataFrame, end_id: int, ranks_path: str, source_col: str) -> DataFrame:
    """(doc_id, source, part, before, n, ids): ids packed as 32-bit numbers, ``before`` counts the source's tokens ahead in this part."""

    def run(batches):
        part, running = TaskContext.get().partitionId(), {}
        for b in batches:
            before, sizes, packed = [], [], []
            sources = b.column("source").to_pylist()
            for source, text in zip(sources, b.column("text")):
                ids = np.append(encode(text.as_py(), ranks_path), end_id).astype("<u4")
                before.append(running.get(source, 0))
                running[source] = before[-1] + len(ids)
                sizes.append(len(ids))
                packed.append((ids.astype("<u2") if ids.max() < 65_536 else ids).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("source"), pa.array([part] * len(sizes), pa.int32()), pa.array(before, pa.int64()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())],
                names=["doc_id", "source", "part", "before", "n", "ids"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("source"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, part int, before long, n long, ids binary")


def pack(docs: DataFrame, window: int = 2048, end_id: int = 1, weights: dict[str, float] | None = None, grain: int = 256, max_queues: int = 4096, ranks_path: str | None = None, source_col: str = "source", max_broadcast_rows: int = 200_000, with_ids: bool = False) -> DataFrame:
    """Pieces: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ``ids`` if asked for).

    ``weights`` gives target proportions by source (others weigh nothing beyond one
    part in 4,096 of a token a round); a queue that runs dry leaves its share to the rest.
    """
    tokens = stored(tokenized(docs, end_id, ranks_path or default_ranks(), source_col))
    parts = tokens.groupBy("source", "part").agg(F.sum("n").alias("n"))
    totals = parts.groupBy("source").agg(F.sum("n").alias("n"))
    top = totals.orderBy(F.desc("n"), "source").limit(max_queues + 1).collect()  # at most max_queues + 1 rows
    # Tokens of the source in earlier parts; a source has one row per part here.
    starts = parts.withColumn("start", F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")).select("source", "part", "start")
    if len(top) > max_queues:
        pieces = by_turns(tokens, starts, totals, window, weights, grain, max_broadcast_rows, with_ids)
        return pieces if with_ids else pieces.drop("ids")
    own = [r["source"] for r in top]
    named = docs.sparkSession.createDataFrame([(s, i) for i, s in enumerate(own)], "source string, queue int")
    rounds = Rounds([r["n"] for r in top], None if weights is None else [weights.get(s[1:], 0.0) for s in own], window, grain)
    placed = tokens.join(few(starts.join(F.broadcast(named), "source"), max_broadcast_rows), ["source", "part"])

    def run(batches):
        for b in batches:
            out = []
            cols = [b.column(c).to_pylist() for c in ("source", "doc_id", "queue", "start", "before", "n", "ids")]
            for source, doc, queue, start, before, n, raw in zip(*cols):
                for first, length, at in rounds.places(queue, start + before, n):
                    size = len(raw) // n
                    out += pieces_of(doc, source, n, first, raw[first * size : (first + length) * size], length, at, window, with_ids)
            yield from as_batches(out)

    pieces = placed.select("doc_id", "source", "queue", "start", "before", "n", "ids").mapInArrow(run, PIECES)
    return pieces if with_ids else pieces.drop("ids")


PIECES = "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"


def few(starts: DataFrame, max_rows: int) -> DataFrame:
    return F.broadcast(starts) if starts.limit(max_rows + 1).count() <= max_rows else starts


def pieces_of(doc, source: str, doc_tokens: int, first: int, raw: bytes, length: int, at: int, window: int, with_ids: bool):
    """Rows of the run of ids ``raw`` that begins at ``first`` in its document and at ``at`` in the packed stream, cut at the sequences."""
    ids, done = np.frombuffer(raw, "<u2" if len(raw) == 2 * length else "<u4").astype("<u4"), 0
    while done < length:
        fit = min(length - done, window - at % window)
        piece = ids[done : done + fit]
        yield doc, source[1:] if source else None, first + done, fit, zlib.crc32(piece.tobytes()), doc_tokens, at // window, at % window, piece.tolist() if with_ids else None
        at, done = at + fit, done + fit


def as_batches(rows: list):
    names = ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    types = [pa.int64(), pa.string(), *[pa.int64()] * 6, pa.list_(pa.int32())]
    for i in range(0, len(rows), 20_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 20_000]), types)], names=names)


def summed_before(df: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows ahead in ``order``, which must be unique.

    Rows are dealt into ranges of the order; only one total per range is gathered.
    """
    ranged = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sums = sorted((r["_range"], r["n"]) for r in ranged.groupBy("_range").agg(F.sum(value).alias("n")).collect())  # one row per partition
    ahead = np.append(0, np.cumsum([n for _, n in sums])).tolist()
    offsets = df.sparkSession.createDataFrame([(r, n) for (r, _), n in zip(sums, ahead)], "_range int, _ahead long")
    within = F.sum(value).over(Window.partitionBy("_range").orderBy(*order)) - F.col(value)
    return ranged.withColumn("_within", within).join(F.broadcast(offsets), "_range").withColumn(name, F.col("_ahead") + F.col("_within")).drop("_range", "_ahead", "_within")


def by_turns(tokens: DataFrame, starts: DataFrame, totals: DataFrame, window: int, weights: dict[str, float] | None, grain: int, max_broadcast_rows: int, with_ids: bool) -> DataFrame:
    """The pieces for any number of sources: offsets of turns are running sums over (round, queue)."""
    spark = tokens.sparkSession
    sources = stored(summed_before(totals.withColumn("one", F.lit(1)), [F.desc("n"), F.asc("source")], "one", "queue"))
    if weights is None:
        whole = sources.agg(F.sum("n")).first()[0]
        share = F.col("n") / F.lit(float(whole))
    else:
        given = spark.createDataFrame([("=" + s, float(w)) for s, w in weights.items()], "source string, weight double")
        sources = sources.join(given, "source", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
        whole = math.fsum(r["weight"] for r in sources.filter("weight > 0").select("weight").collect())  # at most as many as were given
        share = F.col("weight") / F.lit(whole or 1.0)
    sources = sources.select(
        "source",
        "queue",
        F.col("n").alias("total"),
        F.greatest(F.lit(1), F.ceil(share * window * FINE)).cast("long").alias("quantum"),
        F.expr(f"(queue * 2654435761L % 4096) * {grain * FINE} div 4096").alias("credit"),
    )
    placed = tokens.join(few(starts.join(sources, "source"), max_broadcast_rows), ["source", "part"])

    def cut(batches, with_raw):
        for b in batches:
            out = []
            cols = [b.column(c).to_pylist() for c in ("doc_id", "source", "queue", "total", "quantum", "credit", "start", "before", "n")]
            for doc, source, queue, total, quantum, credit, start, before, n, raw in zip(*cols, b.column("ids").to_pylist() if with_raw else [None] * b.num_rows):
                rounds, first = Rounds.of_one(total, quantum, credit, grain), start + before
                size = len(raw) // n if with_raw else 0
                for k, lo, hi in rounds.turns(0, first, n):
                    into = lo - int(rounds.served(k - 1)[0])
                    out.append((doc, source, n, queue, k, lo - first, hi - lo, into, raw[(lo - first) * size : (hi - first) * size] if with_raw else None))
            for i in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 20_000]), kinds)], names=names)

    names = ["doc_id", "source", "n", "queue", "round", "first", "length", "into", "raw"]
    kinds = [pa.int64(), pa.string(), *[pa.int64()] * 6, pa.binary()]
    schema = "doc_id long, source string, n long, queue long, round long, first long, length long, into long, raw binary"
    bare = placed.select("doc_id", "source", "queue", "total", "quantum", "credit", "start", "before", "n")
    turns = bare.mapInArrow(lambda batches: cut(batches, False), schema).groupBy("round", "queue").agg(F.sum("length").alias("size"))
    turns = summed_before(turns, [F.asc("round"), F.asc("queue")], "size", "ahead").select("round", "queue", "ahead")
    runs = placed.select(*bare.columns, "ids").mapInArrow(lambda batches: cut(batches, True), schema)

    def run(batches):
        for b in batches:
            out = []
            for doc, source, n, first, length, into, raw, ahead in zip(*(b.column(c).to_pylist() for c in ("doc_id", "source", "n", "first", "length", "into", "raw", "ahead"))):
                out += pieces_of(doc, source, n, first, raw, length, ahead + into, window, with_ids)
            yield from as_batches(out)

    return runs.join(turns, ["round", "queue"]).select("doc_id", "source", "n", "first", "length", "into", "raw", "ahead").mapInArrow(run, PIECES)
