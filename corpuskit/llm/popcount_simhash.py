"""Near duplicates by SimHash, joined on a grid of per-segment bit counts.

A fingerprint's 64 bits are 16 segments of 4; its embedding is the 16 counts of set bits.
One changed bit moves one count by one, so the Manhattan distance of two embeddings is a
lower bound of the Hamming distance.  Fingerprints within 3 bits are therefore within 1 in
the first or in the last 8 counts.  Each half is a grid with unit cells: a fingerprint lies
in its own cell and also looks into the cells one step up in each of the 8 directions, which
meets every pair within 1 once.  Pairs of a cell are verified exactly by counting the bits
that differ.

Exact copies collapse to one fingerprint before the join.  A cell gives a forest over its
linked fingerprints instead of all its pairs, which leaves the components as they are.  Cells
with very many rows are cut into blocks, and every pair of blocks is a group of its own.

Defined cases: a null text counts as empty; documents without a word have fingerprint zero
and link like any other; a repeated doc_id is one row per row; a null doc_id is never the
smallest of a component unless all are null; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.components import roots
from corpuskit.session import checkpointed

SEED = 42
BLOCK_ROWS = 4096
SMALL_SHARE = 100_000  # a cell is cut into blocks above this part of all rows, so at most so many cells are


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of the word shingles, as an unsigned integer."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: only A-Z are folded, only ASCII white space splits
    if not words:
        return 0
    counts, n = np.zeros(64, np.int64), max(1, len(words) - shingle + 1)
    for at in range(0, n, 65_536):
        part = words[at : at + 65_536 + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def grid(fps: DataFrame) -> DataFrame:
    """(cell, home, fp): every fingerprint in its own cell and one step up, for both halves."""
    cells = []
    for side, shift in ((0, 32), (1, 0)):
        bits = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(0xFFFFFFFF))
        pairs = bits.bitwiseAND(F.lit(0x55555555)) + F.shiftright(bits, 1).bitwiseAND(F.lit(0x55555555))
        counts = pairs.bitwiseAND(F.lit(0x33333333)) + F.shiftright(pairs, 2).bitwiseAND(F.lit(0x33333333))
        own = counts + F.lit(side << 32)
        cells.append(F.struct(own.alias("cell"), F.lit(True).alias("home")))
        for i in range(8):
            free = F.shiftright(counts, 4 * i).bitwiseAND(F.lit(15)) < 4
            cells.append(F.when(free, F.struct((own + F.lit(1 << (4 * i))).alias("cell"), F.lit(False).alias("home"))))
    return fps.select("fp", F.explode(F.array(*cells)).alias("c")).filter("c is not null").select("c.cell", "c.home", "fp")


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links as (node, smallest node of the part it is linked with)."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def linked(key: np.ndarray, home: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within equal keys (sorted), as a forest: compare each row with the d-th row after it, for growing d."""
    ends = np.append(np.flatnonzero(np.diff(key)) + 1, len(key))
    left = np.repeat(ends, np.diff(np.append(0, ends))) - np.arange(len(key))  # rows from here to the group's end
    order = np.argsort(-left, kind="stable")
    left_sorted = -left[order]
    us, vs, held = [], [], 0
    for d in range(1, int(left.max(initial=0))):
        i = order[: np.searchsorted(left_sorted, -d, side="left")]
        near = i[(np.bitwise_count(fp[i] ^ fp[i + d]) <= max_bits) & (home[i] | home[i + d]) & (fp[i] != fp[i + d])]
        us.append(fp[near])
        vs.append(fp[near + d])
        held += len(near)
        if held > 1_000_000:  # keep only the forest of what was found so far
            u, v = local_roots(np.concatenate(us), np.concatenate(vs))
            us, vs, held = [u], [v], len(u)
    if not us or not sum(map(len, us)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return local_roots(np.concatenate(us), np.concatenate(vs))


def links(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """(u, v): a forest over the distinct fingerprints ``fp`` that differ in at most ``max_bits`` bits."""
    if max_bits > 3:
        raise ValueError("one step in each half covers at most 3 bits")
    cells = grid(fps)
    sizes = cells.groupBy("cell").count()
    total = cells.count()
    limit = max(BLOCK_ROWS, total // SMALL_SHARE)
    # At most total / limit <= SMALL_SHARE cells are cut, so they may be broadcast.
    cut = sizes.filter(F.col("count") > limit).select("cell", F.ceil(F.col("count") / limit).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    rows = cells.join(F.broadcast(cut), "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.select("cell", "home", "fp", F.explode(pairs).alias("p")).select("cell", "p.i", "p.j", "home", "fp")
    rows = rows.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "fp")

    def run(batches):
        kept = None
        for b in _with_end(batches):
            table = pa.Table.from_batches([b]) if b is not None else None
            if kept is not None:
                table = kept if table is None else pa.concat_tables([kept, table])
            if table is None or not table.num_rows:
                continue
            cols = [table[c].to_numpy() for c in ("cell", "i", "j")]
            new = np.any([c[1:] != c[:-1] for c in cols], axis=0)
            key = np.append(0, np.cumsum(new))
            whole = len(key) if b is None else int(np.searchsorted(key, key[-1]))  # the last group may go on
            kept = table.slice(whole).combine_chunks() if b is not None else None
            u, v = linked(key[:whole], table["home"].to_numpy()[:whole], table["fp"].to_numpy()[:whole], max_bits)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return rows.mapInArrow(run, "u long, v long").distinct()


def _with_end(batches):
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """One row per document: doc_id, fp and component_id, the smallest doc_id reachable by links."""
    rows = checkpointed(with_fingerprints(docs, shingle))
    groups = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    of = roots(links(groups.select("fp"), max_bits))
    groups = groups.join(of, groups.fp == of.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = groups.groupBy("root").agg(F.min("first_id").alias("component_id"))
    groups = groups.join(least, "root").select(F.col("fp").alias("group_fp"), "component_id")
    return rows.join(groups, rows.fp == groups.group_fp).select("doc_id", "fp", "component_id")


def one_per_component(docs: DataFrame, **options) -> DataFrame:
    """The documents with the smallest doc_id of their component, all columns kept.

    Of repeated rows with that doc_id all stay; documents without a doc_id stay.
    """
    marks = near_duplicates(docs, **options).filter("doc_id = component_id").select(F.col("doc_id").alias("_first")).distinct()
    return docs.join(marks, docs.doc_id == marks["_first"], "left").filter(marks["_first"].isNotNull() | docs.doc_id.isNull()).select(*[docs[c] for c in docs.columns])


def hex_fingerprint(fp) :
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
