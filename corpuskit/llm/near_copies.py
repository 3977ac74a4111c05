"""Near copies for a training corpus: the SimHash components, then word-shingle similarity.

Fingerprints within 3 bits find exact and almost equal texts.  Texts whose sets of five-word
shingles have a Jaccard similarity of 0.8 differ in about ten of 64 bits, far outside any
grid of bit counts, so documents that are the first of their SimHash component go through a
second search: 128 minima of hashed shingles per document, of which 20 bands of 5 are keys.
Documents with equal keys are candidates, equal minima estimate the similarity, and every link
is verified on the whole shingle sets.

A key's documents are not paired with each other.  They are taken in the order of their ids;
each one not yet taken leads, is linked to all that may be similar, and takes those that surely
are.  Groups of copies thus give a number of links that grows with their rows.  Keys of more
than ``BLOCK_ROWS`` rows are led block by block first, and only what was not taken is then
compared between the blocks.

Defined cases: a null text counts as empty; texts without a word are copies of one another;
texts of fewer than five words are one shingle; a repeated doc_id is one row per row, and rows
of one id share a fate; documents without an id stay; other columns are kept; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.components import roots
from corpuskit.llm.popcount_simhash import SEED, near_duplicates
from corpuskit.session import checkpointed, small_or_shuffled

BANDS, BAND_ROWS, MINIMA = 20, 5, 128
BLOCK_ROWS = 4096
LEADER_ROWS = 1000  # verified links of one leader per task
SLACK = 3 * 0.035  # three standard errors of the estimate at 0.8


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """The distinct hashes of the word shingles, sorted."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: only A-Z are folded, only ASCII white space splits
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(size))))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64))


def _mixers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, MINIMA, dtype=np.uint64)


def minima(hashes: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The upper halves of the smallest mixed hashes, one per mixer."""
    low = np.full(MINIMA, 2**64 - 1, np.uint64)
    mixed = (hashes ^ (hashes >> np.uint64(31)))[:, None]
    for at in range(0, len(mixed), 512):  # blocks that stay in the processor's cache
        np.minimum(low, (mixed[at : at + 512] * mul + add).min(axis=0), out=low)
    return low >> np.uint64(32)


def band_keys(low: np.ndarray) -> np.ndarray:
    parts = low[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(BAND_ROWS):
        key = (key ^ parts[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def sketches(docs: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, keys, sig) of every document with an id and a word."""

    def run(batches):
        mul, add = _mixers()
        for b in batches:
            ids, keys, sigs = [], [], []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                hashes = shingles(text, size)
                if len(hashes):
                    low = minima(hashes, mul, add)
                    ids.append(doc_id)
                    keys.append(band_keys(low))
                    sigs.append(low.astype(np.uint8).tobytes())  # the lowest byte of every minimum
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=["doc_id", "keys", "sig"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    return rows.mapInArrow(run, "doc_id long, keys array<long>, sig binary")


def led(ids: np.ndarray, sigs: np.ndarray, may: int, sure: int, split: np.ndarray | None = None) -> tuple[list, np.ndarray]:
    """Links (leader, other) as pairs of positions, and which rows no one took; rows are ordered by id.

    With ``split`` only rows on different sides are compared.
    """
    free, out = np.ones(len(ids), bool), []
    for at in range(len(ids) - 1):
        if not free[at]:
            continue
        rest = np.flatnonzero(free[at + 1 :]) + at + 1
        if split is not None:
            rest = rest[split[rest] != split[at]]
        if not len(rest):
            continue
        equal = (sigs[rest] == sigs[at]).sum(axis=1)
        out.append((at, rest[equal >= may]))
        free[rest[equal >= sure]] = False
    return out, free


def _groups(batches, names):
    """Whole groups of equal values in the first columns, from sorted batches, as slices of one table at a time."""
    kept = None
    for b in batches:
        table = pa.Table.from_batches([b])
        kept = (table if kept is None else pa.concat_tables([kept, table])).combine_chunks()
        cols = [kept[c].to_numpy() for c in names]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        if len(cuts):
            yield kept, np.append(0, cuts)
            kept = kept.slice(cuts[-1])
    if kept is not None and kept.num_rows:
        yield kept, np.array([0, kept.num_rows])


def _lead(rows: DataFrame, similarity: float, between: bool) -> DataFrame:
    """(key, u, v) of rows (key, i, j, side, doc_id, sig): links of each group, and u = v for rows no one took."""
    may = int(np.ceil((similarity - SLACK) * MINIMA))
    sure = int(np.ceil((similarity + 2 * SLACK / 3) * MINIMA))
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "doc_id")

    def run(batches):
        for table, ends in _groups(batches, ["key", "i", "j"]):
            key, ids = table["key"].to_numpy(), table["doc_id"].to_numpy()
            side = table["side"].to_numpy()
            sigs = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(-1, MINIMA)
            keys, us, vs = [], [], []
            for a, z in zip(ends[:-1], ends[1:]):
                links, free = led(ids[a:z], sigs[a:z], may, sure, side[a:z] if between else None)
                for at, others in links:
                    us.append(np.full(len(others), ids[a + at]))
                    vs.append(ids[a:z][others])
                    keys.append(np.full(len(others), key[a]))
                left = ids[a:z][free]
                us.append(left)
                vs.append(left)
                keys.append(np.full(len(left), key[a]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, us, vs)], names=["key", "u", "v"])

    return rows.mapInArrow(run, "key long, u long, v long")


def candidates(sketched: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(u, v), u < v: the pairs of documents to verify."""
    keyed = sketched.select("doc_id", "sig", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").count().filter("count > 1")
    sizes = sizes.select(F.col("key").alias("size_key"), F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks"))
    rows = keyed.join(sizes, keyed.key == sizes.size_key).select("key", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int").alias("i"), "blocks", "doc_id", "sig")
    rows = checkpointed(rows)
    first = checkpointed(_lead(rows.select("key", "i", F.col("i").alias("j"), F.col("i").alias("side"), "doc_id", "sig"), similarity, False))
    found = first.filter("u < v").select("u", "v")
    # Between the blocks of a key only what no one took in its own block is compared.
    left = first.filter("u = v").select(F.col("key").alias("left_key"), F.col("u").alias("left_id")).distinct()
    cut = rows.filter("blocks > 1").join(left, (F.col("key") == F.col("left_key")) & (F.col("doc_id") == F.col("left_id")), "left_semi")
    own = F.col("i")
    pairs = F.transform(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j != own), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    cut = cut.select("key", F.col("i").alias("side"), "doc_id", "sig", F.explode(pairs).alias("p")).select("key", "p.i", "p.j", "side", "doc_id", "sig")
    return found.unionByName(_lead(cut, similarity, True).filter("u < v").select("u", "v")).distinct()


def shingle_sets(docs: DataFrame, size: int = 5) -> DataFrame:
    """(set_id, hashes)."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = [shingles(t, size).view(np.int64) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("set_id"), pa.array(sets, pa.list_(pa.int64()))], names=["set_id", "hashes"])

    return docs.select(F.col("doc_id").cast("long").alias("set_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "set_id long, hashes array<long>")


def verified(pairs: DataFrame, docs: DataFrame, similarity: float = 0.8, size: int = 5) -> DataFrame:
    """The pairs (u, v) whose shingle sets reach the similarity exactly."""
    asked = checkpointed(pairs.select(F.explode(F.array("u", "v")).alias("asked_id")).distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(small_or_shuffled(asked), F.col("doc_id") == F.col("asked_id"), "left_semi")
    sets = checkpointed(shingle_sets(texts, size))
    # A leader's set is sent once per LEADER_ROWS of its links, so that no task holds all of a hot one.
    degree = pairs.groupBy(F.col("u").alias("lead_id")).agg(F.ceil(F.count("*") / LEADER_ROWS).cast("int").alias("salts"))
    leads = degree.join(sets, F.col("lead_id") == F.col("set_id")).select("lead_id", "salts", F.col("hashes").alias("a"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    salted = pairs.join(degree, F.col("u") == F.col("lead_id")).select("u", "v", F.pmod(F.xxhash64("v"), "salts").cast("int").alias("part"))
    both = salted.join(sets.select("set_id", F.col("hashes").alias("b")), F.col("v") == F.col("set_id"))
    both = both.join(leads.hint("merge"), (F.col("u") == F.col("lead_id")) & (F.col("part") == F.col("salt")))
    shared = F.size(F.array_intersect("a", "b"))
    return both.filter(shared >= F.lit(similarity) * (F.size("a") + F.size("b") - shared)).select("u", "v").distinct()


def keep(docs: DataFrame, similarity: float = 0.8, size: int = 5) -> DataFrame:
    """The document with the smallest doc_id of every group of near copies, all columns kept."""
    marks = near_duplicates(docs).filter("doc_id = component_id").select(F.col("doc_id").alias("first_id")).distinct()
    marks = checkpointed(marks)
    sketched = sketches(docs, size).join(marks, F.col("doc_id") == F.col("first_id"), "left_semi")
    links = checkpointed(verified(checkpointed(candidates(checkpointed(sketched), similarity)), docs, similarity, size))
    kept = marks.join(roots(links), F.col("first_id") == F.col("node"), "left_anti").select("first_id")
    return docs.join(kept, docs.doc_id == kept["first_id"], "left").filter(kept["first_id"].isNotNull() | docs.doc_id.isNull()).select(*[docs[c] for c in docs.columns])
