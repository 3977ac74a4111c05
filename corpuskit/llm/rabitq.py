"""Approximate nearest neighbours by inner product on randomly rotated one-bit codes.

Every vector is assigned to a coarse list; its residual to the list's centre is padded,
rotated by a fixed random rotation and kept as one sign bit per rotated component plus two
correction scalars: the residual's length and the inner product of the residual's direction
with its code.  From the packed bits a query estimates the inner product and an error bound;
a vector is reranked on the original numbers if its upper bound reaches the k-th best score
known so far.

Only the list centres are fitted, on at most ``sample_rows`` rows (a documented bound, the
rows with the smallest hashed ids); every row is indexed.  Lists and the queries that probe
them are cut into blocks, so that a list that holds a third of all rows is many tasks.

Defined cases: vectors that are null, zero, or hold a null or a non-finite component take no
part, neither do rows without an id; vectors of another length than the most frequent one
take no part; a repeated id counts once, with its best score; ties go to the smaller id; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.session import checkpointed


@dataclass(frozen=True)
class Index:
    """The coded rows (a checkpointed table) and the small model that reads them."""

    rows: DataFrame
    centres: np.ndarray
    rotation: np.ndarray
    dims: int


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows (vec_id, vec) that can take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).filter(finite & F.exists("vec", lambda x: x != 0))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dims)


def random_rotation(dims: int, code_dims: int, seed: int) -> np.ndarray:
    """``dims`` rows of a random orthogonal matrix of size ``code_dims``: padding and rotation in one step."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((code_dims, code_dims)))
    return (q * np.sign(np.diag(r)))[:dims]


def fit_centres(sample: np.ndarray, lists: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm on the bounded sample."""
    distinct = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    centres = distinct[rng.permutation(len(distinct))[:lists]]
    for _ in range(rounds):
        nearest = nearest_centre(sample, centres)
        counts = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - half, axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, int)])


def encode(x: np.ndarray, lists: np.ndarray, centres: np.ndarray, rotation: np.ndarray):
    """Packed sign bits, residual length and code alignment of every row."""
    rotated = (x - centres[lists]) @ rotation
    length = np.sqrt((rotated**2).sum(1))
    bits = rotated > 0
    aligned = np.abs(rotated).sum(1) / np.sqrt(rotation.shape[1]) / np.where(length > 0, length, 1)
    return np.packbits(bits, axis=1), length, np.where(length > 0, aligned, 1.0)


def build_index(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", lists: int | None = None, bits_per_dim: int = 4, sample_rows: int = 20_000, seed: int = 7) -> Index | None:
    """Code every usable row; None if there is none.

    ``lists`` defaults to a quarter of the square root of the row count, at most 4,096, so
    that fitting and assigning stay bounded.
    """
    rows = usable(vectors, id_col, vec_col)
    sizes = rows.groupBy(F.size("vec").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if sizes is None:
        return None
    dims, total = sizes["dims"], sizes["count"]
    rows = rows.filter(F.size("vec") == dims)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("vec").toArrow()
    lists = min(lists or max(1, round(total**0.5 / 4)), 4096)
    centres = fit_centres(matrix(sample["vec"], dims), lists, seed)
    rotation = random_rotation(dims, -(-dims * bits_per_dim // 8) * 8, seed)

    def coded(batches):
        for b in batches:
            x = matrix(b.column("vec"), dims)
            near = nearest_centre(x, centres)
            code, length, aligned = encode(x, near, centres, rotation)
            yield pa.RecordBatch.from_arrays(
                [pa.array(near, pa.int32()), b.column("vec_id"), b.column("vec"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(length), pa.array(aligned)],
                names=["list", "vec_id", "vec", "code", "length", "aligned"],
            )

    schema = "list int, vec_id long, vec array<double>, code binary, length double, aligned double"
    return Index(checkpointed(rows.mapInArrow(coded, schema)), centres, rotation, dims)


def search(index: Index, queries: DataFrame, k: int = 20, probes: int | None = None, epsilon: float = 2.5, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = 4096, block_queries: int = 1024) -> DataFrame:
    """The ``k`` nearest rows found for every query: query_id, rank, vec_id, score.

    ``probes`` lists are read per query, by default four fifths of them but at least 16;
    ``epsilon`` widens the error bounds (standard errors of the estimate).
    """
    centres, rotation, dims = index.centres, index.rotation, index.dims
    probes = min(len(centres), probes or max(16, round(len(centres) * 0.8)))
    spread = {r["list"]: r["far"] for r in index.rows.groupBy("list").agg(F.max("length").alias("far")).collect()}  # one row per list: at most 4,096
    farthest = np.array([spread.get(i, -1.0) for i in range(len(centres))])

    def probed(batches):
        for b in batches:
            x = matrix(b.column("vec"), dims)
            if not len(x):
                continue
            reach = x @ centres.T + np.sqrt((x**2).sum(1))[:, None] * np.maximum(farthest, 0) / np.sqrt(dims)
            reach[:, farthest < 0] = -np.inf
            chosen = np.argsort(-reach, axis=1, kind="stable")[:, :probes]
            row = np.repeat(np.arange(len(x)), chosen.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(chosen.ravel(), pa.int32()), b.column("vec_id").take(pa.array(row)), b.column("vec").take(pa.array(row))], names=["list", "query_id", "query"])

    asked = usable(queries, id_col, vec_col).filter(F.size("vec") == dims).mapInArrow(probed, "list int, query_id long, query array<double>")
    asked = checkpointed(asked)

    # Blocks of a list and of its queries, from two counts per list.
    def blocks(df: DataFrame, per: int, name: str) -> DataFrame:
        return df.groupBy("list").agg(F.ceil(F.count("*") / per).cast("int").alias(name))

    cut = blocks(index.rows, block_rows, "v_blocks").join(blocks(asked, block_queries, "q_blocks"), "list")
    cut = F.broadcast(cut)  # one row per list: at most 4,096
    sides = []
    for df, key, own, other in ((index.rows, "vec_id", "v", "q"), (asked, "query_id", "q", "v")):
        sides.append(
            df.join(cut, "list")
            .withColumn(f"{own}_block", F.pmod(F.xxhash64(key), F.col(f"{own}_blocks")).cast("int"))
            .withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)))
            .drop("v_blocks", "q_blocks")
            .groupBy("list", "v_block", "q_block")
        )

    def best(rows: pa.Table, asking: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and asking.num_rows:
            ids, x = rows["vec_id"].to_numpy(), matrix(rows["vec"], dims)
            q_ids, q = asking["query_id"].to_numpy(), matrix(asking["query"], dims)
            centre = centres[rows["list"][0].as_py()]
            code = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
            signs = np.unpackbits(code, axis=1).astype(np.float32) * 2 - 1
            length, aligned = rows["length"].to_numpy(), rows["aligned"].to_numpy()
            scale = (length / aligned / np.sqrt(signs.shape[1])).astype(np.float32)
            wide = length * np.sqrt(np.maximum(1 - aligned**2, 0)) / aligned * epsilon / np.sqrt(max(signs.shape[1] - 1, 1))
            turned = (q @ rotation).astype(np.float32)
            q_len = np.sqrt((q**2).sum(1))
            for at in range(0, len(q_ids), 256):
                part = slice(at, at + 256)
                guess = (turned[part] @ signs.T) * scale + (q[part] @ centre)[:, None]
                guess[q_ids[part, None] == ids] = -np.inf
                top = min(k, len(ids))
                first = np.argpartition(-guess, top - 1, axis=1)[:, :top]
                for i in range(len(guess)):
                    known = x[first[i]] @ q[at + i]
                    known[ids[first[i]] == q_ids[at + i]] = -np.inf
                    # slack for the single precision of the estimate
                    reach = np.flatnonzero(guess[i] + wide * q_len[at + i] >= known.min() - 1e-4 * (1 + abs(known.min()))) if np.isfinite(known.min()) else np.flatnonzero(ids != q_ids[at + i])
                    score = np.einsum("ij,j->i", x[reach], q[at + i])
                    order = np.lexsort((ids[reach], -score))[:k]
                    out.append((np.full(len(order), q_ids[at + i]), ids[reach][order], score[order]))
        cols = [np.concatenate([o[j] for o in out]) if out else np.zeros(0) for j in range(3)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    found = sides[0].cogroup(sides[1]).applyInArrow(best, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, **options) -> DataFrame:
    """Index ``vectors`` and search them for ``queries`` (both with vec_id, embedding)."""
    index = build_index(vectors, **options)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(index, queries, k)
