"""Helpers of the operators: stored tables, byte-pair ids, training rows."""

from __future__ import annotations

import base64
import functools
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.session import checkpoint_folder


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the checkpoint folder that all executors share, and read it back.

    Unlike a checkpoint the copy can be read column by column.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """Byte-pair encoder over the ranks file of a public vocabulary."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_ranks() -> str:
    """The 50k byte-level vocabulary; its ranks are the ids of ``byte_bpe_50k.json``."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode(text: str | None, path: str) -> np.ndarray:
    return np.array(encoder(path).encode_ordinary(text or ""), dtype=np.uint32)


def held_out(doc_id):
    """True for the fold that labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, y): at most ``rows`` labelled documents outside the held-out fold.

    The rows with the smallest hashed ids are taken, so the sample does not depend on the
    order or the partitions of the input.  Labels of documents that are not in ``docs`` take
    no part.  A repeated label row counts once, the larger label wins.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).join(texts.select("doc_id"), "doc_id", "left_semi")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return texts.join(F.broadcast(known), "doc_id")  # bounded by ``rows``


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
