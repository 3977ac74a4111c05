"""A training corpus from the documents: score, filter, remove near copies, mask, pack.

Every stage reads the Parquet that the stage before it wrote.  All stages but the last return
the columns of ``documents``; the last returns the packed pieces.  The scoring stages decide
by text alone, row by row.

In every stage a null text counts as an empty one, texts are read whole whatever their length,
an empty table gives an empty result, and further columns, whatever their names, are kept by
all stages but the last, which ignores them.  The functions state what else is defined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuskit.llm import mixture_packing, near_copies as copies, quality_net, toxic_segments, weak_pii
from corpuskit.llm.shared import stored


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Empty texts have the score that their empty features give; rows of equal texts, repeated
    rows included, share a fate; a null doc_id is kept or dropped by its text like any other.
    """
    return quality_net.keep(docs, labels(spark, sf_dir))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic.

    Empty texts hold no toxic passage; equal texts and repeated rows share a fate; a null
    doc_id is kept or dropped by its text.
    """
    return toxic_segments.keep(docs, labels(spark, sf_dir))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every near-copy group.

    Near copies are SimHash fingerprints within 3 bits, and texts whose five-word shingles have
    a Jaccard similarity of at least 0.8.  Texts without a word are copies of one another.  Of
    repeated rows with the smallest id all stay, and documents without an id stay, as nothing
    tells them apart.
    """
    return copies.keep(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the name of its kind.

    A null text stays null, repeated rows are masked alike, and n_chars follows the new text.
    """
    return weak_pii.mask(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2,048 ids.

    An empty text is its end id alone; repeated rows and null ids are packed as rows of their
    own; a null source is a source like any other.
    """
    return mixture_packing.pack(docs, window=2048, end_id=1)


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_copies", near_copies), ("personal_data", personal_data), ("packing", packing)]

ORACLE_SQL = None  # the classifiers and the tokenizer are beyond SQL; tests compare with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": (run, ORACLE_SQL)}
