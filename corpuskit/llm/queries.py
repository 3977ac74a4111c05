"""The registered queries of the operators: ``QUERIES`` maps a name to (function, oracle SQL or None)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpuskit.llm import (
    kd_shards,
    license_sentences,
    line_frequency,
    merkle_manifest,
    mixture_packing,
    periodic_runs,
    popcount_simhash,
    quality_net,
    rabitq,
    sampled_pieces,
    token_rollups,
    toxic_segments,
    weak_pii,
)
from corpuskit.session import checkpoint_folder


def table(spark, sf: str, name: str):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_rabitq_search(spark, sf):
    """Every 20th vector asks for its 20 nearest rows by inner product."""
    vectors = table(spark, sf, "embeddings")
    return rabitq.nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op2_mixture_packing(spark, sf):
    """All documents packed into sequences of 2,048 ids, every window with the corpus's mixture of sources."""
    pieces = mixture_packing.pack(table(spark, sf, "documents"), window=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")


def op3_quality_net(spark, sf):
    """Quality score of every document."""
    return quality_net.score_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op4_line_frequency(spark, sf):
    """Base figures and verdict of every document."""
    return line_frequency.judge(table(spark, sf, "documents"))


def op5_license_sentences(spark, sf):
    """License sentences and licenses of every document."""
    return license_sentences.scan(table(spark, sf, "documents"))


def op6_token_rollups(spark, sf):
    """Totals after three batches: all documents inserted, all recounted by a newer tokenizer, those of label quality 0 deleted; every batch is sent twice."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    ledger = token_rollups.Ledger(spark, f"{checkpoint_folder(spark)}/ledger-{uuid.uuid4().hex}")
    batches = [
        token_rollups.changes(docs, "insert", token_rollups.SPACE_WORDS),
        token_rollups.changes(docs, "revise", token_rollups.SCRIPT_RUNS),
        token_rollups.changes(labels.filter("quality = 0"), "delete"),
    ]
    for number, batch in enumerate(batches, 1):
        ledger.commit(number, batch)
        ledger.commit(number, batch)
    return ledger.totals()


def op7_weak_pii(spark, sf):
    """Personal data of every document."""
    return weak_pii.find(table(spark, sf, "documents"))


def op8_sampled_pieces(spark, sf):
    """A sampled segmentation of every document: number and hash of its ids, and whether decoding gives the text back."""
    return sampled_pieces.sample(table(spark, sf, "documents"), seed=1, with_ids=False)


def op9_toxic_segments(spark, sf):
    """Toxicity score of every document, with the number of significant passages."""
    scored = toxic_segments.score_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


def op10_popcount_simhash(spark, sf):
    """Fingerprint and component of every document."""
    rows = popcount_simhash.near_duplicates(table(spark, sf, "documents"))
    return rows.select("doc_id", popcount_simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op11_kd_tree_shards(spark, sf):
    """All documents in 8 shards of near equal bytes."""
    return kd_shards.assign(table(spark, sf, "documents"), shards=8)


def op12_merkle_manifest(spark, sf):
    """Leaf, roots and proof of every document; half of the documents are verified with tampered texts."""
    return merkle_manifest.manifest(table(spark, sf, "documents"), claimed=merkle_manifest.without_newlines())


def op13_multiscale_minimizers(spark, sf):
    """Runs of every document, those with planted repeats included, and the text that is left without repeats."""
    return periodic_runs.find(table(spark, sf, "documents"), edit=periodic_runs.repeat_tail).drop("runs")


QUERIES = {
    "op1_rabitq_search": (op1_rabitq_search, None),
    "op2_mixture_packing": (op2_mixture_packing, None),
    "op3_quality_net": (op3_quality_net, None),
    "op4_line_frequency": (op4_line_frequency, line_frequency.ORACLE_SQL),
    "op5_license_sentences": (op5_license_sentences, license_sentences.oracle_sql()),
    "op6_token_rollups": (op6_token_rollups, token_rollups.ORACLE_SQL),
    "op7_weak_pii": (op7_weak_pii, None),
    "op8_sampled_pieces": (op8_sampled_pieces, None),
    "op9_toxic_segments": (op9_toxic_segments, None),
    "op10_popcount_simhash": (op10_popcount_simhash, None),
    "op11_kd_tree_shards": (op11_kd_tree_shards, None),
    "op12_merkle_manifest": (op12_merkle_manifest, merkle_manifest.oracle_sql()),
    "op13_multiscale_minimizers": (op13_multiscale_minimizers, None),
}
