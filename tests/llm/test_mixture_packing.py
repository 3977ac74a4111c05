import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuskit.llm import mixture_packing as M
from corpuskit.llm.shared import default_ranks, encode


def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def check(pieces, texts, window):
    """Every id once, gapless sequences, only the last one padded."""
    pieces = pieces.sort_values(["sequence_id", "offset"])
    seq = pieces.groupby("sequence_id")["length"].sum()
    assert seq.index.tolist() == list(range(len(seq))) and (seq.iloc[:-1] == window).all()
    assert (pieces["offset"] == pieces.groupby("sequence_id")["length"].cumsum() - pieces["length"]).all()
    t = tokenizer()
    for doc_id, text in texts.items():
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        own = pieces[pieces["doc_id"] == doc_id].sort_values("start")
        assert own["start"].tolist() == (own["length"].cumsum() - own["length"]).tolist() and own["length"].sum() == len(ids)
        assert (own["doc_tokens"] == len(ids)).all()
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own["start"], own["length"])] == own["ids_crc32"].tolist()


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = M.pack(docs).toPandas()
    check(got, docs.toPandas().set_index("doc_id")["text"].to_dict(), 2048)


def test_every_window_keeps_the_mixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = M.pack(docs).toPandas()
    share = got.groupby("source")["length"].sum() / got["length"].sum()
    per_window = got.groupby(["sequence_id", "source"])["length"].sum().unstack(fill_value=0)
    drift = (per_window.cumsum().sub(np.outer((np.arange(len(per_window)) + 1) * 2048, share), axis=0)).abs()
    # Over the windows so far every source is within its carried deficit and the round it is cut in.
    assert drift.iloc[:-2].max().max() <= 256 + 2048
    assert (per_window.iloc[:-2] > 0).sum(axis=1).min() > 1


def test_closed_form_is_deficit_round_robin():
    totals, window, grain = [5000, 1200, 77, 9000], 1024, 64
    rounds = M.Rounds(totals, None, window, grain)
    credit, served = rounds.start.astype(object) * 1, np.zeros(4, np.int64)
    for k in range(1, 40):
        for s in range(4):
            credit[s] += rounds.quantum[s]
            while credit[s] >= grain * M.FINE:
                credit[s] -= grain * M.FINE
                served[s] = min(totals[s], served[s] + grain)
        assert served.tolist() == rounds.served(k).tolist()
        assert all(0 <= c < grain * M.FINE for c in credit)
    places = sorted((at, n) for s in range(4) for _, n, at in rounds.places(s, 0, totals[s]))
    assert [a for a, _ in places] == np.append(0, np.cumsum([n for _, n in places])[:-1]).tolist()


def test_odd_documents(spark, odd_docs, no_docs):
    got = M.pack(odd_docs, window=128, with_ids=True).toPandas()
    assert got[got["doc_id"] == 1].groupby("start")["length"].count().eq(2).all()  # both repeated rows
    check(got.drop(columns="ids"), {2: "", 3: None, 4: " \t\n\r ", 5: "wort " * 30_000, 6: "A▁b  c\n\nÉcole\t\U0001F600"}, 128)
    assert got["doc_id"].isna().sum() >= 1 and got[got["doc_id"] == 3]["source"].isna().all()
    assert all(len(i) == n for i, n in zip(got["ids"], got["length"]))
    assert M.pack(no_docs).count() == 0


def test_shared_queue_keeps_everything(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = M.pack(docs, max_queues=3, max_broadcast_rows=1).toPandas()
    check(got, docs.toPandas().set_index("doc_id")["text"].to_dict(), 2048)


def test_ids_are_those_of_the_tokenizer_file(spark, sf):
    t = tokenizer()
    odd = ["", "<|endoftext|> x", "a" * 5000, "  \n\n x", "é日本\U0001F600\r\n", "don't 123,456 ###"]
    for text in odd + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(50).collect()]:
        assert encode(text, default_ranks()).tolist() == t.encode(text, add_special_tokens=False).ids


def test_many_sources_keep_their_own_deficits(spark, sf, odd_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", (F.col("doc_id") % 23).cast("string").alias("source"))
    docs = docs.unionByName(odd_docs.select("doc_id", "text", "source"))
    weights = {str(i): 2.0 ** -(i % 5) for i in range(0, 23, 2)}
    for given in (None, weights):
        whole = M.pack(docs, window=512, weights=given)  # one queue per source on the driver
        few = M.pack(docs, window=512, weights=given, max_queues=3, max_broadcast_rows=1)
        assert sorted(map(tuple, few.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)
