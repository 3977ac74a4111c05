import numpy as np

import corpus_pipeline
from corpuskit.llm import popcount_simhash, quality_net, toxic_segments, weak_pii
from corpuskit.llm.shared import encode, default_ranks
from test_near_copies import check as check_copies
from test_popcount_simhash import plain_components


def test_stages_by_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, tables = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        tables.append((docs.toPandas().set_index("doc_id"), docs))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    pieces = docs.toPandas()
    before = [t[0] for t in tables]  # quality, toxicity, near copies, personal data, packing: their inputs
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = quality_net.score_quality(tables[0][1], labels).filter("predicted = 1").toPandas()["doc_id"]
    assert sorted(before[1].index) == sorted(good)
    toxic = toxic_segments.score_toxicity(tables[1][1], labels).filter("predicted = 1").toPandas()["doc_id"]
    assert sorted(before[2].index) == sorted(set(good) - set(toxic)) and len(toxic)
    rows = before[2].sort_index()
    fps = np.array([popcount_simhash.fingerprint(t) for t in rows["text"]], np.uint64)
    first = rows.index[sorted(set(plain_components(fps)))].tolist()  # of the 3-bit components
    assert set(before[3].index) <= set(first)
    pairs, missed = check_copies(rows["text"].to_dict(), first, set(before[3].index))
    assert pairs and not missed
    for doc_id, text in before[4]["text"].items():
        assert not weak_pii.base_spans(text) and len(text) == before[4]["n_chars"][doc_id]
    tokens = sum(len(encode(t, default_ranks())) + 1 for t in before[4]["text"])
    assert pieces["length"].sum() == tokens and set(pieces["doc_id"]) == set(before[4].index)
    assert [s[0] for s in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_copies", "personal_data", "packing"]


def test_run_equals_the_stages(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0 and got.count() > 0


def test_odd_documents(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "/root/testdata/sf0.001")
        docs.count()
