from collections import Counter

import numpy as np
import sentencepiece

from corpuskit.llm import sampled_pieces as S

ODD = ["", "▁", "a▁b  c\n\n d", " lead", "trail ", "日本語 \U0001F600 é\r\t", "\n", "  ", "x" * 3000, "don't,stop... (now)!"]


def all_paths(v, segment):
    out = {}

    def go(at, path, weight):
        if at == len(segment):
            out[tuple(path)] = weight
            return
        alone = v.ids.get(segment[at : at + 1])
        if not alone:
            go(at + 1, [*path, *[v.byte_id[b] for b in segment[at].encode()]], weight + v.fallback * len(segment[at].encode()))
        for end in range(at + 1, len(segment) + 1):
            hit = v.ids.get(segment[at:end])
            if hit:
                go(end, [*path, hit[0]], weight + hit[1])

    go(0, [], 0.0)
    return out


def test_samples_follow_the_lattice():
    v = S.pieces(S.default_model(), 0.5)
    for text in ("then", "thing é", "a日b"):
        want = all_paths(v, " " + text)
        total = sum(np.exp(w) for w in want.values())
        got = Counter(tuple(i.tolist()) for i in S.sample_chunk(v, [text] * 30_000, list(range(30_000)), 3))
        assert set(got) <= set(want)
        for path, weight in want.items():
            p = np.exp(weight) / total
            assert abs(got[path] / 30_000 - p) < 5 * np.sqrt(p * (1 - p) / 30_000) + 1e-4


def test_lossless(spark):
    v = S.pieces(S.default_model(), 0.5)
    ids = S.sample_chunk(v, ODD, list(range(len(ODD))), 1)
    assert [v.decode(i.tolist()) for i in ids] == ODD
    model = sentencepiece.SentencePieceProcessor(model_file=S.default_model())
    plain = [t for t in ODD if "▁" not in t and t]
    assert [model.decode(i.tolist()) for i, t in zip(ids, ODD) if t in plain] == plain
    got = S.sample(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), with_ids=False)
    assert got.filter("NOT lossless").count() == 0 and got.count() == 1000


def test_long_unbroken_text():
    """A segment of any length is walked in linear time and sampled as it is in short steps."""
    import time

    v = S.pieces(S.default_model(), 0.5)
    rng = np.random.default_rng(5)
    long = "".join(rng.choice(list("abcdefghij日本etaon"), 100_000))
    start = time.time()
    ids = S.sample_chunk(v, ["a b", long, "c d"], [1, 2, 3], 1)
    assert time.time() - start < 3 and [v.decode(i.tolist()) for i in ids] == ["a b", long, "c d"]
    same = long[:3000]
    walked = S.sample_chunk(v, ["x y", same], [1, 2], 1)
    limit, S.LONG = S.LONG, 10**9
    try:
        assert [w.tolist() for w in S.sample_chunk(v, ["x y", same], [1, 2], 1)] == [w.tolist() for w in walked]
    finally:
        S.LONG = limit


def test_reproducible_by_row_key(spark, odd_docs):
    a = S.sample(odd_docs.repartition(1)).toPandas().sort_values(["doc_id", "ids_crc32"])
    b = S.sample(odd_docs.repartition(5)).toPandas().sort_values(["doc_id", "ids_crc32"])
    assert a["ids_crc32"].tolist() == b["ids_crc32"].tolist()
    c = S.sample(odd_docs, seed=2).toPandas().sort_values(["doc_id", "ids_crc32"])
    assert a["ids_crc32"].tolist() != c["ids_crc32"].tolist()
    same = a[a["doc_id"] == 1]
    assert same["ids_crc32"].nunique() == 1 and a[a["doc_id"] == 7]["lossless"].all()


def test_odd_documents(spark, odd_docs, no_docs):
    got = S.sample(odd_docs)
    text = {(r.doc_id): r.text for r in S.decode(got).collect()}
    assert text == {r.doc_id: r.text or "" for r in odd_docs.collect()}
    assert S.sample(no_docs).count() == 0
    none = got.filter("doc_id IN (2, 3)").toPandas()
    assert (none["n_ids"] == 0).all() and none["lossless"].all()
