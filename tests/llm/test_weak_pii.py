import hashlib
import random
import re

import numpy as np
import pytest

from corpuskit.llm import weak_pii as P

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def plain(text):
    """The contract's patterns, as they stand."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], P.KINDS.index(s[2])))


def test_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab1.@-+ ()%29") for _ in range(rng.randint(0, 50))) for _ in range(5000)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    texts += ["4111 1111-1111 1111", "+1 (017) 555-7713", "0255.1.1.1 256.1.1.1 1.2.3.4.5.6.7.8", "a@b.c.d@e.f", "é4111111111111111"]
    for text in texts:
        assert P.base_spans(text) == plain(text)


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1" + "(" * 100_000, "a@" * 100_000):
        P.base_spans(text)
        P.candidates(text)


def test_em_finds_the_reliable_labelers():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    right = np.array([0.95, 0.9, 0.75, 0.6, 0.55])
    given = np.where(rng.random((4000, 5)) < right, 1, -1) * np.where(truth, 1, -1)[:, None] * (rng.random((4000, 5)) < 0.9)
    p = P.reliabilities(np.zeros(4000, int), given, np.ones(4000))
    assert ((p > 0.5) == truth).mean() > 0.95
    majority = (given.sum(1) > 0) == truth
    assert ((p > 0.5) == truth).mean() > majority.mean()


def test_query_digest(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = P.find(docs).toPandas().set_index("doc_id")
    for r in docs.collect():
        want, row = plain(r.text or ""), got.loc[r.doc_id]
        assert [row[f"n_{k}"] for k in P.BASE] == [sum(s[2] == k for s in want) for k in P.BASE]
        assert row["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in want).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for a, b, k in want} <= set(filter(None, row["spans"].split(",")))
    assert (got["spans"].str.contains("secret:")).any()  # the method adds spans


def test_mask(spark, odd_docs):
    rows = [(1, "write to joe@mail.example.com or +1 (017) 555-7713 now", 10), (2, "clean text 12", 13), (3, None, None), (4, 'token = "fb8d5f38e0a1b7c2d3e4f5a6b7c8d9e0f1a2b3c4"', 60)]
    docs = spark.createDataFrame(rows * 20, "doc_id long, text string, n_chars long").selectExpr("*", "'x' AS base")
    got = {r.doc_id: (r.text, r.n_chars) for r in P.mask(docs).collect()}
    assert got[1] == ("write to <EMAIL> or <PHONE> now", 31) and got[2] == ("clean text 12", 13) and got[3] == (None, None)
    assert got[4][0] == 'token = "<SECRET>"'
    assert P.mask(docs).columns == docs.columns


def test_odd_documents(odd_docs, no_docs):
    got = P.find(odd_docs).toPandas()
    assert len(got) == 9 and (got["spans"] == "").all() and (got["base_sha256"] == hashlib.sha256(b"").hexdigest()).all()
    assert P.find(no_docs).count() == 0 and P.mask(no_docs).count() == 0
    assert sorted(P.mask(odd_docs).collect(), key=repr) == sorted(odd_docs.collect(), key=repr)


@pytest.mark.parametrize("text", ["joe (at) mail.example (dot) com", "(017) 555-7713", "1234567890123456"])
def test_looser_shapes_are_candidates(text):
    assert P.candidates(text)
