import numpy as np

from corpuskit.llm import toxic_segments as X
from corpuskit.llm.shared import training_rows


def brute_segments(scores):
    """Definition: the best contiguous part, then the same on what is left and right of it."""

    def go(a, b):
        best, at = 0.0, None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > best + 1e-12:
                    best, at = total, (i, j + 1)
        return [] if at is None else go(a, at[0]) + [(*at, best)] + go(at[1], b)

    return go(0, len(scores))


def test_segments_by_definition():
    rng = np.random.default_rng(1)
    for _ in range(400):
        n = int(rng.integers(1, 30))
        positive = {i: float(rng.random() * 3) for i in range(n) if rng.random() < 0.4}
        got = X.maximal_segments(sorted(positive), [positive[i] for i in sorted(positive)], 0.7)
        want = brute_segments([positive.get(i, -0.7) for i in range(n)])
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want])


def test_segments_are_linear():
    n = 200_000
    assert X.maximal_segments(list(range(0, 2 * n, 2)), [1.0] * n, 0.5)[0][:2] == (0, 2 * n - 1)
    assert len(X.maximal_segments(list(range(0, 5 * n, 5)), [1.0] * n, 0.5)) == n


def test_decay_solves_the_moment_equation():
    x = X.decay(np.array([2.0, 3.0]), np.array([0.01, 0.02]), 0.5)
    assert abs(0.01 * np.exp(2 * x) + 0.02 * np.exp(3 * x) + 0.97 * np.exp(-0.5 * x) - 1) < 1e-6 and x > 0


def test_curve_on_separable_rows():
    """Newton steps must not run away where a curve could be as steep as it likes."""
    x = np.array([[-8.0, 0.0]] * 900 + [[9.0 + i % 7, 2.5] for i in range(100)])
    y = np.array([0.0] * 900 + [1.0] * 100)
    w = X.fit_curve(x, y)
    p = X.logistic(w[0] + x @ w[1:])
    assert p[y == 1].min() > 0.9 and p[y == 0].max() < 0.1


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = X.score_toxicity(docs, labels)
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").toPandas()
    rows = rows[rows["held_out"]]
    assert (rows["predicted"] == rows["toxic"]).mean() > 0.97
    assert rows[rows["toxic"] == 1]["predicted"].mean() > 0.85
    assert rows[rows["toxic"] == 0]["predicted"].mean() < 0.01
    assert rows[rows["predicted"] == 1]["passages"].map(len).min() >= 1


def test_odd_documents(spark, odd_docs, no_docs, some_labels):
    got = X.score_toxicity(odd_docs, some_labels).toPandas()
    assert len(got) == 9 and got["score"].between(0, 1).all()
    assert X.score_toxicity(no_docs, some_labels).count() == 0
    bare = X.score_toxicity(odd_docs, some_labels.filter("false")).toPandas()
    assert bare["score"].max() < 1e-6 and (bare["predicted"] == 0).all()
    assert X.keep(odd_docs, some_labels.filter("false")).count() == 9


def test_labels_of_missing_documents_use_up_no_rows(spark):
    docs = spark.range(0, 400, 20).selectExpr("id AS doc_id", "'some text' AS text")
    labels = spark.range(400).selectExpr("id AS doc_id", "0 AS toxic")
    every = {r.doc_id for r in training_rows(docs, labels, "toxic", 400).collect()}
    assert len(every) > 10 and {r.doc_id for r in training_rows(docs, labels, "toxic", len(every)).collect()} == every
    assert len(training_rows(docs, labels, "toxic", 5).collect()) == 5
