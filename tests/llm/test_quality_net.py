import numpy as np

from corpuskit.llm import quality_net as Q


def area(score, y):
    """Area under the curve of the true rates."""
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    ones = y.sum()
    return (rank[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = Q.score_quality(docs, labels)
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").toPandas()
    rows = rows[rows["held_out"]]
    assert area(rows["score"].to_numpy(), rows["quality"].to_numpy()) > 0.97
    assert (rows["predicted"] == rows["quality"]).mean() > 0.95
    # calibration: the mean score is near the share of label 1
    assert abs(rows["score"].mean() - rows["quality"].mean()) < 0.05


def test_labels_of_the_held_out_fold_do_not_matter(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    a, b = (Q.score_quality(docs, x).orderBy("doc_id").toPandas() for x in (labels, other))
    assert a["score"].tolist() == b["score"].tolist()


def test_context_sums_by_brute_force(spark, odd_docs):
    texts = [r.text for r in odd_docs.collect()]
    places, signs = Q.index_vectors(5)
    want, slots = np.zeros((Q.SLOTS + 1, Q.DIMS)), Q.Slots()
    for t in texts:
        w = slots.of(t)
        for i in range(len(w)):
            for j in range(max(0, i - Q.REACH), min(len(w), i + Q.REACH + 1)):
                if i != j:
                    for n in (0, 1):
                        want[w[i], places[w[j], n]] += signs[w[j], n]
    assert (Q.context_sums(odd_docs.repartition(3), 5) == want[: Q.SLOTS]).all()


def test_odd_documents(spark, odd_docs, no_docs, some_labels):
    got = Q.score_quality(odd_docs, some_labels).toPandas()
    assert len(got) == 9 and got["score"].between(0, 1).all() and set(got["predicted"]) <= {0, 1}
    assert got[got["doc_id"].isin([2, 3, 4])]["score"].nunique() == 1  # texts without a word score alike
    assert not got[got["doc_id"].isna()]["held_out"].any()
    assert Q.score_quality(no_docs, some_labels).count() == 0
    bare = Q.score_quality(odd_docs, some_labels.filter("false")).toPandas()
    assert (bare["score"] - 0.5).abs().max() < 1e-6
    kept = Q.keep(odd_docs, some_labels.filter("false"))
    assert kept.columns == odd_docs.columns and kept.count() == 9
