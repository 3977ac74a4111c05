import numpy as np
import pytest

from corpuskit.llm import rabitq as R


def brute(ids, x, q_id, k):
    i = int(np.flatnonzero(ids == q_id)[0])
    score = x @ x[i]
    order = [j for j in np.lexsort((ids, -score)) if ids[j] != q_id][:k]
    return ids[order], score[order]


@pytest.mark.parametrize("probes,least", [(None, 0.9), (10_000, 0.999)])
def test_recall_and_scores(spark, probes, least):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index = R.build_index(rows)
    got = R.search(index, rows.filter("vec_id % 20 = 0"), k=20, probes=probes).toPandas()
    table = rows.toPandas()
    ids, x = table["vec_id"].to_numpy(), np.array(table["embedding"].tolist(), float)
    hits = 0
    for q, part in got.groupby("query_id"):
        want, _ = brute(ids, x, q, 20)
        hits += len(set(want) & set(part["vec_id"]))
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 21))
        exact = x[np.searchsorted(ids, part["vec_id"])] @ x[np.searchsorted(ids, [q])[0]]
        assert np.allclose(part["score"], exact, rtol=0, atol=1e-12) and (np.diff(part["score"]) <= 0).all()
    assert got["query_id"].nunique() == (ids % 20 == 0).sum()
    assert hits / len(got) >= least


def test_bounds_hold():
    rng = np.random.default_rng(0)
    x, q = rng.standard_normal((2000, 32)), rng.standard_normal((50, 32))
    rotation = R.random_rotation(32, 128, 1)
    code, length, aligned = R.encode(x, np.zeros(2000, int), np.zeros((1, 32)), rotation)
    signs = np.unpackbits(code, axis=1).astype(float) * 2 - 1
    guess = (q @ rotation) @ signs.T * (length / aligned / np.sqrt(128))
    bound = length * np.sqrt(1 - aligned**2) / aligned * 2.5 / np.sqrt(127) * np.linalg.norm(q, axis=1)[:, None]
    assert (np.abs(guess - q @ x.T) <= bound).mean() > 0.97


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1.0, inf]), (7, [1.0, None]), (8, [1.0]), (None, [1.0, 1.0]), (9, [0.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as list", "2 as score")
    got = R.nearest(vectors, vectors, k=2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got if r.query_id < 3] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (1, 1, 0, 1.0), (1, 2, 2, 1.0), (2, 1, 0, 1.0), (2, 2, 1, 1.0)]
    assert {r.query_id for r in got} == {0, 1, 2, 9}
    assert R.nearest(vectors.filter("false"), vectors, k=2).count() == 0
    assert R.nearest(vectors.filter("vec_id = 0"), vectors.filter("vec_id = 0"), k=2).count() == 0


def test_blocks_change_nothing(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    index = R.build_index(rows)
    asked = rows.filter("vec_id % 20 = 0")
    whole = R.search(index, asked, k=5).toPandas().sort_values(["query_id", "rank"])
    cut = R.search(index, asked, k=5, block_rows=16, block_queries=3).toPandas().sort_values(["query_id", "rank"])
    assert whole["vec_id"].tolist() == cut["vec_id"].tolist()
