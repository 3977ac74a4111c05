import numpy as np
import xxhash

from corpuskit.llm import popcount_simhash as H
from corpuskit.llm.components import roots


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    out = 0
    for bit in range(64):
        ones = sum(xxhash.xxh64_intdigest(g.encode(), 42) >> bit & 1 for g in grams)
        out |= (ones * 2 > len(grams)) << bit
    return out


def plain_components(fps):
    """Smallest index reachable over all pairs within 3 bits."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= 3) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints(odd_docs):
    for r in odd_docs.filter("doc_id <> 5 OR doc_id IS NULL").collect():
        assert H.fingerprint(r.text) == plain_fingerprint(r.text)
    assert H.fingerprint("İ ÀB Cd") == plain_fingerprint("İ ÀB Cd")
    assert H.fingerprint("wort " * 200_000) == plain_fingerprint("wort " * 5)


def test_documents_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = H.near_duplicates(docs).toPandas().sort_values("doc_id")
    fps, first = np.unique(got["fp"].to_numpy(), return_index=True)
    root = np.array(plain_components(fps))[np.searchsorted(fps, got["fp"])]
    want = got.assign(root=root).groupby("root")["doc_id"].transform("min")
    assert (want == got["component_id"]).all() and got["component_id"].nunique() < len(got)


def test_dense_groups_and_blocks(spark, monkeypatch):
    """A third of all fingerprints within few bits of one another, cut into blocks."""
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 2**63, dtype=np.int64)
    near = [int(centre) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 4), replace=False)) for _ in range(700)]
    far = rng.integers(-(2**62), 2**62, 1400, dtype=np.int64).tolist()
    fps = np.unique(np.array(near + far, np.int64))
    table = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    want = plain_components(fps)
    for rows in (4096, 20):
        monkeypatch.setattr(H, "BLOCK_ROWS", rows)
        found = {r.node: r.root for r in roots(H.links(table)).collect()}
        label = [found.get(int(f), int(f)) for f in fps]
        assert len(set(zip(want, label))) == len(set(want)) == len(set(label))


def test_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901), (901, 900), (5, 5)], "u long, v long")
    assert {r.node: r.root for r in roots(links).collect()} == {**{i: 0 for i in range(1, 301)}, 901: 900}


def test_odd_documents(spark, odd_docs, no_docs):
    got = H.near_duplicates(odd_docs).toPandas()
    by = {None if np.isnan(r.doc_id) else int(r.doc_id): (r.fp, r.component_id) for r in got.itertuples()}
    assert len(got) == 9 and by[2] == by[3] == by[4] == (0, 2) and by[7][1] == 1
    kept = H.one_per_component(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == [-1, 1, 1, 2, 5, 6]
    clash = odd_docs.withColumn("_first", odd_docs.fp).withColumn("component_id", odd_docs.fp)
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in H.one_per_component(clash).collect()) == [-1, 1, 1, 2, 5, 6]
    assert H.near_duplicates(no_docs).count() == 0 and H.one_per_component(no_docs).count() == 0
