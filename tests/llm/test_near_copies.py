import collections
import itertools
import random

import numpy as np
import pytest

from corpuskit.llm import near_copies as N
from corpuskit.llm import popcount_simhash as H


def plain_shingles(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in folded.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def plain_pairs(texts, least=0.8):
    """All pairs of ids whose shingle sets reach the similarity, by counting shared shingles."""
    sets = {i: plain_shingles(t) for i, t in texts.items()}
    where = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    shared = collections.Counter()
    for ids in where.values():
        shared.update(itertools.combinations(sorted(ids), 2))
    return {p for p, n in shared.items() if n >= least * (len(sets[p[0]]) + len(sets[p[1]]) - n)}


def groups(ids, pairs):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def check(texts, first, kept):
    """No near copies are left among the kept, and whoever went has a near copy in its group."""
    pairs = plain_pairs({i: texts[i] for i in first})
    missed = [p for p in pairs if p[0] in kept and p[1] in kept]
    group = groups(first, pairs)
    size = collections.Counter(group.values())
    assert all(size[group[i]] > 1 for i in set(first) - kept)
    assert {group[i] for i in kept} == set(group.values())
    return pairs, missed


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_documents_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    first = {r.doc_id for r in H.near_duplicates(docs).filter("doc_id = component_id").collect()}
    kept = {r.doc_id for r in N.keep(docs).select("doc_id").collect()}
    assert kept <= first
    pairs, missed = check(texts, first, kept)
    assert len(pairs) > 0 and len(missed) <= 0.02 * len(pairs)


def versions(rng, words, count, changes):
    for _ in range(count):
        text = list(words)
        for at in rng.sample(range(len(text)), changes):
            text[at] = f"v{rng.randrange(10**9)}"
        yield " ".join(text)


def test_hot_groups_and_blocks(spark, monkeypatch):
    """Versions of one text are a third of all rows, borderline ones too; blocks give the same."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    texts = list(versions(rng, base, 150, 2)) + list(versions(rng, [f"u{i}" for i in range(150)], 60, 3))
    texts += [" ".join(f"x{rng.randrange(5000)}" for _ in range(rng.randrange(1, 120))) for _ in range(250)]
    half = [f"h{i}" for i in range(100)]  # share half their words: candidates, no copies
    texts += [" ".join(half + [f"y{rng.randrange(10**6)}" for _ in range(60)]) for _ in range(40)]
    rng.shuffle(texts)
    texts = dict(enumerate(texts))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    first = {r.doc_id for r in H.near_duplicates(docs).filter("doc_id = component_id").collect()}
    for rows, leader in ((4096, 1000), (16, 5)):
        monkeypatch.setattr(N, "BLOCK_ROWS", rows)
        monkeypatch.setattr(N, "LEADER_ROWS", leader)
        kept = {r.doc_id for r in N.keep(docs).select("doc_id").collect()}
        pairs, missed = check(texts, first, kept)
        assert len(pairs) > 500 and len(missed) <= 0.005 * len(pairs)


def test_links_grow_with_rows():
    """A group of equal sketches gives one link a row, not all pairs."""
    sigs = np.zeros((2000, N.MINIMA), np.uint8)
    links, free = N.led(np.arange(2000), sigs, 90, 110)
    assert sum(len(o) for _, o in links) == 1999 and free.sum() == 1


def test_shingles_and_estimates():
    mul, add = N._mixers()
    rng = random.Random(5)
    for text in ("", " \t", "A b", "a B c d e", "the cat " * 300, "É é a b C d e f"):
        assert len(N.shingles(text)) == len(plain_shingles(text))
    a = [f"w{i}" for i in range(5000)]
    b = next(versions(rng, a, 1, 100))
    x, y = N.shingles(" ".join(a)), N.shingles(b)
    exact = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs((N.minima(x, mul, add) == N.minima(y, mul, add)).mean() - exact) < 0.12


def test_odd_documents(spark, odd_docs, no_docs):
    clash = odd_docs.withColumn("first_id", odd_docs.fp).withColumn("node", odd_docs.fp).withColumn("hashes", odd_docs.fp)
    for docs in (odd_docs, clash):
        kept = N.keep(docs)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == [-1, 1, 1, 2, 5, 6]
    assert N.keep(no_docs).count() == 0
