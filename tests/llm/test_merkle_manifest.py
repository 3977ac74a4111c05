import hashlib
import zlib

import pytest

from corpuskit.llm import merkle_manifest as M
from corpuskit.llm.queries import op12_merkle_manifest


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(digests):
    """Root, and the siblings (left, right) per level of every digest."""
    paths, level = [[] for _ in digests], list(digests)
    at = list(range(len(digests)))
    while len(level) > 1:
        for p, i in zip(paths, at):
            run = level[i // 3 * 3 : i // 3 * 3 + 3]
            p.append((run[: i % 3], run[i % 3 + 1 :]))
        level = [H("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
        at = [i // 3 for i in at]
    return level[0], paths


def plain(docs):
    """Sorted expected rows of (doc_id, text, lang, source, n_chars)."""
    by = {}
    for doc_id, text, lang, source, n_chars, *_ in docs:
        leaf = H("".join(map(field, (doc_id, source, lang, n_chars, text))))
        changed = leaf
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and text is not None:
            changed = H("".join(map(field, (doc_id, source, lang, n_chars, text.replace("\n", "")))))
        by.setdefault(source, []).append((doc_id, leaf, changed))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for rows in by.values():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    tops = {s: climb([r[1] for r in by[s]]) for s in names}
    root, above = climb([tops[s][0] for s in names])
    out = []
    for s, up in zip(names, above):
        for (doc_id, leaf, folded), own in zip(by[s], tops[s][1]):
            for left, right in own + up:
                folded = H("".join(left) + folded + "".join(right))
            out.append((doc_id, leaf, tops[s][0], root, H("".join("".join(a + b) for a, b in own + up)), folded, folded == root))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r)[:7] for r in df.collect()), key=repr)


@pytest.mark.parametrize("levels", [7, 2])
def test_query_by_brute_force(spark, sf, levels):
    """Small blocks give several rounds in every tree, also in that of the sources."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = plain([tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()])
    got = rows(op12_merkle_manifest(spark, sf) if levels == M.LEVELS else M.manifest(docs, claimed=M.without_newlines(), levels=levels))
    assert got == want and {r[6] for r in got} == {True, False}


def test_odd_documents(spark, odd_docs, no_docs):
    got = M.manifest(odd_docs, claimed=M.without_newlines(), with_proof=True)
    assert rows(got) == plain([tuple(r) for r in odd_docs.collect()])
    for r in got.collect():
        assert M.fold(r.leaf, r.lefts, r.rights) == r.root
    assert M.manifest(no_docs).count() == 0
    plainly = M.manifest(odd_docs)
    assert plainly.filter("verified").count() == 9


def test_uneven_sources(spark):
    """One source with most rows over several partitions, many with one row, a single document alone."""
    docs = [(i, f"t{i}\n", "en", "hot" if i % 3 else f"s{i}", i) for i in range(400)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    assert rows(M.manifest(table.repartition(7), claimed=M.without_newlines(), levels=2)) == plain(docs)
    assert rows(M.manifest(table.filter("doc_id = 3"), claimed=M.without_newlines())) == plain(docs[3:4])


def test_heap_and_paths():
    for n in (1, 2, 3, 4, 10, 28):
        leaves = [H(str(i)) for i in range(n)]
        root, paths = climb(leaves)
        levels = M.height(n)
        got, inbox = M.forward(leaves, levels)
        assert got == root
        assert M.backward(n, levels, inbox, [], []) == [(["".join(a) for a, _ in p], ["".join(b) for _, b in p]) for p in paths]
