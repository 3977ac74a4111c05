import zlib

import pytest

from corpuskit.llm import kd_shards as K
from corpuskit.llm.queries import op11_kd_tree_shards


def checked(rows, docs, shards):
    """Sizes, checksums and gapless slots against the documents; bytes per shard."""
    want = sorted((r[0] if r[0] is not None else -1, len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in docs)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in rows) == want
    assert {(r.law, r.grown_shard) for r in rows} <= {("bytes", None)}
    total = [0] * shards
    for s in range(shards):
        mine = [r for r in rows if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        total[s] = sum(r.size for r in mine)
    assert sum(total) == sum(w[1] for w in want)
    return total


def near_equal(total, largest, tolerance=0.005):
    """A level misses its median by at most half a document or half a tolerated digit; half of that reaches the next level's nodes."""
    mean = sum(total) / len(total)
    return all(abs(t - mean) <= largest + tolerance * mean for t in total)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text", "source").collect()
    rows = op11_kd_tree_shards(spark, f"/root/testdata/{sf}").collect()
    total = checked(rows, docs, 8)
    assert near_equal(total, max(len(d.text.encode()) for d in docs))
    # Equal texts share a shard, but for the groups that a cut may fall into.
    shard = {r.doc_id: r.shard for r in rows}
    groups = {}
    for d in docs:
        groups.setdefault(d.text, set()).add(shard[d.doc_id])
    assert sum(len(g) > 1 for g in groups.values()) <= 7


def test_cuts_by_brute_force(spark, sf):
    """Every cut is at the weighted median of its node along the widest dimension, to one digit."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tree = K.Tree(docs, 8, tolerance=0, group_tolerance=0)
    rows = K.joined(K.points(docs), tree.shared).collect()
    world = [max(r.dims[i] for r in rows) - min(r.dims[i] for r in rows) for i in range(3)]
    nodes = {(0, 8): rows}
    for level in tree.levels:
        for c in level.collect():
            mine = nodes.pop((c.first, c.shards))
            ends = [(min(r.dims[i] for r in mine), max(r.dims[i] for r in mine)) for i in range(3)]
            reach = [(b - a) / w for (a, b), w in zip(ends, world)]
            assert c.dim == reach.index(max(reach)) and c.low == ends[c.dim][0]
            digit = {id(r): int((r.dims[c.dim] - c.low) / c.span * K.STEPS) if c.span else 0 for r in mine}
            left = [r for r in mine if digit[id(r)] < c.bound[0]]
            same = [r for r in mine if digit[id(r)] == c.bound[0]]
            target = sum(r.size for r in mine) / 2
            assert sum(r.size for r in left) <= target <= sum(r.size for r in left) + sum(r.size for r in same)
            placed = {(r.doc_id, r.text_hash): r for r in mine}
            half = c.shards // 2
            nodes[c.first, half], nodes[c.first + half, c.shards - half] = [], []
            at = {r.doc_id: r.shard for r in tree.leaves.collect()}
            for r in placed.values():
                to = (c.first, half) if at[r.doc_id] < c.first + half else (c.first + half, c.shards - half)
                nodes[to].append(r)
                if digit[id(r)] != c.bound[0]:
                    assert (digit[id(r)] < c.bound[0]) == (to[0] == c.first)


def test_hot_group_and_odd_counts(spark):
    """A third of all rows are copies of one text, in one source; 5 shards."""
    docs = [(i, "copy " * 20 if i % 3 == 0 else f"text {i} " * (i % 17), "en", "hot" if i % 3 == 0 else f"s{i % 40}", i % 300) for i in range(3000)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    total = checked(K.assign(table, shards=5).collect(), docs, 5)
    assert near_equal(total, 200)
    by_bytes = K.assign(table, target_bytes=sum(total) // 3).collect()
    assert {r.shard for r in by_bytes} in ({0, 1, 2}, {0, 1, 2, 3})


def test_odd_documents(spark, odd_docs, no_docs, tmp_path):
    rows = K.assign(odd_docs, shards=8).collect()
    checked(rows, [tuple(r) for r in odd_docs.collect()], 8)
    assert K.assign(no_docs, shards=8).count() == 0
    clash = odd_docs.withColumn("shard", odd_docs.fp).withColumn("dims", odd_docs.fp).withColumn("size", odd_docs.fp)
    assert K.write(clash, str(tmp_path / "out"), shards=3) == 3
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 9 and set(back.columns) == set(clash.columns)
    got = {(r.doc_id, r.text): r.shard for r in back.collect()}
    assert got == {(r.doc_id, t.text): r.shard for r in K.assign(odd_docs, shards=3).collect() for t in odd_docs.collect() if t.doc_id == r.doc_id}
    with pytest.raises(ValueError):
        K.assign(odd_docs)
