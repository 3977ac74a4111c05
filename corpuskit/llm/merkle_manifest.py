"""Merkle manifest of a dataset by time-forward processing, with proofs delivered by a reversed sweep.

Every row is a leaf, the leaves of a source ascend by doc_id, every three neighbours have a
parent.  A node's label is its level and its number in the level.  A node that is finished
sends its digest to its parent's label; messages wait in a priority queue ordered by label, so
a parent meets all its children at the front of the queue.  The queue has two parts: inside a
block (``ARITY ** LEVELS`` neighbouring nodes, the part of the tree below one node) it is a
heap, between blocks it is Spark's sorted, spilling shuffle.  A round reduces a level by the
size of a block, so a source of n rows takes log(n) / log(2187) rounds, and no source, however
large, passes through one task.  The tree over the sources' roots is built in the same way.

The sweep back runs from the root down in reversed order: a node sends its children the
siblings on their way to the root, again inside blocks and then to the blocks below.  A proof
lists those siblings, left and right, level by level; folding a leaf with them gives a root.

Defined cases: a null field is hashed as ``-``; rows without doc_id come first in their source,
rows of one doc_id are ordered by leaf digest, equal rows are leaves of their own with equal
digests; rows without source form a source of their own, before all others; other columns are
not part of a leaf; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.llm.shared import stored
from corpuskit.session import small_or_shuffled

ARITY = 3
LEVELS = 7  # of a block
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "lefts array<string>, rights array<string>, subroot string, root string"


def digest(parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def forward(digests: list[str], levels: int) -> tuple[str, dict[tuple[int, int], list[str]]]:
    """Root of a block of ``levels`` levels, and the children's digests by parent label."""
    queue = [(1, i // ARITY, i, d) for i, d in enumerate(digests)] if levels else []  # sorted, so a heap
    inbox: dict[tuple[int, int], list[str]] = {}
    root = digests[0]
    while queue:
        label = queue[0][:2]
        children = []
        while queue and queue[0][:2] == label:
            children.append(heapq.heappop(queue)[3])
        inbox[label] = children
        root = digest(children)
        if label[0] < levels:
            heapq.heappush(queue, (label[0] + 1, label[1] // ARITY, label[1], root))
    return root, inbox


def backward(n: int, levels: int, inbox: dict, lefts: list[str], rights: list[str]) -> list[tuple[list[str], list[str]]]:
    """Siblings left and right of the way from every one of the ``n`` nodes to the root."""
    paths = {(levels, 0): (lefts, rights)}
    for label in sorted(inbox, reverse=True):
        lefts, rights = paths.pop(label)
        children = inbox[label]
        for i in range(len(children)):
            below = (label[0] - 1, label[1] * ARITY + i)
            paths[below] = (["".join(children[:i]), *lefts], ["".join(children[i + 1 :]), *rights])
    return [paths[0, i] for i in range(n)]


def fold(leaf: str, lefts: list[str], rights: list[str]) -> str:
    """The root that a leaf and its proof lead to."""
    for left, right in zip(lefts, rights):
        leaf = digest((left, leaf, right))
    return leaf


def leaf_digest(text: Column | None = None) -> Column:
    """Digest of the fields of a row; ``text`` may stand in for the column of that name."""
    fields = [F.col(c).cast("string") if c != "text" or text is None else text.cast("string") for c in FIELDS]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in fields)), 256)


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with pos (from 0) along ``order`` inside their tree, and the tree's number of rows n.

    The rows are sorted over all partitions and written; their number inside the partition and
    the counts of trees per partition give the position.  No tree is gathered.
    """
    line = F.monotonically_increasing_id()
    rows = stored(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("_line", line))
    part = F.shiftright("_line", 33)
    parts = rows.groupBy("tree", part.alias("_part")).agg(F.count("*").alias("_rows"), F.min("_line").alias("_first"))
    tree = Window.partitionBy("tree")  # at most one row per partition
    before = F.sum("_rows").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sums = stored(parts.select("tree", "_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_rows").over(tree).alias("n")))
    placed = rows.withColumn("_part", part).join(small_or_shuffled(sums), ["tree", "_part"])
    return placed.withColumn("pos", F.col("_before") + F.col("_line") - F.col("_first")).drop("_line", "_part", "_first", "_before")


def in_blocks(rows: DataFrame) -> DataFrame:
    """Rows sorted by tree, block and pos, every block whole in one partition."""
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def streamed(batches, names: list[str]):
    """The rows of sorted batches, as one (block, rows) after the other."""
    rows = (r for b in batches for r in zip(*(b.column(n).to_pylist() for n in names)))
    return groupby(rows, key=itemgetter(0, 1))


def batched(rows, schema: pa.Schema, size: int = 2000):
    """Record batches of a stream of tuples."""
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def block(levels: int) -> Column:
    return F.floor(F.col("pos") / F.lit(ARITY**levels)).cast("long").alias("block")


def up(nodes: DataFrame, levels: int) -> DataFrame:
    """One round: (tree, pos, digest, n) of the blocks' roots; n counts them, 1 is a tree's root."""
    schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("digest", pa.string()), ("n", pa.int64())])
    size = ARITY**levels

    def run(batches):
        def roots():
            for (tree, number), rows in streamed(batches, ["tree", "block", "pos", "digest", "n"]):
                rows = list(rows)
                n = rows[0][4]
                yield tree, number, forward([r[3] for r in rows], min(levels, height(n)))[0], -(-n // size)

        return batched(roots(), schema)

    return in_blocks(nodes.select("tree", block(levels), "pos", "digest", "n")).mapInArrow(run, "tree string, pos long, digest string, n long")


def rounds(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """The nodes of every round, the leaves first; a tree ends with the round where its n is 1."""
    out = [nodes]
    while out[-1].filter("n > 1").limit(1).count() or len(out) == 1:
        out.append(stored(up(out[-1] if len(out) == 1 else out[-1].filter("n > 1"), levels)))
    return out


def delivered(nodes: DataFrame, paths: DataFrame, levels: int) -> DataFrame:
    """One round back: the nodes with the path from each of them to the root; ``paths`` are those of their blocks.

    A block's path travels as one more row, before the block's nodes.
    """
    empty = [F.lit(None).cast("array<string>").alias(c) for c in ("lefts", "rights")] + [F.lit(None).cast("string").alias(c) for c in ("subroot", "root")]
    first = paths.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), *(F.lit(None).cast(t).alias(c) for c, t in (("digest", "string"), ("n", "long"), ("doc_id", "long"), ("claimed", "string"))), "lefts", "rights", "subroot", "root")
    rows = nodes.select("tree", block(levels), "pos", "digest", "n", "doc_id", "claimed", *empty)
    return in_blocks(rows.unionByName(first))


NAMES = ["tree", "block", "pos", "digest", "n", "doc_id", "claimed", "lefts", "rights", "subroot", "root"]


def swept(batches, levels: int):
    """(row, lefts, rights, subroot, root) of every node in a stream of delivered blocks."""
    for _, rows in streamed(batches, NAMES):
        head, *rows = rows
        high = min(levels, height(rows[0][4]))
        _, inbox = forward([r[3] for r in rows], high)
        for row, (lefts, rights) in zip(rows, backward(len(rows), high, inbox, head[7], head[8])):
            yield row, lefts, rights, head[9], head[10]


def down(nodes: DataFrame, paths: DataFrame, levels: int) -> DataFrame:
    """The paths (tree, pos, lefts, rights, subroot, root) of the nodes of one round."""
    texts = pa.list_(pa.string())
    schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("lefts", texts), ("rights", texts), ("subroot", pa.string()), ("root", pa.string())])

    def run(batches):
        return batched(((r[0], r[2], a, b, s, t) for r, a, b, s, t in swept(batches, levels)), schema)

    bare = nodes.withColumn("doc_id", F.lit(None).cast("long")).withColumn("claimed", F.lit(None).cast("string"))
    return delivered(bare, paths, levels).mapInArrow(run, "tree string, pos long, " + PATH)


def all_paths(found: list[DataFrame], tops: DataFrame, levels: int) -> DataFrame:
    """Paths of the blocks of leaves, from the paths ``tops`` of the trees' roots.

    ``found`` are the rounds; a tree's root is the single node of its last round.
    """
    paths = None
    for nodes in reversed(found[1:]):
        ends = nodes.filter("n = 1").select("tree", "pos").join(small_or_shuffled(tops), "tree")
        here = ends if paths is None else ends.unionByName(stored(down(nodes.filter("n > 1"), paths, levels)))
        paths = stored(here)
    return paths


def manifest(docs: DataFrame, claimed: Column | None = None, with_proof: bool = False, levels: int = LEVELS) -> DataFrame:
    """Per row: doc_id, leaf, subroot (of its source), root, proof_sha256, folded_root and verified.

    ``claimed`` is a text column whose leaf is folded with the proof instead of the row's own;
    ``with_proof`` adds the proof itself as the lists lefts and rights (siblings on either side,
    one entry a level, empty where there are none).  A block holds ``levels`` levels.
    """
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))  # null sorts first, the others bytewise
    other = F.lit(None).cast("string") if claimed is None else leaf_digest(claimed)
    leaves = stored(docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest().alias("digest"), other.alias("claimed")))
    leaves = ranked(leaves, ["doc_id", "digest"])
    found = rounds(leaves, levels)
    subroots = found[1].filter("n = 1")
    for nodes in found[2:]:
        subroots = subroots.unionByName(nodes.filter("n = 1"))
    # The tree over the sources has one name; a source's name is kept to send its path back.
    sources = ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"])
    above = rounds(sources, levels)
    top = above[-1].select("tree", F.array().cast("array<string>").alias("lefts"), F.array().cast("array<string>").alias("rights"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    of_sources = down(sources, all_paths(above, top, levels), levels).drop("subroot", "tree")
    tops = sources.select("pos", F.col("name").alias("tree"), F.col("digest").alias("subroot")).join(of_sources, "pos").drop("pos")
    paths = all_paths(found, stored(tops.select("tree", "lefts", "rights", "subroot", "root")), levels)
    texts = pa.list_(pa.string())
    fields = [("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())]
    schema = pa.schema(fields + ([("lefts", texts), ("rights", texts)] if with_proof else []))

    def rows(batches):
        for r, lefts, rights, subroot, root in swept(batches, levels):
            folded = fold(r[6] or r[3], lefts, rights)
            proof = digest(s for pair in zip(lefts, rights) for s in pair)
            row = (r[5], r[3], subroot, root, proof, folded, folded == root)
            yield (*row, lefts, rights) if with_proof else row

    out = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    out += ", lefts array<string>, rights array<string>" if with_proof else ""
    return delivered(leaves, paths, levels).mapInArrow(lambda b: batched(rows(b), schema), out)


def without_newlines() -> Column:
    """Tampering by rule: rows whose hashed doc_id is even lose the line breaks of their text."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.translate(F.col("text").cast("string"), "\n", "")).otherwise(F.col("text").cast("string"))


def oracle_sql(leaf_levels: int = 13, source_levels: int = 7) -> str:
    """The manifest in SQL, level by level, for up to 3^13 rows a source and 3^7 sources; CRC-32 is spelt out bit by bit."""
    field = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')".format
    leaf = "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars"))) + " || {0})"
    crc = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: [ord(substr(doc_id::VARCHAR, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295)"
    own, changed = leaf.format(field("text")), leaf.format(field("replace(text, chr(10), '')"))
    parts = [
        f"base AS (SELECT doc_id, coalesce('s' || source, '') AS tree, {own} AS leaf, CASE WHEN {crc} % 2 = 0 THEN {changed} ELSE {own} END AS claimed FROM documents)",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY tree) AS n FROM base)",
        "a0 AS (SELECT tree, p AS i, leaf AS d, n FROM placed)",
    ]
    level = "{0}{2} AS (SELECT {1}, i // 3 AS i, CASE WHEN max(n) = 1 THEN max(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d, (max(n) + 2) // 3 AS n FROM {0}{3} GROUP BY {1}, i // 3)"
    parts += [level.format("a", "tree", k + 1, k) for k in range(leaf_levels)]
    parts += [f"b0 AS (SELECT 0 AS one, row_number() OVER (ORDER BY tree) - 1 AS i, d, count(*) OVER () AS n, tree FROM a{leaf_levels})"]
    parts += [level.format("b", "one", k + 1, k) for k in range(source_levels)]
    parts += ["f0 AS (SELECT doc_id, leaf, tree, p, claimed AS f, '' AS proof FROM placed)"]
    side = "coalesce((SELECT string_agg(d, '' ORDER BY i) FROM {0}{1} s WHERE {2} s.i // 3 = f.{3} // {4} AND s.i {5} f.{3} // {6}), '')"
    step = "f{0} AS (SELECT doc_id, leaf, g.tree, p{7}, CASE WHEN x.n = 1 THEN f ELSE sha256(l || f || r) END AS f, proof || l || r AS proof FROM (SELECT f.*, {1} AS l, {2} AS r FROM f{3} f) g JOIN {4} x ON {5} x.i = g.{6})"
    for k in range(leaf_levels):
        both = [side.format("a", k, "s.tree = f.tree AND", "p", 3 ** (k + 1), o, 3**k) for o in "<>"]
        parts.append(step.format(k + 1, *both, k, f"a{k}", "x.tree = g.tree AND", f"p // {3**k}", ""))
    parts.append(f"g0 AS (SELECT f.*, b0.i AS q, b0.d AS subroot FROM f{leaf_levels} f JOIN b0 ON b0.tree = f.tree)")
    for k in range(source_levels):
        both = [side.format("b", k, "", "q", 3 ** (k + 1), o, 3**k) for o in "<>"]
        text = step.format(k + 1, *both, k, f"b{k}", "", f"q // {3**k}", ", q, subroot").replace("FROM f", "FROM g")
        parts.append("g" + text[1:])
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = d AS verified FROM g{source_levels}, b{source_levels}"
    )
