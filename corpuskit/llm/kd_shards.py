"""Shards of near equal bytes by k-d tree partitioning over document metadata.

A node of the tree holds documents and stands for a number of shards.  It is cut along the
dimension (place of the source, place of the language, log of n_chars) in which its documents
reach furthest, measured against the whole table, at the weighted median: the place where the
bytes before it are the share of shards that go left.  All nodes of a level are cut together.

The medians are found without sorting: a document's place is a list of digits (its value in
65,536 steps of the node's extent, then 32 bits of the hash of its text, then 32 bits of the
hash of its doc_id).  A round counts bytes per node and next digit, which Spark sums before the
shuffle, and keeps the digit where the sum passes the median, until a digit holds a single row
or less than ``tolerance`` of a shard; the cut is at its nearer edge.  Rounds read a compact copy of the
metadata (no text); what a round leaves is one row per node.

Equal texts have one place (the smallest value of the group in every dimension, one hash), so
they share a shard; a group is only cut, by doc_id, where a median falls into one of more than
``group_tolerance`` of a shard.  A hot source, language or group thus spreads over as many
shards as its bytes fill.

Defined cases: a null text has no bytes (size 1); null source and language have a place of
their own, null n_chars counts as 0; rows equal in doc_id and text stay together; extra columns
are ignored by ``assign`` and kept by ``write``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.llm.shared import stored
from corpuskit.operators.ordering import positions
from corpuskit.session import small_or_shuffled

STEPS = 65_535
DIGITS = 5
SLOT_ROWS = 50_000  # rows numbered in one task


def place(name: Column) -> Column:
    """A fixed place in [0, 1) of a name."""
    return F.coalesce(F.pmod(F.xxhash64(name.cast("string")), F.lit(1 << 20)) / F.lit(float(1 << 20)), F.lit(-1.0))


def points(docs: DataFrame, keep: list[Column] | None = None) -> DataFrame:
    """Per row: doc_id, size, text_crc32, dims, text_hash; ``keep`` adds columns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    dims = F.array(place(F.col("source")), place(F.col("lang")), F.log1p(F.greatest(F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)), F.lit(0.0))))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        dims.alias("dims"),
        F.xxhash64(text).alias("text_hash"),
        *(keep or []),
    )
    return rows


def one_place(rows: DataFrame) -> DataFrame:
    """(text_hash, shared): the smallest value in every dimension, for the texts whose rows differ there."""
    ends = [(F.min(F.col("dims")[i]), F.max(F.col("dims")[i])) for i in range(3)]
    groups = rows.groupBy("text_hash").agg(F.array(*(a for a, _ in ends)).alias("shared"), F.array(*(b for _, b in ends)).alias("_most"))
    return groups.filter("shared <> _most").drop("_most")


def joined(rows: DataFrame, shared: DataFrame) -> DataFrame:
    rows = rows.join(small_or_shuffled(shared), "text_hash", "left")
    return rows.withColumn("dims", F.coalesce("shared", "dims")).drop("shared")


def digits() -> Column:
    """A row's place in its node, of which dim, low and span are known."""
    value = F.when(F.col("span") > 0, F.floor((F.get("dims", F.col("dim")) - F.col("low")) / F.col("span") * STEPS)).otherwise(0)
    row_hash = F.xxhash64("doc_id", F.lit(7))
    parts = [value, F.shiftrightunsigned("text_hash", 48), F.shiftrightunsigned("text_hash", 32) % 65_536, F.shiftrightunsigned(row_hash, 48), F.shiftrightunsigned(row_hash, 32) % 65_536]
    return F.array(*(p.cast("int") for p in parts))


def extents(rows: DataFrame, world: dict) -> DataFrame:
    """Per node: the dimension it is cut along, its low end and span, and the bytes that go left."""
    ends = rows.groupBy("first", "shards").agg(*(f(F.col("dims")[i]).alias(f"{n}{i}") for i in range(3) for n, f in (("low", F.min), ("high", F.max))), F.sum("size").alias("bytes"))
    reach = [((F.col(f"high{i}") - F.col(f"low{i}")) / F.lit(world[i] or 1.0)) for i in range(3)]
    widest = F.greatest(*reach)
    dim = F.when(reach[0] == widest, 0).when(reach[1] == widest, 1).otherwise(2)
    ends = ends.withColumn("dim", dim).withColumn("low", F.get(F.array("low0", "low1", "low2"), F.col("dim"))).withColumn("span", F.get(F.array("high0", "high1", "high2"), F.col("dim")) - F.col("low"))
    left = F.floor(F.col("shards") / 2)
    return ends.select("first", "shards", "dim", "low", "span", (F.col("bytes") * left / F.col("shards")).alias("target"))


def per_node(df: DataFrame, shards: int) -> DataFrame:
    """A table of one row a node, broadcast while the number of shards bounds it."""
    return F.broadcast(df) if shards <= 50_000 else df.hint("merge")


def medians(rows: DataFrame, nodes: DataFrame, shards: int, shard_bytes: float, tolerance: float, group_tolerance: float) -> DataFrame:
    """``nodes`` with the cut: rows whose first digits are below ``bound`` (or equal, if ``equal_left``) go left."""
    state = nodes.withColumn("bound", F.array().cast("array<int>")).withColumn("before", F.lit(0).cast("long"))
    state = state.withColumn("equal_left", F.lit(False)).withColumn("done", F.lit(False))
    finished = None
    for r in range(DIGITS):
        placed = rows.join(per_node(state, shards), ["first", "shards"]).withColumn("digits", digits())
        if r:
            placed = placed.filter(F.slice("digits", 1, r) == F.col("bound"))
        bins = placed.groupBy("first", "shards", F.col("digits")[r].alias("digit")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), (F.min("text_hash") == F.max("text_hash")).alias("one_text"))
        upto = F.sum("bytes").over(Window.partitionBy("first", "shards").orderBy("digit"))  # at most 65,536 rows a node
        bins = bins.withColumn("upto", upto).join(per_node(state, shards), ["first", "shards"])
        passed = bins.filter(F.col("before") + F.col("upto") >= F.col("target"))
        hit = passed.groupBy("first", "shards").agg(F.min_by(F.struct("digit", "bytes", "rows", "one_text", "upto"), "digit").alias("h"))
        state = state.join(per_node(hit, shards), ["first", "shards"]).withColumn("low_edge", F.col("before") + F.col("h.upto") - F.col("h.bytes"))
        small = (F.col("h.bytes") <= shard_bytes * tolerance) | (F.col("h.rows") == 1) | (F.col("h.one_text") & (F.col("h.bytes") <= shard_bytes * group_tolerance))
        nearer = F.col("low_edge") + F.col("h.bytes") - F.col("target") <= F.col("target") - F.col("low_edge")
        state = state.select("first", "shards", "dim", "low", "span", "target", F.concat("bound", F.array("h.digit")).alias("bound"), F.col("low_edge").alias("before"), nearer.alias("equal_left"), (small | F.lit(r + 1 == DIGITS)).alias("done"))
        state = stored(state)
        over = state.filter("done")
        finished = over if finished is None else finished.unionByName(over)
        state = state.filter("NOT done")
        if not state.limit(1).count():
            break
    return finished.select("first", "shards", "dim", "low", "span", "bound", "equal_left")


def step(rows: DataFrame, cuts: DataFrame, shards: int) -> DataFrame:
    """Send the rows of the nodes in ``cuts`` one level down."""
    rows = rows.join(per_node(cuts, shards), ["first", "shards"], "left").withColumn("_at", F.slice(digits(), 1, F.size("bound")))
    half = F.floor(F.col("shards") / 2).cast("int")
    right = (F.col("_at") > F.col("bound")) | ((F.col("_at") == F.col("bound")) & ~F.col("equal_left"))
    to = F.when(F.col("bound").isNull(), F.struct("first", "shards")).when(right, F.struct((F.col("first") + half).alias("first"), (F.col("shards") - half).alias("shards")))
    to = to.otherwise(F.struct("first", half.alias("shards")))
    return rows.withColumn("_to", to).withColumn("first", F.col("_to.first")).withColumn("shards", F.col("_to.shards")).drop("dim", "low", "span", "bound", "equal_left", "_at", "_to")


def rooted(rows: DataFrame, shards: int) -> DataFrame:
    return rows.withColumn("first", F.lit(0)).withColumn("shards", F.lit(shards))


class Tree:
    """A fitted tree: its number of shards, cuts level by level, and the compact rows at its leaves."""

    def __init__(self, docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, tolerance: float = 0.001, group_tolerance: float = 0.005):
        rows = stored(points(docs))
        self.shared = stored(one_place(rows))
        rows = joined(rows, self.shared)
        ends = [f(F.col("dims")[i]) for i in range(3) for f in (F.min, F.max)]
        *world, total, self.rows = rows.agg(*ends, F.sum("size"), F.count("*")).first()
        if shards is None:
            if not target_bytes or target_bytes < 1:
                raise ValueError("give a number of shards or the bytes of a shard")
            shards = max(1, -(-(total or 0) // target_bytes))
        self.shards, self.levels = shards, []
        rows = rooted(rows, shards)
        if self.rows:
            world = {i: world[2 * i + 1] - world[2 * i] for i in range(3)}
            most = shards
            while most > 1:
                rows = stored(rows)
                nodes = stored(extents(rows.filter("shards > 1"), world))
                self.levels.append(medians(rows, nodes, shards, total / shards, tolerance, group_tolerance))
                rows = step(rows, self.levels[-1], shards)
                most -= most // 2
        self.leaves = rows.withColumnRenamed("first", "shard").drop("shards")

    def place(self, docs: DataFrame, shard_col: str = "shard") -> DataFrame:
        """``docs`` with all their columns and the shard of every row."""
        rows = rooted(joined(points(docs, [F.struct("*").alias("_row")]), self.shared), self.shards)
        for cuts in self.levels:
            rows = step(rows, cuts, self.shards)
        names = [c for c in docs.columns if c != shard_col]
        return rows.select(*(F.col("_row")[c].alias(c) for c in names), F.col("first").alias(shard_col))


def assign(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, **options) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot (from 0 in every shard, by hashed doc_id) and grown_shard (null).

    Give the number of shards, or the bytes that a shard should reach.
    """
    tree = Tree(docs, shards, target_bytes, **options)
    buckets = tree.rows // SLOT_ROWS + 1
    slot_hash = F.xxhash64("doc_id", "text_hash")
    rows = tree.leaves.withColumn("_hash", slot_hash)
    rows = positions(rows, ["shard"], ["_hash", "doc_id", "text_hash"], F.floor((F.col("_hash") / 2.0**64 + 0.5) * buckets).cast("bigint"), "slot")
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write(docs: DataFrame, path: str, shards: int | None = None, target_bytes: int | None = None, **options) -> int:
    """Write ``docs`` as Parquet folders ``shard=N``, one task a shard; returns the number of shards."""
    tree = Tree(docs, shards, target_bytes, **options)
    tree.place(docs).repartition("shard").write.partitionBy("shard").mode("overwrite").parquet(path)
    return tree.shards
