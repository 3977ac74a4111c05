"""Running totals, positions and neighbours without one task per group.

A window partitioned by text alone sorts a whole text in one task.  Here every
group is cut into buckets that follow the order; the totals of the buckets (one
small row each) are accumulated first, and the rows are only ordered inside
their own bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_WIDTH = 65_536


def int_bucket(c: Column, width: int = BUCKET_WIDTH) -> Column:
    """Bucket of an integer order key; unique keys leave at most ``width`` rows in one."""
    return F.floor(c / F.lit(width)).cast("bigint")


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: Column, out: str, inclusive: bool = True
) -> DataFrame:
    """Sum of ``value`` over all rows up to this one, per group and in order.

    ``bucket`` must not decrease along ``order``.
    """
    keys = list(keys)
    staged = df.withColumn("__b", bucket).withColumn("__v", value.cast("bigint"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        staged.groupBy(*keys, "__b")
        .agg(F.sum("__v").alias("__s"))
        .select(*keys, "__b", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__o"))
    )
    inside = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.col("__o") + F.sum("__v").over(inside)
    if not inclusive:
        total = total - F.col("__v")
    return staged.join(offsets, [*keys, "__b"]).withColumn(out, total).drop("__b", "__v", "__o")


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, out: str = "pos") -> DataFrame:
    """0-based rank of every row inside its group."""
    return running_total(df, keys, order, bucket, F.lit(1), out, inclusive=False)


def first_seen_ordinal(
    df: DataFrame, keys: Sequence[str], entity: str, order: str, out: str = "ordinal", width: int = BUCKET_WIDTH
) -> DataFrame:
    """Number the entities of a group 1, 2, ... by their first appearance."""
    firsts = df.groupBy(*keys, entity).agg(F.min(order).alias("first_at"))
    ranked = positions(firsts, keys, ["first_at", entity], int_bucket(F.col("first_at"), width), out)
    return ranked.withColumn(out, F.col(out) + 1)


def neighbours(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, ident: str, prev: str = "prev_id", nxt: str = "next_id"
) -> DataFrame:
    """Previous and next ``ident`` in order; bucket edges meet through a small table."""
    keys = list(keys)
    staged = df.withColumn("__b", bucket)
    rank = F.struct(*order)
    edges = staged.groupBy(*keys, "__b").agg(
        F.min_by(F.col(ident), rank).alias("__first"), F.max_by(F.col(ident), rank).alias("__last")
    )
    across = Window.partitionBy(*keys).orderBy("__b")
    edges = edges.select(*keys, "__b", F.lag("__last").over(across).alias("__before"), F.lead("__first").over(across).alias("__after"))
    inside = Window.partitionBy(*keys, "__b").orderBy(*order)
    return (
        staged.join(edges, [*keys, "__b"])
        .withColumn(prev, F.coalesce(F.lag(ident).over(inside), F.col("__before")))
        .withColumn(nxt, F.coalesce(F.lead(ident).over(inside), F.col("__after")))
        .drop("__b", "__before", "__after")
    )


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """The first ``k`` rows of every group.

    The rank filter lets Spark drop rows before the shuffle (window group
    limit), so a hot group sends at most ``k`` rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)
