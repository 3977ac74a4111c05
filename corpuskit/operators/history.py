"""Latest-per-key reductions of user event tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.functions import text as T
from corpuskit.operators.ordering import top_per_group

# Length of the search history and of the resume list.
HISTORY_KEPT, RESUME_KEPT = 12, 4


def latest_state(events: DataFrame, keys: Sequence[str], order: Sequence[str], deleted: Column | None = None) -> DataFrame:
    """The newest row per key, combined before the shuffle; tombstones disappear."""
    rest = [c for c in events.columns if c not in keys]
    newest = events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("s")).select(*keys, "s.*")
    return newest if deleted is None else newest.filter(~deleted)


def recent_history(events: DataFrame, user: str = "user_id", query: str = "query", ts: str = "ts", keep: int = HISTORY_KEPT) -> DataFrame:
    """The last ``keep`` distinct trimmed queries of every user."""
    trimmed = events.withColumn(query, T.trim_space(F.col(query))).filter(F.col(query) != "")
    once = trimmed.groupBy(user, query).agg(F.max(ts).alias(ts))
    return top_per_group(once, [user], [F.desc(ts), F.asc(query)], keep)


def resume_list(positions: DataFrame, catalog: DataFrame, user: str, text: str, ts: str, keep: int = RESUME_KEPT) -> DataFrame:
    """The newest positions of a user whose text is still in the catalog."""
    return top_per_group(positions.join(catalog, text), [user], [F.desc(ts), F.asc(text)], keep)


def newest_first(rows: DataFrame, ts: str, *tie: str) -> DataFrame:
    return rows.orderBy(F.desc(ts), *tie)


def debounced(events: DataFrame, keys: Sequence[str], ts: str, gap_ms: int = 800, span: str = "day", tie: Sequence[str] = ()) -> DataFrame:
    """Events that stayed the last one of their key for ``gap_ms``.

    The rows are cut at ``span`` limits; the first event of the next filled span
    closes the last one of the span before.  Equal times are ordered by ``tie``.
    """
    keys = list(keys)
    staged = events.withColumn("__b", F.date_trunc(span, ts))
    starts = staged.groupBy(*keys, "__b").agg(F.min(ts).alias("__first"))
    nexts = starts.select(*keys, "__b", F.lead("__first").over(Window.partitionBy(*keys).orderBy("__b")).alias("__after"))
    inside = Window.partitionBy(*keys, "__b").orderBy(ts, *tie)
    following = F.coalesce(F.lead(ts).over(inside), F.col("__after"))
    waited = F.unix_millis(F.col("__next").cast("timestamp")) - F.unix_millis(F.col(ts).cast("timestamp"))
    return (
        staged.join(nexts, [*keys, "__b"])
        .withColumn("__next", following)
        .filter(F.col("__next").isNull() | (waited >= gap_ms))
        .drop("__b", "__after", "__next")
    )


def upsert_catalog(old: DataFrame, new: DataFrame, key: str, order: DataFrame | None = None) -> DataFrame:
    """New rows replace old ones with the same key; the canonical order is a table ``key, place``."""
    merged = old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)
    if order is None:
        return merged
    return merged.join(order, key, "left").orderBy(F.coalesce("place", F.lit(-1)), key)


def merge_new_only(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Existing records are never overwritten; only unknown keys are added."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti"), allowMissingColumns=True)
