"""Translations: merge by priority, fall back where none exists, batch out, take results in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions import text as T
from corpuskit.operators.ordering import int_bucket, positions

# Limits of the fallback text, of a batch and of a block sent out.
FALLBACK_CHARS, BATCH_UNITS, BLOCK_CHARS = 600, 8, 2400
FALLBACK_SOURCE = "prose-derived"
DRAFT_LICENSE = "ai-draft"


def first_block_text(blocks: Column | str = "blocks", chars: int = FALLBACK_CHARS) -> Column:
    """The first block with visible text, cut to ``chars`` with an ellipsis."""
    source = F.col(blocks) if isinstance(blocks, str) else blocks
    first = F.get(F.filter(source, lambda b: T.trim_space(b["text"]) != ""), F.lit(0))["text"]
    return F.concat(F.substring(first, 1, chars), F.when(F.length(first) > chars, "…").otherwise(""))


def capped_blocks(blocks: Column | str = "blocks", cap: int = BLOCK_CHARS) -> Column:
    """Blank blocks removed, the others trimmed and cut with a ``truncated`` flag."""
    source = F.col(blocks) if isinstance(blocks, str) else blocks
    texts = F.transform(source, lambda b: F.struct(b["kind"].alias("kind"), T.trim_space(b["text"]).alias("text")))
    return F.transform(
        F.filter(texts, lambda b: b["text"] != ""),
        lambda b: F.struct(
            b["kind"].alias("kind"), F.substring(b["text"], 1, cap).alias("text"), (F.length(b["text"]) > cap).alias("truncated")
        ),
    )


def prefer_files(entries: DataFrame, group: list[str], priority: str = "priority") -> DataFrame:
    """Keep, per source and language, only the entries of the best file kind."""
    best = entries.groupBy(*group).agg(F.min(priority).alias(priority))
    return entries.join(best, [*group, priority], "left_semi")


def build_meanings(
    units: DataFrame, entries: DataFrame, sources: DataFrame, fallback_chars: int = FALLBACK_CHARS, fallback_note: str = ""
) -> DataFrame:
    """Ordered entries per key: ``text_slug, key, seq, language, text, source_id``.

    Units without an entry of their own get their first block instead.  Order:
    primary sources, then reviewed before drafts, then language, then input order.
    ``units`` has ``text_slug, unit_id, blocks``; ``entries`` has ``text_slug, key,
    language, text, source_id, input_seq``; ``sources`` has ``source_id, is_primary,
    license``.
    """
    bare = units.join(entries.select("text_slug", F.col("key").alias("unit_id")), ["text_slug", "unit_id"], "left_anti")
    fallback = bare.select("text_slug", F.col("unit_id").alias("key"), first_block_text(chars=fallback_chars).alias("t")).filter(
        F.col("t").isNotNull()
    )
    made = fallback.select(
        "text_slug", "key", F.lit("en").alias("language"), F.concat(F.lit(fallback_note), "t").alias("text"),
        F.lit(FALLBACK_SOURCE).alias("source_id"), F.lit(0).cast("bigint").alias("input_seq"),
    )
    both = entries.select("text_slug", "key", "language", "text", "source_id", F.col("input_seq").cast("bigint")).unionByName(made)
    ranked = both.join(sources.select("source_id", "is_primary", "license"), "source_id", "left")
    ordered = ranked.select(
        "text_slug", "key", "language", "text", "source_id", "input_seq",
        F.when(F.col("is_primary"), 0).otherwise(1).alias("o_primary"),
        F.when(F.col("license") == DRAFT_LICENSE, 1).otherwise(0).alias("o_draft"),
        F.when(F.col("language") == "en", 0).otherwise(1).alias("o_language"),
    )
    # The bucket follows the order, so a key with very many entries is not sorted in one task.
    bucket = F.struct("o_primary", "o_draft", "o_language", int_bucket(F.col("input_seq")))
    placed = positions(ordered, ["text_slug", "key"], ["o_primary", "o_draft", "o_language", "input_seq"], bucket, "seq")
    return placed.select("text_slug", "key", F.col("seq").cast("int").alias("seq"), "language", "text", "source_id")


def used_sources(sources: DataFrame, meanings: DataFrame, drop_orphans: bool = False) -> DataFrame:
    """The source list that belongs to the output; the fallback source only if it was used."""
    used = meanings.select("source_id").distinct()
    kept = sources.join(used, "source_id", "left_semi") if drop_orphans else sources
    extra = used.join(sources, "source_id", "left_anti").filter(F.col("source_id") == FALLBACK_SOURCE)
    return kept.unionByName(extra, allowMissingColumns=True)


def meanings_for_units(units: DataFrame, meanings: DataFrame) -> DataFrame:
    """Entries of the root and of every block of a unit; ``block_idx`` -1 is the root."""
    slots = units.select(
        "text_slug", "unit_id", F.explode(F.sequence(F.lit(-1), F.size("blocks") - 1)).alias("block_idx")
    ).withColumn("key", F.when(F.col("block_idx") < 0, F.col("unit_id").cast("string")).otherwise(F.concat_ws("::block-", "unit_id", "block_idx")))
    return slots.join(meanings, ["text_slug", "key"], "left")


def first_by_language(meanings: DataFrame) -> DataFrame:
    return meanings.groupBy("text_slug", "key", "language").agg(F.min_by("text", "seq").alias("text"), F.min_by("source_id", "seq").alias("source_id"))


def prepare_batches(units: DataFrame, order: str, size: int = BATCH_UNITS, cap: int = BLOCK_CHARS) -> DataFrame:
    """Number the non-empty units of a text and cut them into batches of ``size``."""
    ready = units.withColumn("blocks", capped_blocks(cap=cap)).filter((F.coalesce("root", F.lit("")) != "") | (F.size("blocks") > 0))
    placed = positions(ready, ["text_slug"], [order], int_bucket(F.col(order)), "unit_pos")
    totals = ready.groupBy("text_slug").agg(F.ceil(F.count("*") / size).cast("int").alias("total_batches"))
    return placed.join(totals, "text_slug").withColumn("batch_index", F.floor(F.col("unit_pos") / size).cast("int"))


def reference_label(units: DataFrame, chapters: DataFrame) -> DataFrame:
    """``text title · chapter title · rest of the id`` for units of a known chapter."""
    joined = units.join(chapters.select("text_slug", "chapter_id", "text_title", "title"), ["text_slug", "chapter_id"], "left")
    rest = F.regexp_replace(F.substr("unit_id", F.length("chapter_id") + 1), "^_", "")
    label = F.concat(F.col("text_title"), F.lit(" · "), F.coalesce("title", "chapter_id"), F.lit(" · "), rest)
    return joined.withColumn("reference", F.when(F.col("text_title").isNotNull() & F.startswith("unit_id", F.col("chapter_id")), F.trim(label)).otherwise(F.col("unit_id")))


def flatten_results(results: DataFrame) -> DataFrame:
    """Result files to one row per translated piece; block items are strings or objects.

    ``results`` has ``dir_slug, file, slug`` and ``units`` with ``id, root_en, root_ml``
    and the arrays of JSON texts ``blocks_en, blocks_ml``.
    """
    unit = results.select("dir_slug", "file", "slug", F.posexplode("units").alias("unit_pos", "u"))

    def pieces(lang: str) -> Column:
        blocks = F.transform(
            F.coalesce(F.col(f"u.blocks_{lang}"), F.array().cast("array<string>")),
            lambda b, i: F.struct(
                F.lit(lang).alias("language"),
                F.concat(F.col("u.id"), F.lit("::block-"), i.cast("string")).alias("key"),
                F.when(F.startswith(F.ltrim(b), F.lit("{")), F.try_variant_get(F.try_parse_json(b), "$.text", "string"))
                .otherwise(F.try_variant_get(F.try_parse_json(b), "$", "string"))
                .alias("text"),
                F.lit(1).alias("shortest"),
            ),
        )
        root = F.struct(F.lit(lang).alias("language"), F.col("u.id").alias("key"), F.col(f"u.root_{lang}").alias("text"), F.lit(2).alias("shortest"))
        return F.concat(F.array(root), blocks)

    return unit.select(
        "dir_slug", "file", "slug", "unit_pos", F.col("u.id").alias("unit_id"), F.explode(F.concat(pieces("en"), pieces("ml"))).alias("p")
    ).select("dir_slug", "file", "slug", "unit_pos", "unit_id", "p.*")


def ingest_results(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``: the last file wins per key and language, bad pieces are reported.

    ``pieces`` has ``dir_slug, slug, file, unit_pos, unit_id, language, key, text,
    shortest``; a text must have ``shortest`` characters after trimming.
    """
    text = T.trim_space(F.coalesce("text", F.lit("")))
    reason = (
        F.when(F.col("slug") != F.col("dir_slug"), "slug mismatch")
        .when(F.coalesce("unit_id", F.lit("")) == "", "missing id")
        .when(F.length(text) < F.col("shortest"), "no text")
    )
    judged = pieces.withColumn("text", text).withColumn("reason", reason)
    accepted = (
        judged.filter(F.col("reason").isNull())
        .groupBy("slug", "language", "key")
        .agg(F.max_by("text", F.struct("file", "unit_pos")).alias("text"))
    )
    return accepted, judged.filter(F.col("reason").isNotNull()).select("dir_slug", "file", "unit_id", "language", "key", "reason")
