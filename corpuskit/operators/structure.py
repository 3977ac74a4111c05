"""Units, blocks and chapters: flattening, bodies, counts, volume."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions import text as T
from corpuskit.operators.ordering import first_seen_ordinal, int_bucket, positions, running_total

# Block kinds that are shown before the root of a unit.
LEADING_KINDS = ("leading_bhashya", "intro_bhashya")


def explode_blocks(units: DataFrame, keep: Sequence[str] = ("text_slug", "chapter_id", "unit_id")) -> DataFrame:
    """One row per prose block with its 0-based index."""
    return units.select(*keep, F.posexplode("blocks").alias("block_idx", "block")).select(
        *keep, "block_idx", F.col("block.kind").alias("kind"), F.col("block.text").alias("text")
    )


def block_texts(blocks: Column | str = "blocks") -> Column:
    return F.transform(F.col(blocks) if isinstance(blocks, str) else blocks, lambda b: b["text"])


def with_body(units: DataFrame, out: str = "body") -> DataFrame:
    return units.withColumn(out, T.unit_body(F.col("root"), block_texts()))


def flatten_units(chapters: DataFrame) -> DataFrame:
    """Chapters with a nested ``units`` array to one row per unit, in order."""
    return chapters.select(*[c for c in chapters.columns if c != "units"], F.posexplode("units").alias("unit_pos", "unit")).select(
        *[c for c in chapters.columns if c != "units"], "unit_pos", "unit.*"
    )


def leading_split(units: DataFrame, lead_kinds: Sequence[str] = LEADING_KINDS) -> DataFrame:
    """Longest prefix of leading blocks, only where the unit has a root."""
    lead = F.transform("blocks", lambda b: b["kind"].isin(*lead_kinds))
    first_other = F.array_position(lead, F.lit(False))
    n_lead = (
        F.when(F.coalesce(F.col("root"), F.lit("")) == "", F.lit(0))
        .when(first_other > 0, first_other - 1)
        .otherwise(F.size("blocks"))
        .cast("int")
    )
    empty = F.slice("blocks", 1, 0)
    return units.withColumn("__n", n_lead).select(
        *units.columns,
        F.when(F.col("__n") > 0, F.slice("blocks", F.lit(1), F.greatest("__n", F.lit(1)))).otherwise(empty).alias("leading_blocks"),
        F.when(F.col("__n") < F.size("blocks"), F.slice("blocks", F.col("__n") + 1, F.greatest(F.size("blocks"), F.lit(1))))
        .otherwise(empty)
        .alias("trailing_blocks"),
    )


def leading_flags(blocks: DataFrame, keys: Sequence[str], index: str, lead: Column) -> DataFrame:
    """The same split on exploded blocks: is the block inside the leading run?"""
    marked = blocks.withColumn("__lead", lead)
    ends = marked.filter(~F.col("__lead")).groupBy(*keys).agg(F.min(index).alias("__end"))
    return (
        marked.join(ends, list(keys), "left")
        .withColumn("is_leading", F.col("__end").isNull() | (F.col(index) < F.col("__end")))
        .drop("__lead", "__end")
    )


def text_counts(units: DataFrame, pattern: str = T.SCRIPT_RUN, keys: Sequence[str] = ("text_slug",)) -> DataFrame:
    """Chapters, units, intros and words per text."""
    words = T.run_count(F.coalesce(F.col("root"), F.lit("")), pattern) + F.aggregate(
        F.transform(block_texts(), lambda t: T.run_count(t, pattern)), F.lit(0), lambda a, x: a + x
    )
    return units.groupBy(*keys).agg(
        F.count_distinct("chapter_id").alias("chapters"),
        F.count_if(F.col("kind") != "intro").alias("mantras"),
        F.count_if(F.col("kind") == "intro").alias("intros"),
        F.sum(words.cast("bigint")).alias("words"),
    )


def volume_rollup(units: DataFrame) -> DataFrame:
    """Units, characters and whitespace tokens per text and block kind, with totals.

    One scan: the root is exploded together with the blocks as kind ``root``.
    Level 0 = text and kind, 1 = text, 2 = kind over all texts, 3 = everything.
    """
    root = F.struct(F.lit("root").alias("kind"), F.coalesce(F.col("root"), F.lit("")).alias("text"))
    rest = F.transform("blocks", lambda b: F.struct(b["kind"].alias("kind"), b["text"].alias("text")))
    parts = units.select("text_slug", F.explode(F.concat(F.array(root), rest)).alias("p")).select(
        "text_slug",
        F.col("p.kind").alias("kind"),
        F.length("p.text").cast("bigint").alias("chars"),
        T.space_token_count(F.col("p.text")).cast("bigint").alias("tokens"),
    )
    measures = [
        F.count_if(F.col("kind") == "root").alias("units"),
        F.sum("chars").alias("chars"),
        F.sum("tokens").alias("tokens"),
    ]
    fine = parts.groupBy("text_slug", "kind").agg(*measures)
    # The cube runs over the few pre-aggregated rows, not over the blocks.
    return (
        fine.cube("text_slug", "kind")
        .agg(
            F.sum("units").alias("units"),
            F.sum("chars").alias("chars"),
            F.sum("tokens").alias("tokens"),
            (F.grouping("text_slug") * 2 + F.grouping("kind")).cast("int").alias("level"),
        )
        .select(
            F.coalesce("text_slug", F.lit("TOTAL")).alias("text_slug"),
            F.coalesce("kind", F.lit("all")).alias("kind"),
            "units",
            "chars",
            "tokens",
            "level",
        )
    )


def translation_estimate(volume: DataFrame, low: float = 2.5, high: float = 3.5) -> DataFrame:
    """Expected word range of a translation, from the grand total of the roll-up."""
    return volume.filter(F.col("level") == 3).select(
        "tokens",
        F.round(F.col("tokens") * F.lit(low), 0).cast("bigint").alias("words_low"),
        F.round(F.col("tokens") * F.lit(high), 0).cast("bigint").alias("words_high"),
    )


def assemble_units(nodes: DataFrame, keys: Sequence[str], pos: str = "pos", width: int = 65_536) -> DataFrame:
    """Give every node of a chapter its unit: verse number, or the prose run around it.

    ``nodes`` has ``is_verse``.  Prose before a verse forms one intro unit, prose
    after the last verse an outro that continues the intro numbering.  Adds
    ``island`` (verses seen so far), ``verse_no`` and, on prose rows,
    ``intro_no`` and ``is_outro``.
    """
    keys = list(keys)
    bucket = int_bucket(F.col(pos), width)
    counted = running_total(nodes, keys, [pos], bucket, F.col("is_verse").cast("int"), "island")
    prose = counted.filter(~F.col("is_verse"))
    runs = prose.groupBy(*keys, "island").agg(F.min(pos).alias("run_start"))
    numbered = positions(runs, keys, ["island"], int_bucket(F.col("island"), width), "intro_no").withColumn(
        "intro_no", F.col("intro_no") + 1
    )
    total = nodes.groupBy(*keys).agg(F.sum(F.col("is_verse").cast("bigint")).alias("n_verses"))
    numbered = numbered.join(total, keys).withColumn("is_outro", F.col("island") == F.col("n_verses")).drop("n_verses")
    verses = counted.filter("is_verse").withColumn("verse_no", F.col("island"))
    out = prose.join(numbered, [*keys, "island"])
    return verses.unionByName(out, allowMissingColumns=True)


def chapter_ordinals(nodes: DataFrame, keys: Sequence[str], chapter: str, pos: str) -> DataFrame:
    return first_seen_ordinal(nodes, keys, chapter, pos, "chapter_ord")


def parent_ordinals(chapters: DataFrame, keys: Sequence[str], parent: str, pos: str) -> DataFrame:
    return first_seen_ordinal(chapters.filter(F.col(parent).isNotNull()), keys, parent, pos, "parent_ord")


def unit_kind(type_attr: Column, unit_id: Column) -> Column:
    """Kind of a verse unit: the type attribute first, then the letter in the id."""
    declared = F.lower(F.coalesce(type_attr, F.lit("")))
    letter = F.regexp_extract(unit_id, r"_([A-Z])\d+$", 1)
    return (
        F.when((declared == "sutra") | (letter == "S"), "sutra")
        .when(declared == "shloka", "verse")
        .when((declared == "karika") | (letter == "K"), "karika")
        .otherwise("mantra")
    )


def unit_ordinal(unit_id: Column, running: Column) -> Column:
    digits = F.regexp_extract(unit_id, r"_[A-Z](\d+)$", 1)
    return F.coalesce(F.when(digits != "", digits.cast("bigint")), running)


def group_members(df: DataFrame, group: Sequence[str], order: Sequence[str], bucket: Column) -> DataFrame:
    """Members of a group in order, flat: one row each with its place and the group size."""
    sizes = df.groupBy(*group).agg(F.count("*").alias("group_size"))
    return positions(df, group, order, bucket, "member_pos").join(sizes, list(group))
