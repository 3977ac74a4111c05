"""Dotted references and human labels of units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions import text as T
from corpuskit.operators.ordering import int_bucket, positions

# Labels of chapter and unit kinds.
CHAPTER_LABELS = {
    "adhyaya": "अध्याय",
    "valli": "वल्ली",
    "pada": "पाद",
    "paada": "पाद",
    "khanda": "खण्ड",
    "brahmana": "ब्राह्मण",
    "brahmanam": "ब्राह्मण",
    "prashna": "प्रश्न",
    "mundaka": "मुण्डक",
    "prapathaka": "प्रपाठक",
    "anuvaka": "अनुवाक",
    "anuvaaka": "अनुवाक",
    "karika": "कारिका",
    "prakarana": "प्रकरण",
    "prakaranam": "प्रकरण",
}
UNIT_LABELS = {"mantra": "मन्त्र", "sutra": "सूत्र", "verse": "श्लोक", "karika": "कारिका", "intro": "भूमिका"}
PARENT_LABEL, OTHER_LABEL = "अध्याय", "विभाग"


def parse_reference(c: Column) -> Column:
    """One to three positive numbers, or null; a trailing dot is accepted."""
    clean = F.regexp_replace(T.trim_space(c), r"\.+$", "")
    parts = F.transform(F.split(clean, r"\."), lambda p: p.try_cast("bigint"))
    return F.when(clean.rlike(r"^[0-9]+(?:\.[0-9]+){0,2}$") & F.forall(parts, lambda p: p.isNotNull() & (p > 0)), parts)


def resolve_refs(refs: DataFrame, chapters: DataFrame, units: DataFrame, in_parent: bool = False) -> DataFrame:
    """``ref_id, status, unit_id`` for ``refs(ref_id, text_slug, ref)``.

    One number: the first chapter of the text.  Two: the chapter without parent,
    else the first chapter with that number.  Three: parent, chapter, unit.
    Intro units are never meant.  Each lookup is an equi-join.  With ``in_parent`` the middle
    number of three may also count the chapters of its parent from 1, if the chapter's own
    number leads nowhere; the column ``numbering`` then says which one was meant.
    ``chapters(text_slug, chapter_id, chapter_pos, chapter_ord, parent_ord)``,
    ``units(text_slug, chapter_id, unit_id, unit_pos, ordinal, kind)``.
    """
    asked = refs.withColumn("p", parse_reference(F.col("ref")))
    first = lambda: F.min_by("chapter_id", "chapter_pos").alias("chapter_id")
    top = F.coalesce("parent_ord", F.lit(0)) == 0
    at = lambda i: F.get("p", F.lit(i))

    def wanted(size: int, prio: int, table: DataFrame, keys: list[str], places: list[Column], leaf: Column) -> DataFrame:
        rows = asked.filter(F.size("p") == size).select("ref_id", "text_slug", *[c.alias(k) for k, c in zip(keys, places)], leaf.alias("ordinal"))
        return rows.join(table, ["text_slug", *keys]).select("ref_id", "text_slug", "chapter_id", "ordinal", F.lit(size).alias("numbers"), F.lit(prio).alias("prio"))

    ones = wanted(1, 0, chapters.groupBy("text_slug").agg(first()), [], [], at(0))
    flat = wanted(2, 0, chapters.filter(top).groupBy("text_slug", "chapter_ord").agg(first()), ["chapter_ord"], [at(0)], at(1))
    loose = wanted(2, 1, chapters.groupBy("text_slug", "chapter_ord").agg(first()), ["chapter_ord"], [at(0)], at(1))
    nested = wanted(
        3, 0, chapters.groupBy("text_slug", "parent_ord", "chapter_ord").agg(first()), ["parent_ord", "chapter_ord"], [at(0), at(1)], at(2)
    )
    places = ones.unionByName(flat).unionByName(loose).unionByName(nested)
    if in_parent:
        below = positions(chapters.filter(~top), ["text_slug", "parent_ord"], ["chapter_pos"], int_bucket(F.col("chapter_pos")), "place")
        counted = below.select("text_slug", "parent_ord", (F.col("place") + 1).alias("ord_in_parent"), "chapter_id")
        places = places.unionByName(wanted(3, 1, counted, ["parent_ord", "ord_in_parent"], [at(0), at(1)], at(2)))
    targets = units.filter(F.col("kind") != "intro").select("text_slug", "chapter_id", F.col("ordinal").cast("bigint"), "unit_id", "unit_pos")
    found = (
        places.join(targets, ["text_slug", "chapter_id", "ordinal"])
        .groupBy("ref_id")
        .agg(F.min_by(F.struct("unit_id", F.when(F.col("numbers") == 3, F.when(F.col("prio") == 1, "in parent").otherwise("chapter")).alias("numbering")), F.struct("prio", "unit_pos")).alias("u"))
        .select("ref_id", "u.*")
    )
    status = F.when(F.col("p").isNull(), "parse").when(F.col("unit_id").isNull(), "no-match").otherwise("ok")
    return asked.join(found, "ref_id", "left").select("ref_id", status.alias("status"), "unit_id", *(["numbering"] if in_parent else []))


def _label(kind: Column, labels: dict[str, str], other: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(kind)), other)


def describe_units(units: DataFrame, chapters: DataFrame) -> DataFrame:
    """A readable label per unit; ids of no known chapter keep their numbered parts.

    ``chapters(text_slug, chapter_id, chapter_ord, parent_ord, chapter_kind)``,
    ``units(text_slug, chapter_id, unit_id, kind, ordinal)``.
    """
    joined = units.join(
        chapters.select("text_slug", "chapter_id", "chapter_ord", "parent_ord", "chapter_kind", F.lit(True).alias("known")),
        ["text_slug", "chapter_id"],
        "left",
    )
    named = F.col("chapter_kind").isNotNull() & ~F.col("chapter_kind").isin("", "pseudo")
    parts = F.array(
        F.when(F.coalesce("parent_ord", F.lit(0)) != 0, F.concat_ws(" ", F.lit(PARENT_LABEL), "parent_ord")),
        F.when(named, F.concat_ws(" ", _label(F.col("chapter_kind"), CHAPTER_LABELS, F.lower("chapter_kind")), "chapter_ord")),
        F.concat_ws(" ", _label(F.col("kind"), UNIT_LABELS, F.col("kind")), F.when(F.coalesce("ordinal", F.lit(0)) != 0, F.col("ordinal"))),
    )
    label = F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), " · ")
    return joined.select(
        "text_slug", "unit_id", F.when(F.col("known") & (label != ""), label).otherwise(T.degraded_reference(F.col("unit_id").cast("string"))).alias("label")
    )


def chapter_by_prefix(ids: DataFrame, chapters: DataFrame, known: str = "unit_id") -> DataFrame:
    """The first chapter whose id starts the given id, by equi-join on every prefix length."""
    prefixes = ids.select("text_slug", known, F.explode(F.sequence(F.lit(1), F.length(known))).alias("n")).select(
        "text_slug", known, F.substr(known, F.lit(1), F.col("n")).alias("chapter_id")
    )
    return (
        prefixes.join(chapters.select("text_slug", "chapter_id", "chapter_ord"), ["text_slug", "chapter_id"])
        .groupBy("text_slug", known)
        .agg(F.min_by("chapter_id", "chapter_ord").alias("chapter_id"))
    )
