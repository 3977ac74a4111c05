"""Readers of the corpus, lexicon, translation, result, gold and utterance files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuskit import schemas
from corpuskit.functions import text as T


def read_chunks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(chunks, bad)``: one JSON file per chapter below ``path/<slug>/``; unreadable files are returned, not hidden."""
    raw = (
        spark.read.schema(schemas.CHUNK)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(f"{path}/*/*.json")
        .withColumn("file", F.col("_metadata.file_path"))
    )
    broken = F.col("chapter").isNull()
    return raw.filter(~broken).drop("_corrupt_record"), raw.filter(broken).select("file")


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(texts, chapters, units)`` of a corpus directory; bad chapter files are skipped."""
    chunks, _ = read_chunks(spark, path)
    chapters = chunks.select(
        F.col("textSlug").alias("text_slug"),
        F.col("chapter.id").alias("chapter_id"),
        F.col("chapter.ordinal").alias("chapter_ord"),
        F.col("chapter.titleSa").alias("title"),
        F.col("chapter.parentTitleSa").alias("parent_title"),
        F.col("chapter.parentOrdinal").alias("parent_ord"),
        F.col("chapter.kind").alias("chapter_kind"),
    )
    units = chunks.select(
        F.col("textSlug").alias("text_slug"),
        F.col("chapter.id").alias("chapter_id"),
        F.col("chapter.ordinal").alias("chapter_ord"),
        F.col("chapter.parentOrdinal").alias("parent_ord"),
        F.posexplode("chapter.units").alias("at", "u"),
    ).select(
        "text_slug", "chapter_id", "chapter_ord", "parent_ord", F.col("at").alias("unit_pos"), F.col("u.id").alias("unit_id"), "u.kind", "u.ordinal", "u.root", "u.blocks"
    )
    texts = chapters.groupBy("text_slug").agg(F.count("*").alias("chapters"))
    return texts, chapters, units


def read_published(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(chapters, units)`` of the chapter lines that :func:`corpuskit.sources.sinks.write_chunks` wrote."""
    lines = spark.read.text(path).select("text_slug", "chapter_id", F.from_json("value", schemas.CHUNK_LINE).alias("l"))
    heads = lines.filter("l.chapter IS NOT NULL").select(
        "text_slug", "chapter_id", F.col("l.chapter.ordinal").alias("chapter_ord"), F.col("l.chapter.titleSa").alias("title"),
        F.col("l.chapter.parentTitleSa").alias("parent_title"), F.col("l.chapter.parentOrdinal").alias("parent_ord"), F.col("l.chapter.kind").alias("chapter_kind"),
    )
    units = lines.filter("l.unit IS NOT NULL").select("text_slug", "chapter_id", "l.unit_pos", F.col("l.unit.id").alias("unit_id"), "l.unit.kind", "l.unit.ordinal", "l.unit.root", "l.unit.blocks")
    return heads, units


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(schemas.CATALOG).option("multiLine", True).json(path)
    return raw.select(F.posexplode("texts").alias("place", "t")).select("place", "t.*")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MANIFEST).option("multiLine", True).json(path)


def read_lexicon_dump(spark: SparkSession, path: str) -> DataFrame:
    """``rec, value``: records cut at line-start ``<L>``, in file order.

    ``rec`` counts the records of a file without ordering them in one task.
    """
    raw = spark.read.option("lineSep", "\n<L>").text(path).select(
        F.regexp_replace("value", "^<L>", "").alias("value"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    # Ids rise inside a read task; the block start orders the tasks of one file.
    return raw.withColumn("rec", F.struct("file", "block", "at"))


def read_lexicon_json(spark: SparkSession, path: str, dict_id: str) -> DataFrame:
    """``dict_id, head, iast, pos, en, ml, src`` from one JSON object per file."""
    raw = spark.read.option("wholetext", True).text(path)
    parsed = raw.select(F.explode(F.from_json("value", f"MAP<STRING, {schemas.LEXICON_ENTRY}>")).alias("head", "e"))
    return parsed.select(F.lit(dict_id).alias("dict_id"), "head", "e.*")


def translation_lines(raw: DataFrame) -> DataFrame:
    """``key, text`` of tab-separated lines: the first tab splits, the last duplicate wins.

    ``raw`` has ``value``, the group columns ``text_slug, source_id, language`` and
    ``line_no``.  Comments and blank lines are dropped.
    """
    line = F.regexp_replace("value", f"{T.SPACE}+$", "")
    rows = (
        raw.withColumn("line", line)
        .filter((F.col("line") != "") & ~F.startswith("line", F.lit("#")) & F.contains("line", F.lit("\t")))
        .withColumn("key", T.trim_space(F.substring_index("line", "\t", 1)))
        .withColumn("text", T.trim_space(F.expr("substr(line, instr(line, '\t') + 1)")))
        .filter((F.col("key") != "") & (F.col("text") != ""))
    )
    return rows.groupBy("text_slug", "source_id", "language", "key").agg(
        F.max_by("text", "line_no").alias("text"), F.max("line_no").alias("input_seq")
    )


def _file_parts(df: DataFrame) -> DataFrame:
    """Slug, source and language from ``.../<slug>/<source>.<language>.<ext>``."""
    pattern = r"([^/]+)/([^/]+)\.([a-z]{2})\.[a-z]+$"
    return df.select(
        "*",
        F.regexp_extract("file", pattern, 1).alias("text_slug"),
        F.regexp_extract("file", pattern, 2).alias("source_id"),
        F.regexp_extract("file", pattern, 3).alias("language"),
    )


def read_translations(spark: SparkSession, path: str) -> DataFrame:
    """All translation files below ``path/<slug>/``; a JSON file hides the TSV file of the same source and language."""
    from corpuskit.operators.meanings import prefer_files

    options = {"pathGlobFilter": "*.tsv", "recursiveFileLookup": True}
    lines = spark.read.options(**options).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")
    )
    # Byte at which the split starts plus the line's number in it: a line has at least one byte, so later splits have larger numbers.
    lines = lines.withColumn("line_no", F.col("block") + F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))).drop("block", "at")
    tsv = translation_lines(_file_parts(lines)).withColumn("priority", F.lit(1))
    whole = spark.read.options(pathGlobFilter="*.??.json", recursiveFileLookup=True, wholetext=True).text(path).select(
        "value", F.col("_metadata.file_path").alias("file")
    )
    pairs = _file_parts(whole).select("text_slug", "source_id", "language", F.posexplode(F.map_entries(F.from_json("value", "MAP<STRING, STRING>"))).alias("input_seq", "e"))
    json = pairs.select(
        "text_slug", "source_id", "language", F.col("e.key").alias("key"), F.col("e.value").alias("text"),
        F.col("input_seq").cast("bigint"), F.lit(0).alias("priority"),
    )
    return prefer_files(json.unionByName(tsv), ["text_slug", "source_id", "language"]).drop("priority")


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """Source registries ``<slug>/sources.json`` as rows."""
    raw = spark.read.schema(schemas.SOURCES).option("multiLine", True).json(f"{path}/*/sources.json")
    slug = F.regexp_extract("_metadata.file_path", r"([^/]+)/sources\.json$", 1)
    return raw.select(slug.alias("text_slug"), F.explode("sources").alias("s")).select(
        "text_slug", F.col("s.id").alias("source_id"), "s.citation", "s.license", F.col("s.publishedAt").alias("published_at"), F.col("s.isPrimary").alias("is_primary")
    )


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result files of translation batches, with the directory each was found in."""
    raw = spark.read.schema(schemas.RESULT).options(multiLine=True, pathGlobFilter="result-*.json").json(f"{path}/*/")
    file = F.col("_metadata.file_path")
    unit = lambda u: F.struct(
        u["id"].alias("id"), u["rootEn"].alias("root_en"), u["rootMl"].alias("root_ml"),
        u["blocksEn"].alias("blocks_en"), u["blocksMl"].alias("blocks_ml"),
    )
    units = F.transform("units", unit)
    as_json = F.transform(
        units,
        lambda u: u.withField("blocks_en", F.transform(u["blocks_en"], _json_item)).withField("blocks_ml", F.transform(u["blocks_ml"], _json_item)),
    )
    return raw.select(
        F.regexp_extract(file, r"([^/]+)/[^/]+$", 1).alias("dir_slug"), F.regexp_extract(file, r"([^/]+)$", 1).alias("file"), "slug", as_json.alias("units")
    )


def _json_item(b):
    """An object is kept; a bare string becomes a JSON string again."""
    text = F.to_json(F.struct(b.alias("text")))
    return F.when(F.startswith(F.ltrim(b), F.lit("{")), b).otherwise(text)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Gold forms and reviewers, one JSON object per line."""
    return spark.read.schema(schema).json(path)


def utterance_stream(spark: SparkSession, path: str) -> DataFrame:
    """Recogniser events as a file stream; any streaming source with this schema serves."""
    return spark.readStream.schema(schemas.UTTERANCE).json(path)

