"""Views of the given tables as units, blocks, vocabularies and lexicons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.functions import text as T
from corpuskit.operators.freq import token_stream
from corpuskit.session import spread


# Text-heavy tables and their keys: spread over the cores when they are small.
TEXT_KEYS = {"documents": "doc_id", "pages": "page_id"}


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df, TEXT_KEYS[name]) if name in TEXT_KEYS else df


def doc_units(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as units: language = text, source = chapter, first line = root, lines = blocks."""
    lines = F.split("text", "\n")
    block = lambda x: F.struct(
        F.when(F.length(x) >= 400, "long").when(F.length(x) >= 80, "mid").otherwise("short").alias("kind"), x.alias("text")
    )
    return read(spark, sf, "documents").select(
        F.col("lang").alias("text_slug"),
        F.col("source").alias("chapter_id"),
        F.col("doc_id").alias("unit_id"),
        F.when(F.trim(lines[0]) == "", "intro").otherwise("verse").alias("kind"),
        lines[0].alias("root"),
        F.transform(F.slice(lines, 2, 1_000_000_000), block).alias("blocks"),
    )


SQL_LINES = "lines AS (SELECT lang AS text_slug, source AS chapter_id, doc_id AS unit_id, string_split(text, chr(10)) AS l FROM documents)"
SQL_BLOCKS = """blocks AS (SELECT text_slug, chapter_id, unit_id, CAST(i - 2 AS INTEGER) AS block_idx, l[i] AS text,
  CASE WHEN length(l[i]) >= 400 THEN 'long' WHEN length(l[i]) >= 80 THEN 'mid' ELSE 'short' END AS kind
  FROM (SELECT *, unnest(range(2, len(l) + 1)) AS i FROM lines))"""
SQL_SPACE = r"[\s\x0b\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def sql_space_count(c: str) -> str:
    return rf"len(list_filter(regexp_split_to_array({c}, '{SQL_SPACE}+'), lambda x: x <> ''))"


def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct lower-case words of the documents with their frequency."""
    docs = read(spark, sf, "documents")
    return token_stream(docs, F.lower("text"), T.LATIN_WORD).groupBy("token").agg(F.count("*").alias("freq"))


SQL_VOCAB = r"vocab AS (SELECT token, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS token FROM documents) GROUP BY token)"


def lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """Two lexicons: ``bench`` (words of the benchmark) before ``conv`` (words of the conversations)."""
    parts = []
    for dict_id, order, table in (("bench", 1, "benchmark"), ("conv", 2, "conversations")):
        words = token_stream(read(spark, sf, table), F.lower("text"), T.LATIN_WORD).distinct()
        parts.append(words.select(F.lit(dict_id).alias("dict_id"), F.lit(order).alias("dict_order"), F.col("token").alias("head")))
    return parts[0].unionByName(parts[1])


SQL_LEXICON = r"""lexicon AS (
  SELECT DISTINCT 'bench' AS dict_id, 1 AS dict_order, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS head FROM benchmark
  UNION ALL
  SELECT DISTINCT 'conv' AS dict_id, 2 AS dict_order, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS head FROM conversations)"""
