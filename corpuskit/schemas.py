"""Explicit schemas of the nested corpus files."""

BLOCK = "kind STRING, text STRING, id STRING"
UNIT = f"id STRING, kind STRING, ordinal BIGINT, root STRING, blocks ARRAY<STRUCT<{BLOCK}>>"
CHAPTER = (
    "id STRING, ordinal BIGINT, titleSa STRING, parentTitleSa STRING, parentOrdinal BIGINT, kind STRING, "
    f"units ARRAY<STRUCT<{UNIT}>>"
)
CHUNK = f"textSlug STRING, chapter STRUCT<{CHAPTER}>, _corrupt_record STRING"
CHUNK_LINE = f"textSlug STRING, chapter STRUCT<{CHAPTER}>, unit_pos BIGINT, unit STRUCT<{UNIT}>"
COUNTS = "STRUCT<chapters: BIGINT, mantras: BIGINT, intros: BIGINT, words: BIGINT>"
CATALOG_ENTRY = (
    "slug STRING, titleSa STRING, titleIast STRING, titleEn STRING, `group` STRING, sourceUrl STRING, "
    f"counts {COUNTS}, dataPath STRING, sizeBytes BIGINT"
)
CATALOG = f"generatedAt STRING, texts ARRAY<STRUCT<{CATALOG_ENTRY}>>"
STUB = "id STRING, ordinal BIGINT, titleSa STRING, parentTitleSa STRING, parentOrdinal BIGINT, kind STRING, chunkPath STRING, chunkSize BIGINT"
MANIFEST = f"slug STRING, titleSa STRING, `group` STRING, chunked BOOLEAN, counts {COUNTS}, chapters ARRAY<STRUCT<{STUB}>>"
LEXICON_ENTRY = "STRUCT<iast: STRING, pos: STRING, en: STRING, ml: STRING, src: STRING>"
SOURCES = (
    "sources ARRAY<STRUCT<id STRING, citation STRING, license STRING, publishedAt STRING, isPrimary BOOLEAN>>"
)
RESULT = (
    "slug STRING, batchIndex INT, totalBatches INT, units ARRAY<STRUCT<id STRING, rootEn STRING, rootMl STRING, "
    "blocksEn ARRAY<STRING>, blocksMl ARRAY<STRING>>>"
)
GOLD_FORM = (
    "form_id STRING, form STRING, source STRING, lemma STRING, pos STRING, morph MAP<STRING, STRING>, sutras ARRAY<STRING>, "
    "notes STRING, reviewer STRING, reviewed_at STRING, unverified BOOLEAN, expect_gap BOOLEAN"
)
REVIEWER = "id STRING, name STRING, specialisation STRING, affiliation STRING, active_since STRING"
UTTERANCE = "session_id STRING, ts TIMESTAMP, seq BIGINT, transcript STRING, is_final BOOLEAN"
