"""Corpus structure, volume and token frequency queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.functions import text as T
from corpuskit.operators import freq, ordering, structure
from corpuskit.operators.ordering import int_bucket
from corpuskit.queries.tables import SQL_BLOCKS, SQL_LINES, SQL_SPACE, doc_units, read, sql_space_count


def token_freq(spark, sf):
    docs = read(spark, sf, "documents")
    out = freq.token_freq(docs, F.lower("text"), T.LATIN_WORD, T.ANY_LETTER)
    return out.select("token", T.ascii_fold(F.col("token")).alias("ascii"), "freq")


def token_freq_totals(spark, sf):
    return freq.freq_totals(token_freq(spark, sf))


def ascii_fold_tokens(spark, sf):
    docs = read(spark, sf, "documents")
    words = freq.token_stream(docs, F.col("text"), T.LATIN_WORD).groupBy("token").agg(F.count("*").alias("freq"))
    return words.groupBy(T.ascii_fold(F.col("token")).alias("ascii")).agg(
        F.count("*").alias("spellings"), F.sum("freq").alias("occurrences")
    )


def volume(spark, sf):
    return structure.volume_rollup(doc_units(spark, sf))


def translation_estimate(spark, sf):
    return structure.translation_estimate(volume(spark, sf))


def text_counts(spark, sf):
    return structure.text_counts(doc_units(spark, sf), T.LATIN_WORD)


def blocks_exploded_stats(spark, sf):
    blocks = structure.explode_blocks(doc_units(spark, sf))
    return blocks.groupBy("text_slug", "chapter_id").agg(
        F.count("*").alias("n_blocks"),
        F.count_if(F.trim("text") != "").alias("n_nonblank"),
        F.max("block_idx").alias("last_idx"),
        F.sum(F.length("text").cast("bigint")).alias("chars"),
    )


def unit_bodies(spark, sf):
    units = structure.with_body(doc_units(spark, sf))
    return units.select("unit_id", F.length("body").alias("body_chars"), F.md5(F.col("body").cast("binary")).alias("body_md5"))


def clean_whitespace(spark, sf):
    docs = read(spark, sf, "documents")
    clean = T.normalise_space(F.col("text"))
    return docs.select(
        "doc_id", F.length(clean).alias("clean_chars"), F.md5(clean.cast("binary")).alias("clean_md5"),
        T.space_token_count(F.col("text")).alias("space_tokens"), T.run_count(F.col("text"), T.LATIN_WORD).alias("letter_runs"),
    )


def index_tokens(spark, sf):
    docs = read(spark, sf, "documents")
    return (
        docs.select("lang", F.explode(T.index_tokens(F.col("text"))).alias("token"))
        .groupBy("lang", "token")
        .agg(F.count("*").alias("freq"))
        .groupBy("lang")
        .agg(F.count("*").alias("distinct_tokens"), F.sum("freq").alias("tokens"), F.max(F.length("token")).alias("longest"))
    )


def leading_blocks(spark, sf):
    """Turns of a conversation as blocks; system and user turns lead until another role speaks."""
    turns = read(spark, sf, "conversations").select("conv_id", "turn", "role")
    return structure.leading_flags(turns, ["conv_id"], "turn", F.col("role").isin("system", "user")).select(
        "conv_id", "turn", "role", "is_leading"
    )


def leading_split(spark, sf):
    units = structure.leading_split(doc_units(spark, sf), lead_kinds=("short", "mid"))
    return units.select("unit_id", F.size("leading_blocks").alias("n_leading"), F.size("trailing_blocks").alias("n_trailing"))


def intro_islands(spark, sf):
    """Per user, purchases are verses and everything between them is prose."""
    nodes = read(spark, sf, "events").select("user_id", "event_id", (F.col("event_type") == "purchase").alias("is_verse"))
    units = structure.assemble_units(nodes, ["user_id"], "event_id")
    prose = units.filter(~F.col("is_verse"))
    return prose.groupBy("user_id", "intro_no").agg(
        F.count("*").alias("n_blocks"), F.min("event_id").alias("first_event"), F.max("is_outro").alias("is_outro")
    )


def verse_ordinals(spark, sf):
    nodes = read(spark, sf, "events").select("user_id", "event_id", (F.col("event_type") == "purchase").alias("is_verse"))
    units = structure.assemble_units(nodes, ["user_id"], "event_id")
    return units.filter("is_verse").select("user_id", "event_id", "verse_no")


def parent_first_seen(spark, sf):
    """Number the sources of a language in the order they first appear."""
    docs = read(spark, sf, "documents").select("lang", "source", "doc_id")
    return structure.parent_ordinals(docs, ["lang"], "source", "doc_id").select(
        F.col("lang").alias("text_slug"), F.col("source").alias("parent"), "first_at", "parent_ord"
    )


def chapter_ordinals(spark, sf):
    """Number the orders of a customer in the order their first line ships."""
    orders = read(spark, sf, "orders").select("o_custkey", "o_orderkey")
    lines = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.unix_timestamp("l_shipdate").alias("shipped"))
    return ordering.first_seen_ordinal(
        lines.join(orders, "o_orderkey"), ["o_custkey"], "o_orderkey", "shipped", "chapter_ord", width=90 * 86_400
    ).select("o_custkey", "o_orderkey", "chapter_ord")


def flat_unit_order(spark, sf):
    """Position of every document inside its text."""
    docs = read(spark, sf, "documents").select("lang", "doc_id")
    return ordering.positions(docs, ["lang"], ["doc_id"], int_bucket(F.col("doc_id")), "unit_pos")


def unit_neighbours(spark, sf):
    docs = read(spark, sf, "documents").select("lang", "doc_id")
    out = ordering.neighbours(docs, ["lang"], ["doc_id"], int_bucket(F.col("doc_id"), 4096), "doc_id")
    return out.fillna(-1, ["prev_id", "next_id"])


def chapter_neighbours(spark, sf):
    orders = read(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    month = F.date_trunc("month", "o_orderdate")
    return ordering.neighbours(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], month, "o_orderkey").select(
        "o_custkey", "o_orderkey", "prev_id", "next_id"
    ).fillna(-1, ["prev_id", "next_id"])


def catalog_group(spark, sf):
    """Nations grouped by region, members in name order."""
    nation, region = read(spark, sf, "nation"), read(spark, sf, "region")
    members = nation.join(region, nation.n_regionkey == region.r_regionkey).select("r_name", "n_name")
    return structure.group_members(members, ["r_name"], ["n_name"], F.substring("n_name", 1, 1))


def toc_group(spark, sf):
    """Parts grouped by brand in key order."""
    part = read(spark, sf, "part").select("p_brand", "p_partkey", "p_name")
    return structure.group_members(part, ["p_brand"], ["p_partkey"], int_bucket(F.col("p_partkey")))


def url_keys(spark, sf):
    return read(spark, sf, "pages").select("page_id", T.url_key(F.col("url")).alias("url_key"))


def degraded_refs(spark, sf):
    item = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    ref = F.concat(F.lit("BR_C"), F.col("l_orderkey"), F.lit("_S"), F.col("l_linenumber"), F.lit("_x"))
    return item.select(T.degraded_reference(ref).alias("reference")).groupBy("reference").agg(F.count("*").alias("n"))


SQL_WORDS = r"words AS (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS token FROM documents)"
SQL_FREQ = f"""{SQL_WORDS}, freq AS (SELECT token, lower(strip_accents(token)) AS ascii, count(*) AS freq FROM words
  WHERE length(token) >= 2 GROUP BY token HAVING count(*) >= 2)"""
SQL_PARTS = f"""{SQL_LINES}, {SQL_BLOCKS}, parts AS (
  SELECT text_slug, 'root' AS kind, l[1] AS text FROM lines UNION ALL SELECT text_slug, kind, text FROM blocks)"""
SQL_VOLUME = f"""{SQL_PARTS}, volume AS (
  SELECT coalesce(text_slug, 'TOTAL') AS text_slug, coalesce(kind, 'all') AS kind,
    CAST(count_if(kind = 'root') AS BIGINT) AS units, CAST(sum(length(text)) AS BIGINT) AS chars,
    CAST(sum({sql_space_count('text')}) AS BIGINT) AS tokens,
    CAST(grouping(text_slug) * 2 + grouping(kind) AS INTEGER) AS level
  FROM parts GROUP BY CUBE (text_slug, kind))"""
SQL_INTROS = """
WITH n AS (SELECT user_id, event_id, event_type = 'purchase' AS is_verse,
    sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events),
  tot AS (SELECT user_id, max(island) AS n_verses FROM n GROUP BY 1),
  runs AS (SELECT user_id, island, count(*) AS n_blocks, min(event_id) AS first_event FROM n WHERE NOT is_verse GROUP BY 1, 2)
SELECT r.user_id, row_number() OVER (PARTITION BY r.user_id ORDER BY r.island) AS intro_no, n_blocks, first_event,
  r.island = t.n_verses AS is_outro
FROM runs r JOIN tot t USING (user_id)"""

QUERIES = {
    "token_freq": (token_freq, f"WITH {SQL_FREQ} SELECT * FROM freq"),
    "token_freq_totals": (
        token_freq_totals,
        f"WITH {SQL_FREQ} SELECT CAST(sum(freq) AS BIGINT) AS total, count(*) AS distinct_tokens FROM freq",
    ),
    "ascii_fold_tokens": (
        ascii_fold_tokens,
        r"""SELECT lower(strip_accents(token)) AS ascii, count(DISTINCT token) AS spellings, count(*) AS occurrences
        FROM (SELECT unnest(regexp_extract_all(text, '\p{L}+')) AS token FROM documents) GROUP BY 1""",
    ),
    "volume_rollup": (volume, f"WITH {SQL_VOLUME} SELECT * FROM volume"),
    "translation_estimate": (
        translation_estimate,
        f"""WITH {SQL_VOLUME} SELECT tokens, CAST(round(tokens * 2.5) AS BIGINT) AS words_low,
        CAST(round(tokens * 3.5) AS BIGINT) AS words_high FROM volume WHERE level = 3""",
    ),
    "text_counts": (
        text_counts,
        rf"""WITH {SQL_LINES} SELECT text_slug, count(DISTINCT chapter_id) AS chapters,
        CAST(count_if(trim(l[1]) <> '') AS BIGINT) AS mantras, CAST(count_if(trim(l[1]) = '') AS BIGINT) AS intros,
        CAST(sum(len(regexp_extract_all(array_to_string(l, chr(10)), '\p{{L}}+'))) AS BIGINT) AS words FROM lines GROUP BY 1""",
    ),
    "blocks_exploded_stats": (
        blocks_exploded_stats,
        f"""WITH {SQL_LINES}, {SQL_BLOCKS} SELECT text_slug, chapter_id, count(*) AS n_blocks,
        CAST(count_if(trim(text) <> '') AS BIGINT) AS n_nonblank, max(block_idx) AS last_idx,
        CAST(sum(length(text)) AS BIGINT) AS chars FROM blocks GROUP BY 1, 2""",
    ),
    "unit_bodies": (
        unit_bodies,
        f"""WITH {SQL_LINES}, b AS (SELECT unit_id, array_to_string(list_filter(l, lambda x: x <> ''), ' ') AS body FROM lines)
        SELECT unit_id, CAST(length(body) AS INTEGER) AS body_chars, md5(body) AS body_md5 FROM b""",
    ),
    "clean_whitespace": (
        clean_whitespace,
        rf"""WITH c AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
          regexp_replace(replace(replace(text, chr(160), ' '), chr(8203), ''), '[\t\r]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'),
          '[ \f\x0b]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '^{SQL_SPACE}+', ''), '{SQL_SPACE}+$', '') AS clean FROM documents)
        SELECT doc_id, CAST(length(clean) AS INTEGER) AS clean_chars, md5(clean) AS clean_md5,
          CAST({sql_space_count('text')} AS INTEGER) AS space_tokens,
          CAST(len(regexp_extract_all(text, '\p{{L}}+')) AS INTEGER) AS letter_runs FROM c""",
    ),
    "index_tokens": (
        index_tokens,
        rf"""WITH t AS (SELECT lang, unnest(list_filter(regexp_split_to_array(text,
            '[{SQL_SPACE[1:-1]}\x{{0964}}\x{{0965}},;:—–\-()\[\]"''`\x{{0970}}\x{{093d}}.!?/]+'), lambda x: x <> '')) AS token FROM documents)
        SELECT lang, count(DISTINCT token) AS distinct_tokens, count(*) AS tokens, CAST(max(length(token)) AS INTEGER) AS longest
        FROM t GROUP BY lang""",
    ),
    "leading_blocks": (
        leading_blocks,
        """SELECT conv_id, turn, role, bool_and(role IN ('system', 'user')) OVER
        (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS is_leading FROM conversations""",
    ),
    "leading_split": (
        leading_split,
        f"""WITH {SQL_LINES}, {SQL_BLOCKS}, f AS (SELECT unit_id, min(block_idx) FILTER (kind = 'long') AS e, count(*) AS n
          FROM blocks GROUP BY 1), u AS (SELECT unit_id, l[1] AS root, coalesce(n, 0) AS n,
          CASE WHEN l[1] = '' THEN 0 ELSE coalesce(e, n, 0) END AS lead FROM lines LEFT JOIN f USING (unit_id))
        SELECT unit_id, CAST(lead AS INTEGER) AS n_leading, CAST(n - lead AS INTEGER) AS n_trailing FROM u""",
    ),
    "intro_islands": (intro_islands, SQL_INTROS),
    "verse_ordinals": (
        verse_ordinals,
        """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS verse_no
        FROM events WHERE event_type = 'purchase'""",
    ),
    "parent_first_seen": (
        parent_first_seen,
        """SELECT lang AS text_slug, source AS parent, min(doc_id) AS first_at,
        row_number() OVER (PARTITION BY lang ORDER BY min(doc_id)) AS parent_ord FROM documents GROUP BY 1, 2""",
    ),
    "chapter_ordinals": (
        chapter_ordinals,
        """WITH f AS (SELECT o_custkey, o_orderkey, min(l_shipdate) AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
        SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY s, o_orderkey) AS chapter_ord FROM f""",
    ),
    "flat_unit_order": (
        flat_unit_order,
        "SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS unit_pos FROM documents",
    ),
    "unit_neighbours": (
        unit_neighbours,
        """SELECT lang, doc_id, coalesce(lag(doc_id) OVER w, -1) AS prev_id, coalesce(lead(doc_id) OVER w, -1) AS next_id FROM documents
        WINDOW w AS (PARTITION BY lang ORDER BY doc_id)""",
    ),
    "chapter_neighbours": (
        chapter_neighbours,
        """SELECT o_custkey, o_orderkey, coalesce(lag(o_orderkey) OVER w, -1) AS prev_id, coalesce(lead(o_orderkey) OVER w, -1) AS next_id FROM orders
        WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    ),
    "catalog_group": (
        catalog_group,
        """SELECT r_name, n_name, row_number() OVER (PARTITION BY r_name ORDER BY n_name) - 1 AS member_pos,
        count(*) OVER (PARTITION BY r_name) AS group_size FROM nation JOIN region ON n_regionkey = r_regionkey""",
    ),
    "toc_group": (
        toc_group,
        """SELECT p_brand, p_partkey, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS member_pos,
        count(*) OVER (PARTITION BY p_brand) AS group_size FROM part""",
    ),
    "url_keys": (url_keys, "SELECT page_id, substr(sha1(url), 1, 16) AS url_key FROM pages"),
    "degraded_refs": (
        degraded_refs,
        """SELECT 'C' || l_orderkey || ' · S' || l_linenumber AS reference, count(*) AS n FROM lineitem GROUP BY 1""",
    ),
}
