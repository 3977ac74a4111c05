"""Search, snippets, highlighting and suggestions over the documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpuskit.functions import text as T
from corpuskit.operators import freq as freq_ops
from corpuskit.operators import search as S
from corpuskit.operators.ordering import int_bucket, positions
from corpuskit.queries.tables import SQL_SPACE, doc_units, read
from corpuskit.session import checkpoint_folder, materialised


def asked(spark, sf):
    """Benchmark passages as queries of several lengths: one word, three words, the whole passage, blank."""
    words = F.element_at(F.array(*map(F.lit, (1, 3, 1_000_000, 0))), (F.col("item_id") % 4 + 1).cast("int"))
    return read(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), F.lit(1), words), " ").alias("query")
    )


INDEXES: dict[tuple[str, str], S.Index] = {}


def stored_index(spark, sf) -> S.Index:
    """The stored index of the documents; the first search of an application writes it, the others read it."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in INDEXES:
        path = f"{checkpoint_folder(spark)}/search-{uuid.uuid4().hex}"
        INDEXES[key] = S.write_folded(S.build_search(doc_units(spark, sf)), path)
    return INDEXES[key]


def indexed(spark, sf):
    """Documents, vocabulary and postings of the stored index."""
    return stored_index(spark, sf).tables


def search_and(spark, sf):
    index = stored_index(spark, sf)
    queries = asked(spark, sf)
    hits = S.matching_units(S.query_tokens(queries), index.vocab, index.postings, queries, index.grams, index.units)
    return hits.select("query_id", "text_slug", "unit_id", "tokens_hit")


def search_scope(spark, sf):
    index = stored_index(spark, sf)
    queries = asked(spark, sf).withColumn("scope", F.array(F.lit("de"), F.lit("fr")))
    return S.search(queries, *index.tables, limit=20, grams=index.grams, units=index.units).select("query_id", "text_slug", "unit_id", "tier", "score", "rank")


def search_ranked(spark, sf):
    index = stored_index(spark, sf)
    return S.search(asked(spark, sf), *index.tables, grams=index.grams, units=index.units).select(
        "query_id", "text_slug", "unit_id", "tier", "score", "rank", "snippet"
    )


def find_snippets(spark, sf):
    index = stored_index(spark, sf)
    return S.find_in_text(asked(spark, sf), *index.tables, grams=index.grams, units=index.units)


def search_linear(spark, sf):
    index = stored_index(spark, sf)
    return S.linear_search(asked(spark, sf), *index.tables, grams=index.grams, units=index.units)


def highlight(spark, sf):
    docs = S.build_search(doc_units(spark, sf))
    marked = T.highlight(F.col("body"), F.array(F.lit("the"), F.lit("then"), F.lit("tion"), F.lit(".")))
    return docs.select("unit_id", F.length(marked).alias("marked_chars"), F.md5(marked.cast("binary")).alias("marked_md5"))


def token_list(spark, sf):
    docs = read(spark, sf, "documents")
    out = freq_ops.token_freq(docs, F.lower("text"), T.LATIN_WORD, T.ANY_LETTER)
    return materialised(out.withColumn("ascii", T.ascii_fold(F.col("token"))), "token")


def passage_words(spark, sf):
    """``item_id, word``: every word of every passage."""
    return read(spark, sf, "benchmark").select("item_id", F.explode(T.matches(F.lower("text"), T.LATIN_WORD)).alias("word"))


def suggest(spark, sf):
    """Completions of every word of the passages."""
    words = passage_words(spark, sf).select(F.col("word").alias("query_id"), F.col("word").alias("query")).distinct()
    return S.suggest(words, token_list(spark, sf)).select("query_id", "token", "freq", "bucket", "rank")


def suggest_last_token(spark, sf):
    """Completions of the last word of every passage."""
    queries = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.regexp_replace("text", r"[^\p{L}]+$", "").alias("query"))
    return S.suggest_last_token(queries, token_list(spark, sf)).select("query_id", "full", "freq", "rank")


def merge_suggestions(spark, sf):
    """One list per passage: the completions of the first three letters of all its words."""
    starts = passage_words(spark, sf).select("item_id", F.substring("word", 1, 3).alias("query_id")).distinct()
    lists = S.suggest(starts.select("query_id", F.col("query_id").alias("query")).distinct(), token_list(spark, sf))
    return S.merge_suggestions(lists.join(starts, "query_id").select("item_id", "token", "freq"), "item_id")


def rolling_buffer(spark, sf):
    """The last 80 event types of a user at every event."""
    events = read(spark, sf, "events").select("user_id", "event_id", "event_type")
    placed = positions(events, ["user_id"], ["event_id"], int_bucket(F.col("event_id")))
    return S.rolling_buffer(placed, ["user_id"], "pos", "event_type").select(
        "user_id", "event_id", F.size("buffer").alias("n_buffered"), F.md5(F.array_join("buffer", ",").cast("binary")).alias("buffer_md5")
    )


SQL_ASKED = "q AS (SELECT item_id AS query_id, array_to_string(string_split(text, ' ')[1:[1, 3, 1000000, 0][item_id % 4 + 1]], ' ') AS query FROM benchmark)"
SQL_DOCS = r"""d AS (SELECT lang AS text_slug, doc_id AS unit_id, replace(text, chr(10), ' ') || CASE WHEN contains(text, chr(10)) THEN '' ELSE ' ' END AS body,
    substr(CASE WHEN string_split(text, chr(10))[1] <> '' THEN string_split(text, chr(10))[1] ELSE coalesce(string_split(text, chr(10))[2], '') END, 1, 160) AS snippet
    FROM documents WHERE trim(replace(text, chr(10), ' ')) <> ''),
  df AS (SELECT *, lower(strip_accents(body)) AS folded FROM d)"""
SQL_HITS = rf"""{SQL_ASKED}, {SQL_DOCS},
  ts AS (SELECT query_id, list_filter(regexp_split_to_array(query, '{SQL_SPACE}+'), lambda x: x <> '') AS toks FROM q),
  t AS (SELECT query_id, len(toks) AS n, unnest(range(1, len(toks) + 1)) AS i, unnest(toks) AS tok FROM ts),
  hits AS (SELECT query_id, text_slug, unit_id, count(DISTINCT i) AS tokens_hit FROM t JOIN df
    ON contains(folded, lower(strip_accents(tok))) OR contains(body, tok) GROUP BY query_id, text_slug, unit_id, n HAVING count(DISTINCT i) = n)"""
SQL_TIER = """CASE WHEN snippet = query THEN 4 WHEN starts_with(snippet, query)
  OR starts_with(lower(strip_accents(snippet)), lower(strip_accents(query))) THEN 3 ELSE 2 END"""
SQL_RANKED = f"""{SQL_HITS}, r AS (SELECT query_id, text_slug, unit_id, CAST({SQL_TIER} AS INTEGER) AS tier,
    round(tokens_hit * CAST(1.1 AS DOUBLE), 6) AS score, snippet FROM hits JOIN q USING (query_id) JOIN d USING (text_slug, unit_id))"""
SQL_FREQ = r"""freq AS (SELECT token, lower(strip_accents(token)) AS ascii, count(*) AS freq
  FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS token FROM documents)
  WHERE length(token) >= 2 GROUP BY token HAVING count(*) >= 2)"""
SQL_BUCKET = """CASE WHEN starts_with(token, n) THEN 1 WHEN ends_with(token, n) THEN 3 WHEN contains(token, n) THEN 2
  WHEN starts_with(ascii, a) THEN 1 WHEN ends_with(ascii, a) THEN 3 WHEN contains(ascii, a) THEN 2 END"""


def sql_suggest(prefixes: str) -> str:
    return f"""{SQL_FREQ}, p AS ({prefixes}), pa AS (SELECT *, lower(strip_accents(n)) AS a FROM p WHERE n <> ''),
    s AS (SELECT query_id, token, freq, CAST({SQL_BUCKET} AS INTEGER) AS bucket FROM pa JOIN freq ON contains(ascii, a)),
    top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY bucket, freq DESC, token) AS INTEGER) AS rank
      FROM s WHERE bucket IS NOT NULL QUALIFY rank <= 8)"""


SQL_SUGGEST = r"SELECT DISTINCT w AS query_id, w AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS w FROM benchmark)"

QUERIES = {
    "search_and": (search_and, f"WITH {SQL_HITS} SELECT * FROM hits"),
    "search_scope": (
        search_scope,
        f"""WITH {SQL_RANKED} SELECT query_id, text_slug, unit_id, tier, score, CAST(row_number() OVER
        (PARTITION BY query_id ORDER BY tier DESC, score DESC, text_slug, unit_id) AS INTEGER) AS rank FROM r
        WHERE text_slug IN ('de', 'fr') QUALIFY rank <= 20""",
    ),
    "search_ranked": (
        search_ranked,
        f"""WITH {SQL_RANKED} SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY tier DESC, score DESC, text_slug, unit_id)
        AS INTEGER) AS rank FROM r QUALIFY rank <= 100""",
    ),
    "find_snippets": (
        find_snippets,
        rf"""WITH {SQL_ASKED}, {SQL_DOCS}, ts AS (SELECT query_id, list_filter(regexp_split_to_array(query,
            '[\s\x0b\x{{00a0}}\x{{0964}}\x{{0965}},;:—–\-()\[\]"''`]+'), lambda x: x <> '') AS toks FROM q),
        t AS (SELECT query_id, len(toks) AS n, toks, unnest(range(1, len(toks) + 1)) AS i FROM ts),
        h AS (SELECT query_id, text_slug, unit_id FROM t JOIN df ON contains(folded, lower(strip_accents(toks[i])))
          GROUP BY query_id, text_slug, unit_id, n HAVING count(DISTINCT i) = n),
        k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, text_slug ORDER BY unit_id) AS INTEGER) AS hit_no FROM h QUALIFY hit_no <= 100),
        a AS (SELECT k.*, body, CASE WHEN strpos(body, toks[1]) > 0 THEN strpos(body, toks[1])
          ELSE strpos(folded, lower(strip_accents(toks[1]))) END - 1 AS z FROM k JOIN ts USING (query_id) JOIN df USING (text_slug, unit_id))
        SELECT query_id, hit_no, text_slug, unit_id, CASE WHEN z > 30 THEN '…' ELSE '' END ||
          substr(body, greatest(z - 30, 0) + 1, least(length(body), z + 110) - greatest(z - 30, 0)) ||
          CASE WHEN z + 110 < length(body) THEN '…' ELSE '' END AS snippet FROM a""",
    ),
    "search_linear": (
        search_linear,
        f"""WITH {SQL_ASKED}, {SQL_DOCS}, f AS (SELECT query_id, text_slug, unit_id, body,
          CASE WHEN strpos(body, query) > 0 THEN strpos(body, query) ELSE strpos(folded, lower(strip_accents(query))) END AS p
          FROM q JOIN df ON query <> '' AND (contains(folded, lower(strip_accents(query))) OR contains(body, query)))
        SELECT query_id, text_slug, unit_id, round(CAST(1 AS DOUBLE) / p, 6) AS score,
          substr(body, greatest(p - 21, 0) + 1, least(length(body), p - 1 + 140) - greatest(p - 21, 0)) AS snippet,
          CAST(row_number() OVER (PARTITION BY query_id ORDER BY text_slug, unit_id) AS INTEGER) AS hit_no FROM f QUALIFY hit_no <= 100""",
    ),
    "highlight": (
        highlight,
        rf"""WITH {SQL_DOCS}, m AS (SELECT unit_id, regexp_replace(body, '(then|tion|the|\.)', '<mark>\1</mark>', 'g') AS marked FROM d)
        SELECT unit_id, CAST(length(marked) AS INTEGER) AS marked_chars, md5(marked) AS marked_md5 FROM m""",
    ),
    "suggest": (suggest, f"WITH {sql_suggest(SQL_SUGGEST)} SELECT query_id, token, freq, bucket, rank FROM top"),
    "suggest_last_token": (
        suggest_last_token,
        r"WITH w AS (SELECT item_id AS query_id, regexp_replace(text, '[^\p{L}]+$', '') AS query FROM benchmark), "
        + sql_suggest("SELECT query_id, regexp_extract(query, '([^ ]+)$', 1) AS n FROM w WHERE query <> ''")
        + " SELECT query_id, regexp_extract(query, '^(.* )?[^ ]+$', 1, 's') || token AS \"full\", freq, rank FROM top JOIN w USING (query_id)",
    ),
    "merge_suggestions": (
        merge_suggestions,
        r"""WITH pw AS (SELECT DISTINCT item_id, substr(w, 1, 3) AS n FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS w FROM benchmark)), """
        + sql_suggest("SELECT DISTINCT n AS query_id, n FROM pw")
        + """, g AS (SELECT item_id, token, max(freq) AS freq FROM top JOIN pw ON query_id = pw.n GROUP BY 1, 2)
        SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY freq DESC, token) AS INTEGER) AS rank FROM g QUALIFY rank <= 8""",
    ),
    "rolling_buffer": (
        rolling_buffer,
        """WITH b AS (SELECT user_id, event_id, list(event_type) OVER (PARTITION BY user_id ORDER BY event_id
          ROWS BETWEEN 79 PRECEDING AND CURRENT ROW) AS buf FROM events)
        SELECT user_id, event_id, CAST(len(buf) AS INTEGER) AS n_buffered, md5(array_to_string(buf, ',')) AS buffer_md5 FROM b""",
    ),
}
