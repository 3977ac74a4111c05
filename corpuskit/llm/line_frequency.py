"""Quality rules with cross-document line frequency, in DataFrame expressions only.

Base figures count words, symbols, repeated lines and repeated three-word windows of a text.
Then every line with a word is normalised (lower case, runs of white space as one space,
digits as 0) and hashed; the distinct documents of a host that have the line are counted.  A
line is above the limit if more than ``max_docs`` documents of the host have it, whatever the
size of the host; it is removed from all of them but the one with the smallest doc_id.  A document is depleted, and not kept, if fewer than ``min_words`` words or less than
``min_left`` of its words remain.

Texts are read once: the figures and the line hashes go to a checkpoint, a small part of the
input.  Counting a line is an aggregation with map-side combine, and the join back is split on
hot lines by adaptive execution.  Windows are compared by 64-bit hashes within a document.

Defined cases: a null or empty text has no words, fails the base rules and has no lines; a
null host is a host of its own; a repeated row counts as a document of its own; rows without
a doc_id are never a line's first document; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.session import checkpointed

SPACE = r"[\x20\x09-\x0D]+"
A_WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE, -1), "")


def normalised(line: Column) -> Column:
    return F.regexp_replace(F.lower(F.array_join(words_of(line), " ")), "[0-9]", "0")


def with_base(docs: DataFrame, host_col: str = "source") -> DataFrame:
    """Base figures of every row and its lines as (hash, words)."""
    df = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit("")).alias("host"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("row_id"),
    )
    df = df.withColumns({"w": words_of(F.col("text")), "l": F.filter(F.split("text", "\n", -1), lambda x: x.rlike(A_WORD))})
    windows = F.transform(F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))
    df = df.withColumns(
        {
            "n_words": F.size("w").cast("long"),
            "word_chars": F.length(F.array_join("w", "")).cast("long"),
            "n_symbols": (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("l") - F.size(F.array_distinct("l"))).cast("long"),
            "lines": F.transform("l", lambda x: F.struct(F.xxhash64(normalised(x)).alias("hash"), F.size(words_of(x)).alias("words"))),
            "h": windows,
        }
    ).drop("text", "w", "l")
    # Windows sorted by hash: equal neighbours are repeated; each covers 3 words, less where the next one starts earlier.
    some = F.size(F.array_distinct("h")) < F.size("h")
    df = df.withColumn("s", F.when(some, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    same = lambda e, k: F.coalesce(F.get("s", k)["x"] == e["x"], F.lit(False))
    twice = F.filter("s", lambda e, k: same(e, k - 1) | same(e, k + 1))
    df = df.withColumn("p", F.sort_array(F.transform(twice, lambda e: e["i"])))
    covered = F.aggregate(F.transform("p", lambda at, k: F.least(F.lit(3), F.coalesce(F.get("p", k + 1) - at, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("h", "s", "p")
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def judge(docs: DataFrame, max_docs: int = 10, min_words: int = 50, min_left: float = 0.3, host_col: str = "source") -> DataFrame:
    """Figures and verdict of every row: doc_id, the base figures, base_failed, removed_words and kept."""
    base = checkpointed(with_base(docs, host_col))
    seen = base.select("host", "doc_id", F.explode(F.array_distinct("lines.hash")).alias("hash"))
    counts = seen.groupBy("host", "hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    frequent = counts.filter(F.col("n") > max_docs).select("host", "hash", "first_id")
    lines = base.select("row_id", "host", "doc_id", F.explode("lines").alias("line")).select("row_id", "host", "doc_id", "line.hash", "line.words")
    hit = lines.join(frequent, ["host", "hash"]).filter(~F.coalesce(F.col("doc_id") == F.col("first_id"), F.lit(False)))
    removed = hit.groupBy("row_id").agg(F.sum("words").alias("removed"))
    left = F.col("n_words") - F.col("removed_words")
    return (
        base.drop("lines")
        .join(removed, "row_id", "left")
        .withColumn("removed_words", F.coalesce("removed", F.lit(0)).cast("long"))
        .withColumn("kept", ~F.col("base_failed") & (left >= min_words) & (left >= min_left * F.col("n_words")))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept")
    )


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM (SELECT *, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
rep AS (SELECT rid, sum(least(3, coalesce(nxt - i, 3))) AS n FROM r GROUP BY rid),
b AS (SELECT w.rid, doc_id, host, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep ON rep.rid = w.rid),
ln AS (SELECT rid, doc_id, host, regexp_replace(lower(array_to_string(regexp_extract_all(x, '[^\x20\x09-\x0D]+'), ' ')), '[0-9]', '0', 'g') AS line,
  len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words FROM (SELECT rid, doc_id, host, unnest(l) AS x FROM w)),
f AS (SELECT host, line, min(doc_id) AS first_id FROM (SELECT DISTINCT rid, doc_id, host, line FROM ln) GROUP BY host, line HAVING count(*) > 10),
rm AS (SELECT rid, sum(words)::BIGINT AS n FROM ln JOIN f USING (host, line) WHERE doc_id IS DISTINCT FROM first_id GROUP BY rid),
v AS (SELECT b.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(rm.n, 0) AS removed_words FROM b LEFT JOIN rm ON rm.rid = b.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words,
  NOT base_failed AND n_words - removed_words >= 50 AND n_words - removed_words >= 0.3 * n_words AS kept FROM v
"""
