"""In-text definitions: mining, lookup and sense reranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions import text as T
from corpuskit.operators.ordering import int_bucket, positions, top_per_group

# The four definition patterns as (rule, pattern, term group, score), in the
# order they are tried.
_TERM, _CLAUSE, _BREAK = r"([\u0900-\u097f]{3,}?)", r"([\u0900-\u097f\s]{2,40}?)", r"[\u0964\u0965;,—]"
PATTERNS = (
    ("ity-arthah", _CLAUSE + r"\s*" + _TERM + r"\s*इत्यर्थः", 2, 1.0),
    ("arthat", _TERM + r"\s*अर्थात्\s*" + _CLAUSE + f"(?={_BREAK})", 1, 0.95),
    ("iti-uchyate", _CLAUSE + r"\s*इत्युच्यते", 1, 0.6),
    ("iti", _TERM + r"\s*इति\s*" + _CLAUSE + f"(?={_BREAK})", 1, 0.7),
)
# Bounds of a term, of a snippet, and of the list kept per term.
TERM_MIN, TERM_MAX, SNIPPET_MAX, KEPT = 3, 30, 220, 10
FINAL_SIGNS = r"[\u093e-\u094d\u0962\u0963]+$"


def tidy(c: Column) -> Column:
    return T.trim_space(F.regexp_replace(F.regexp_replace(c, T.SPACE + "+", " "), "[‘’\"]", ""))


def _pattern_matches(order: int, rule: str, pattern: str, group: int, score: float, sign: str | None = None) -> Column:
    """All matches of one pattern in ``piece`` as an array of records."""
    pairs = F.arrays_zip(
        F.regexp_extract_all("piece", F.lit(pattern), F.lit(0)).alias("whole"),
        F.regexp_extract_all("piece", F.lit(pattern), F.lit(group)).alias("term"),
    )
    found = F.transform(
        pairs,
        lambda m, i: F.struct(
            tidy(m["term"]).alias("term"),
            F.substring(tidy(m["whole"]), 1, SNIPPET_MAX).alias("snippet"),
            F.lit(rule).alias("rule"),
            F.lit(float(score)).alias("score"),
            F.lit(order).alias("rule_order"),
            i.alias("place"),
        ),
    )
    return found if sign is None else F.when(F.col("piece").rlike(sign), found)


def extract_glosses(
    units: DataFrame,
    patterns: Sequence[tuple[str, str, int, float]] = PATTERNS,
    top: int = KEPT,
    clause: str | None = None,
    signs: Sequence[str] | None = None,
) -> DataFrame:
    """Best definition per unit and term, then the ``top`` per text and term in unit order.

    ``units`` has ``text_slug, unit_id, body``.  All patterns run in one pass over
    the body; the best match is a map-side combined ``max_by``.  A pattern that begins with a
    lazy run tries that run from every character.  Where no match reaches over the end of a
    ``clause`` (a regex that cuts the body), ``signs`` names per pattern a cheap regex that
    occurs in every clause with a match, and the pattern runs on these clauses alone.
    """
    signs = signs or [None] * len(patterns)
    if len(signs) != len(patterns) or (clause is None and any(signs)):
        raise ValueError("a sign per pattern, and a clause to look for them")
    found = [F.coalesce(_pattern_matches(i, *p, sign), F.array()) for i, (p, sign) in enumerate(zip(patterns, signs))]
    pieces = units.filter(F.col("body") != "").select(
        "text_slug", "unit_id", F.posexplode_outer(F.array("body") if clause is None else T.matches(F.col("body"), clause)).alias("at", "piece")
    )
    if all(signs):
        pieces = pieces.filter(F.col("piece").rlike("|".join(f"(?:{s})" for s in signs)))
    # Outer, as Spark works the array of a plain explode out twice: once to drop the empty ones.
    rows = pieces.select("text_slug", "unit_id", "at", F.explode_outer(F.concat(*found)).alias("m")).select("text_slug", "unit_id", "at", "m.*")
    rows = rows.filter(F.length("term").between(TERM_MIN, TERM_MAX))
    best = rows.groupBy("text_slug", "term", "unit_id").agg(
        F.max_by(F.struct("snippet", "rule", "score"), F.struct("score", -F.col("rule_order"), -F.col("at"), -F.col("place"))).alias("b")
    )
    return top_per_group(
        best.select("text_slug", "term", "unit_id", "b.snippet", "b.rule", "b.score"),
        ["text_slug", "term"],
        [F.desc("score"), F.asc("unit_id")],
        top,
    )


def conservative_stem(term: Column) -> Column:
    return F.regexp_replace(term, FINAL_SIGNS, "")


def lookup_glosses(
    terms: DataFrame, glosses: DataFrame, limit: int = 5, stem: Column | None = None, shortest: int = 3
) -> DataFrame:
    """Definitions of ``(text_slug, term)``: the exact term, else its conservative stem."""
    asked = terms.select("text_slug", "term").distinct().withColumn("stem", conservative_stem(F.col("term")) if stem is None else stem)
    kept = glosses.filter(F.col("rank") <= limit)
    exact = asked.join(kept, ["text_slug", "term"])
    tried = asked.join(exact.select("text_slug", "term").distinct(), ["text_slug", "term"], "left_anti").filter(
        (F.col("stem") != F.col("term")) & (F.length("stem") >= shortest)
    )
    by_stem = tried.join(kept.withColumnRenamed("term", "stem"), ["text_slug", "stem"])
    cols = ["text_slug", "term", "unit_id", "snippet", "rule", "score", "rank"]
    return exact.select(cols).unionByName(by_stem.select(cols))


def in_every_text(terms: DataFrame, glosses: DataFrame, stem: Column | None = None) -> DataFrame:
    """``terms`` with the ``text_slug`` of every text that defines the term or its stem; the others can have no definition."""
    stem = conservative_stem(F.col("term")) if stem is None else stem
    written = F.explode(F.array_distinct(F.array("term", "__stem"))).alias("__written")
    keys = glosses.select("text_slug", F.col("term").alias("__written")).distinct()
    return terms.withColumn("__stem", stem).select(*terms.columns, written).join(keys, "__written").select(*terms.columns, "text_slug").distinct()


def token_glosses(tokens: DataFrame, candidates: DataFrame, glosses: DataFrame, limit: int = 6) -> DataFrame:
    """Definitions of a token and of its lemma candidates: no repeats, best first.

    ``tokens`` has ``text_slug, token``.
    """
    terms = tokens.select("text_slug", "token", F.col("token").alias("term"), F.lit(-1).alias("seq")).unionByName(
        tokens.join(candidates.select("token", F.col("lemma").alias("term"), "seq"), "token").select("text_slug", "token", "term", "seq")
    )
    found = terms.join(lookup_glosses(terms, glosses), ["text_slug", "term"])
    once = found.groupBy("text_slug", "token", "unit_id", "snippet").agg(
        F.min_by(F.struct("rule", "score", "seq", "rank"), F.struct("seq", "rank")).alias("g")
    )
    flat = once.select("text_slug", "token", "unit_id", "snippet", "g.rule", "g.score", "g.seq", F.col("g.rank").alias("list_rank"))
    return top_per_group(
        flat, ["text_slug", "token"], [F.desc("score"), F.asc("seq"), F.asc("list_rank"), F.asc("unit_id")], limit
    ).drop("seq", "list_rank")


def rerank_senses(senses: DataFrame, priors: DataFrame, keys: Sequence[str] = ("head",)) -> DataFrame:
    """Reorder the senses of a head by the weighted keywords of its prior.

    ``senses`` has the keys, ``idx`` (0-based) and ``sense``; ``priors`` has the
    keys and ``preferred``.  A head with one sense or without prior keeps score 0.
    """
    keys = list(keys)
    counts = senses.groupBy(*keys).agg(F.count("*").alias("n_senses"))
    n = F.size("preferred")
    weighed = F.transform(
        "preferred",
        lambda p, i: F.when((p != "") & F.contains(F.lower("sense"), F.lower(p)), 1 - i / n * 0.5).otherwise(F.lit(0.0)),
    )
    total = F.aggregate(weighed, F.lit(0.0), lambda a, x: a + x) / n
    first = F.get(F.filter("preferred", lambda p: (p != "") & F.contains(F.lower("sense"), F.lower(p))), F.lit(0))
    active = F.col("preferred").isNotNull() & (n > 0) & (F.col("n_senses") > 1)
    scored = (
        senses.join(counts, keys)
        .join(priors, keys, "left")
        .withColumn("score", F.when(active, total).otherwise(F.lit(0.0)))
        .withColumn("matched", F.when(active, first))
        .select(*keys, "idx", "sense", "score", "matched")
    )
    # Ranked in buckets that follow the order: a head may have very many senses.
    ordered = scored.withColumn("lack", -F.col("score"))
    placed = positions(ordered, keys, ["lack", "idx"], F.struct("lack", int_bucket(F.col("idx"))), "rank")
    return placed.withColumn("rank", (F.col("rank") + 1).cast("int")).drop("lack")
