"""Nearest heads by trigram overlap, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.functions import text as T
from corpuskit.operators.ordering import top_per_group


def gram_overlap(query: Column, head: Column, n: int = 3) -> Column:
    """Query grams, with repeats, that occur in the head."""
    shared = F.size(F.filter(T.char_ngrams(query, n), lambda g: F.contains(head, g)))
    return F.when((F.length(query) < n) | (F.length(head) < n), (query == head).cast("int")).otherwise(shared)


def nearest_heads(tokens: DataFrame, pool: DataFrame, k: int = 5, min_score: float = 0.45, n: int = 3) -> DataFrame:
    """The ``k`` best heads per token with score at least ``min_score``.

    A head reaching the score shares at least ``ceil(min_score * (n_query + 1) / 2)``
    query grams, so one fewer of the commonest grams of a token may be ignored
    when looking for candidates.  The exact score is then computed on the
    candidates, so nothing is lost and hot grams are mostly never joined.
    """
    heads = pool.select("head").distinct().withColumn("n_head", F.size(F.array_distinct(T.char_ngrams(F.col("head"), n))))
    postings = heads.select("head", "n_head", F.explode(F.array_distinct(T.char_ngrams(F.col("head"), n))).alias("gram"))
    counts = postings.groupBy("gram").agg(F.count("*").alias("n_heads"))
    # Few bytes, much work: an explicit partition count is not coalesced at run time.
    cores = tokens.sparkSession.sparkContext.defaultParallelism
    asked = tokens.select("token").repartition(cores * 2, "token").distinct().withColumn("grams", T.char_ngrams(F.col("token"), n))
    probes = (
        asked.select("token", F.size("grams").alias("n_query"), F.explode("grams").alias("gram"))
        .groupBy("token", "n_query", "gram")
        .agg(F.count("*").alias("times"))
        .join(counts, "gram")
    )
    commonest_first = Window.partitionBy("token").orderBy(F.desc("n_heads"), "gram").rowsBetween(Window.unboundedPreceding, 0)
    probes = (
        probes.withColumn("may_skip", F.ceil(F.col("n_query") * (min_score / 2) + min_score / 2 - 1e-9) - 1)
        .withColumn("seen", F.sum("times").over(commonest_first))
        .filter(F.col("seen") > F.col("may_skip"))
    )
    size_gap = F.abs(F.length("head") - F.length("token"))
    # What the grams looked up leave open is at most the number of grams skipped.
    best_case = 2 * (F.col("found") + F.col("may_skip")) / (F.col("n_query") + F.col("n_head"))
    candidates = (
        probes.join(postings, "gram")
        .filter(size_gap <= F.greatest(F.lit(3.0), F.length("token") * 0.5))
        .groupBy("token", "n_query", "may_skip", "head", "n_head")
        .agg(F.sum("times").alias("found"))
        .filter(best_case >= min_score)
    )
    hits = gram_overlap(F.col("token"), F.col("head"), n)
    scored = candidates.withColumn("score", 2 * hits / (F.col("n_query") + F.col("n_head"))).filter(F.col("score") >= min_score)
    return top_per_group(scored.select("token", "head", "score"), ["token"], [F.desc("score"), F.asc("head")], k)


def prefix_lookup(tokens: DataFrame, heads: DataFrame, limit: int = 5, longest: int = 6, shortest: int = 3) -> DataFrame:
    """Heads that start with the first ``min(longest, length)`` characters of a token."""
    asked = tokens.select("token", F.least(F.length("token"), F.lit(longest)).alias("n")).filter(F.col("n") >= shortest)
    asked = asked.withColumn("prefix", F.substr("token", F.lit(1), F.col("n")))
    starts = heads.select(
        "head", F.explode(F.filter(F.array(*[F.lit(i) for i in range(shortest, longest + 1)]), lambda i: i <= F.length("head"))).alias("n")
    ).withColumn("prefix", F.substr("head", F.lit(1), F.col("n")))
    return top_per_group(asked.join(starts, ["n", "prefix"]).select("token", "head"), ["token"], [F.asc("head")], limit)
