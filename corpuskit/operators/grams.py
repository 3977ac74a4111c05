"""Substring matching over a vocabulary by grams: an equi-join, then an exact test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions import text as T
from corpuskit.session import small_or_shuffled


def all_grams(c: Column) -> Column:
    """Distinct 1-, 2- and 3-grams of a string (none longer than the string)."""

    def of(n: int) -> Column:
        return F.when(F.length(c) >= n, T.char_ngrams(c, n)).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(of(1), of(2), of(3)))


def gram_index(vocab: DataFrame, fields: tuple[str, ...] = ("native", "ascii")) -> DataFrame:
    """``(field, gram, token, form)`` for every written form of every vocabulary token."""
    forms = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("form")) for f in fields])).alias("f")
    return (
        vocab.select("token", forms)
        .select("token", F.col("f.field").alias("field"), F.col("f.form").alias("form"))
        .filter(F.col("form").isNotNull() & (F.col("form") != ""))
        .withColumn("gram", F.explode(all_grams(F.col("form"))))
    )


def match_needles(needles: DataFrame, index: DataFrame) -> DataFrame:
    """Vocabulary tokens that contain a needle.

    ``needles`` has ``needle_id``, ``field`` and ``needle``.  A token containing
    the needle contains every gram of it, so only the rarest gram is looked up;
    needles of up to three characters are grams themselves.  The final test is
    ``contains``, so the result is exact.
    """
    wanted = needles.filter(F.col("needle") != "").select("field", "needle").distinct()
    grams = F.when(F.length("needle") <= 3, F.array("needle")).otherwise(F.array_distinct(T.char_ngrams(F.col("needle"), 3)))
    probes = small_or_shuffled(wanted.select("field", "needle", F.size(grams).alias("n_grams"), F.explode(grams).alias("gram")))
    present = index.join(small_or_shuffled(probes.select("field", "gram").distinct()), ["field", "gram"], "left_semi")
    counts = present.groupBy("field", "gram").agg(F.count("*").alias("n_tokens"))
    rarest = (
        probes.join(counts, ["field", "gram"])
        .groupBy("field", "needle", "n_grams")
        .agg(F.min_by("gram", F.struct("n_tokens", "gram")).alias("gram"), F.count("*").alias("found"))
        .filter(F.col("found") == F.col("n_grams"))
        .select("field", "needle", "gram")
    )
    hits = index.join(rarest, ["field", "gram"]).filter(F.contains("form", "needle")).select("field", "needle", "token").distinct()
    return hits.join(needles, ["field", "needle"]).select("needle_id", "token").distinct()
