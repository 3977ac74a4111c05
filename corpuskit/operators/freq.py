"""Token frequencies over a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions import text as T


def token_stream(df: DataFrame, text: Column, pattern: str = T.SCRIPT_RUN) -> DataFrame:
    return df.select(F.explode(T.matches(text, pattern)).alias("token"))


def token_freq(
    df: DataFrame, text: Column, pattern: str = T.SCRIPT_RUN, letter: str = T.SCRIPT_LETTER, min_count: int = 2
) -> DataFrame:
    """Useful tokens and their counts; the count is combined before the shuffle."""
    return (
        token_stream(df, text, pattern)
        .filter(T.useful_token(F.col("token"), letter))
        .groupBy("token")
        .agg(F.count("*").alias("freq"))
        .filter(F.col("freq") >= min_count)
    )


def freq_totals(freq: DataFrame) -> DataFrame:
    """Totals after the minimum-count filter, as the token list publishes them."""
    return freq.agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("total"), F.count("*").alias("distinct_tokens"))
