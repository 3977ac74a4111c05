"""Lexicon dumps to head-word tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions import text as T
from corpuskit.operators.ordering import top_per_group

# Markup of the dumps.
ENGLISH_INLINE = r"</?(?:s[0-9]?|gk|i|b|sup|sub|info|lbinfo|lang|etym)[^>]*>"
ENGLISH_WRAPPERS = r"</?(?:H[0-9]+[A-Z]?|head|body|tail|hom|key1|key2|e|ls|lex|ab|pc|L)[^>]*>"
SANSKRIT_MARKUP = r"</?(?:L|LEND|pc|k1|k2|h|e|hom|head|body|tail|info|lbinfo)[^>]*>"
BAR = "¦"
SENSE_GLUE = " · "


def parse_dump(raw: DataFrame) -> DataFrame:
    """Records of a tagged dump to ``rec, k1, body``.

    ``raw`` has ``value``, one record each as cut at line-start ``<L>``, and
    ``rec``, the order of the records.  Records without head or body drop out.
    """
    header = F.substring_index("value", "\n", 1)
    body = F.substring_index(F.expr("substr(value, instr(value, '\n') + 1)"), "<LEND>", 1)
    return (
        raw.filter(F.contains("value", F.lit("\n")))
        .select("rec", F.trim(F.regexp_extract(header, r"<k1>([^<\n]+)", 1)).alias("k1"), body.alias("body"))
        .filter(F.col("k1") != "")
    )


def clean_english(body: Column, convert) -> Column:
    """Strip the tags of an English body; marked inline words go through ``convert``."""
    marked = F.regexp_replace(F.regexp_replace(body, r"<s1?>([^<]*)</s1?>", "\u0001$1\u0001"), r"\{#([^#]+)#\}", "\u0001$1\u0001")
    pieces = F.split(marked, "\u0001")
    joined = F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, convert(p)).otherwise(p)), "")
    for pattern in (ENGLISH_INLINE, ENGLISH_WRAPPERS, r"</?LEND>|</?ENT>"):
        joined = F.regexp_replace(joined, pattern, "")
    return T.trim_space(F.regexp_replace(F.regexp_replace(joined, BAR, " "), T.SPACE + "+", " "))


def clean_native(body: Column, convert) -> Column:
    stripped = F.regexp_replace(F.regexp_replace(body, SANSKRIT_MARKUP, ""), BAR, " ")
    return T.trim_space(F.regexp_replace(convert(stripped), T.SPACE + "+", " "))


def budget(head: Column, body: Column, chars: int) -> Column:
    """Drop the echoed head word, then cut to the character budget."""
    echo = F.when(F.startswith(body, head), F.regexp_replace(F.substr(body, F.length(head) + 1), f"^{T.SPACE}+", "")).otherwise(body)
    return F.when(F.length(echo) > chars, F.concat(F.regexp_replace(F.substring(echo, 1, chars), f"{T.SPACE}+$", ""), F.lit("…"))).otherwise(echo)


def fold_senses(entries: DataFrame, limit: int, head: str = "head", order: str = "rec", body: str = "body") -> DataFrame:
    """One body per head: later senses are appended while the text is short.

    Every append adds at least five characters, so no more than
    ``(limit - 30) / 5 + 2`` senses can take part; the rest is dropped before the
    fold, and a head with millions of records still folds a short list.
    """
    most = max((limit - 30) // 5 + 2, 1)
    cut = int(limit * 1.5)
    first = top_per_group(entries.select(head, order, body).filter(F.col(body) != ""), [head], [F.asc(order)], most, "place")
    folded = F.aggregate(
        F.transform(F.array_sort(F.collect_list(F.struct("place", body))), lambda s: s[body]),
        F.lit(None).cast("string"),
        lambda acc, b: F.when(acc.isNull(), b)
        .when(F.length(acc) < limit - 30, F.concat(F.substring(F.concat(acc, F.lit(SENSE_GLUE), b), 1, cut), F.lit("…")))
        .otherwise(acc),
    )
    return first.groupBy(head).agg(folded.alias(body))


def build_lexicon(raw: DataFrame, dict_id: str, native_body: bool, chars: int, to_native, to_roman) -> DataFrame:
    """``dict_id, head, iast, en, src`` from a tagged dump."""
    records = parse_dump(raw).withColumn("head", to_native(F.col("k1"))).withColumn("iast", to_roman(F.col("k1")))
    cleaned = clean_native(F.col("body"), to_native) if native_body else clean_english(F.col("body"), to_native)
    records = records.withColumn("body", budget(F.col("head"), cleaned, chars)).filter((F.col("head") != "") & (F.col("body") != ""))
    romans = records.groupBy("head").agg(F.min_by("iast", "rec").alias("iast"))
    return fold_senses(records, chars).join(romans, "head").select(
        F.lit(dict_id).alias("dict_id"), "head", "iast", F.col("body").alias("en"), F.lit(dict_id).alias("src")
    )
