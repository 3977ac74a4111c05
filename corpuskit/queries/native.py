"""Native-script forms of the vocabulary: search forms, highlighting variants and phonetic skeletons, with the letter maps as SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from corpuskit.functions import scripts as S
from corpuskit.functions import text as T
from corpuskit.operators.freq import token_stream
from corpuskit.queries.tables import SQL_SPACE, SQL_VOCAB, read, vocabulary
from corpuskit.session import materialised, spread


def words(spark, sf):
    return materialised(vocabulary(spark, sf).select("token"), "token")


def native_forms(spark, sf):
    """Canonical and folded search form of every word."""
    native, folded = S.native_forms(F.col("token"))
    return words(spark, sf).select("token", native.alias("native"), folded.alias("ascii"))


def romanisations(spark, sf):
    """Every word read by each of the four romanisations."""
    scheme = F.explode(F.array(*[F.struct(F.lit(s).alias("scheme"), S.from_roman(F.col("token"), s).alias("native")) for s in S.ROMAN]))
    return words(spark, sf).select("token", scheme.alias("r")).select("token", "r.*")


def script_targets(spark, sf):
    """Every word in the canonical script, written in each display script of the same layout and read back."""
    native = S.from_roman(F.col("token"), "hk")
    back = F.explode(F.array(*[F.struct(F.lit(s).alias("script"), S.from_script(S.convert(native, s), s).alias("back")) for s in LOSSLESS]))
    return words(spark, sf).select("token", back.alias("b")).select("token", "b.*")


# Scripts that have a letter for every letter of the romanisation.
LOSSLESS = ("telugu", "kannada", "malayalam")


def phonetic_skeletons(spark, sf):
    """What a recogniser keeps of every word."""
    skeleton = T.phonetic_skeleton(S.from_roman(F.col("token"), "hk"))
    return words(spark, sf).select("token", skeleton.alias("skeleton"), F.size(T.follow_tokens(S.from_roman(F.col("token"), "hk"))).alias("n_tokens"))


def query_variants(spark, sf):
    """Canonical forms a benchmark word may stand for."""
    asked = token_stream(read(spark, sf, "benchmark"), F.lower("text"), T.LATIN_WORD).distinct()
    return spread(asked, "token").select("token", F.explode(S.query_variants(F.col("token"))).alias("variant"))


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql_map(keys, values) -> str:
    return "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in dict(zip(keys, values)).items()) + "}"


def sql_letters(c: str, tokens) -> str:
    longest_first = sorted(tokens, key=lambda t: (-len(t), t))
    return f"regexp_extract_all({c}, {quoted('|'.join(map(re.escape, longest_first)) + '|(?s:.)')})"


def sql_let(name: str, value: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def sql_from_roman(c: str, scheme: str) -> str:
    """A romanisation read letter by letter: a consonant keeps its vowel sign, or none."""
    vowels, consonants, marks = S.ROMAN[scheme]
    also = S.ALSO_READ[scheme]
    if also:
        every = [*vowels, *consonants, *marks, *also]
        c = f"array_to_string(list_transform({sql_letters(c, every)}, lambda a: coalesce({sql_map(also, also.values())}[a], a)), '')"
    c = f"lower({c})" if scheme == "iast" else c
    free, cons, signs, other = sql_map(vowels, S.VOWELS), sql_map(consonants, S.CONSONANTS), sql_map(vowels, S.SIGNS), sql_map(marks, S.MARKS)
    one = f"""CASE WHEN {cons}[l[i]] IS NOT NULL THEN {cons}[l[i]] || CASE WHEN i < len(l) AND {free}[l[i + 1]] IS NOT NULL THEN '' ELSE '{S.VIRAMA}' END
      WHEN {free}[l[i]] IS NOT NULL THEN CASE WHEN i > 1 AND {cons}[l[i - 1]] IS NOT NULL THEN {signs}[l[i]] ELSE {free}[l[i]] END
      ELSE coalesce({other}[l[i]], l[i]) END"""
    return sql_let("l", sql_letters(c, [*vowels, *consonants, *marks]), f"array_to_string(list_transform(range(1, len(l) + 1), lambda i: {one}), '')")


SQL_NATIVE = r"'[\x{0900}-\x{097f}\x{1cd0}-\x{1cff}]'"


def sql_native(c: str) -> str:
    """First romanisation that gives the canonical script."""
    reads = ", ".join(sql_let("r", sql_from_roman(c, s), f"CASE WHEN regexp_matches(r, {SQL_NATIVE}) THEN r END") for s in S.ROMAN)
    return f"coalesce({reads}, '')"


def sql_endings(c: str) -> str:
    others = ", ".join(
        f"CASE WHEN ends_with({c}, {quoted(e)}) AND length({c}) >= {n} THEN substr({c}, 1, length({c}) - {len(e)}) || {quoted(r)} END" for e, r, n in S.ENDING_VARIANTS
    )
    return f"[{c}, {others}]"


def sql_skeleton(c: str) -> str:
    c = rf"regexp_replace({c}, '[^{SQL_SPACE[1:-1]}\x{{0900}}-\x{{097f}}]', ' ', 'g')"
    c = rf"regexp_replace({c}, '[\x{{0900}}-\x{{0903}}\x{{093c}}\x{{0951}}-\x{{0954}}\x{{0962}}\x{{0963}}\x{{097d}}]', '', 'g')"
    c = f"translate({c}, 'आईऊॠॡीूॄा', 'अइउऋऌिुृ')"
    return f"trim(regexp_replace({c}, '{SQL_SPACE}+', ' ', 'g'))"


GUESSES = ", ".join(f"regexp_replace(folded, '{p}', '{new}', 'g')" for p, new, _ in S.ASCII_GUESSES)
SQL_VARIANTS = rf"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS token FROM benchmark),
  n AS (SELECT token, {sql_native('token')} AS native, lower(strip_accents(token)) AS folded FROM w),
  g AS (SELECT token, native, CASE WHEN regexp_matches(token, {SQL_NATIVE}) OR regexp_matches(token, '(?i)[āīūṛṝḷḹṃḥṅñṭḍṇśṣ]') THEN [] ELSE list_distinct([folded, {GUESSES}]) END AS guesses FROM n),
  b AS (SELECT token, native AS base FROM g UNION SELECT token, base FROM (SELECT token, {sql_from_roman('x', 'iast')} AS base FROM (SELECT token, unnest(guesses) AS x FROM g)) WHERE regexp_matches(base, {SQL_NATIVE})),
  v AS (SELECT DISTINCT token, unnest({sql_endings('base')}) AS variant FROM b WHERE base <> '')
  SELECT * FROM v WHERE variant <> ''"""
SQL_HK = sql_from_roman("token", "hk")

QUERIES = {
    "native_forms": (native_forms, f"WITH {SQL_VOCAB} SELECT token, {sql_native('token')} AS native, lower(strip_accents(token)) AS ascii FROM vocab"),
    "romanisations": (
        romanisations,
        f"WITH {SQL_VOCAB} " + " UNION ALL ".join(f"SELECT token, '{s}' AS scheme, {sql_from_roman('token', s)} AS native FROM vocab" for s in S.ROMAN),
    ),
    "script_targets": (script_targets, f"WITH {SQL_VOCAB} SELECT token, s AS script, {SQL_HK} AS back FROM vocab, (VALUES {', '.join(f'({quoted(s)})' for s in LOSSLESS)}) t(s)"),
    "phonetic_skeletons": (
        phonetic_skeletons,
        f"""WITH {SQL_VOCAB}, k AS (SELECT token, {sql_skeleton(SQL_HK)} AS skeleton FROM vocab)
        SELECT token, skeleton, CAST(len(list_filter(regexp_extract_all(skeleton, '(?:[क-हळ]्)*[क-हळ][ा-ौॢॣ]?्?|(?s:.)'), lambda x: trim(x) <> '')) AS INTEGER) AS n_tokens FROM k""",
    ),
    "query_variants": (query_variants, SQL_VARIANTS),
}
