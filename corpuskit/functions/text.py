"""Text column functions: tokenisers, folds, cleaning, counts.

All of them are built-in expressions, so they stay inside code generation.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes, written as escapes so that no tool can
# decompose them.
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
LATIN_WORD = r"\p{L}+"
SCRIPT_RUN = r"[\u0900-\u097f]+"
DICT_TOKEN = r"[\u0900-\u0963\u0972-\u097f]+"
SCRIPT_LETTER = r"[\u0904-\u0939\u0958-\u095f\u0960-\u0961]"
ANY_LETTER = r"\p{L}"
INDEX_SPLIT = "[" + SPACE[1:-1] + r"\u0964\u0965,;:—–\-()\[\]\"'`\u0970\u093d.!?/]+"
IN_TEXT_SPLIT = "[" + SPACE[1:-1] + r"\u0964\u0965,;:—–\-()\[\]\"'`]+"
LOOKUP_PUNCTUATION = "[" + SPACE[1:-1] + r"\u0964\u0965,.;:?!«»\"'()\[\]]+"
AKSHARA = (
    r"[\u0915-\u0939\u0958-\u095f\u0978-\u097f](?:\u094d[\u0915-\u0939\u0958-\u095f\u0978-\u097f])*\u094d?"
    r"\u093c*[\u093a-\u094c\u0955-\u0957\u0962-\u0963]?[\u0900-\u0903\u093c\u0951-\u0954]*"
    r"|[\u0904-\u0914\u0960-\u0961\u0972-\u0977\u093a-\u094c\u0955-\u0957\u0962-\u0963\u0900-\u0903\u0951-\u0954\u094d]"
    r"\u093c*[\u093a-\u094c\u0955-\u0957\u0962-\u0963]?[\u0900-\u0903\u093c\u0951-\u0954]*"
    r"|(?s:.)"
)


def _fold_table() -> tuple[str, str]:
    """Precomposed Latin letters and the base letter each decomposes to."""
    sources, targets = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        letter = chr(code)
        base = "".join(ch for ch in unicodedata.normalize("NFD", letter) if not "\u0300" <= ch <= "\u036f")
        if len(base) == 1 and base != letter:
            sources.append(letter)
            targets.append(base)
    return "".join(sources), "".join(targets)


FOLD_FROM, FOLD_TO = _fold_table()


def ascii_fold(c: Column) -> Column:
    """Drop Latin diacritics and lower the case."""
    return F.lower(F.translate(F.regexp_replace(c, r"[\u0300-\u036f]", ""), FOLD_FROM, FOLD_TO))


def matches(c: Column, pattern: str) -> Column:
    """Every match of ``pattern`` in order."""
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def split_nonempty(c: Column, pattern: str) -> Column:
    return F.filter(F.split(c, pattern), lambda x: x != "")


def space_tokens(c: Column) -> Column:
    return split_nonempty(c, SPACE + "+")


def space_token_count(c: Column) -> Column:
    return F.size(space_tokens(c))


def run_count(c: Column, pattern: str = SCRIPT_RUN) -> Column:
    """Word count by script runs, the definition behind text counts."""
    return F.size(matches(c, pattern))


def index_tokens(c: Column) -> Column:
    return split_nonempty(c, INDEX_SPLIT)


def in_text_tokens(c: Column) -> Column:
    return split_nonempty(c, IN_TEXT_SPLIT)


def useful_token(c: Column, letter: str = SCRIPT_LETTER) -> Column:
    return (F.length(c) >= 2) & c.rlike(letter)


def clean_lookup_word(c: Column) -> Column:
    return F.regexp_replace(c, LOOKUP_PUNCTUATION, "")


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def normalise_space(c: Column) -> Column:
    """Non-breaking and zero-width characters, runs of blanks, extra line breaks."""
    c = F.regexp_replace(c, "\u00a0", " ")
    c = F.regexp_replace(c, "\u200b", "")
    c = F.regexp_replace(c, r"[\t\r]+", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.regexp_replace(c, r"[ \f\x0b]+", " ")
    c = F.regexp_replace(c, r" *\n *", "\n")
    return trim_space(c)


def aksharas(c: Column) -> Column:
    """Orthographic syllables; joining the array restores the input."""
    return F.filter(matches(c, AKSHARA), lambda x: x != "")


def phonetic_skeleton(c: Column) -> Column:
    """What survives recogniser noise: script only, no nasals, short vowels."""
    c = F.regexp_replace(c, "[^" + SPACE[1:-1] + r"\u0900-\u097f]", " ")
    c = F.regexp_replace(c, r"[\u0900-\u0903\u093c\u0951-\u0954\u0962\u0963\u097d]", "")
    c = F.translate(
        c,
        "\u0906\u0908\u090a\u0960\u0961\u0940\u0942\u0944\u093e",
        "\u0905\u0907\u0909\u090b\u090c\u093f\u0941\u0943",
    )
    return trim_space(F.regexp_replace(c, SPACE + "+", " "))


def follow_tokens(c: Column) -> Column:
    """Skeleton syllables, the unit of position following."""
    return F.filter(aksharas(phonetic_skeleton(c)), lambda x: ~x.rlike(f"^{SPACE}*$"))


def array_ngrams(tokens: Column, n: int = 3) -> Column:
    """Joined n-grams over an array; a short array is one gram."""
    size = F.size(tokens)
    return F.when(size < n, F.array(F.array_join(tokens, ""))).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), ""))
    )


def char_ngrams(c: Column, n: int = 3) -> Column:
    """Character n-grams in order; a short string is one gram."""
    size = F.length(c)
    return F.when(size < n, F.array(c)).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: F.substr(c, i, F.lit(n)))
    )


def unit_body(root: Column, texts: Column) -> Column:
    """Root and every block text joined by a blank, empties dropped."""
    return F.array_join(F.filter(F.concat(F.array(F.coalesce(root, F.lit(""))), texts), lambda x: x.isNotNull() & (x != "")), " ")


def url_key(c: Column) -> Column:
    return F.substring(F.sha1(c), 1, 16)


def degraded_reference(unit_id: Column) -> Column:
    """``BR_C04_S05_V13`` becomes ``C04 · S05 · V13``."""
    return F.array_join(F.filter(F.split(unit_id, "_"), lambda p: p.rlike("^[A-Z][0-9]+")), " · ")


def snippet_around(text: Column, at: Column, before: int, after: int, marks: bool = True) -> Column:
    """Cut ``text`` around the 1-based position ``at``; at 0 it starts at the top."""
    zero = F.greatest(at - 1, F.lit(0))
    start = F.greatest(zero - before, F.lit(0))
    end = F.least(F.length(text), zero + after)
    cut = F.substr(text, start + 1, end - start)
    if not marks:
        return cut
    ellipsis = F.lit("…")
    return F.concat(
        F.when(start > 0, ellipsis).otherwise(F.lit("")), cut, F.when(end < F.length(text), ellipsis).otherwise(F.lit(""))
    )


def escape_regex(c: Column) -> Column:
    return F.regexp_replace(c, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def highlight(text: Column, tokens: Column, opening: str = "<mark>", closing: str = "</mark>") -> Column:
    """Wrap every token occurrence, longest token first."""
    words = F.array_distinct(F.filter(tokens, lambda x: x.isNotNull() & (x != "")))
    ordered = F.transform(
        F.array_sort(F.transform(words, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("w")))), lambda s: escape_regex(s["w"])
    )
    return F.when(F.size(words) == 0, text).otherwise(
        F.regexp_replace(text, F.concat(F.lit("("), F.array_join(ordered, "|"), F.lit(")")), F.lit(f"{opening}$1{closing}"))
    )


def token_is_highlighted(token: Column, tokens: Column) -> Column:
    """Exact match, or a match without the final nasal or visarga sign."""
    return F.array_contains(tokens, token) | (
        token.rlike(r"[\u0902\u0903]$") & F.array_contains(tokens, F.regexp_replace(token, r"[\u0902\u0903]$", ""))
    )


def split_senses(body: Column) -> Column:
    """Dot-separated senses, otherwise a numbered list, otherwise one sense."""
    dotted = F.split(body, f"{SPACE}+·{SPACE}+")
    numbered = F.split(body, SPACE + r"*(?=\b\d{1,2}\.\s)")
    chosen = F.when(F.size(dotted) > 1, dotted).otherwise(numbered)
    return F.filter(F.transform(chosen, trim_space), lambda x: x != "")

