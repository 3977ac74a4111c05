"""Script detection and conversion as column expressions, and the normal forms for search."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuskit.functions import text as T

# The letters of the canonical script and of the romanisations, in one order.
VOWELS = "अ आ इ ई उ ऊ ऋ ॠ ऌ ॡ ए ऐ ओ औ".split()
SIGNS = ["", *"ा ि ी ु ू ृ ॄ ॢ ॣ े ै ो ौ".split()]
CONSONANTS = "क ख ग घ ङ च छ ज झ ञ ट ठ ड ढ ण त थ द ध न प फ ब भ म य र ल व श ष स ह ळ".split()
MARKS = "ं ः ँ ऽ".split()
VIRAMA = "्"
ROMAN = {
    "iast": (
        "a ā i ī u ū ṛ ṝ ḷ ḹ e ai o au".split(),
        "k kh g gh ṅ c ch j jh ñ ṭ ṭh ḍ ḍh ṇ t th d dh n p ph b bh m y r l v ś ṣ s h ḻ".split(),
        "ṃ ḥ m̐ '".split(),
    ),
    "itrans": (
        "a A i I u U RRi RRI LLi LLI e ai o au".split(),
        "k kh g gh ~N ch Ch j jh ~n T Th D Dh N t th d dh n p ph b bh m y r l v sh Sh s h L".split(),
        "M H .N .a".split(),
    ),
    "hk": (
        "a A i I u U R RR lR lRR e ai o au".split(),
        "k kh g gh G c ch j jh J T Th D Dh N t th d dh n p ph b bh m y r l v z S s h L".split(),
        "M H ~ '".split(),
    ),
    "slp1": (
        "a A i I u U f F x X e E o O".split(),
        "k K g G N c C j J Y w W q Q R t T d D n p P b B m y r l v S z s h L".split(),
        "M H ~ '".split(),
    ),
}
# Other spellings accepted when reading.
ALSO_READ = {
    "iast": {"ṁ": "ṃ"},
    "itrans": {"aa": "A", "ii": "I", "ee": "I", "uu": "U", "oo": "U", "R^i": "RRi", "R^I": "RRI", "w": "v", "x": "kSh", ".n": "M", ".m": "M", "shh": "Sh"},
    "hk": {},
    "slp1": {},
}
# Start of the block of each script that is laid out like the canonical one.
BLOCKS = {
    "bengali": 0x0980,
    "gurmukhi": 0x0A00,
    "gujarati": 0x0A80,
    "oriya": 0x0B00,
    "tamil": 0x0B80,
    "telugu": 0x0C00,
    "kannada": 0x0C80,
    "malayalam": 0x0D00,
    "grantha": 0x11300,
}
# Letters a script lacks, and how it writes them.
SUBSTITUTES = {"bengali": {"व": "ব"}, "tamil": {"ं": "ம்"}}
# Tamil writes the rows of stops with raised numbers.
TAMIL_ROWS = (("क", "ख ग घ"), ("च", "छ"), ("ज", "झ"), ("ट", "ठ ड ढ"), ("त", "थ द ध"), ("प", "फ ब भ"))
# Order and ranges of script detection.
DETECTION = (
    ("devanagari", r"[ऀ-ॿ]"),
    ("malayalam", r"[ഀ-ൿ]"),
    ("tamil", r"[஀-௿]"),
    ("telugu", r"[ఀ-౿]"),
    ("kannada", r"[ಀ-೿]"),
    ("bengali", r"[ঀ-৿]"),
    ("gurmukhi", r"[਀-੿]"),
    ("gujarati", r"[઀-૿]"),
    ("oriya", r"[଀-୿]"),
)
NATIVE = r"[ऀ-ॿ᳐-᳿]"
OTHER_INDIC = r"[ঀ-࿿]"
DIACRITICS = r"(?iu)[āīūṛṝḷḹṃḥṅñṭḍṇśṣ]"


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _alternation(tokens) -> str:
    """Longest token first, then any character."""
    return "|".join([*(re.escape(t) for t in sorted(tokens, key=lambda t: (-len(t), t))), "(?s:.)"])


def replace_letters(c: Column, table: dict[str, str]) -> Column:
    letters = T.matches(c, _alternation(table))
    return F.array_join(F.transform(letters, lambda x: F.coalesce(F.try_element_at(_map(table), x), x)), "")


def block_table(script: str) -> dict[str, str]:
    """Canonical letters to those of a script, by the parallel layout of their blocks."""
    base, table = BLOCKS[script], {}
    for offset in range(0x01, 0x70):
        source, target = chr(0x0900 + offset), chr(base + offset)
        if offset not in (0x64, 0x65) and unicodedata.name(source, "") and unicodedata.name(target, ""):
            table[source] = target
    if script == "tamil":
        for first, rest in TAMIL_ROWS:
            for power, letter in zip("²³⁴", rest.split()):
                table[letter] = table[first] + power
    table.update(SUBSTITUTES.get(script, {}))
    return table


def to_roman(c: Column, scheme: str = "iast") -> Column:
    """Canonical script to a romanisation: a consonant without sign carries ``a``."""
    vowels, consonants, marks = ROMAN[scheme]
    bare = dict(zip(CONSONANTS, consonants))
    signs = {**dict(zip(SIGNS[1:], vowels[1:])), VIRAMA: ""}
    single = {**dict(zip(VOWELS, vowels)), **dict(zip(MARKS, marks))}
    digits = {chr(0x0966 + d): str(d) for d in range(10)}
    pattern = r"[क-हळ]़?[ा-्ॢॣ]?|(?s:.)"
    tail = lambda x: F.regexp_replace(F.substring(x, 2, 2), r"़", "")

    def one(x: Column) -> Column:
        letter = F.try_element_at(_map(bare), F.substring(x, 1, 1))
        vowel = F.when(tail(x) == "", F.lit(vowels[0])).otherwise(F.coalesce(F.try_element_at(_map(signs), tail(x)), tail(x)))
        return F.coalesce(F.concat(letter, vowel), F.try_element_at(_map({**single, **digits}), x), x)

    return F.array_join(F.transform(T.matches(c, pattern), one), "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def from_roman(c: Column, scheme: str = "iast") -> Column:
    """Romanisation to the canonical script, longest letters first.

    Every letter is looked up once, for its number: consonants come first, then vowels, then
    marks, 0 is no letter.  What stands beside a letter is then a matter of two numbers.
    """
    vowels, consonants, marks = ROMAN[scheme]
    also = ALSO_READ[scheme]
    if also:
        read = replace_letters(c, {**{t: t for t in [*vowels, *consonants, *marks] if len(t) > 1}, **also})
        c = F.when(c.rlike("|".join(re.escape(t) for t in also)), read).otherwise(c)
    if scheme == "iast":
        c = F.lower(c)
    numbers = {t: i + 1 for i, t in enumerate([*consonants, *vowels, *marks])}
    is_cons = lambda n: F.coalesce((n > 0) & (n <= len(consonants)), F.lit(False))
    is_vowel = lambda n: F.coalesce((n > len(consonants)) & (n <= len(consonants) + len(vowels)), F.lit(False))
    alone = F.array(*[F.lit(x) for x in [*CONSONANTS, *VOWELS, *MARKS]])
    signs = F.array(*[F.lit(x) for x in SIGNS])

    def build(letters: Column) -> Column:
        def one(w: Column) -> Column:
            def letter(n: Column, i: Column) -> Column:
                before, after = F.get(w, i - 1), F.get(w, i + 1)
                own = F.get(alone, n["n"] - 1)
                return (
                    F.when(is_cons(n["n"]), F.concat(own, F.when(is_vowel(after["n"]), "").otherwise(VIRAMA)))
                    .when(is_vowel(n["n"]) & is_cons(before["n"]), F.get(signs, n["n"] - (len(consonants) + 1)))
                    .when(n["n"] > 0, own)
                    .otherwise(n["x"])
                )

            return F.array_join(F.transform(w, letter), "")

        numbered = F.transform(letters, lambda x: F.struct(x.alias("x"), F.coalesce(F.try_element_at(_map(numbers), x), F.lit(0)).alias("n")))
        return _let(numbered, one)

    # A letter of one character is what any character is.
    return build(T.matches(c, _alternation(t for t in numbers if len(t) > 1)))


def convert(c: Column, target: str) -> Column:
    """Canonical script to any of the display scripts."""
    if target == "devanagari":
        return c
    return to_roman(c, target) if target in ROMAN else replace_letters(c, block_table(target))


def from_script(c: Column, script: str) -> Column:
    """Any supported script to the canonical one."""
    if script == "devanagari":
        return c
    return from_roman(c, script) if script in ROMAN else replace_letters(c, {v: k for k, v in block_table(script).items()})


def detect_script(c: Column) -> Column:
    """First range that occurs; Latin text is IAST, ITRANS or HK by its letters."""
    out = F.when(c.rlike(DETECTION[0][1]), DETECTION[0][0])
    for script, pattern in DETECTION[1:]:
        out = out.when(c.rlike(pattern), script)
    return out.when(c.rlike(DIACRITICS), "iast").when(c.rlike(r"[A-Z]{2,}|\."), "itrans").otherwise("hk")


def to_canonical(c: Column) -> Column:
    """Input in any script to the canonical script by detection."""
    script = detect_script(c)
    out = F.when(script == "devanagari", c)
    for name in [*[s for s, _ in DETECTION[1:]], "iast", "itrans", "hk"]:
        out = out.when(script == name, from_script(c, name))
    return out.otherwise(c)


def native_forms(c: Column) -> tuple[Column, Column]:
    """``(native, ascii)`` search forms of a string in any script."""
    raw = T.trim_space(c)
    script = detect_script(raw)
    indic = F.lit("")
    for name, _ in reversed(DETECTION[1:]):
        indic = F.when(script == name, from_script(raw, name)).otherwise(indic)
    ladder = []
    for scheme in ("iast", "itrans", "hk", "slp1"):
        out = from_roman(raw, scheme)
        ladder.append(F.when(out.rlike(NATIVE), out))
    native = F.when(raw.rlike(NATIVE), raw).when(raw.rlike(OTHER_INDIC), indic).otherwise(F.coalesce(*ladder, F.lit("")))
    ascii_ = F.when(raw.rlike(NATIVE) | raw.rlike(OTHER_INDIC), T.ascii_fold(to_roman(native))).otherwise(T.ascii_fold(raw))
    return native, ascii_


# Endings a word may also have (ending, replacement, shortest word).
ENDING_VARIANTS = (
    ("ं", "", 1),
    ("ं", "म्", 1),
    ("ः", "", 1),
    ("ः", "स्", 1),
    ("ो", "ः", 1),
    ("ो", "स्", 1),
    ("ा", "न्", 3),
    ("्", "", 1),
)
# Readings of a plain ASCII word (pattern, replacement, first match only).
ASCII_GUESSES = (
    ("^a", "ā", True),
    ("a$", "ā", True),
    ("i", "ī", False),
    ("u", "ū", False),
    ("ri", "ṛ", False),
    ("aa", "ā", False),
    ("sh", "ś", False),
    ("sh", "ṣ", False),
    ("m$", "ṃ", True),
    ("h$", "ḥ", True),
    ("a$", "an", True),
    ("an$", "", True),
)


def ending_variants(word: Column) -> Column:
    """The word and its other endings."""
    others = [
        F.when(F.endswith(word, F.lit(end)) & (F.length(word) >= shortest), F.concat(F.substr(word, F.lit(1), F.length(word) - len(end)), F.lit(new)))
        for end, new, shortest in ENDING_VARIANTS
    ]
    return F.array_distinct(F.filter(F.array(word, *others), lambda x: x.isNotNull() & (x != "")))


def query_variants(c: Column) -> Column:
    """Every canonical form a query word may stand for, used for highlighting."""
    raw = T.trim_space(c)
    native, _ = native_forms(raw)
    folded = T.ascii_fold(raw)
    guesses = F.array(folded, *[F.regexp_replace(folded, p, new) for p, new, _ in ASCII_GUESSES])
    plain = ~raw.rlike(NATIVE) & ~raw.rlike(DIACRITICS)
    read = F.transform(F.array_distinct(guesses), lambda g: from_roman(g, "iast"))
    bases = F.concat(F.array(native), F.when(plain, F.filter(read, lambda x: x.rlike(NATIVE))).otherwise(F.array().cast("array<string>")))
    every = F.flatten(F.transform(F.filter(bases, lambda b: b != ""), ending_variants))
    return F.when(raw == "", F.array().cast("array<string>")).otherwise(F.array_distinct(every))
