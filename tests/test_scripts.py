import pytest
from pyspark.sql import functions as F

from corpuskit.functions import scripts as S


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v"))).first()[0]


@pytest.mark.parametrize("scheme,written", [("iast", "kṛṣṇaḥ"), ("hk", "kRSNaH"), ("slp1", "kfzRaH"), ("itrans", "kRRiShNaH")])
def test_romanisation_round_trip(spark, scheme, written):
    assert one(spark, "कृष्णः", lambda c: S.to_roman(c, scheme)) == written
    assert one(spark, written, lambda c: S.from_roman(c, scheme)) == "कृष्णः"


def test_words(spark):
    assert one(spark, "ब्रह्म", S.to_roman) == "brahma"
    assert one(spark, "ātman", S.from_roman) == "आत्मन्"
    assert one(spark, "अ एव", S.to_roman) == "a eva"


@pytest.mark.parametrize("script", ["bengali", "gurmukhi", "gujarati", "oriya", "tamil", "telugu", "kannada", "malayalam", "grantha"])
def test_scripts_round_trip(spark, script):
    out = one(spark, "नमस्ते राम", lambda c: S.convert(c, script))
    assert out and out != "नमस्ते राम"
    assert one(spark, out, lambda c: S.from_script(c, script)) == "नमस्ते राम"
    if script != "grantha":
        assert one(spark, out, S.detect_script) == script


def test_detection(spark):
    cases = {"राम": "devanagari", "rāma": "iast", "RAma.": "itrans", "raama": "hk"}
    for text, script in cases.items():
        assert one(spark, text, S.detect_script) == script


def test_native_forms(spark):
    df = spark.createDataFrame([("आत्मा",), ("ātmā",), ("atma",), ("ആത്മാ",), ("  ",)], "v string")
    native, ascii_ = S.native_forms(F.col("v"))
    got = [(r.n, r.a) for r in df.select(native.alias("n"), ascii_.alias("a")).collect()]
    assert got == [("आत्मा", "atma"), ("आत्मा", "atma"), ("अत्म", "atma"), ("आत्मा", "atma"), ("", "")]


def test_query_variants(spark):
    assert {"सर्वं", "सर्व", "सर्वम्"} <= set(one(spark, "सर्वं", S.query_variants))
    assert "आत्म" in one(spark, "atma", S.query_variants)
    assert one(spark, " ", S.query_variants) == []


def by_letter(word, scheme):
    """A romanisation read one letter after the other, longest letters first."""
    import re

    def letters(text, known):
        return re.findall("|".join(re.escape(t) for t in sorted(known, key=lambda t: (-len(t), t))) + "|(?s:.)", text)

    vowels, consonants, marks = S.ROMAN[scheme]
    also = S.ALSO_READ[scheme]
    word = "".join(also.get(t, t) for t in letters(word, [*vowels, *consonants, *marks, *also]))
    word = word.lower() if scheme == "iast" else word
    found, out = letters(word, [*vowels, *consonants, *marks]), []
    for i, t in enumerate(found):
        before, after = found[i - 1] if i else None, found[i + 1] if i + 1 < len(found) else None
        if t in consonants:
            out.append(S.CONSONANTS[consonants.index(t)] + ("" if after in vowels else S.VIRAMA))
        elif t in vowels:
            out.append((S.SIGNS if before in consonants else S.VOWELS)[vowels.index(t)])
        else:
            out.append(S.MARKS[marks.index(t)] if t in marks else t)
    return "".join(out)


@pytest.mark.parametrize("scheme", list(S.ROMAN))
def test_letters_beside_each_other(spark, scheme):
    """Letters of every length in any order, strange ones and spellings of either kind among them."""
    import random

    draw = random.Random(scheme)
    vowels, consonants, marks = S.ROMAN[scheme]
    able = [*vowels, *consonants, *marks, *S.ALSO_READ[scheme], "?", "ß", "क", "A", "R", "h", ".", "\U0001f600", " "]
    words = ["", *able, *("".join(draw.choice(able) for _ in range(draw.randint(2, 9))) for _ in range(1500))]
    rows = spark.createDataFrame([(w,) for w in words], "v string").select("v", S.from_roman(F.col("v"), scheme).alias("got")).collect()
    assert {r.v: r.got for r in rows} == {w: by_letter(w, scheme) for w in words}


def test_a_word_is_cut_into_letters_once(spark):
    """One search for letters per word: as an expression inside the loop over the letters it ran for every letter again."""
    plan = spark.createDataFrame([("x",)], "v string").select(S.from_roman(F.col("v"), "hk").alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
