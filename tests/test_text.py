from hypothesis import given, settings
from hypothesis import strategies as st
import regex
from pyspark.sql import functions as F

from corpuskit.functions import text as T
from corpuskit.functions.morph import morph_features


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v"))).first()[0]


def test_ascii_fold(spark):
    assert one(spark, "Ātmā Kṛṣṇa Ñ ḹ été", T.ascii_fold) == "atma krsna n l ete"


def test_aksharas(spark):
    for word, parts in {
        "कमल": ["क", "म", "ल"],
        "रामः": ["रा", "मः"],
        "अहं": ["अ", "हं"],
        "कः": ["कः"],
        "ब्रह्म": ["ब्र", "ह्म"],
        "कृष्ण": ["कृ", "ष्ण"],
    }.items():
        assert one(spark, word, T.aksharas) == parts


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(min_codepoint=0x0900, max_codepoint=0x097F), max_size=12))
def test_aksharas_restore_the_input(word):
    assert "".join(regex.findall(T.AKSHARA, word)) == word


def test_phonetic_skeleton(spark):
    assert one(spark, "कामलं hello रामः", T.phonetic_skeleton) == one(spark, "कमल राम", T.phonetic_skeleton)
    assert one(spark, "hello 12", T.follow_tokens) == []


def test_normalise_space(spark):
    assert one(spark, "क ख\n\n\n ग​\t", T.normalise_space) == "क ख\n\nग"


def test_snippet_and_reference(spark):
    text = "a" * 50 + "NEEDLE" + "b" * 200
    got = spark.createDataFrame([(text,)], "t string").select(
        T.snippet_around(F.col("t"), F.call_function("instr", F.col("t"), F.lit("NEEDLE")), 30, 110)
    ).first()[0]
    assert got == "…" + text[20:160] + "…"
    assert one(spark, "BR_C04_S05_V13", T.degraded_reference) == "C04 · S05 · V13"


def test_highlight(spark):
    row = spark.createDataFrame([("the then a.b", ["the", "then", "a.b"])], "t string, k array<string>")
    assert row.select(T.highlight(F.col("t"), F.col("k"))).first()[0] == "<mark>the</mark> <mark>then</mark> <mark>a.b</mark>"
    marks = spark.createDataFrame([("सर्वं", ["सर्व"]), ("राम", ["सीता"])], "t string, k array<string>")
    assert [r[0] for r in marks.select(T.token_is_highlighted(F.col("t"), F.col("k"))).collect()] == [True, False]


def test_split_senses(spark):
    assert one(spark, "one · two ·  three", T.split_senses) == ["one", "two", "three"]
    assert one(spark, "1. one 2. two", T.split_senses) == ["1. one", "2. two"]
    assert one(spark, " single ", T.split_senses) == ["single"]


def test_morph(spark):
    labels = ["a-stem gen. sg.", "instr. pl.", "perf. 3sg of √vac", "perf.", "gen.", "adverb"]
    df = spark.createDataFrame([(x,) for x in labels], "l string").select(morph_features(F.col("l")).alias("m"))
    a, b, c, d, e, f = [r.m for r in df.collect()]
    assert (a.vibhakti, a.vacana, a.linga) == (6, "eka", "m")
    assert (b.vibhakti, b.vacana, b.linga) == (3, "bahu", None)
    assert (c.lakara, c.purusha, c.vacana) == ("lit", 3, "eka")
    assert d is None and e is None and f is None


def test_morph_words(spark):
    """Earlier values win over earlier words; a stem word may name the gender; a case needs its full stop."""
    labels = ["n-stem nom./acc. dual", "gen./abl. sg.", "fut. 3sg passive", "genitive case", "perfect tense generally", "", None, "m. loc. Plural", "aor. 2nd pl"]
    df = spark.createDataFrame([(x,) for x in labels], "l string").select(morph_features(F.col("l")).alias("m"))
    got = [r.m and tuple(r.m) for r in df.collect()]
    assert got == [(None, None, "dvi", 1, "n"), (None, None, "eka", 5, None), ("lrt", 3, "eka", None, None), None, None, None, None, (None, None, "bahu", 7, "m"), ("lun", 2, "bahu", None, None)]
