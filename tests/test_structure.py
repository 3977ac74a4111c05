import random

from pyspark.sql import functions as F

from corpuskit.operators import ordering, search, structure
from corpuskit.operators.ordering import int_bucket


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_positions_with_narrow_buckets(spark):
    rng = random.Random(1)
    data = [(k, n) for k in "ab" for n in rng.sample(range(500), 120)]
    df = spark.createDataFrame(data, "k string, n bigint")
    got = {(r.k, r.n): r.pos for r in ordering.positions(df, ["k"], ["n"], int_bucket(F.col("n"), 7)).collect()}
    for k in "ab":
        for i, n in enumerate(sorted(n for kk, n in data if kk == k)):
            assert got[k, n] == i


def test_neighbours_cross_buckets(spark):
    df = spark.createDataFrame([("a", n) for n in (1, 5, 9, 30)], "k string, n bigint")
    out = ordering.neighbours(df, ["k"], ["n"], int_bucket(F.col("n"), 4), "n")
    assert rows(out.select("n", "prev_id", "next_id").fillna(-1)) == [(1, -1, 5), (5, 1, 9), (9, 5, 30), (30, 9, -1)]


def test_rolling_buffer_crosses_buckets(spark):
    df = spark.createDataFrame([("u", i, str(i)) for i in range(50)], "k string, pos bigint, v string")
    out = search.rolling_buffer(df, ["k"], "pos", "v", size=6, width=10).collect()
    assert len(out) == 50
    for r in out:
        assert r.buffer == [str(i) for i in range(max(0, r.pos - 5), r.pos + 1)]


def units(spark, blocks, root="r"):
    return spark.createDataFrame([(root, [(k, k) for k in blocks])], "root string, blocks array<struct<kind:string,text:string>>")


def test_leading_split(spark):
    def split(blocks, root="r"):
        r = structure.leading_split(units(spark, blocks, root)).first()
        return [b.kind for b in r.leading_blocks], [b.kind for b in r.trailing_blocks]

    lead, intro, other = "leading_bhashya", "intro_bhashya", "bhashya"
    assert split([lead, other]) == ([lead], [other])
    assert split([lead, intro, other, lead]) == ([lead, intro], [other, lead])
    assert split([other, lead]) == ([], [other, lead])
    assert split([lead], "") == ([], [lead])
    assert split([]) == ([], [])
    assert split([lead, intro]) == ([lead, intro], [])


def test_assemble_units_intros_and_outro(spark):
    kinds = "ppvvpvpp"
    df = spark.createDataFrame([("c", i, k == "v") for i, k in enumerate(kinds)], "c string, pos bigint, is_verse boolean")
    got = {r.pos: (r.verse_no, r.intro_no, r.is_outro) for r in structure.assemble_units(df, ["c"], "pos", 3).collect()}
    assert got[0][1] == got[1][1] == 1 and got[0][2] is False
    assert [got[i][0] for i in (2, 3, 5)] == [1, 2, 3]
    assert got[4][1:] == (2, False)
    assert got[6][1:] == got[7][1:] == (3, True)


def test_unit_kind_and_ordinal(spark):
    df = spark.createDataFrame([("sutra", "X_V01"), (None, "MK_C02_K07"), ("shloka", "A_V3"), ("", "A_V13"), (None, "A")], "t string, i string")
    out = df.select(structure.unit_kind(F.col("t"), F.col("i")).alias("k"), structure.unit_ordinal(F.col("i"), F.lit(99)).alias("o")).collect()
    assert [(r.k, r.o) for r in out] == [("sutra", 1), ("karika", 7), ("verse", 3), ("mantra", 13), ("mantra", 99)]
