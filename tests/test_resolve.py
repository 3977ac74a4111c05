import pytest
from pyspark.sql import functions as F

from corpuskit.operators import compound as C
from corpuskit.operators import resolve as R
from corpuskit.operators.similarity import nearest_heads
from corpuskit.rules import devanagari as D


def candidates(spark, *words):
    df = spark.createDataFrame([(w,) for w in words], "token string")
    return {(r.token, r.lemma, r.method) for r in R.lemma_candidates(df, D.manual_table(spark), D.rules(spark)).collect()}


def test_lemma_candidates(spark):
    got = candidates(spark, "तेषाम्", "अस्य", "उवाच", "रामस्य", "लोकेषु", "एकत्वात्", "ब्रह्मणः", "सर्वं", "देवो", "ब्रह्मा", "च")
    for want in [
        ("तेषाम्", "तद्", "manual"), ("अस्य", "इदम्", "manual"), ("उवाच", "वच्", "manual"), ("रामस्य", "राम", "rule"),
        ("लोकेषु", "लोक", "rule"), ("एकत्वात्", "एक", "rule"), ("ब्रह्मणः", "ब्रह्मन्", "rule"), ("सर्वं", "सर्वम्", "rule"),
        ("देवो", "देवस्", "rule"), ("ब्रह्मा", "ब्रह्मन्", "rule"),
    ]:
        assert want in got
    assert not [g for g in got if g[0] == "च"]


def test_rules_longest_first(spark):
    seqs = [(r.seq, len(r.suffix)) for r in D.rules(spark).orderBy("seq").collect()][len(D.SURFACE_VARIANTS):]
    assert [n for _, n in seqs] == sorted((n for _, n in seqs), reverse=True)


def split(spark, words, heads, **options):
    tokens = spark.createDataFrame([(w,) for w in words], "token string")
    known = spark.createDataFrame([(h,) for h in heads], "head string")
    out = C.split_compounds(tokens, known, D.SPLIT_RULES, D.rules(spark), D.manual_table(spark), **options).collect()
    return {(r.token, r["rank"]): (r.parts, round(r.score, 6)) for r in out}


def test_compound_splits(spark):
    heads = ["ब्रह्म", "विद्या", "योग", "तत्र", "इदम्", "देव"]
    got = split(spark, ["ब्रह्मविद्या", "ब्रह्मविद्यायोग", "क्षनदोह", "तत्रेदम्"], heads)
    assert got["ब्रह्मविद्या", 1] == (["ब्रह्म", "विद्या"], 1.0)
    assert got["ब्रह्मविद्यायोग", 1] == (["ब्रह्म", "विद्या", "योग"], 1.0)
    assert got["तत्रेदम्", 1] == (["तत्र", "इदम्"], 1.0)
    assert not [k for k in got if k[0] == "क्षनदोह"]


def test_boundary_reversals(spark):
    words = spark.createDataFrame([("नास्ति",), ("देवोस्ति",)], "token string")
    pairs = {(r.left, r.right) for r in C.boundary_candidates(words, D.SPLIT_RULES).collect()}
    assert ("न", "अस्ति") in pairs and ("देवः", "अस्ति") in pairs


def test_best_splits_equals_enumeration(spark):
    import itertools

    credit = {"ab": 10, "cd": 6, "abc": 6, "d": 10, "ef": 10, "def": 6, "cdef": 10, "bcd": 10}
    word = list("abcdef")
    want = []
    for k in (2, 3, 4):
        for cuts in itertools.combinations(range(1, 6), k - 1):
            edges = [0, *cuts, 6]
            parts = ["".join(word[a:b]) for a, b in zip(edges, edges[1:])]
            if all(len(p) >= 2 for p in parts[:-1]):
                want.append((-sum(credit.get(p, 0) for p in parts) / k, k, cuts, parts))
    want.sort()
    table = spark.createDataFrame([("abcdef", word, credit)], "token string, segments array<string>, credit map<string, int>")
    for keep in (1, 5, 40):
        got = table.select(C.best_splits([C.NO_CHANGE], 4, keep, F.length).alias("b")).first().b
        assert [(g.mean, g.names) for g in got] == [(w[0], w[3]) for w in want[:keep]]


def test_known_parts(spark):
    words = spark.createDataFrame([("abcdefgh",), ("xxab",)], "token string")
    heads = spark.createDataFrame([("ab",), ("cd",), ("efgh",)], "head string")
    got = {r.head for r in C.known_parts(words, heads, segment=C.characters).collect()}
    assert got == {"ab", "cd", "efgh"}


def dice(query, head):
    def grams(s):
        return [s] if len(s) < 3 else [s[i : i + 3] for i in range(len(s) - 2)]

    hg = set(grams(head))
    return 2 * sum(g in hg for g in grams(query)) / (len(grams(query)) + len(hg))


def test_nearest_heads_equals_all_pairs(spark, sf):
    from corpuskit.queries.tables import lexicon, vocabulary

    heads = [r.head for r in lexicon(spark, sf).select("head").distinct().orderBy("head").limit(700).collect()]
    tokens = [r.token for r in vocabulary(spark, sf).orderBy("token").limit(300).collect()] + ["aaaaaa", "ab"]
    got = {}
    for r in nearest_heads(
        spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame([(h,) for h in heads], "head string"), 3, 0.45
    ).collect():
        got.setdefault(r.token, []).append((r["rank"], r.head, round(r.score, 9)))
    for t in tokens:
        near = [(round(dice(t, h), 9), h) for h in heads if abs(len(h) - len(t)) <= max(3, 0.5 * len(t))]
        want = sorted([(-s, h) for s, h in near if s >= 0.45])[:3]
        assert sorted(got.get(t, [])) == [(i + 1, h, -s) for i, (s, h) in enumerate(want)]


def test_resolution_layers(spark):
    lex = spark.createDataFrame([("mw", 2, "राम"), ("apte", 3, "राम"), ("mw", 2, "ब्रह्म"), ("mw", 2, "विद्या"), ("mw", 2, "धर्मक्षेत्र")], "dict_id string, dict_order int, head string")
    tokens = spark.createDataFrame([("राम", 5), ("रामस्य", 3), ("ब्रह्मविद्या", 2), ("धर्मक्षेत्र्ये", 1), ("तेषाम्", 1), ("टठड", 1)], "token string, freq int")
    options = {"split_rules": D.SPLIT_RULES, "max_parts": 4}
    got = {r.token: (r.layer, r.via) for r in R.verdicts(tokens, lex, D.rules(spark), D.manual_table(spark), split_options=options).collect()}
    assert got["राम"] == ("direct", "mw")
    assert got["रामस्य"] == ("inflection", "mw")
    assert got["ब्रह्मविद्या"] == ("compound", "split")
    assert got["टठड"] == ("none", "")
    report = R.resolve_tokens(tokens.select("token"), lex, D.rules(spark), D.manual_table(spark), options).collect()
    assert {(r.token, r.dict_id) for r in report if r.layer == "direct"} >= {("राम", "mw"), ("राम", "apte")}
    assert ("तेषाम्", "manual-table") in {(r.token, r.dict_id) for r in report}


def test_coverage_gate(spark):
    schema = "basis string, layer string, pct double"
    cur = spark.createDataFrame([("distinct", "direct", 5.0), ("distinct", "none", 22.0), ("distinct", "fuzzy", 3.0)], schema)
    base = spark.createDataFrame([("distinct", "direct", 6.5), ("distinct", "none", 20.0), ("distinct", "fuzzy", 3.5)], schema)
    got = {r.layer: r.failed for r in R.coverage_gate(cur, base).collect()}
    assert got == {"direct": True, "none": True, "fuzzy": False}


def test_seed_lookup(spark):
    tokens = spark.createDataFrame([("ब्रह्म",), ("ब्रह्मणः",), ("रामस्य",), ("xyz",)], "token string")
    heads = spark.createDataFrame([("ब्रह्म",), ("राम",)], "head string")
    got = {r.token: (r.lemma, r.exact) for r in R.seed_lookup(tokens, heads, D.seed_rules(spark)).collect()}
    assert got == {"ब्रह्म": ("ब्रह्म", True), "ब्रह्मणः": ("ब्रह्म", False), "रामस्य": ("राम", False)}


def test_a_reversal_may_lengthen_the_left_part(spark):
    """Two surface syllables can hide a part of two: the restored part is what is measured."""
    tokens = spark.createDataFrame([("संग",), ("संगम",), ("गम",)], "token string")
    heads = spark.createDataFrame([("सम्",), ("ग",), ("गम",)], "head string")
    got = {r.token: r.parts for r in C.split_compounds(tokens, heads, D.SPLIT_RULES, keep=1).collect()}
    assert got == {"संग": ["सम्", "ग"], "संगम": ["सम्", "गम"]}


def test_an_own_segmenter_brings_its_counter(spark):
    tokens, heads = spark.createDataFrame([("ab-cd-e",)], "token string"), spark.createDataFrame([("ab-cd-",), ("e",)], "head string")
    pieces = lambda c: F.split(c, "(?<=-)")
    with pytest.raises(ValueError):
        C.split_compounds(tokens, heads, segment=pieces)
    got = C.split_compounds(tokens, heads, segment=pieces, count=lambda p: F.size(F.split(F.regexp_replace(p, "-$", ""), "-")), keep=1).collect()
    assert [r.parts for r in got] == [["ab-cd-", "e"]]


def test_gloss_layer_and_resolved(spark):
    """A word is resolved by any layer; definitions count inside their own text only."""
    tokens = spark.createDataFrame([("a", "x"), ("b", "x"), (None, "x"), ("a", "y"), (None, "y"), ("a", "z"), ("a", "z")], "text_slug string, token string")
    report = spark.createDataFrame([("y", "direct"), ("y", "inflection"), ("y", "inflection")], "token string, layer string")
    found = spark.createDataFrame(
        [("a", "x", "u1", "of x", "iti", 0.7, 1), ("a", "x", "u2", "x is", "iti", 0.7, 2)],
        "text_slug string, token string, unit_id string, snippet string, rule string, score double, rank int",
    )
    got = {(r.text_slug, r.token): (r.direct, r.inflection, r.compound, r.fuzzy, r.gloss, r.resolved) for r in R.resolve_in_texts(tokens, report, found).collect()}
    assert got == {
        ("a", "x"): (0, 0, 0, 0, 2, True),
        ("b", "x"): (0, 0, 0, 0, 0, False),
        (None, "x"): (0, 0, 0, 0, 0, False),
        ("a", "y"): (1, 2, 0, 0, 0, True),
        (None, "y"): (1, 2, 0, 0, 0, True),
        ("a", "z"): (0, 0, 0, 0, 0, False),
    }
    rows = R.gloss_rows(found).collect()
    assert {(r.text_slug, r.token, r.layer, r.seq, r.method, r.unit_id) for r in rows} == {("a", "x", "gloss", 1, "iti", "u1"), ("a", "x", "gloss", 2, "iti", "u2")}


def test_plain_cuts_give_the_general_results(spark, monkeypatch):
    import random

    draw = random.Random(5)
    word = lambda low, high: "".join(draw.choice("abé") for _ in range(draw.randint(low, high)))
    words = spark.createDataFrame([(w,) for w in {word(1, 13) for _ in range(300)} | {"a", "ab", "abé", "zz" * 9}], "token string")
    heads = spark.createDataFrame([(w,) for w in {word(1, 4) for _ in range(25)}], "head string")
    own = lambda c: C.characters(c)  # noqa: E731  the same segments, not known to be plain
    manual = spark.createDataFrame([("abab", "a", "x", None)], "form string, lemma string, label string, gloss string")
    options = dict(lemma_rules=R.rule_table(spark, [("b", "", "x"), ("éa", "a", "y")]), manual=manual, keep=1, min_score=0.3, strict=False)
    for most in (2, 5):
        plain, general = (sorted(C.split_compounds(words, heads, segment=s, count=F.length, max_parts=most, **options).collect()) for s in (C.characters, own))
        assert plain == general and len(plain) > 100
    monkeypatch.setattr(C, "_plain_longest", lambda most: 6)
    assert sorted(C.split_compounds(words, heads, segment=C.characters, max_parts=5, **options).collect()) == general
    assert sorted(C.known_parts(words, heads, segment=C.characters).collect()) == sorted(C.known_parts(words, heads, segment=own).collect())
    cuts = {(r.token, r.cut, r.left, r.right) for r in C.boundary_candidates(words, segment=C.characters).collect()}
    assert cuts == {(w.token, i, w.token[:i], w.token[i:]) for w in words.collect() for i in range(1, len(w.token))}
    none = heads.limit(0)
    assert C.split_compounds(words, none, segment=C.characters, keep=1).count() == 0 == C.known_parts(words, none, segment=C.characters).count()


def test_plain_cuts_are_numbers(spark):
    words = spark.createDataFrame([("abcd",)], "token string")
    text = C.boundary_candidates(words, segment=C.characters)._jdf.queryExecution().toString()
    assert "array_join" not in text and "lambda" not in text


def parts_by_cuts(words, heads, depth=3):
    found, frontier = set(), set(words)
    for _ in range(depth):
        cuts = {(t[:i], t[i:]) for t in frontier if len(t) >= 4 for i in range(1, len(t) - 1)}
        found |= {side for cut in cuts for side in cut if side in heads}
        frontier = {r for l, r in cuts if l in heads and r not in heads} | {l for l, r in cuts if r in heads and l not in heads}
    return found


@pytest.mark.parametrize("letters", ["abé", "abcdé𝒳ß"])
def test_known_parts_list_no_cuts(spark, monkeypatch, letters):
    """Plain cuts are read off one row per string, whatever lies around its known parts."""
    import random

    draw = random.Random(len(letters))
    word = lambda low, high: "".join(draw.choice(letters) for _ in range(draw.randint(low, high)))
    words = sorted({word(1, 16) for _ in range(400)} | {"a", "ab", "zz" * 9})
    heads = {word(1, 9) for _ in range(150)} | {"", "ab" * 5} | set(words[:20])
    monkeypatch.setattr(C, "boundary_candidates", None)
    table = lambda rows, name: spark.createDataFrame([(r,) for r in rows], f"{name} string")
    for depth in (1, 3):
        got = [r.head for r in C.known_parts(table(words, "token"), table([*heads, None], "head"), segment=C.characters, depth=depth).collect()]
        assert sorted(got) == sorted(parts_by_cuts(words, heads, depth))


def test_known_beginnings(spark):
    heads = ["a", "ab", "abcdefg", "abcdefgh", "abcdeg", "b", "é", "éa"]
    texts = ["a", "ab", "abc", "abcdefgz", "abcdefh", "abcdegx", "abcdez", "é", "éab", "ea", "c", "abcdefgh", "abcdefgh"]
    known = spark.createDataFrame([(h,) for h in heads], "head string")
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    marks = C._own_beginnings(known.select(F.col("head").alias("text")), known)
    got = {r.id: sorted(r.sizes) for r in C.known_beginnings(rows, F.col("t"), known, marks, "sizes").collect()}
    assert got == {i: sorted(len(h) for h in heads if t.startswith(h)) for i, t in enumerate(texts)}


def test_pairs_and_credits_equal_the_splits(spark):
    """Credits made from the heads are those of the parts, and tokens found in two parts are those whose best split of two parts reaches the score."""
    heads = ["an", "ber", "cat", "g", "make", "mente", "b", "ing", "catter"]
    rules = R.rule_table(spark, [("ing", "", "a"), ("ing", "e", "b"), ("s", "", "c"), ("er", "", "d")], [("e", "a", "v", 3)])
    manual = spark.createDataFrame([("was", "make", "x", None), ("zz", "none", "x", None)], "form string, lemma string, label string, gloss string")
    known = spark.createDataFrame([(h,) for h in heads], "head string")
    tokens = ["making", "catmaking", "catwas", "anber", "anbers", "bing", "catg", "catcatmaking", "xxcat", "zzcat", "ananan", "bertering", "a", "wasb", "catb", "catx"]
    words = spark.createDataFrame([(t,) for t in tokens], "token string")
    credits = C.part_credits(known, rules, manual)
    made = {r.part: r.credit for r in credits.collect()}
    parts = spark.createDataFrame([(t[i:j],) for t in tokens for i in range(len(t)) for j in range(i + 1, len(t) + 1)], "token string").distinct()
    through = {r.token for r in R.lemma_candidates(parts, manual, rules, dedupe=False).join(known, F.col("lemma") == F.col("head")).collect()}
    for part in (r.token for r in parts.collect()):
        assert made.get(part, 0) == (10 if part in heads else 6 if part in through else 0), part
    for score in (0.5, 0.6, 0.8, 1.0):
        for strict in (True, False):
            options = {"min_score": score, "strict": strict, "segment": C.characters}
            paired = {r.token for r in C.in_two_parts(words, credits, **options).collect()}
            given = {r.token for r in C.split_compounds(words, known, lemma_rules=rules, manual=manual, keep=4, max_parts=2, **options).collect()}
            both = {r.token: r.parts for r in C.split_compounds(words, known, credits=credits, keep=4, max_parts=2, **options).collect()}
            assert set(both) == given and paired == {t for t in given if any(made.get(t[:i], 0) and made.get(t[i:], 0) and (10 * score < (made[t[:i]] + made[t[i:]]) / 2 or not strict and 10 * score <= (made[t[:i]] + made[t[i:]]) / 2) for i in range(2, len(t)))}
    assert C.in_two_parts(words, credits).count() == 0  # other segments are left to the splits


def test_no_split_row_for_words_of_two_parts(spark, monkeypatch):
    """The verdicts leave to the splits only what two parts don't settle."""
    seen = []
    splits = C.split_compounds
    monkeypatch.setattr(C, "split_compounds", lambda tokens, *a, **o: seen.append({r.token for r in tokens.collect()}) or splits(tokens, *a, **o))
    lex = spark.createDataFrame([("d", 1, h) for h in ("cat", "dog", "cow")], "dict_id string, dict_order int, head string")
    freq = spark.createDataFrame([("cat", 1), ("catdog", 2), ("catdogcow", 3), ("zebra", 4)], "token string, freq long")
    rules = R.rule_table(spark, [("s", "", "plural")])
    got = {r.token: r.layer for r in R.verdicts(freq, lex, rules, split_options={"segment": C.characters}).collect()}
    assert got == {"cat": "direct", "catdog": "compound", "catdogcow": "compound", "zebra": "none"}
    assert seen == [{"catdogcow", "zebra"}]
