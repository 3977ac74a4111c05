from pyspark.sql import functions as F

from corpuskit.functions.scripts import native_forms
from corpuskit.operators import search as S


UNITS = [
    ("gita", "c1", "u1", "धर्मक्षेत्रे कुरुक्षेत्रे", ["आत्मा ब्रह्म।परमात्मन्"]),
    ("gita", "c1", "u2", "आत्मा", ["किञ्चित्"]),
    ("isha", "c1", "u3", "ईशावास्यम्", ["परमात्मा, सर्वं ब्रह्म"]),
]


def setup(spark):
    units = spark.createDataFrame(
        [(a, b, c, r, [("bhashya", t) for t in bl]) for a, b, c, r, bl in UNITS],
        "text_slug string, chapter_id string, unit_id string, root string, blocks array<struct<kind:string,text:string>>",
    )
    docs = S.build_search(units)
    return docs, *S.build_postings(docs, native_forms)


def run(spark, queries, scope=None):
    docs, vocab, postings = setup(spark)
    q = spark.createDataFrame([(i, x, scope) for i, x in enumerate(queries)], "query_id int, query string, scope array<string>")
    hits = S.search(q, docs, vocab, postings, forms=native_forms).collect()
    return {i: [(r.unit_id, r.tier) for r in sorted(hits, key=lambda r: r["rank"]) if r.query_id == i] for i in range(len(queries))}


def test_cross_script_and_tiers(spark):
    got = run(spark, ["आत्मा", "atma", "tma", "ātmā ब्रह्म", "നാസ്തി", " ", "ब्रह्म परमात्मा"])
    # The folded form of a native query also finds it inside longer words.
    assert got[0] == [("u2", S.TIER_EXACT), ("u1", S.TIER_SUBSTRING), ("u3", S.TIER_SUBSTRING)]
    assert {u for u, _ in got[1]} == {u for u, _ in got[2]} == {"u1", "u2", "u3"}
    assert {u for u, _ in got[3]} == {"u1", "u3"}
    assert got[4] == [] and got[5] == []
    assert {u for u, _ in got[6]} == {"u1", "u3"}


def test_scope(spark):
    got = run(spark, ["atma"], ["isha"])
    assert [u for u, _ in got[0]] == ["u3"]


def test_matching_equals_brute_force(spark, sf):
    from corpuskit.queries import search as Q

    docs, vocab, postings = Q.indexed(spark, sf)
    words = [r.w for r in docs.select(F.explode(F.split("body", " ")).alias("w")).limit(3000).collect()]
    needles = sorted({w[i : i + n] for w in words[::97] for i, n in ((0, 2), (1, 4), (2, 6), (0, 1)) if len(w) > i + n})[:40]
    q = spark.createDataFrame(list(enumerate(needles)), "query_id int, query string")
    got = {(r.query_id, r.unit_id) for r in S.matching_units(S.query_tokens(q), vocab, postings, q).collect()}
    bodies = docs.select("unit_id", "body", S.T.ascii_fold(F.col("body")).alias("folded")).collect()
    folded = {i: r.f for i, r in enumerate(spark.createDataFrame([(n,) for n in needles], "n string").select(S.T.ascii_fold(F.col("n")).alias("f")).collect())}
    want = {(i, b.unit_id) for i, n in enumerate(needles) for b in bodies if n in b.body or folded[i] in b.folded}
    assert got == want


FREQ = [("brahma", "brahma", 50), ("brahman", "brahman", 5), ("brahmin", "brahmin", 20), ("abrahma", "abrahma", 10), ("xbrahmax", "xbrahmax", 15)]


def test_suggest_buckets(spark):
    freq = spark.createDataFrame(FREQ, "token string, ascii string, freq bigint")
    q = spark.createDataFrame([(1, "brahm"), (2, "zzz"), (3, "brahma")], "query_id int, query string")
    got = S.suggest(q, freq, 4).orderBy("query_id", "rank").collect()
    assert [r.token for r in got if r.query_id == 1] == ["brahma", "brahmin", "brahman", "xbrahmax"]
    assert [r.token for r in got if r.query_id == 2] == []
    assert [r.token for r in got if r.query_id == 3] == ["brahma", "brahman", "xbrahmax", "abrahma"]


def test_suggest_last_token(spark):
    freq = spark.createDataFrame(FREQ, "token string, ascii string, freq bigint")
    q = spark.createDataFrame([(1, "om brahmi"), (2, "om "), (3, "brahmi")], "query_id int, query string")
    got = {(r.query_id, r.full) for r in S.suggest_last_token(q, freq).collect()}
    assert got == {(1, "om brahmin"), (3, "brahmin")}


def test_find_in_text_and_linear(spark):
    docs, vocab, postings = setup(spark)
    q = spark.createDataFrame([(1, "सर्वं, ब्रह्म"), (2, "atma brah")], "query_id int, query string")
    found = S.find_in_text(q, docs, vocab, postings, forms=native_forms).collect()
    assert {(r.query_id, r.unit_id) for r in found if r.query_id == 1} == {(1, "u3")}
    lin = S.linear_search(q.filter("query_id = 1"), docs, vocab, postings, forms=native_forms).collect()
    assert lin == []


def test_stored_index_gives_the_same_hits(spark, tmp_path):
    """Searches over the stored index, with and without scopes, equal those over tables made for one call."""
    docs, vocab, postings = setup(spark)
    S.write_index(docs, str(tmp_path / "index"), native_forms)
    index = S.read_index(spark, str(tmp_path / "index"))
    asked = [(1, "atma", None), (2, "brahma", ["isha"]), (3, "ātmā ब्रह्म", []), (4, "brahma", ["none"]), (5, "brahma parama", ["gita", "isha"]), (6, "kurukṣetre", None)]
    q = spark.createDataFrame(asked, "query_id int, query string, scope array<string>")
    plain = S.search(q, docs, vocab, postings, forms=native_forms).drop("snippet")
    stored = S.search(q, *index.tables, forms=native_forms, grams=index.grams, units=index.units).drop("snippet")
    want = sorted(map(tuple, plain.collect()))
    assert want and sorted(map(tuple, stored.collect())) == want
    assert {r[2] for r in want if r[0] == 2} == {"u3"} and not [r for r in want if r[0] == 4]
    assert "text_slug=gita" in {p.name for p in (tmp_path / "index/postings").iterdir()}


def test_suggestions_by_brute_force(spark):
    """Prefix-first lookup gives the rows that looking inside every token gives."""
    words = [("ātman", "atman", 9), ("ātar", "atar", 2), ("matar", "matar", 8), ("at", "at", 5), ("xat", "xat", 4), ("Bā", "ba", 7), ("bā", "ba", 6)]
    words += [(f"at{i}", f"at{i}", i) for i in range(9)] + [(f"z{i}atā", f"z{i}ata", i) for i in range(5)]
    freq = spark.createDataFrame(words, "token string, ascii string, freq long")
    asked = ["at", "ā", "tar", "atm", "a", "", "ba", "ata", "zz"]
    fold = lambda x: x.replace("ā", "a").lower()
    place = lambda form, n: None if not n else 1 if form.startswith(n) else 3 if form.endswith(n) else 2 if n in form else None
    want = []
    for i, q in enumerate(asked):
        hits = [(place(t, q) or place(a, fold(q)), -f, t) for t, a, f in words if place(t, q) or place(a, fold(q))]
        want += [(i, t, -f, b, r) for r, (b, f, t) in enumerate(sorted(hits)[:4], 1)]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    got = [(r.query_id, r.token, r.freq, r.bucket, r["rank"]) for r in S.suggest(q, freq, 4).collect()]
    assert sorted(got) == sorted(want)


def test_few_queries_read_units_alone(spark, tmp_path, monkeypatch):
    """One pass over the stored units, without vocabulary and postings, gives the rows of the postings; repeated rows are one unit."""
    rows = [("en", "c", 1, "The cat sat", []), ("en", "c", 2, "École the", ["a cat"]), ("fr", "c", 3, "Le chat", ["ecole, cat"]), ("fr", "c", 4, "dog", []), ("fr", "c", 4, "catnip", [])]
    units = spark.createDataFrame([(*r[:4], [("b", t) for t in r[4]]) for r in rows], "text_slug string, chapter_id string, unit_id long, root string, blocks array<struct<kind:string,text:string>>")
    docs = S.build_search(units)
    index = S.write_folded(docs, str(tmp_path / "index"))
    asked = [(1, "cat", None), (2, "école cat", None), (3, "CAT", ["fr"]), (4, "dog catnip", None), (5, " ", None), (6, "none", None), (7, "cat", [])]
    q = spark.createDataFrame(asked, "query_id int, query string, scope array<string>")
    tokens = S.query_tokens(q)
    scanned = S.matching_units(tokens, None, None, q, units=index.units)
    got = sorted(map(tuple, scanned.select("query_id", "text_slug", "unit_id", "tokens_hit").collect()))
    assert got == [(1, "en", 1, 1), (1, "en", 2, 1), (1, "fr", 3, 1), (1, "fr", 4, 1), (2, "en", 2, 2), (2, "fr", 3, 2), (3, "fr", 3, 1), (3, "fr", 4, 1), (4, "fr", 4, 2), (7, "en", 1, 1), (7, "en", 2, 1), (7, "fr", 3, 1), (7, "fr", 4, 1)]
    monkeypatch.setattr(S, "FEW_WORDS", 1)
    many = S.matching_units(tokens, index.vocab, index.postings, q, index.grams, index.units)
    assert sorted(map(tuple, many.select("query_id", "text_slug", "unit_id", "tokens_hit").collect())) == got


def test_linear_search_cuts_snippets_of_its_rows(spark, tmp_path):
    units = spark.createDataFrame([("en", "c", i, f"{'x' * i} One two", []) for i in range(5)], "text_slug string, chapter_id string, unit_id long, root string, blocks array<struct<kind:string,text:string>>")
    index = S.write_folded(S.build_search(units), str(tmp_path / "index"))
    q = spark.createDataFrame([(1, "one two"), (2, "two one")], "query_id int, query string")
    found = S.linear_search(q, *index.tables, limit=2, grams=index.grams, units=index.units).orderBy("hit_no")
    assert [(r.query_id, r.unit_id, r.hit_no, r.snippet) for r in found.collect()] == [(1, 0, 1, " One two "), (1, 1, 2, "x One two ")]
