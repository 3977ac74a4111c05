import json
import re

import pytest
from pyspark.sql import functions as F

from corpuskit.functions import scripts as S
from corpuskit.operators import glosses as G
from corpuskit.operators import history as H
from corpuskit.operators import integrity as I
from corpuskit.operators import lexicon as L
from corpuskit.operators import meanings as M
from corpuskit.operators import refs as R


def test_glosses_of_published_sample(spark):
    bodies = [
        ("a", "u1", "स इमाँल्लोकान् ईक्षत लोकान्नु सृजा इति ॥ १ ॥"),
        ("a", "u2", "कर्मणा न लिप्यस इत्यर्थः ।"),
        ("a", "u3", "कर्म अर्थात् अग्निहोत्रम् ।"),
        ("a", "u4", "तत् ब्रह्म इत्युच्यते"),
    ]
    df = spark.createDataFrame(bodies, "text_slug string, unit_id string, body string")
    got = {(r.term, r.unit_id): (r.snippet, r.rule, r.score) for r in G.extract_glosses(df).collect()}
    assert got["सृजा", "u1"] == ("सृजा इति ॥ १", "iti", 0.7)
    assert got["लिप्यस", "u2"] == ("कर्मणा न लिप्यस इत्यर्थः", "ity-arthah", 1.0)
    assert got["कर्म", "u3"][1:] == ("arthat", 0.95)


def test_clauses_and_signs_change_no_gloss(spark, sf):
    from corpuskit.queries import texts as Q

    odd = ["", "the", " the cat. the dog;", "a" * 60 + " is " + "b" * 50 + ".", "lion is big, is is is is. King of all the beasts; x of y z",
           "one two the der los end. no mark is here", "is of the of is the.", "é est île, été de la mer." * 3, "tab\tis here. 3 cats is four. cat is 4. ab of cd, abc of d."]
    df = spark.createDataFrame([("t", i, b) for i, b in enumerate(odd)], "text_slug string, unit_id bigint, body string").unionByName(Q.bodies(spark, sf))
    plain = G.extract_glosses(df, Q.LATIN_PATTERNS).collect()
    assert sorted(G.extract_glosses(df, Q.LATIN_PATTERNS, clause=Q.LATIN_CLAUSE, signs=Q.LATIN_SIGNS).collect()) == sorted(plain) and len(plain) > 100
    with pytest.raises(ValueError):
        G.extract_glosses(df, Q.LATIN_PATTERNS, signs=Q.LATIN_SIGNS)


def test_gloss_lookup_stem(spark):
    table = spark.createDataFrame([("t", "लोक", "u1", "s", "iti", 0.7, 1), ("t", "कर्म", "u2", "s", "iti", 0.7, 1)], "text_slug string, term string, unit_id string, snippet string, rule string, score double, rank int")
    terms = spark.createDataFrame([("t", "लोकान्"), ("t", "लोके"), ("t", "कर्म"), ("x", "कर्म"), ("t", "गज")], "text_slug string, term string")
    got = {(r.text_slug, r.term): r.unit_id for r in G.lookup_glosses(terms, table).collect()}
    assert got == {("t", "लोके"): "u1", ("t", "कर्म"): "u2"}


def test_rerank(spark):
    senses = spark.createDataFrame(
        [("आत्मन्", 0, "breath"), ("आत्मन्", 1, "the SELF, soul"), ("गज", 0, "elephant"), ("गज", 1, "self"), ("एक", 0, "self")], "head string, idx bigint, sense string"
    )
    priors = spark.createDataFrame([("आत्मन्", ["self", "soul"]), ("एक", ["self"])], "head string, preferred array<string>")
    got = {(r.head, r["rank"]): (r.idx, r.score, r.matched) for r in G.rerank_senses(senses, priors).collect()}
    assert got["आत्मन्", 1] == (1, (1 + 0.75) / 2, "self")
    assert got["गज", 1] == (0, 0.0, None) and got["एक", 1][1] == 0.0


DUMP = "<L>1<pc>1<k1>deva<k2>deva\n<s>deva</s>¦ a god <ls>RV</ls>\n<LEND>\n<L>2<pc>1<k1>Darma\n<s>Darma</s> law\n<LEND>\n<L>3<k1>deva\nheavenly\n<LEND>\n<L>4<pc>9\nno head\n<LEND>\n<L>5<k1>loka\n" + "w" * 50 + "\n<LEND>\n"


def test_lexicon_dump(spark, tmp_path):
    from corpuskit.sources.files import read_lexicon_dump

    (tmp_path / "d.txt").write_text(DUMP, encoding="utf8")
    raw = read_lexicon_dump(spark, str(tmp_path / "d.txt"))
    to_native, to_roman = (lambda c: S.from_roman(c, "slp1")), (lambda c: S.to_roman(S.from_roman(c, "slp1")))
    out = {r.head: r for r in L.build_lexicon(raw, "mw", False, 40, to_native, to_roman).collect()}
    assert set(out) == {"देव", "धर्म", "लोक"}
    assert out["देव"].en == "a god RV · heavenly…" and out["देव"].iast == "deva"
    assert out["धर्म"].en == "law" and out["धर्म"].iast == "dharma"
    assert out["लोक"].en == "w" * 40 + "…"


def fold(bodies, limit):
    acc = bodies[0]
    for b in bodies[1:]:
        if len(acc) < limit - 30:
            acc = (acc + " · " + b)[: int(limit * 1.5)] + "…"
    return acc


def test_fold_drops_nothing_that_counts(spark):
    rows = [("h", i, "x") for i in range(500)] + [("g", i, "word" * (i % 7 + 1)) for i in range(60)]
    df = spark.createDataFrame(rows, "head string, rec int, body string")
    got = {r.head: r.body for r in L.fold_senses(df, 120).collect()}
    for head in "hg":
        assert got[head] == fold([b for h, _, b in rows if h == head], 120)


def test_meanings(spark):
    blocks = "array<struct<kind:string,text:string>>"
    units = spark.createDataFrame([("t", "U", [("b", " "), ("b", "x" * 601)]), ("t", "V", [("b", "body")]), ("t", "W", [])], f"text_slug string, unit_id string, blocks {blocks}")
    entries = spark.createDataFrame(
        [("t", "V", "ml", "ml text", "main", 1), ("t", "V", "en", "draft", "ai", 2), ("t", "V", "en", "other", "rev", 3), ("t", "V", "en", "main", "main", 4), ("t", "U::block-1", "en", "b", "rev", 5)],
        "text_slug string, key string, language string, text string, source_id string, input_seq bigint",
    )
    sources = spark.createDataFrame([("main", True, "pd"), ("rev", False, "pd"), ("ai", False, "ai-draft")], "source_id string, is_primary boolean, license string")
    out = M.build_meanings(units, entries, sources)
    got = {(r.key, r.seq): (r.language, r.text, r.source_id) for r in out.collect()}
    assert [got["V", i][1] for i in range(4)] == ["main", "ml text", "other", "draft"]
    assert got["U", 0] == ("en", "x" * 600 + "…", M.FALLBACK_SOURCE) and ("W", 0) not in got
    assert {r.source_id for r in M.used_sources(sources, out).collect()} == {"main", "rev", "ai", M.FALLBACK_SOURCE}
    slots = M.meanings_for_units(units, out).collect()
    assert {(r.unit_id, r.block_idx, r.text) for r in slots if r.text and r.unit_id == "U"} == {("U", -1, "x" * 600 + "…"), ("U", 1, "b")}
    assert len([r for r in slots if r.unit_id == "W"]) == 1


def test_translation_files(spark, tmp_path):
    from corpuskit.sources.files import read_sources, read_translations

    (tmp_path / "gita").mkdir()
    (tmp_path / "gita" / "a.en.tsv").write_text("# note\n\nU1\tone\ttab\nU1\ttwo\nbad line\nU2\t \n", encoding="utf8")
    (tmp_path / "gita" / "b.en.tsv").write_text("U3\tfrom tsv\n", encoding="utf8")
    (tmp_path / "gita" / "b.en.json").write_text('{"U3": "from json"}', encoding="utf8")
    (tmp_path / "gita" / "sources.json").write_text('{"sources": [{"id": "a", "license": "pd", "isPrimary": true}]}', encoding="utf8")
    got = {(r.text_slug, r.source_id, r.key): r.text for r in read_translations(spark, str(tmp_path)).collect()}
    assert got == {("gita", "a", "U1"): "two", ("gita", "b", "U3"): "from json"}
    assert [(r.text_slug, r.source_id, r.is_primary) for r in read_sources(spark, str(tmp_path)).collect()] == [("gita", "a", True)]


def test_ingest(spark, tmp_path):
    import json

    from corpuskit.plans.jobs import ingest
    from corpuskit.sources.files import read_results

    def put(name, slug, units):
        (tmp_path / "gita").mkdir(exist_ok=True)
        (tmp_path / "gita" / name).write_text(json.dumps({"slug": slug, "units": units}), encoding="utf8")

    put("result-000.json", "gita", [{"id": "U1", "rootEn": " first ", "blocksEn": ["plain", {"kind": "b", "text": "object"}, 7]}, {"rootEn": "no id"}])
    put("result-001.json", "gita", [{"id": "U1", "rootEn": "second", "rootMl": "x"}])
    put("result-002.json", "other", [{"id": "U1", "rootEn": "wrong"}])
    accepted, rejected = ingest(read_results(spark, str(tmp_path)))
    got = {(r.language, r.key): r.text for r in accepted.collect()}
    assert got["en", "U1"] == "second" and got["en", "U1::block-0"] == "plain" and got["en", "U1::block-1"] == "object"
    assert ("ml", "U1") not in got
    assert {r.reason for r in rejected.collect()} >= {"slug mismatch", "missing id", "no text"}


def test_batches(spark):
    rows = [("t", i, "" if i == 3 else "r", [("b", " "), ("b", "y" * 2500)] if i == 0 else []) for i in range(20)]
    df = spark.createDataFrame(rows, "text_slug string, unit_id bigint, root string, blocks array<struct<kind:string,text:string>>")
    out = {r.unit_id: r for r in M.prepare_batches(df, "unit_id").collect()}
    assert 3 not in out and len(out) == 19
    assert out[0].blocks[0].truncated and len(out[0].blocks[0].text) == 2400 and len(out[0].blocks) == 1
    assert out[8].batch_index == 0 and out[9].batch_index == 1 and out[19].total_batches == 3


def test_references(spark):
    chapters = [("bg", f"BG_C{c:02d}", c, c, None) for c in (1, 2, 3)] + [
        ("bs", f"BS_C{p:02d}_S{c:02d}", p * 10 + c, c, p) for p in (1, 2) for c in (1, 2, 3)
    ] + [("is", "IS_C01", 1, 1, None), ("br", "BR_C04_S05", 1, 5, 4), ("kv", "KV_C02", 2, 2, 9)]
    units = [("bg", f"BG_C{c:02d}", f"BG_C{c:02d}_V{v:02d}", v, v, "mantra") for c in (1, 2, 3) for v in (1, 13, 42)]
    units += [("bs", f"BS_C{p:02d}_S{c:02d}", f"BS_C{p:02d}_S{c:02d}_V{v:02d}", v, v, "sutra") for p in (1, 2) for c in (1, 2, 3) for v in (1, 12)]
    units += [("is", "IS_C01", f"IS_C01_V{v:02d}", v, v, "mantra") for v in (7, 18)]
    units += [("br", "BR_C04_S05", "BR_C04_S05_INTRO1", 0, 1, "intro"), ("br", "BR_C04_S05", "BR_C04_S05_V01", 1, 1, "mantra"), ("kv", "KV_C02", "KV_C02_V3", 1, 3, "mantra")]
    asks = {
        ("bg", "3.42"): "BG_C03_V42", ("bg", " 2.13. "): "BG_C02_V13", ("bs", "1.1.12"): "BS_C01_S01_V12", ("bs", "2.3.1"): "BS_C02_S03_V01",
        ("br", "4.5.1"): "BR_C04_S05_V01", ("is", "7"): "IS_C01_V07", ("is", "18"): "IS_C01_V18", ("kv", "2.3"): "KV_C02_V3",
        ("bg", "9.9"): "no-match", ("bg", ""): "parse", ("bg", "x"): "parse", ("bg", "1.2.3.4"): "parse", ("bg", "0"): "parse",
        ("bg", "99999999999999999999"): "parse",
    }
    refs = spark.createDataFrame([(i, t, r) for i, (t, r) in enumerate(asks)], "ref_id int, text_slug string, ref string")
    ch = spark.createDataFrame(chapters, "text_slug string, chapter_id string, chapter_pos int, chapter_ord int, parent_ord int")
    un = spark.createDataFrame(units, "text_slug string, chapter_id string, unit_id string, unit_pos int, ordinal int, kind string")
    got = {r.ref_id: r.unit_id or r.status for r in R.resolve_refs(refs, ch, un).collect()}
    assert [got[i] for i in range(len(asks))] == list(asks.values())
    pre = spark.createDataFrame([("bs", "BS_C01_S02_V05"), ("bs", "ZZ")], "text_slug string, unit_id string")
    assert [r.chapter_id for r in R.chapter_by_prefix(pre, ch).collect()] == ["BS_C01_S02"]


def test_integrity_and_history(spark):
    docs = spark.createDataFrame([("t", "a"), ("t", "b")], "text_slug string, unit_id string")
    units = docs.filter("unit_id = 'a'")
    assert [r.unit_id for r in I.dangling(docs, units, ["text_slug", "unit_id"]).collect()] == ["b"]
    assert tuple(I.link_report(docs, units, ["text_slug", "unit_id"]).first()) == (2, 1)
    forms = spark.createDataFrame(
        [("1", "f", "a", "l", "r-1", False), ("2", "", "a", "l", None, True), ("3", "f", "zz", "l", "nobody", False)],
        "form_id string, form string, source string, lemma string, reviewer string, unverified boolean",
    )
    people = spark.createDataFrame([("r-1", "vyakarana"), ("R1", "vyakarana"), ("d-d", "x"), ("d-d", "vyakarana")], "id string, specialisation string")
    got = {(r.rule, r.subject) for r in I.verify_gold(forms, people, units).collect()}
    assert got == {("required field", "2"), ("unknown reviewer", "3"), ("unknown unit", "3"), ("duplicate reviewer", "d-d"), ("reviewer id", "R1"), ("specialisation", "d-d")}
    events = spark.createDataFrame([(1, " a ", 1), (1, "b", 2), (1, "a", 3), (1, " ", 4)] + [(2, str(i), i) for i in range(20)], "user_id int, query string, ts int")
    hist = H.recent_history(events).collect()
    assert [r.query for r in sorted(hist, key=lambda r: r["rank"]) if r.user_id == 1] == ["a", "b"]
    assert len([r for r in hist if r.user_id == 2]) == 12


def test_catalog_upsert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "slug string, v int")
    new = spark.createDataFrame([("b", 2), ("d", 2)], "slug string, v int")
    order = spark.createDataFrame([("d", 0), ("c", 1), ("b", 2), ("a", 3)], "slug string, place int")
    assert [(r.slug, r.v) for r in H.upsert_catalog(old, new, "slug", order).collect()] == [("d", 2), ("c", 1), ("b", 2), ("a", 1)]
    assert sorted((r.slug, r.v) for r in H.merge_new_only(old, new, "slug").collect()) == [("a", 1), ("b", 1), ("c", 1), ("d", 2)]


def test_corpus_round_trip(spark, tmp_path):
    import json

    from corpuskit.sources.files import read_chunks, read_corpus

    chapter = {"id": "C1", "ordinal": 1, "titleSa": "t", "kind": "adhyaya", "units": [{"id": "u0", "kind": "intro", "ordinal": 1, "root": "", "blocks": []}, {"id": "u1", "kind": "mantra", "ordinal": 1, "root": "root", "blocks": []}]}
    (tmp_path / "gita").mkdir()
    (tmp_path / "gita" / "C1.json").write_text(json.dumps({"textSlug": "gita", "chapter": chapter}), encoding="utf8")
    (tmp_path / "gita" / "C2.json").write_text("{broken", encoding="utf8")
    texts, ch, un = read_corpus(spark, str(tmp_path))
    assert [(r.unit_pos, r.unit_id, r.kind) for r in un.orderBy("unit_pos").collect()] == [(0, "u0", "intro"), (1, "u1", "mantra")]
    assert [re.sub(".*/", "", r.file) for r in read_chunks(spark, str(tmp_path))[1].collect()] == ["C2.json"]
    assert texts.first().chapters == 1 and ch.first().title == "t"


@pytest.mark.parametrize("step", [1, 10_000_000])
def test_published_chapters_have_one_shape(spark, tmp_path, step):
    """Positions may be anything: the head once, one line per unit, in order, and the same path."""
    from corpuskit.sources import sinks
    from corpuskit.sources.files import read_published

    rows = [("gita", c, i * step, f"{c}u{i}", "mantra", i, f"root {i}", [("bhashya", "é", None)]) for c in ("C1", "C2") for i in range(30)]
    units = spark.createDataFrame(
        rows + [("gita", "C9", 1, "stray", "mantra", 1, "", [])],
        "text_slug string, chapter_id string, unit_pos bigint, unit_id string, kind string, ordinal bigint, root string, blocks array<struct<kind:string,text:string,id:string>>",
    )
    chapters = spark.createDataFrame([("gita", c, o, c, None, None, "adhyaya") for o, c in enumerate(("C1", "C2", "C3"), 1)], "text_slug string, chapter_id string, chapter_ord bigint, title string, parent_title string, parent_ord bigint, chapter_kind string")
    manifests, stubs, chunks = sinks.split_manifest(units, chapters, min_bytes=1)
    m = manifests.first()
    assert (m.chapters, m.units, m.chunked) == (3, 60, True)
    sizes = {r.chapter_id: 0 for r in stubs.collect()}
    for r in chunks.collect():
        sizes[r.chapter_id] += len(r.json.encode())
    assert {r.chapter_id: (r.chunk_size, r.units, r.chunk_path) for r in stubs.collect()} == {c: (n, 0 if c == "C3" else 30, f"text_slug=gita/chapter_id={c}") for c, n in sizes.items()}
    sinks.write_chunks(chunks, str(tmp_path / "out"))
    lines = [json.loads(x) for f in sorted((tmp_path / "out/text_slug=gita/chapter_id=C1").glob("part-*")) for x in f.read_text(encoding="utf8").splitlines()]
    assert lines[0]["chapter"]["id"] == "C1" and [x["unit"]["id"] for x in lines[1:]] == [f"C1u{i}" for i in range(30)]
    heads, back = read_published(spark, str(tmp_path / "out"))
    assert sorted(tuple(r) for r in heads.collect()) == sorted(tuple(r) for r in chapters.collect())
    assert sorted((r.unit_id, r.unit_pos, r.root, r.blocks[0].text) for r in back.collect()) == sorted((r[3], r[2], r[6], "é") for r in rows)
