"""The composite jobs from pages to search, token list, glosses and coverage."""

import json

import pytest
from pyspark.sql import functions as F

from corpuskit.operators import search as S
from corpuskit.plans import jobs
from corpuskit.rules import devanagari as D
from corpuskit.sources import sinks

PAGE = (
    '<div class="container-fluid maintext"><div class="chapter" id="K_C01" type="valli" data-name="वल्ली">'
    '<div class="intro_bhashya">आत्मा ब्रह्म आत्मा</div>'
    '<div class="verse" id="K_C01_V01" type="mantra"><div class="versetext">आत्मा वै ब्रह्म</div>'
    '<div class="bhashya">निष्फला गाव इत्यर्थः । रामस्य ब्रह्मविद्या रामस्य</div></div></div></div>'
)


@pytest.fixture(scope="module")
def built(spark):
    pages = spark.createDataFrame([("katha", 1, f"<body>{PAGE}</body>"), ("katha", 2, " ")], "source string, page int, html string")
    return jobs.build_corpus(pages)


def test_corpus_to_search(spark, built):
    counts = built["counts"].first()
    assert (counts.chapters, counts.mantras, counts.intros, counts.words) == (1, 1, 1, 3 + 3 + 7)
    parts = jobs.build_search(built["units"])
    q = spark.createDataFrame([(1, "atma brahma"), (2, "gāva")], "query_id int, query string")
    hits = S.search(q, parts["docs"], parts["vocab"], parts["postings"], forms=jobs.native_forms).collect()
    assert {(r.query_id, r.unit_id) for r in hits} == {(1, "K_C01_INTRO1"), (1, "K_C01_V01"), (2, "K_C01_V01")}
    dangling, report = jobs.verify_links(parts["docs"], built["units"])
    assert dangling.count() == 0 and tuple(report.first()) == (2, 0)


def test_tokens_glosses_volume(built):
    units = built["units"]
    tokens = {r.token: (r.ascii, r.freq) for r in jobs.build_tokens(units).collect()}
    assert tokens == {"आत्मा": ("atma", 3), "ब्रह्म": ("brahma", 2), "रामस्य": ("ramasya", 2)}
    assert [(r.term, r.rule) for r in jobs.mine_glosses(units).collect()] == [("गाव", "ity-arthah")]
    volume, estimate = jobs.audit_volume(units)
    total = volume.filter("level = 3").first()
    assert (total.units, total.tokens) == (2, 13) and tuple(estimate.first()) == (13, 33, 46)


def test_coverage_and_reduction(spark, built):
    units = built["units"]
    lex = spark.createDataFrame(
        [("mw", 2, h) for h in ("राम", "ब्रह्म", "विद्या", "unused", "गाव")] + [("apte", 3, "आत्मन्")], "dict_id string, dict_order int, head string"
    )
    report = jobs.coverage_report(units, lex, D.rules(spark), D.manual_table(spark), split_options={"split_rules": D.SPLIT_RULES, "max_parts": 3})
    layers = {r.token: r.layer for r in report["verdict"].collect()}
    assert layers["ब्रह्म"] == "direct" and layers["रामस्य"] == "inflection" and layers["आत्मा"] == "inflection" and layers["ब्रह्मविद्या"] == "compound"
    assert abs(sum(r.pct_tokens for r in report["coverage"].collect()) - 100) < 0.1
    kept, counts = jobs.reduce_lexicons(units, lex, D.rules(spark), D.manual_table(spark), {"split_rules": D.SPLIT_RULES})
    assert "unused" not in {r.head for r in kept.collect()}
    assert {r.dict_id: (r.total, r.kept) for r in counts.collect()} == {"mw": (5, 4), "apte": (1, 1)}


def test_publish_and_write(spark, built, tmp_path):
    units = built["units"]
    chapters = built["chapters"].select(F.col("source").alias("text_slug"), "chapter_id", "chapter_ord", "title", "parent_title", "parent_ord", "chapter_kind")
    jobs.publish(units, chapters, str(tmp_path / "out"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out" / "chunks")).collect()]
    assert len(lines) == 3 and sum('"unit_pos"' in x for x in lines) == 2 and sum("chapter" in x for x in lines) == 1
    stub = spark.read.parquet(str(tmp_path / "out" / "stubs")).first()
    assert stub.chunk_path == "text_slug=katha/chapter_id=K_C01" and stub.chunk_size == sum(len(x.encode()) for x in lines) and stub.units == 2
    assert spark.read.parquet(str(tmp_path / "out" / "stubs")).first().chapter_id == "K_C01"
    sinks.write_token_list(jobs.build_tokens(units), str(tmp_path / "tokens"))
    assert spark.read.parquet(str(tmp_path / "tokens")).count() == 3


def test_republish_touches_one_text(spark, tmp_path):
    """Only the files of the rebuilt text change, the catalog keeps its canonical order, and every stub leads to its lines."""
    schema = "text_slug string, chapter_id string, unit_pos bigint, unit_id string, kind string, ordinal bigint, root string, blocks array<struct<kind:string,text:string,id:string>>"
    units = lambda texts, root: spark.createDataFrame([(t, c, i, f"{t}{c}{i}", "mantra", i, root, []) for t in texts for c in ("C:1", "C2") for i in range(3)], schema)
    chapters = lambda texts: spark.createDataFrame([(t, c, o, c, None, None, "adhyaya") for t in texts for o, c in enumerate(("C:1", "C2"), 1)], "text_slug string, chapter_id string, chapter_ord bigint, title string, parent_title string, parent_ord bigint, chapter_kind string")
    order = spark.createDataFrame([("b", 0), ("a", 1), ("c", 2)], "text_slug string, place int")
    out = tmp_path / "out"
    totals = jobs.publish(units("abc", "old"), chapters("abc"), str(out), order)
    assert totals["chunks"]["rows"] == 3 * 2 * 4 and totals["stubs"]["rows"] == 6 and totals["catalog"]["rows"] == 3
    before = {p: p.stat().st_mtime_ns for p in out.glob("chunks/*/*/part-*")}
    jobs.republish(units("b", "new").filter("chapter_id = 'C2'"), chapters("b").filter("chapter_id = 'C2'"), str(out), order)
    after = {p: p.stat().st_mtime_ns for p in out.glob("chunks/*/*/part-*")}
    assert {p for p in before if after.get(p) != before[p]} <= {p for p in before if "text_slug=b" in str(p)}
    stubs = spark.read.parquet(str(out / "stubs")).collect()
    assert sorted((r.text_slug, r.chapter_id) for r in stubs) == [("a", "C2"), ("a", "C:1"), ("b", "C2"), ("c", "C2"), ("c", "C:1")]
    for r in stubs:
        lines = [x for f in (out / "chunks" / r.chunk_path).glob("part-*") for x in f.read_text(encoding="utf8").splitlines()]
        assert sum(len(x.encode()) for x in lines) == r.chunk_size and len(lines) == r.units + 1
        assert all(("new" if r.text_slug == "b" else "old") in x for x in lines if "unit_pos" in x)
    catalog = sinks.latest_version(spark, str(out / "catalog")).orderBy("place").collect()
    assert [(r.text_slug, r.chapters) for r in catalog] == [("b", 1), ("a", 2), ("c", 2)]
    assert sinks.versions(spark, str(out / "catalog")) == [1, 2]


def test_batch_is_one_file_whatever_the_partitions(spark, tmp_path):
    rows = spark.range(0, 400, 1, 16).select(F.lit("t").alias("text_slug"), (F.col("id") % 5).cast("int").alias("batch_index"), F.col("id").alias("unit_id"))
    total = sinks.write_batches(rows, str(tmp_path / "batches"))
    assert total["rows"] == 400
    files = [sorted(d.glob("*.json")) for d in sorted((tmp_path / "batches" / "text_slug=t").iterdir()) if d.is_dir()]
    assert [len(f) for f in files] == [1] * 5
    assert sum(len(f[0].read_text().splitlines()) for f in files) == 400


def test_folders_of_batches_grow_with_their_logarithm(spark, tmp_path):
    """Many batches share folders; each lies in one file, its lines name it, and it is read back."""
    rows = spark.range(0, 3000, 1, 6).select(F.lit("t").alias("text_slug"), F.floor(F.col("id") / 2).cast("int").alias("batch_index"), F.col("id").alias("unit_id"))
    assert sinks.write_batches(rows, str(tmp_path / "batches"))["rows"] == 3000
    found = [(json.loads(x), f) for f in (tmp_path / "batches").glob("text_slug=t/batches=*/*.json") for x in f.read_text().splitlines()]
    assert len(found) == 3000 and len({f.parent for _, f in found}) == 64 + 32 * 4 + 15  # 64, 128, 256, 512, 1024 to 1499
    assert len({(r["batch_index"], f) for r, f in found}) == 1500
    back = spark.read.schema(rows.schema).json(str(tmp_path / "batches"))
    assert sorted((r.batch_index, r.unit_id) for r in back.collect()) == [(i // 2, i) for i in range(3000)]
