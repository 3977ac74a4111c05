from pyspark.sql import functions as F

from corpuskit.operators.structure import text_counts
from corpuskit.sources import html_pages as H


def build(spark, *pages, source="mk"):
    df = spark.createDataFrame([(source, i + 1, f'<html><body>{p}</body></html>') for i, p in enumerate(pages)], "source string, page int, html string")
    chapters, blocks = H.pages_to_units(df)
    units = {r.unit_id: r for r in H.units_from_blocks(blocks).collect()}
    return sorted(chapters.collect(), key=lambda r: r.chapter_ord), units


MAIN = '<div class="container-fluid maintext">{}</div>'


def test_flat_chapter(spark):
    html = MAIN.format(
        '<div class="chapter" id="IS_C01" data-name="प्रथम" type="adhyaya"><div class="intro_bhashya">क ख ग</div>'
        '<div class="verse" id="IS_C01_V01" type="mantra"><div class="versetext" type="gadya">उवाच</div><div class="versetext">क ख<br>ग</div>'
        '<div class="bhashya">घ <span class="emphasis">ङ</span></div></div>'
        '<div class="verse" id="IS_C01_V02"><div class="leading_bhashya">च</div><div class="versetext">छ</div>'
        '<div class="bhashya">ज</div><div class="aux_bhashya">झ</div><div class="unknown">x</div></div></div>'
    )
    chapters, units = build(spark, html)
    assert [(c.chapter_id, c.title, c.chapter_kind) for c in chapters] == [("IS_C01", "प्रथम", "adhyaya")]
    assert {u: r.kind for u, r in units.items()} == {"IS_C01_INTRO1": "intro", "IS_C01_V01": "mantra", "IS_C01_V02": "mantra"}
    assert units["IS_C01_V01"].root == "उवाच\nक ख\nग"
    assert [b.text for b in units["IS_C01_V01"].blocks] == ["घ ङ"]
    assert [b.kind for b in units["IS_C01_V02"].blocks] == ["leading_bhashya", "bhashya", "aux_bhashya"]
    assert units["IS_C01_INTRO1"].ordinal == 1 and units["IS_C01_V02"].ordinal == 2


def test_nested_sections_over_pages_and_outro(spark):
    one = MAIN.format(
        '<div class="chapter" id="A" data-name="अध्याय"><div class="section" id="A1"><h2>शीर्ष</h2><div class="verse" type="sutra"><div class="versetext">क</div></div>'
        '<div class="bhashya">अन्त</div></div><div class="section" id="A2"><div class="verse" id="X_V13" type="shloka"><div class="versetext">ख</div></div></div></div>'
    )
    two = '<div class="chapter" id="B"><div class="section" id="B1"><div class="verse" id="B_K01"><div class="versetext">ग</div></div></div></div>'
    chapters, units = build(spark, one, two)
    assert [(c.chapter_id, c.chapter_ord, c.parent_ord, c.parent_title) for c in chapters] == [
        ("A1", 1, 1, "अध्याय"), ("A2", 2, 1, "अध्याय"), ("B1", 3, 2, None)
    ]
    assert chapters[0].title == "शीर्ष"
    assert units["A1_V1"].kind == "sutra" and units["A1_OUTRO1"].kind == "intro"
    assert (units["X_V13"].kind, units["X_V13"].ordinal) == ("verse", 13)
    assert (units["B_K01"].kind, units["B_K01"].ordinal) == ("karika", 1)


def test_no_sections_and_canonical_title(spark):
    chapters, units = build(spark, MAIN.format('<div class="verse" id="q_V1"><div class="versetext">क</div></div><div class="bhashya">ख</div>'), source="isha")
    assert [c.chapter_id for c in chapters] == ["ISHA_C01"]
    assert set(units) == {"q_V1", "ISHA_C01_OUTRO1"}
    chapters, _ = build(spark, MAIN.format('<div class="chapter" id="MK_C02"><div class="verse"><div class="versetext">क</div></div></div>'))
    assert chapters[0].title == "वैतथ्यप्रकरणम्"


def test_counts(spark):
    html = MAIN.format(
        '<div class="chapter" id="C"><div class="intro_bhashya">क ख ग</div><div class="verse" id="C_V1"><div class="versetext">क ख ग</div>'
        '<div class="bhashya">क ख ग घ</div></div></div>'
    )
    df = spark.createDataFrame([("t", 1, html)], "source string, page int, html string")
    _, blocks = H.pages_to_units(df)
    row = text_counts(H.units_from_blocks(blocks)).first()
    assert (row.chapters, row.mantras, row.intros, row.words) == (1, 1, 1, 10)


def test_stitch_stops_at_empty_or_missing_page(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 3, " \n"), ("a", 4, "z"), ("b", 1, "x"), ("b", 2, "y"), ("b", 4, "z"), ("c", 1, "")]
    df = spark.createDataFrame(rows, "source string, page int, html string")
    assert sorted((r.source, r.page) for r in H.stitch_pages(df).collect()) == [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 1)]


def test_only_the_first_main_text_counts(spark):
    verse = '<div class="chapter" id="K_C0{0}"><div class="verse" id="K_C0{0}_V01"><div class="versetext">{1}</div></div></div>'
    page = '<div class="chapter" id="NAV"><div class="verse"><div class="versetext">nav</div></div></div>' + MAIN.format(verse.format(1, "क")) + MAIN.format(verse.format(2, "ख")) + '<div class="bhashya">foot</div>'
    chapters, units = build(spark, page)
    assert [c.chapter_id for c in chapters] == ["K_C01"] and set(units) == {"K_C01_V01"}


def test_a_chapter_that_goes_on_keeps_its_units_apart(spark):
    part = '<div class="chapter" id="K_C01"><div class="intro_bhashya">{0}</div><div class="verse" id="K_C01_V0{1}"><div class="versetext">{0}</div></div></div>'
    df = spark.createDataFrame([("k", p, f"<body>{MAIN.format(part.format(t, p))}</body>") for p, t in ((1, "क"), (2, "ख"))], "source string, page int, html string")
    chapters, blocks = H.pages_to_units(df)
    units = H.units_from_blocks(blocks).orderBy("unit_pos").collect()
    assert [(u.unit_id, [b.text for b in u.blocks] or u.root) for u in units] == [("K_C01_INTRO1", ["क"]), ("K_C01_V01", "क"), ("K_C01_INTRO1", ["ख"]), ("K_C01_V02", "ख")]
    assert chapters.count() == 2
