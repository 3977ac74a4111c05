"""Paginated HTML to units: a small event parser per page, everything else relational."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.functions import text as T
from corpuskit.operators.ordering import first_seen_ordinal, int_bucket, positions
from corpuskit.session import checkpointed
from corpuskit.operators.structure import assemble_units, unit_kind, unit_ordinal

# The markup of the pages and the titles the pages leave out.
DEFAULT_MARKUP = {
    "scope": ("div", "maintext"),
    "sections": (("div", "chapter"), ("div", "section")),
    "verse": ("div", "verse"),
    "root": ("div", "versetext"),
    "blocks": {
        "bhashya": "bhashya",
        "aux_bhashya": "aux_bhashya",
        "leading_bhashya": "leading_bhashya",
        "intro_bhashya": "intro_bhashya",
        "auxShloka": "aux_shloka",
        "pratika": "pratika",
    },
    "block_tags": {},
}
CANONICAL_TITLES = (
    ("MK_C01", "आगमप्रकरणम्"),
    ("MK_C02", "वैतथ्यप्रकरणम्"),
    ("MK_C03", "अद्वैतप्रकरणम्"),
    ("MK_C04", "अलातशान्तिप्रकरणम्"),
)
VOID = {"br", "img", "meta", "hr", "input", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
ENDS_PARAGRAPH = {"p", "div", "article", "section", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "footer", "header", "nav"}
PAGE_STRIDE = 1 << 32  # nodes of a page are numbered below it
ROWS_AT_ONCE = 2_000  # nodes held by a task before they are handed on

NODE_SCHEMA = (
    "source string, page int, node int, what string, section int, owner int, node_id string, node_type string, kind string, title string, text string"
)


class _Nodes(HTMLParser):
    """Collects sections, verses, roots and blocks of one page in document order.

    If the page has a main-text container, only what lies in the first one counts.
    """

    def __init__(self, markup: dict):
        super().__init__(convert_charrefs=True)
        self.markup, self.rows, self.open, self.count, self.container, self.left = markup, [], [], 0, None, False

    def _enclosing(self, what: str) -> int:
        inner = self.open[self.open.index(self.container) + 1 :] if self.container in self.open else self.open
        return next((e["node"] for e in reversed(inner) if e["what"] == what), 0)

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.handle_data("\n")
        if tag in VOID:
            return
        if tag in ENDS_PARAGRAPH and any(e["tag"] == "p" for e in self.open):
            self.handle_endtag("p")
        attrs = dict(attrs)
        classes = (attrs.get("class") or "").split()
        has = lambda want: tag == want[0] and (want[1] is None or want[1] in classes)
        m = self.markup
        parent = self.open[-1]["what"] if self.open else ""
        kind = m["block_tags"].get(tag) or next((m["blocks"][c] for c in classes if c in m["blocks"]), None)
        if any(has(s) for s in m["sections"]):
            what = "section"
        elif m["verse"] and has(m["verse"]) and parent in ("section", "scope", ""):
            what = "verse"
        elif m["root"] and has(m["root"]) and parent == "verse":
            what = "root"
        elif kind and parent in ("section", "verse", "scope", ""):
            what = "block"
        elif m["scope"] and has(m["scope"]) or tag in ("html", "body"):
            what = "scope"
        elif tag in ("h1", "h2", "h3", "h4", "h5") and parent == "section":
            what = "heading"
        else:
            what = "skip" if tag in ("script", "style") else "other"
        self.count += 1
        entry = {"tag": tag, "what": what, "node": self.count, "text": []}
        if m["scope"] and has(m["scope"]) and self.container is None:
            self.container, self.rows = entry, []  # what came before lies outside
        if self.left:
            entry["what"] = what = "other"
        if what in ("section", "verse", "root", "block"):
            entry["row"] = [
                self.count, what, self._enclosing("section"), self._enclosing("verse"),
                attrs.get("id"), attrs.get("type"), kind, attrs.get("data-name"), "",
            ]
            self.rows.append(entry["row"])
        self.open.append(entry)

    def handle_endtag(self, tag):
        if not any(e["tag"] == tag for e in self.open):
            return
        while self.open:
            entry = self.open.pop()
            if entry["what"] in ("root", "block"):
                entry["row"][8] = "".join(entry["text"])
            elif entry["what"] == "heading":
                section = next((e for e in reversed(self.open) if e["what"] == "section"), None)
                if section and not (section["row"][7] or "").strip():
                    section["row"][7] = "".join(entry["text"])
            self.left = self.left or entry is self.container
            if entry["tag"] == tag:
                return

    def handle_data(self, data):
        if any(e["what"] == "skip" for e in self.open):
            return
        for e in self.open:
            if e["what"] in ("root", "block", "heading"):
                e["text"].append(data)

    def finish(self) -> list:
        self.close()
        while self.open:
            self.handle_endtag(self.open[-1]["tag"])
        return self.rows


def page_nodes(pages: DataFrame, markup: dict | None = None) -> DataFrame:
    """One row per section, verse, root and block of every page, in page order."""
    chosen = markup or DEFAULT_MARKUP

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["source", "page", "node", "what", "section", "owner", "node_id", "node_type", "kind", "title", "text"]
        for batch in batches:
            rows = []
            for source, page, html in zip(batch["source"], batch["page"], batch["html"]):
                parser = _Nodes(chosen)
                parser.feed(html or "")
                rows += [(source, page, *r) for r in parser.finish()]
                if len(rows) > ROWS_AT_ONCE:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    return pages.select("source", F.col("page").cast("int"), "html").mapInPandas(parse, NODE_SCHEMA)


def stitch_pages(pages: DataFrame, source: str = "source", page: str = "page", body: str = "html") -> DataFrame:
    """Pages of a source up to the first empty or missing one, as rows in order.

    Pages stay rows: a page is parsed on its own and ordered by number, so even a
    source that holds a third of all pages never becomes one string.
    """
    first = pages.groupBy(source).agg(F.min(page).alias("__first"))
    empty = pages.filter(T.trim_space(F.coalesce(body, F.lit(""))) == "").groupBy(source).agg(F.min(page).alias("__empty"))
    known = pages.select(source, page).distinct()
    after = known.select(source, (F.col(page) + 1).alias(page))
    gaps = after.join(known, [source, page], "left_anti").groupBy(source).agg(F.min(page).alias("__gap"))
    cut = first.join(empty, source, "left").join(gaps, source, "left")
    cut = cut.select(source, "__first", F.least("__empty", "__gap").alias("__cut"))
    kept = pages.join(cut, source).filter((F.col(page) < F.col("__cut")) | (F.col(page) == F.col("__first")))
    return kept.drop("__first", "__cut")


def pages_to_units(pages: DataFrame, markup: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """``(chapters, blocks)`` of all pages.

    ``chapters``: one row per leaf section with ordinal, title, parent title and
    ordinal.  ``blocks``: one row per root or prose block with its unit
    (``unit_id, kind, ordinal, unit_pos``), in document order by ``pos``.
    """
    stride = F.lit(PAGE_STRIDE)
    nodes = page_nodes(pages, markup).withColumn("text", T.normalise_space(F.coalesce("text", F.lit("")))).withColumn(
        "title", F.nullif(T.normalise_space(F.coalesce("title", F.lit(""))), F.lit(""))
    )
    at = lambda c: (F.col("page") * stride + F.col(c)).cast("bigint")
    nodes = nodes.withColumn("pos", at("node")).withColumn("section_pos", at("section")).withColumn("owner_pos", at("owner"))
    nodes = checkpointed(nodes)  # parsed once, read by every step below
    sections = nodes.filter(F.col("what") == "section")
    holders = sections.filter(F.col("section") > 0).select("source", F.col("section_pos").alias("pos")).distinct()
    leaves = sections.join(holders, ["source", "pos"], "left_anti")
    bare = nodes.select("source").distinct().join(leaves.select("source"), "source", "left_anti")
    made = bare.select(
        "source", F.lit(0).cast("bigint").alias("pos"), F.concat(F.upper("source"), F.lit("_C01")).alias("node_id"),
        F.lit(None).cast("string").alias("node_type"), F.lit(None).cast("string").alias("title"), F.lit(0).cast("bigint").alias("section_pos"),
    )
    leaves = leaves.select("source", "pos", "node_id", "node_type", "title", "section_pos").unionByName(made)
    leaves = positions(leaves, ["source"], ["pos"], int_bucket(F.col("pos"), PAGE_STRIDE * 16), "n").withColumn("chapter_ord", F.col("n") + 1)
    parents = sections.join(holders, ["source", "pos"], "left_semi").select(
        "source", F.col("pos").alias("section_pos"), F.coalesce("node_id", F.lit("")).alias("parent_id"), F.col("title").alias("parent_title")
    )
    placed = leaves.join(parents, ["source", "section_pos"], "left")
    numbered = first_seen_ordinal(
        placed.filter(F.col("parent_id").isNotNull()), ["source"], "parent_id", "chapter_ord", "parent_ord"
    ).select("source", "parent_id", "parent_ord")
    titles = pages.sparkSession.createDataFrame(list(CANONICAL_TITLES), "chapter_id string, canonical string")
    chapters = (
        placed.join(numbered, ["source", "parent_id"], "left")
        .withColumn("chapter_id", F.coalesce("node_id", F.concat(F.lit("C"), "chapter_ord")))
        .join(F.broadcast(titles), "chapter_id", "left")
        .select(
            "source", "chapter_id", F.col("pos").alias("chapter_at"), "chapter_ord", F.coalesce("title", "canonical").alias("title"), "parent_title", "parent_ord",
            F.col("node_type").alias("chapter_kind"),
        )
    )
    chapters = checkpointed(chapters)  # one row per chapter, joined by several steps
    anchor = F.when(F.col("section") > 0, F.col("section_pos")).otherwise(F.lit(0).cast("bigint"))
    inside = nodes.withColumn("chapter_at", anchor).join(chapters.select("source", "chapter_at", "chapter_id"), ["source", "chapter_at"])
    texts = inside.filter(F.col("what").isin("root", "block") & (F.col("text") != ""))
    top = inside.filter(F.col("what") == "verse").select("source", "chapter_at", "chapter_id", "pos", "node_id", "node_type", F.lit(True).alias("is_verse"))
    loose = texts.filter((F.col("what") == "block") & (F.col("owner") == 0)).select(
        "source", "chapter_at", "chapter_id", "pos", "node_id", "node_type", F.lit(False).alias("is_verse")
    )
    made_units = assemble_units(checkpointed(top.unionByName(loose)), ["source", "chapter_at"], "pos", PAGE_STRIDE * 16)
    prefix = F.when(F.col("is_outro"), "_OUTRO").otherwise("_INTRO")
    unit_id = F.when(F.col("is_verse"), F.coalesce("node_id", F.concat("chapter_id", F.lit("_V"), "verse_no"))).otherwise(
        F.concat("chapter_id", prefix, "intro_no")
    )
    units = made_units.withColumn("unit_id", unit_id).select(
        "source", "chapter_at", "chapter_id", F.col("pos").alias("unit_at"), F.coalesce("run_start", "pos").alias("unit_start"), "unit_id",
        F.when(F.col("is_verse"), unit_kind(F.col("node_type"), F.col("unit_id"))).otherwise("intro").alias("unit_kind"),
        F.when(F.col("is_verse"), unit_ordinal(F.col("unit_id"), F.col("verse_no"))).otherwise(F.col("intro_no")).alias("ordinal"),
    )
    owned = texts.withColumn("unit_at", F.when(F.col("owner") > 0, F.col("owner_pos")).otherwise(F.col("pos")))
    blocks = owned.select("source", "unit_at", "pos", "what", "kind", "text", F.col("node_id").alias("block_id")).join(units, ["source", "unit_at"])
    return chapters, blocks.select("source", "chapter_at", "chapter_id", "unit_start", "unit_id", "unit_kind", "ordinal", "pos", "what", "kind", "text", "block_id")


def units_from_blocks(blocks: DataFrame) -> DataFrame:
    """Nested units (root, ordered blocks); the array of a unit is one verse or prose run.

    Units are told apart by where they start, as ids may come again (a chapter that goes on
    on another page).
    """
    piece = F.struct("pos", "kind", "text", F.col("block_id").alias("id"))
    grouped = blocks.groupBy("source", "chapter_at", "chapter_id", "unit_start", "unit_id", "unit_kind", "ordinal").agg(
        F.min("pos").alias("unit_pos"),
        F.array_sort(F.collect_list(F.when(F.col("what") == "root", F.struct("pos", "text")))).alias("roots"),
        F.array_sort(F.collect_list(F.when(F.col("what") == "block", piece))).alias("pieces"),
    )
    return grouped.select(
        F.col("source").alias("text_slug"), "chapter_id", "unit_id", F.col("unit_kind").alias("kind"), "ordinal", "unit_pos",
        F.array_join(F.transform("roots", lambda r: r["text"]), "\n").alias("root"),
        F.transform("pieces", lambda b: F.struct(b["kind"].alias("kind"), b["text"].alias("text"), b["id"].alias("id"))).alias("blocks"),
    )

