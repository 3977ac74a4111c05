"""Whole jobs put together from the operators; each reads and returns DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.functions import text as T
from corpuskit.functions.scripts import native_forms
from corpuskit.operators import freq, glosses, history, integrity, meanings, resolve, search, structure
from corpuskit.session import checkpointed, materialised
from corpuskit.sources import html_pages, sinks


def build_corpus(pages: DataFrame, markup: dict | None = None) -> dict[str, DataFrame]:
    """Pages to chapters, units and counts per text."""
    kept = html_pages.stitch_pages(pages)
    chapters, blocks = html_pages.pages_to_units(kept, markup)
    # Every later job reads these tables, so they are written once.
    blocks = checkpointed(blocks)
    units = checkpointed(html_pages.units_from_blocks(blocks))
    return {"chapters": chapters, "blocks": blocks, "units": units, "counts": structure.text_counts(units)}


def build_search(units: DataFrame, forms=native_forms, block_chars: int | None = None) -> dict[str, DataFrame]:
    """Search documents, vocabulary with its forms, and postings."""
    docs = search.build_search(units, block_chars)
    vocab, postings = search.build_postings(docs, forms)
    return {"docs": docs, "vocab": materialised(vocab, "token"), "postings": postings}


def build_tokens(units: DataFrame, forms=native_forms, pattern: str = T.SCRIPT_RUN, letter: str = T.SCRIPT_LETTER) -> DataFrame:
    """Token list; the written forms are made once per distinct token."""
    counted = freq.token_freq(structure.with_body(units), F.col("body"), pattern, letter)
    return counted.select("token", forms(F.col("token"))[1].alias("ascii"), "freq")


def audit_volume(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    volume = structure.volume_rollup(units)
    return volume, structure.translation_estimate(volume)


def corpus_vocabulary(units: DataFrame, pattern: str = T.DICT_TOKEN) -> DataFrame:
    body = structure.with_body(units)
    return freq.token_stream(body, F.col("body"), pattern).groupBy("token").agg(F.count("*").alias("freq"))


def coverage_report(units: DataFrame, lexicon: DataFrame, rules: DataFrame, manual: DataFrame, pattern: str = T.DICT_TOKEN, **options) -> dict[str, DataFrame]:
    """Verdict per vocabulary token, shares per layer, and the commonest open tokens."""
    vocab = materialised(corpus_vocabulary(units, pattern), "token")
    verdict = materialised(resolve.verdicts(vocab, lexicon, rules, manual, **options), "token")
    return {"verdict": verdict, "coverage": resolve.coverage(verdict), "unresolved": resolve.unresolved_top(verdict)}


def reduce_lexicons(units: DataFrame, lexicon: DataFrame, rules: DataFrame, manual: DataFrame, split_options: dict | None = None, pattern: str = T.DICT_TOKEN):
    vocab = materialised(corpus_vocabulary(units, pattern), "token")
    needed = materialised(resolve.needed_heads(vocab, lexicon, manual, rules, split_options), "head")
    return resolve.reduce_lexicon(lexicon, needed)


def mine_glosses(units: DataFrame, patterns=glosses.PATTERNS, top: int = glosses.KEPT) -> DataFrame:
    return glosses.extract_glosses(structure.with_body(units).select("text_slug", "unit_id", "body"), patterns, top)


def ingest(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    return meanings.ingest_results(meanings.flatten_results(results))


def verify_links(docs: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    keys = ["text_slug", "unit_id"]
    return integrity.dangling(docs, units, keys), integrity.link_report(docs, units, keys)


def publish(units: DataFrame, chapters: DataFrame, path: str, catalog_order: DataFrame | None = None) -> dict[str, dict]:
    """Write manifests, stubs, chapter chunks and the catalog below ``path``; the totals of every writer."""
    return _published(units, chapters, path, catalog_order, replace_all=True)


def republish(units: DataFrame, chapters: DataFrame, path: str, catalog_order: DataFrame | None = None) -> dict[str, dict]:
    """Publish some texts anew: the files of other texts stay as they are, the catalog rows are merged.

    ``catalog_order(text_slug, place)`` is the canonical order of the texts.  Stubs and
    manifests of a text are replaced as a whole; a chapter that a text lost is no longer named
    by a stub.
    """
    return _published(units, chapters, path, catalog_order, replace_all=False)


def _published(units: DataFrame, chapters: DataFrame, path: str, catalog_order: DataFrame | None, replace_all: bool) -> dict[str, dict]:
    spark = units.sparkSession
    manifests, stubs, chunks = sinks.split_manifest(units, chapters)
    totals = {
        "chunks": sinks.write_chunks(chunks, f"{path}/chunks", replace_all),
        "stubs": sinks.write_table(stubs, f"{path}/stubs", "text_slug", replace_all=replace_all),
        "manifests": sinks.write_table(manifests, f"{path}/manifests", "text_slug", replace_all=replace_all),
    }
    rows = spark.read.parquet(f"{path}/manifests").join(chapters.select("text_slug").distinct(), "text_slug", "left_semi")
    old = None if replace_all else sinks.latest_version(spark, f"{path}/catalog")
    new = rows.select("text_slug", "chapters", "units", "bytes", "chunked")
    merged = history.upsert_catalog(new.limit(0) if old is None else old.drop("place"), new, "text_slug")
    place = merged if catalog_order is None else merged.join(catalog_order, "text_slug", "left")
    place = place if catalog_order is not None else place.withColumn("place", F.lit(None).cast("int"))
    totals["catalog"] = sinks.write_version(place, f"{path}/catalog")
    return totals

