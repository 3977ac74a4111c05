"""Glosses, senses, meanings, batches, references, integrity, history, following, pages and streams."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F

from corpuskit.functions import text as T
from corpuskit.operators import follow, glosses, history, integrity, lexicon, meanings, refs, resolve
from corpuskit.operators.freq import token_stream
from corpuskit.operators.resolve import rule_table
from corpuskit.operators.structure import with_body
from corpuskit.queries import resolve as RQ
from corpuskit.queries.resolve import _values
from corpuskit.queries.tables import SQL_SPACE, doc_units, read
from corpuskit.session import checkpoint_folder, kept, materialised
from corpuskit.sources import html_pages
from corpuskit.streaming import follow_stream as streams

# Definition patterns for the Latin-script test texts, passed as a parameter.
LATIN_PATTERNS = (
    ("named", r"([\p{L} ]{2,40}?) (?:the|der|los) (\p{L}{3,30})[.,;]", 2, 1.0),
    ("means", r"(\p{L}{3,}?) (?:is|est|ist|es) ([\p{L} ]{2,40}?)[.,;]", 1, 0.95),
    ("of", r"(\p{L}{3,30}) (?:of|de|von) ([\p{L} ]{2,40}?)[.,;]", 1, 0.7),
)
# A match of these patterns is letters and blanks up to a mark, so it ends a clause; what its clause has before the mark.
LATIN_CLAUSE = r"[\p{L} ]+[.,;]?"
LATIN_SIGNS = (r" (?:the|der|los) \p{L}{3,30}[.,;]", r" (?:is|est|ist|es) [\p{L} ]{2,40}[.,;]", r" (?:of|de|von) [\p{L} ]{2,40}[.,;]")


def bodies(spark, sf):
    return with_body(doc_units(spark, sf)).select("text_slug", "unit_id", "body")


def glosses_top(spark, sf):
    found = glosses.extract_glosses(bodies(spark, sf), LATIN_PATTERNS, clause=LATIN_CLAUSE, signs=LATIN_SIGNS)
    return found.select("text_slug", "term", "unit_id", "snippet", "rule", "score", "rank")


def gloss_lookup(spark, sf):
    """Definitions of the benchmark words in every text, exact or without a final s, e or n."""
    table = materialised(glosses_top(spark, sf), "term")
    words = read(spark, sf, "benchmark").select(F.explode(T.matches(F.col("text"), T.LATIN_WORD)).alias("term")).distinct()
    stem = F.regexp_replace("term", "[sen]+$", "")
    found = glosses.lookup_glosses(glosses.in_every_text(words, table, stem), table, stem=stem)
    return found.select("text_slug", "term", "unit_id", "rule", "score", "rank")


def token_glosses(spark, sf):
    """Definitions of the benchmark words and of their lemma candidates, in every text."""
    table = materialised(glosses_top(spark, sf), "term")
    words = read(spark, sf, "benchmark").select(F.explode(T.matches(F.lower("text"), T.LATIN_WORD)).alias("token")).distinct()
    from corpuskit.operators.resolve import lemma_candidates

    rules = rule_table(spark, [("s", "", "plural"), ("ed", "", "past"), ("ing", "", "participle")])
    candidates = materialised(lemma_candidates(words, None, rules), "token")
    terms = words.select("token", F.col("token").alias("term")).unionByName(candidates.select("token", F.col("lemma").alias("term")))
    tokens = glosses.in_every_text(terms, table).select("text_slug", "token").distinct()
    return glosses.token_glosses(tokens, candidates, table).select("text_slug", "token", "unit_id", "rule", "score", "rank")


def resolved_in_texts(spark, sf):
    """Results per layer of the benchmark words, outside of a text and in every text that defines them."""
    table = materialised(glosses_top(spark, sf), "term")
    words = materialised(token_stream(read(spark, sf, "benchmark"), F.lower("text"), T.LATIN_WORD).distinct(), "token")
    heads = RQ.lexicons(spark, sf).filter("dict_id = 'conv'")
    report = resolve.resolve_tokens(words, heads, RQ.rules(spark), RQ.manual(spark), split_options=RQ.OPTIONS)
    candidates = materialised(resolve.lemma_candidates(words, RQ.manual(spark), RQ.rules(spark)), "token")
    terms = words.select("token", F.col("token").alias("term")).unionByName(candidates.select("token", F.col("lemma").alias("term")))
    inside = materialised(glosses.in_every_text(terms, table).select("text_slug", "token").distinct(), "token")
    found = glosses.token_glosses(inside, candidates, table)
    tokens = inside.unionByName(words.select(F.lit(None).cast("string").alias("text_slug"), "token"))
    return resolve.resolve_in_texts(tokens, report, found).withColumn("text_slug", F.coalesce("text_slug", F.lit("")))


PRIORS = [
    ("Brand#1", ["red", "small", "gear"]),
    ("Brand#2", ["ring", "Blue"]),
    ("Brand#3", ["hot", "widget", "bolt", "cold"]),
    ("Brand#4", ["nothing"]),
]


def part_senses(spark, sf):
    from corpuskit.operators.ordering import int_bucket, positions

    part = read(spark, sf, "part").select(F.col("p_brand").alias("head"), "p_partkey", F.col("p_name").alias("sense"))
    return positions(part, ["head"], ["p_partkey"], int_bucket(F.col("p_partkey")), "idx")


def sense_rerank(spark, sf):
    priors = spark.createDataFrame(PRIORS, "head string, preferred array<string>")
    out = glosses.rerank_senses(part_senses(spark, sf), F.broadcast(priors))
    return out.select("head", "idx", "sense", F.round("score", 6).alias("score"), F.coalesce("matched", F.lit("")).alias("matched"), "rank")


def lexicon_fold(spark, sf):
    part = read(spark, sf, "part").select(F.col("p_brand").alias("head"), F.col("p_partkey").alias("rec"), F.col("p_name").alias("body"))
    return lexicon.fold_senses(part, 200)


def split_senses(spark, sf):
    """The folded bodies cut into senses again."""
    return lexicon_fold(spark, sf).select("head", F.posexplode(T.split_senses(F.col("body"))).alias("i", "sense"))


def meaning_inputs(spark, sf):
    units = doc_units(spark, sf).withColumn("unit_id", F.col("unit_id").cast("string"))
    labels = read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", F.col("lang").alias("text_slug")), "doc_id")
    made = labels.select(
        "text_slug",
        F.col("doc_id").cast("string").alias("key"),
        F.explode(F.when(F.col("quality") == 1, F.array(F.lit("ml"), F.lit("en"))).otherwise(F.array(F.lit("en")))).alias("language"),
        F.concat(F.lit("quality "), "quality").alias("text"),
        F.when(F.col("toxic") == 1, "draft").otherwise("main").alias("source_id"),
        F.col("doc_id").alias("input_seq"),
    )
    notes = labels.filter(F.col("quality") == 0).select(
        "text_slug", F.col("doc_id").cast("string").alias("key"), F.lit("en").alias("language"), F.lit("second opinion").alias("text"),
        F.lit("other").alias("source_id"), (F.col("doc_id") + 1).alias("input_seq"),
    )
    sources = spark.createDataFrame(
        [("main", True, "public-domain"), ("other", False, "public-domain"), ("draft", False, "ai-draft")],
        "source_id string, is_primary boolean, license string",
    )
    return units, made.unionByName(notes), F.broadcast(sources)


def meanings_order(spark, sf):
    units, entries, sources = meaning_inputs(spark, sf)
    out = meanings.build_meanings(units, entries, sources)
    return out.select("text_slug", "key", "seq", "language", F.md5(F.col("text").cast("binary")).alias("text_md5"), "source_id")


def meanings_first(spark, sf):
    units, entries, sources = meaning_inputs(spark, sf)
    out = meanings.first_by_language(meanings.build_meanings(units, entries, sources))
    return out.groupBy("text_slug", "language", "source_id").agg(F.count("*").alias("keys"))


def first_block_fallback(spark, sf):
    return doc_units(spark, sf).select("unit_id", F.coalesce(meanings.first_block_text(), F.lit("")).alias("text"))


def truncate_blocks(spark, sf):
    blocks = doc_units(spark, sf).select("unit_id", F.posexplode(meanings.capped_blocks(cap=300)).alias("i", "b"))
    return blocks.select("unit_id", "i", "b.kind", F.length("b.text").alias("chars"), "b.truncated", F.md5(F.col("b.text").cast("binary")).alias("md5"))


def batches(spark, sf):
    out = meanings.prepare_batches(doc_units(spark, sf), "unit_id")
    return out.select("text_slug", "unit_id", "unit_pos", "batch_index", "total_batches", F.size("blocks").alias("n_blocks"))


def result_pieces(spark, sf):
    events = read(spark, sf, "events")
    own = F.concat(F.lit("u"), "user_id")
    return events.select(
        own.alias("dir_slug"),
        F.when(F.col("event_type") == "error", "other").otherwise(own).alias("slug"),
        F.date_format("ts", "'result-'yyyyMMddHH").alias("file"),
        F.col("event_id").alias("unit_pos"),
        F.when(F.col("value") < 1, "").otherwise(F.col("event_type")).alias("unit_id"),
        F.lit("en").alias("language"),
        F.col("event_type").alias("key"),
        F.when(F.col("event_type") == "signup", F.regexp_extract("props", r": (\d+)", 1)).otherwise(F.col("props")).alias("text"),
        F.lit(2).alias("shortest"),
    )


def ingest_last_wins(spark, sf):
    return meanings.ingest_results(result_pieces(spark, sf))[0]


def ingest_rejects(spark, sf):
    rejected = meanings.ingest_results(result_pieces(spark, sf))[1]
    return rejected.groupBy("dir_slug", "reason").agg(F.count("*").alias("n"))


def reference_tables(spark, sf):
    """References built from the events into the orders (chapters) and lines (units) of a customer."""
    orders = read(spark, sf, "orders")
    chapters = orders.select(
        F.col("o_custkey").alias("text_slug"), F.col("o_orderkey").alias("chapter_id"), F.col("o_orderkey").alias("chapter_pos"),
        F.dayofmonth("o_orderdate").alias("chapter_ord"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.quarter("o_orderdate")).alias("parent_ord"),
    )
    units = (
        read(spark, sf, "lineitem")
        .join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
        .select(
            F.col("o_custkey").alias("text_slug"), F.col("l_orderkey").alias("chapter_id"), F.col("l_partkey").alias("unit_id"),
            F.col("l_partkey").alias("unit_pos"), F.col("l_linenumber").alias("ordinal"),
            F.when(F.col("l_returnflag") == "R", "intro").otherwise("verse").alias("kind"),
        )
    )
    k = F.regexp_extract("props", r": (\d+)", 1).cast("int")
    unit = (k % 7 + 1).cast("string")
    day = F.dayofmonth("ts").cast("string")
    ref = (
        F.when(F.col("event_type") == "click", F.concat_ws(".", (k % 4 + 1).cast("string"), day, unit))
        .when(F.col("event_type") == "view", F.concat_ws(".", day, unit))
        .when(F.col("event_type") == "signup", unit)
        .when(F.col("event_type") == "purchase", F.concat(F.lit(" "), day, F.lit("."), unit, F.lit(".")))
        .otherwise(F.concat(unit, F.lit(".x")))
    )
    asked = read(spark, sf, "events").select(F.col("event_id").alias("ref_id"), F.col("user_id").alias("text_slug"), ref.alias("ref"))
    return asked, chapters, units


def resolve_refs(spark, sf):
    return refs.resolve_refs(*reference_tables(spark, sf)).select("ref_id", "status", F.coalesce("unit_id", F.lit(-1)).alias("unit_id"))


def resolve_refs_in_parent(spark, sf):
    """The same references; the middle number may also count the chapters of its parent."""
    found = refs.resolve_refs(*reference_tables(spark, sf), in_parent=True)
    return found.select("ref_id", "status", F.coalesce("unit_id", F.lit(-1)).alias("unit_id"), F.coalesce("numbering", F.lit("")).alias("numbering"))


def describe_units(spark, sf):
    orders = read(spark, sf, "orders").select(
        F.lit("t").alias("text_slug"), F.col("o_orderkey").alias("chapter_id"), F.col("o_custkey").alias("chapter_ord"),
        F.when(F.col("o_orderstatus") != "P", F.month("o_orderdate")).alias("parent_ord"),
        F.when(F.col("o_orderstatus") == "F", "valli").when(F.col("o_orderstatus") == "O", "Book").alias("chapter_kind"),
    )
    units = read(spark, sf, "lineitem").select(
        F.lit("t").alias("text_slug"), F.col("l_orderkey").alias("chapter_id"), F.concat_ws("_", F.lit("X"), "l_orderkey", "l_linenumber").alias("unit_id"),
        F.when(F.col("l_returnflag") == "A", "mantra").when(F.col("l_returnflag") == "N", "sutra").otherwise("line").alias("kind"),
        F.col("l_linenumber").alias("ordinal"),
    )
    return refs.describe_units(units, orders).groupBy("label").agg(F.count("*").alias("n"))


def prefix_chapters(spark, sf):
    """Source names as chapter ids; ``src1`` also starts ``src12``, so the first in order wins."""
    docs = read(spark, sf, "documents").select("lang", "source", "doc_id")
    chapters = docs.select(F.col("lang").alias("text_slug"), F.col("source").alias("chapter_id")).distinct().withColumn(
        "chapter_ord", F.regexp_extract("chapter_id", r"(\d+)", 1).cast("int")
    )
    ids = docs.select(F.col("lang").alias("text_slug"), F.concat_ws("_", "source", "doc_id").alias("unit_id"))
    return refs.chapter_by_prefix(ids, chapters)


def link_check(spark, sf):
    """Labels without an English document."""
    docs = read(spark, sf, "documents").filter(F.col("lang") == "en").select("doc_id")
    return integrity.dangling(read(spark, sf, "labels"), docs, ["doc_id"])


def link_report(spark, sf):
    docs = read(spark, sf, "documents").filter(F.col("lang") == "en").select("doc_id")
    return integrity.link_report(read(spark, sf, "labels"), docs, ["doc_id"])


def gold_check(spark, sf):
    orders = read(spark, sf, "orders")
    forms = orders.select(
        F.col("o_orderkey").alias("form_id"),
        F.when(F.col("o_orderpriority").startswith("4"), "").otherwise(F.col("o_orderpriority")).alias("form"),
        F.col("o_custkey").alias("source"),
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("lemma"),
        (F.col("o_custkey") % 120).alias("reviewer"),
        (F.col("o_orderstatus") == "F").alias("unverified"),
    )
    people = read(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") > 0, "vyakarana").otherwise("other").alias("specialisation"), "s_nationkey"
    )
    reviewers = people.unionByName(people.filter("s_nationkey = 0")).drop("s_nationkey")
    units = read(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("unit_id"))
    return integrity.verify_gold(forms, reviewers, units, id_shape="^[0-9]+$")


def recent_history(spark, sf):
    events = read(spark, sf, "events").select("user_id", F.col("props").alias("query"), "ts")
    return history.recent_history(events).select("user_id", "query", "rank")


def positions_with_time(spark, sf):
    events = read(spark, sf, "events").select("user_id", "event_type", "event_id", "value", "ts")
    out = history.latest_state(events, ["user_id", "event_type"], ["ts", "event_id"], deleted=F.col("value") < 5)
    return out.select("user_id", "event_type", "event_id", "ts")


def latest_position(spark, sf):
    return positions_with_time(spark, sf).drop("ts")


def resume_list(spark, sf):
    catalog = read(spark, sf, "events").select("event_type").distinct().filter("event_type <> 'error'")
    return history.resume_list(positions_with_time(spark, sf), catalog, "user_id", "event_type", "ts").select(
        "user_id", "event_type", "event_id", "rank"
    )


def bookmarks_newest(spark, sf):
    return history.newest_first(positions_with_time(spark, sf), "ts", "user_id", "event_type").drop("ts")


def debounced(spark, sf):
    events = read(spark, sf, "events").select("user_id", "event_id", "ts")
    return history.debounced(events, ["user_id"], "ts", gap_ms=6 * 3_600_000, tie=["event_id"]).select("user_id", "event_id")


def catalog_upsert(spark, sf):
    old = read(spark, sf, "supplier")
    new = old.filter(F.col("s_nationkey") < 10).withColumn("s_acctbal", F.round(F.col("s_acctbal") + 1000, 2))
    return history.upsert_catalog(old, new, "s_suppkey", old.select("s_suppkey", F.col("s_nationkey").alias("place"))).drop("place")


def source_merge(spark, sf):
    existing = read(spark, sf, "supplier").filter("s_nationkey < 10").select(F.col("s_suppkey").alias("id"), F.lit("old").alias("note"))
    new = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("new").alias("note"))
    return history.merge_new_only(existing, new, "id")


def stream_docs(spark, sf):
    return read(spark, sf, "documents").select(F.col("lang").alias("text_slug"), F.col("doc_id").alias("unit_id"), F.col("text").alias("body"))


def stream_words(c):
    return T.matches(F.lower(c), T.LATIN_WORD)


def stream_tokens(spark, sf):
    return follow.corpus_tokens(stream_docs(spark, sf), "unit_id", stream_words)


def token_positions(spark, sf):
    """First and last stream position of every document and a digest of its tokens."""
    return stream_tokens(spark, sf).groupBy("text_slug", "unit_id").agg(
        F.min("pos").alias("start"), F.max("pos").alias("last"), F.count("*").alias("n"), F.sum(F.length("token").cast("bigint") * (F.col("unit_offset") + 1)).alias("weighted")
    )


def heard(spark, sf, hint):
    """The benchmark passages as utterances, asked of every text."""
    passages = read(spark, sf, "benchmark").select("item_id", T.matches(F.lower("text"), T.LATIN_WORD).alias("tokens"))
    return passages.select(F.col("item_id").alias("utt_id"), "tokens", hint.cast("bigint").alias("hint"))


def stream_index(spark, sf):
    return follow.unit_index(follow.placed_units(stream_docs(spark, sf), "unit_id", stream_words), stored=True)


def best_window(spark, sf):
    """Where in each text the end of every benchmark passage is best aligned."""
    found = follow.best_window(heard(spark, sf, F.lit(None)), stream_index(spark, sf))
    return found.select("utt_id", "text_slug", "start", "end", F.round("score", 6).alias("score"))


def follow_neighbourhood(spark, sf):
    found = follow.best_window(heard(spark, sf, F.col("item_id") * 1000), stream_index(spark, sf), min_score=0.1, neighbourhood=20_000)
    return found.select("utt_id", "text_slug", "start", "end", F.round("score", 6).alias("score"), "is_local")


def stitch_pages(spark, sf):
    """Turns as pages of a conversation; a user turn under 40 characters is an empty page."""
    turns = read(spark, sf, "conversations").select(
        F.col("conv_id").alias("source"), F.col("turn").alias("page"), F.when(F.length("text") < 40, " ").otherwise(F.col("text")).alias("html")
    )
    return html_pages.stitch_pages(turns).select("source", "page", F.length("html").alias("chars"))


ARTICLE = {
    "scope": None, "sections": (("article", None),), "verse": None, "root": None, "blocks": {}, "block_tags": {"p": "para"},
}


def page_blocks(spark, sf):
    pages = read(spark, sf, "pages").select(F.col("page_id").cast("string").alias("source"), F.lit(1).alias("page"), "html")
    _, blocks = html_pages.pages_to_units(pages, ARTICLE)
    return blocks.groupBy("source", "unit_id", "unit_kind").agg(
        F.count("*").alias("n_blocks"), F.sum(T.run_count(F.col("text"), T.LATIN_WORD).cast("bigint")).alias("words")
    )


def stream_folder(spark) -> str:
    """A new folder for one stream run, inside the checkpoint folder the session names."""
    return f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"


def event_batches(spark, sf, parts: int = 3, closing_days: int | None = None):
    """The events as a bounded file stream, its folder, and what adds them to it, one micro-batch after the other, cut by time.

    With ``closing_days`` the last one holds one row without user, so many days after the newest
    event: it moves the watermark, so that everything that waits is closed.
    """
    events, root = read(spark, sf, "events"), stream_folder(spark)
    first, last = events.agg(F.min("ts").cast("timestamp"), F.max("ts").cast("timestamp")).first()
    cut = F.least(F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(first))) * parts / F.greatest(F.unix_micros(F.lit(last)) - F.unix_micros(F.lit(first)), F.lit(1))), F.lit(parts - 1))
    batches = [events.filter(cut == i) for i in range(parts)]
    if closing_days is not None:
        late = {"ts": F.lit(last + datetime.timedelta(days=closing_days)) if last else F.lit(None)}
        nobody = [late.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema]
        batches.append(spark.range(1).select(*nobody).coalesce(1))
    batches[0].limit(0).write.parquet(f"{root}/events")
    return spark.readStream.schema(events.schema).parquet(f"{root}/events"), root, batches


def run_batches(writer, root, batches):
    """Give a stream its batches one by one: however many files a batch has, it is one micro-batch."""
    for batch in batches:
        batch.write.mode("append").parquet(f"{root}/events")
        streams.run_available(writer, f"{root}/log")


def stream_matches(spark, sf):
    """Users recite the document of their number: every event speaks a few of its words, views are interim hypotheses."""
    cut = kept(stream_docs(spark, sf).withColumn("body", stream_words(F.col("body"))))
    placed = kept(follow.placed_units(cut, "unit_id", lambda words: words))
    users = read(spark, sf, "events").select("user_id").distinct()
    words = kept(placed.select(F.col("unit_id").alias("user_id"), "text_slug", F.col("tokens").alias("words")).join(users, "user_id"))
    events, root, batches = event_batches(spark, sf)
    view = F.col("event_type") == "view"
    said = F.slice("words", (F.col("event_id") * 13 % F.size("words") + 1).cast("int"), F.when(view, 5).otherwise(8))
    spoken = events.join(words, "user_id").select(
        F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
        F.array_join(said, " ").alias("transcript"), (~view).alias("is_final"),
    )
    sessions = kept(words.select(F.col("user_id").cast("string").alias("session_id"), "text_slug"))
    index = follow.unit_index(placed, stored=True)
    writer = streams.match_stream(spoken, sessions, index, root, tokens=T.space_tokens, idle_minutes=10**7)
    run_batches(writer, root, batches)
    found = streams.matches_of(spark, root, placed)
    return found.select(F.col("session_id").cast("bigint").alias("user_id"), F.col("seq").alias("event_id"), "unit_id", "start", "end", F.round("score", 6).alias("score"), "is_local")


def stream_latest(spark, sf):
    """Newest event per user and type; where that is one of value 0 to 1, the key counts as deleted."""
    keys, order = ["user_id", "event_type"], ["ts", "event_id"]
    stream, root, batches = event_batches(spark, sf)
    events = stream.select("user_id", "event_type", "event_id", "ts", (F.col("value") < 1).alias("gone"))
    run_batches(streams.latest_stream(events, keys, order, f"{root}/rows"), root, batches)
    return streams.latest_rows(spark, f"{root}/rows", keys, order, events.schema, "gone").drop("ts", "gone")


def stream_follow(spark, sf):
    """Event types heard per user as a stream of final hypotheses: the buffer after every event."""
    stream, root, batches = event_batches(spark, sf)
    events = stream.select(
        F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("event_type").alias("transcript"),
        F.lit(True).alias("is_final"),
    )
    run_batches(streams.heard_writer(events, root, tokens=T.space_tokens, idle_minutes=10**7), root, batches)
    return streams.heard_of(spark, root).select(
        F.col("session_id").cast("bigint").alias("user_id"), F.col("seq").alias("event_id"), F.size("heard").alias("n_buffered"),
        F.md5(F.array_join("heard", ",").cast("binary")).alias("buffer_md5"),
    )


def stream_debounced(spark, sf):
    """Events of a user that no other one follows within six hours, the newest included, from the stream."""
    stream, root, batches = event_batches(spark, sf, closing_days=2)
    events = stream.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    closed = streams.debounce_stream(events, ["user_id"], "ts", "event_id", gap_ms=6 * 3_600_000)
    run_batches(streams.into_folder(closed, f"{root}/rows"), root, batches)
    return spark.read.schema(closed.schema).parquet(f"{root}/rows").filter("user_id IS NOT NULL").select("user_id", "event_id")


SQL_BODY = """b AS (SELECT lang AS text_slug, doc_id AS unit_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), ' ') AS body FROM documents)"""


def _sql_tidy(c: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '{SQL_SPACE}+', ' ', 'g'), '[‘’\"]', '', 'g'), '^{SQL_SPACE}+', ''), '{SQL_SPACE}+$', '')"


SQL_GLOSS = (
    f"WITH {SQL_BODY}, m AS ("
    + " UNION ALL ".join(
        rf"""SELECT text_slug, unit_id, {i} AS o, '{rule}' AS rule, CAST({score} AS DOUBLE) AS score, i, {_sql_tidy('w[i]')} AS whole, {_sql_tidy('t[i]')} AS term
        FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM (SELECT text_slug, unit_id, regexp_extract_all(body, '{p}') AS w,
        regexp_extract_all(body, '{p}', {g}) AS t FROM b))"""
        for i, (rule, p, g, score) in enumerate(LATIN_PATTERNS)
    )
    + """), best AS (SELECT text_slug, term, unit_id, arg_max({'s': substr(whole, 1, 220), 'r': rule, 'c': score}, score * 1e9 - o * 1e6 - i) AS x
      FROM m WHERE length(term) BETWEEN 3 AND 30 GROUP BY 1, 2, 3),
    glosses AS (SELECT text_slug, term, unit_id, x.s AS snippet, x.r AS rule, x.c AS score,
      CAST(row_number() OVER (PARTITION BY text_slug, term ORDER BY x.c DESC, unit_id) AS INTEGER) AS rank FROM best QUALIFY rank <= 10)"""
)
SQL_LABELS = """l AS (SELECT lang AS text_slug, labels.* FROM labels JOIN documents USING (doc_id)),
  e AS (SELECT text_slug, CAST(doc_id AS VARCHAR) AS key, 'en' AS language, 'quality ' || quality AS text, CASE WHEN toxic = 1 THEN 'draft' ELSE 'main' END AS source_id, doc_id AS s FROM l
    UNION ALL SELECT text_slug, CAST(doc_id AS VARCHAR), 'ml', 'quality ' || quality, CASE WHEN toxic = 1 THEN 'draft' ELSE 'main' END, doc_id FROM l WHERE quality = 1
    UNION ALL SELECT text_slug, CAST(doc_id AS VARCHAR), 'en', 'second opinion', 'other', doc_id + 1 FROM l WHERE quality = 0)"""
SQL_FIRST = rf"""fb AS (SELECT lang AS text_slug, doc_id, list_filter(string_split(text, chr(10))[2:], lambda x: regexp_replace(x, '{SQL_SPACE}+', '', 'g') <> '')[1] AS f FROM documents),
  ft AS (SELECT text_slug, doc_id, substr(f, 1, 600) || CASE WHEN length(f) > 600 THEN '…' ELSE '' END AS t FROM fb)"""
SQL_MEANINGS = f"""WITH {SQL_LABELS}, {SQL_FIRST},
  a AS (SELECT * FROM e UNION ALL SELECT text_slug, CAST(doc_id AS VARCHAR), 'en', t, 'prose-derived', 0 FROM ft
    WHERE t IS NOT NULL AND CAST(doc_id AS VARCHAR) NOT IN (SELECT key FROM e)),
  m AS (SELECT text_slug, key, language, text, source_id, row_number() OVER (PARTITION BY text_slug, key ORDER BY
    CASE WHEN source_id = 'main' THEN 0 ELSE 1 END, CASE WHEN source_id = 'draft' THEN 1 ELSE 0 END,
    CASE WHEN language = 'en' THEN 0 ELSE 1 END, s) - 1 AS seq FROM a)"""
SQL_TRIM = rf"regexp_replace(regexp_replace(x, '^{SQL_SPACE}+', ''), '{SQL_SPACE}+$', '')"
SQL_CAPPED = f"""cb AS (SELECT lang AS text_slug, doc_id AS unit_id, string_split(text, chr(10))[1] AS root,
  list_filter(list_transform(string_split(text, chr(10))[2:], lambda x: {{'k': CASE WHEN length(x) >= 400 THEN 'long' WHEN length(x) >= 80 THEN 'mid' ELSE 'short' END,
    't': {SQL_TRIM}}}), lambda x: x.t <> '') AS bl FROM documents)"""
SQL_PIECES = r"""p AS (SELECT 'u' || user_id AS dir_slug, CASE WHEN event_type = 'error' THEN 'other' ELSE 'u' || user_id END AS slug,
  strftime(ts, 'result-%Y%m%d%H') AS file, event_id AS unit_pos, CASE WHEN value < 1 THEN '' ELSE event_type END AS unit_id, event_type AS key,
  CASE WHEN event_type = 'signup' THEN regexp_extract(props, ': (\d+)', 1) ELSE props END AS text FROM events),
  j AS (SELECT *, CASE WHEN slug <> dir_slug THEN 'slug mismatch' WHEN unit_id = '' THEN 'missing id' WHEN length(text) < 2 THEN 'no text' END AS reason FROM p)"""
SQL_REFS = r"""WITH c AS (SELECT o_custkey AS t, o_orderkey AS ch, day(o_orderdate) AS co, CASE WHEN o_orderpriority <> '1-URGENT' THEN quarter(o_orderdate) END AS po FROM orders),
  u AS (SELECT l_orderkey AS ch, l_linenumber AS o, min(l_partkey) AS unit FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2),
  ev AS (SELECT event_id, user_id, event_type, day(ts) AS d, CAST(regexp_extract(props, ': (\d+)', 1) AS INTEGER) AS k FROM events),
  r AS (SELECT event_id, user_id AS t, event_type, CASE event_type WHEN 'click' THEN 3 WHEN 'signup' THEN 1 WHEN 'error' THEN 0 ELSE 2 END AS n,
    k % 4 + 1 AS p, d, k % 7 + 1 AS leaf FROM ev),
  ch1 AS (SELECT t, min(ch) AS ch FROM c GROUP BY 1), ch2 AS (SELECT t, co, min(ch) FILTER (po IS NULL) AS a, min(ch) AS b FROM c GROUP BY 1, 2),
  ch3 AS (SELECT t, po, co, min(ch) AS ch FROM c GROUP BY 1, 2, 3),
  x AS (SELECT event_id, n, CASE n WHEN 1 THEN u1.unit WHEN 2 THEN coalesce(u2.unit, u2b.unit) WHEN 3 THEN u3.unit END AS unit FROM r
    LEFT JOIN ch1 ON ch1.t = r.t LEFT JOIN u u1 ON u1.ch = ch1.ch AND u1.o = leaf
    LEFT JOIN ch2 ON ch2.t = r.t AND ch2.co = d LEFT JOIN u u2 ON u2.ch = ch2.a AND u2.o = leaf LEFT JOIN u u2b ON u2b.ch = ch2.b AND u2b.o = leaf
    LEFT JOIN ch3 ON ch3.t = r.t AND ch3.po = p AND ch3.co = d LEFT JOIN u u3 ON u3.ch = ch3.ch AND u3.o = leaf)
SELECT event_id AS ref_id, CASE WHEN n = 0 THEN 'parse' WHEN unit IS NULL THEN 'no-match' ELSE 'ok' END AS status, coalesce(unit, -1) AS unit_id FROM x"""
SQL_REFS_IN_PARENT = SQL_REFS[: SQL_REFS.rindex("SELECT event_id AS ref_id")] + """, ci AS (SELECT t, po, ch, row_number() OVER (PARTITION BY t, po ORDER BY ch) AS oip FROM c WHERE po IS NOT NULL AND po <> 0),
  y AS (SELECT x.event_id, x.n, x.unit, u4.unit AS other FROM x LEFT JOIN r r4 ON r4.event_id = x.event_id AND r4.n = 3 LEFT JOIN ci ON ci.t = r4.t AND ci.po = r4.p AND ci.oip = r4.d
    LEFT JOIN u u4 ON u4.ch = ci.ch AND u4.o = r4.leaf)
SELECT event_id AS ref_id, CASE WHEN n = 0 THEN 'parse' WHEN coalesce(unit, other) IS NULL THEN 'no-match' ELSE 'ok' END AS status, coalesce(unit, other, -1) AS unit_id,
  CASE WHEN n <> 3 OR coalesce(unit, other) IS NULL THEN '' WHEN unit IS NULL THEN 'in parent' ELSE 'chapter' END AS numbering FROM y"""
SQL_LATEST = """latest AS (SELECT user_id, event_type, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value, epoch_us(max(ts)) AS ts FROM events GROUP BY 1, 2),
  pos AS (SELECT user_id, event_type, event_id, ts FROM latest WHERE value >= 5)"""
SQL_STREAM = r"""tk AS (SELECT lang AS text_slug, doc_id AS unit_id, regexp_extract_all(lower(text), '\p{L}+') AS w FROM documents),
  ts0 AS (SELECT text_slug, unit_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS token FROM tk),
  tok AS (SELECT text_slug, unit_id, i - 1 AS unit_offset, token, row_number() OVER (PARTITION BY text_slug ORDER BY unit_id, i) - 1 AS pos FROM ts0)"""


def sql_windows(hint: str, threshold: float, near: int) -> str:
    return rf"""WITH {SQL_STREAM}, lens AS (SELECT text_slug, count(*) AS len FROM tok GROUP BY 1),
  g AS (SELECT text_slug, pos, token || lead(token, 1) OVER w || lead(token, 2) OVER w AS gram FROM tok WINDOW w AS (PARTITION BY text_slug ORDER BY pos)),
  h0 AS (SELECT item_id, regexp_extract_all(lower(text), '\p{{L}}+') AS w FROM benchmark),
  h1 AS (SELECT item_id, least(greatest(len(w), 4), 14) AS win, w[greatest(len(w) - least(greatest(len(w), 4), 14), 0) + 1:] AS hw FROM h0 WHERE len(w) > 0),
  h2 AS (SELECT item_id, win, CASE WHEN len(hw) < 3 THEN [array_to_string(hw, '')] ELSE list_transform(range(1, len(hw) - 1), lambda i: hw[i] || hw[i + 1] || hw[i + 2]) END AS hg FROM h1),
  q AS (SELECT item_id, win, len(hg) + win - 2 AS total, gram, count(*) AS cq FROM (SELECT item_id, win, hg, unnest(hg) AS gram FROM h2) GROUP BY ALL),
  hit AS (SELECT item_id, text_slug, win, total, pos, gram, cq FROM q JOIN g USING (gram)),
  st AS (SELECT item_id, h.text_slug, win, total, gram, cq, unnest(range(greatest(pos - (win - 3), 0), least(pos, len - win) + 1)) AS start FROM hit h JOIN lens USING (text_slug)),
  sc AS (SELECT item_id, text_slug, win, start, total, sum(hits) AS hits FROM (SELECT item_id, text_slug, win, total, start, gram, least(count(*), cq) AS hits FROM st
    GROUP BY item_id, text_slug, win, total, start, gram, cq) GROUP BY ALL),
  f AS (SELECT *, 2.0 * hits / total AS score, coalesce(start >= {hint} - {near} / 2 AND start + win <= {hint} + {near} + 1, false) AS is_local FROM sc)
SELECT item_id AS utt_id, text_slug, start, start + win AS "end", round(CAST(score AS DOUBLE), 6) AS score, is_local FROM f WHERE score >= {threshold}
QUALIFY row_number() OVER (PARTITION BY item_id, text_slug ORDER BY is_local DESC, score DESC, start) = 1"""


SQL_MATCHES = rf"""WITH RECURSIVE {SQL_STREAM}, lens AS (SELECT text_slug, count(*) AS len FROM tok GROUP BY 1),
  g AS (SELECT text_slug, pos, token || lead(token, 1) OVER w || lead(token, 2) OVER w AS gram FROM tok WINDOW w AS (PARTITION BY text_slug ORDER BY pos)),
  ev AS (SELECT user_id, event_id, text_slug, event_type <> 'view' AS fin, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
    w[event_id * 13 % len(w) + 1 : event_id * 13 % len(w) + CASE WHEN event_type = 'view' THEN 5 ELSE 8 END] AS new FROM events JOIN tk ON unit_id = user_id WHERE len(w) > 0),
  buf AS (SELECT user_id, n, new AS b FROM ev WHERE n = 1 UNION ALL
    SELECT e.user_id, e.n, (CASE WHEN fin THEN list_concat(b, new) ELSE list_concat(b[1:greatest(len(b) - len(new), 0)], new) END)[-80:] FROM buf JOIN ev e ON e.user_id = buf.user_id AND e.n = buf.n + 1),
  h1 AS (SELECT user_id, n, text_slug, least(greatest(len(b), 4), 14) AS win, b[greatest(len(b) - least(greatest(len(b), 4), 14), 0) + 1:] AS hw FROM buf JOIN ev USING (user_id, n)),
  h2 AS (SELECT user_id, n, text_slug, win, CASE WHEN len(hw) < 3 THEN [array_to_string(hw, '')] ELSE list_transform(range(1, len(hw) - 1), lambda i: hw[i] || hw[i + 1] || hw[i + 2]) END AS hg FROM h1),
  q AS (SELECT user_id, n, text_slug, win, len(hg) + win - 2 AS total, gram, count(*) AS cq FROM (SELECT *, unnest(hg) AS gram FROM h2) GROUP BY ALL),
  st AS (SELECT user_id, n, win, total, gram, cq, unnest(range(greatest(pos - (win - 3), 0), least(pos, len - win) + 1)) AS start FROM q JOIN g USING (text_slug, gram) JOIN lens USING (text_slug)),
  sc AS (SELECT user_id, n, win, start, total, sum(hits) AS hits FROM (SELECT user_id, n, win, total, start, gram, least(count(*), cq) AS hits FROM st GROUP BY user_id, n, win, total, start, gram, cq) GROUP BY ALL),
  c AS (SELECT user_id, n, list({{'s': start, 'w': win, 'x': 2.0 * hits / total}} ORDER BY 2.0 * hits / total DESC, start) AS c FROM sc WHERE 2.0 * hits / total >= 0.25 GROUP BY 1, 2),
  rows AS (SELECT ev.user_id, ev.n, event_id, text_slug, c.c FROM ev LEFT JOIN c USING (user_id, n)),
  walk AS (SELECT user_id, n, event_id, text_slug, c[1] AS m, false AS is_local, c[1].s AS hint FROM rows WHERE n = 1 UNION ALL
    SELECT user_id, n, event_id, text_slug, coalesce(near, c[1]), near IS NOT NULL, coalesce(near.s, c[1].s, hint) FROM (
      SELECT r.*, hint, CASE WHEN hint IS NOT NULL THEN list_filter(r.c, lambda z: z.s >= hint - 40 AND z.s + z.w <= hint + 81)[1] END AS near FROM walk JOIN rows r ON r.user_id = walk.user_id AND r.n = walk.n + 1))
SELECT user_id, event_id, unit_id, m.s AS start, m.s + m.w AS "end", round(CAST(m.x AS DOUBLE), 6) AS score, is_local FROM walk JOIN tok ON tok.text_slug = walk.text_slug AND tok.pos = m.s WHERE m IS NOT NULL"""


SQL_UPSERT = """SELECT * FROM supplier WHERE s_nationkey >= 10 UNION ALL
  SELECT s_suppkey, s_name, s_nationkey, round(s_acctbal + 1000, 2) FROM supplier WHERE s_nationkey < 10"""

QUERIES = {
    "glosses_top10": (glosses_top, SQL_GLOSS + " SELECT * FROM glosses"),
    "gloss_lookup": (
        gloss_lookup,
        SQL_GLOSS
        + r""", w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\p{L}+')) AS term FROM benchmark),
        t AS (SELECT s AS text_slug, term, regexp_replace(term, '[sen]+$', '') AS stem FROM w, (SELECT DISTINCT text_slug AS s FROM glosses) v),
        k AS (SELECT * FROM glosses WHERE rank <= 5), x AS (SELECT t.text_slug, t.term, unit_id, rule, score, rank FROM t JOIN k USING (text_slug, term))
        SELECT * FROM x UNION ALL SELECT t.text_slug, t.term, k.unit_id, k.rule, k.score, k.rank FROM t JOIN k ON t.text_slug = k.text_slug AND t.stem = k.term
        WHERE t.stem <> t.term AND length(t.stem) >= 3 AND (t.text_slug, t.term) NOT IN (SELECT (text_slug, term) FROM x)""",
    ),
    "token_glosses": (
        token_glosses,
        SQL_GLOSS
        + r""", w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS token FROM benchmark),
        r(seq, suffix) AS (VALUES (1, 'ing'), (2, 'ed'), (3, 's')),
        c AS (SELECT token, token AS term, -1 AS seq FROM w UNION ALL SELECT token, substr(token, 1, length(token) - length(suffix)), seq
          FROM w JOIN r ON ends_with(token, suffix) AND length(token) > length(suffix)),
        k AS (SELECT * FROM glosses WHERE rank <= 5), f AS (SELECT token, seq, k.* FROM c JOIN k USING (term)),
        o AS (SELECT text_slug, token, unit_id, snippet, arg_min({'r': rule, 's': score, 'q': seq, 'k': rank}, seq * 100 + rank) AS g FROM f GROUP BY 1, 2, 3, 4)
        SELECT text_slug, token, unit_id, g.r AS rule, g.s AS score, CAST(row_number() OVER (PARTITION BY text_slug, token ORDER BY g.s DESC, g.q, g.k, unit_id) AS INTEGER) AS rank
        FROM o QUALIFY rank <= 6""",
    ),
    "resolved_in_texts": (
        resolved_in_texts,
        f"""WITH layers AS ({RQ.QUERIES["resolve_layers"][1]}), glosses AS ({SQL_GLOSS} SELECT * FROM glosses WHERE rank <= 5),
        terms AS (WITH {RQ.SQL_BENCH}, {RQ.SQL_RULES}, {RQ.sql_lemmas("bench", "cand")}
          SELECT token, token AS term FROM bench UNION ALL SELECT token, lemma FROM cand),
        found AS (SELECT DISTINCT text_slug, token, unit_id, snippet FROM terms JOIN glosses USING (term)),
        defined AS (SELECT text_slug, token, least(count(*), 6) AS gloss FROM found GROUP BY 1, 2),
        asked AS (SELECT text_slug, token, gloss FROM defined UNION ALL SELECT DISTINCT '', token, 0 FROM terms),
        counts AS (SELECT token, count(*) FILTER (layer = 'direct') AS direct, count(*) FILTER (layer = 'inflection') AS inflection,
          count(*) FILTER (layer = 'compound') AS compound, count(*) FILTER (layer = 'fuzzy') AS fuzzy FROM layers GROUP BY 1)
        SELECT text_slug, token, coalesce(direct, 0) AS direct, coalesce(inflection, 0) AS inflection, coalesce(compound, 0) AS compound,
          coalesce(fuzzy, 0) AS fuzzy, gloss, coalesce(direct + inflection + compound + fuzzy, 0) + gloss > 0 AS resolved
        FROM asked LEFT JOIN counts USING (token)""",
    ),
    "sense_rerank": (
        sense_rerank,
        f"""WITH s AS (SELECT p_brand AS head, p_name AS sense, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS idx,
          count(*) OVER (PARTITION BY p_brand) AS n FROM part),
        pr(head, pref, i, np) AS (VALUES {_values([(h, p, i, len(ps)) for h, ps in PRIORS for i, p in enumerate(ps)])}),
        m AS (SELECT s.head, idx, sum(CASE WHEN contains(lower(sense), lower(pref)) THEN 1 - CAST(i AS DOUBLE) / np * 0.5 ELSE 0 END) / max(np) AS sc,
          min(i) FILTER (contains(lower(sense), lower(pref))) AS mi FROM s JOIN pr ON s.head = pr.head WHERE n > 1 GROUP BY 1, 2),
        j AS (SELECT s.head, s.idx, sense, round(coalesce(sc, 0), 6) AS score, coalesce(pref, '') AS matched FROM s
          LEFT JOIN m ON s.head = m.head AND s.idx = m.idx LEFT JOIN pr ON pr.head = m.head AND pr.i = m.mi)
        SELECT *, CAST(row_number() OVER (PARTITION BY head ORDER BY score DESC, idx) AS INTEGER) AS rank FROM j""",
    ),
    "lexicon_fold": (
        lexicon_fold,
        """SELECT p_brand AS head, list_reduce(list(p_name ORDER BY p_partkey), lambda a, y: CASE WHEN length(a) < 170
        THEN substr(a || ' · ' || y, 1, 300) || '…' ELSE a END) AS body FROM part GROUP BY 1""",
    ),
    "split_senses": (
        split_senses,
        """WITH f AS (SELECT p_brand AS head, list_reduce(list(p_name ORDER BY p_partkey), lambda a, y: CASE WHEN length(a) < 170
          THEN substr(a || ' · ' || y, 1, 300) || '…' ELSE a END) AS body FROM part GROUP BY 1),
        s AS (SELECT head, list_filter(list_transform(regexp_split_to_array(body, '\\s+·\\s+'), lambda x: trim(x)), lambda x: x <> '') AS l FROM f)
        SELECT head, CAST(unnest(range(0, len(l))) AS INTEGER) AS i, unnest(l) AS sense FROM s""".replace("\\\\", "\\"),
    ),
    "meanings_order": (meanings_order, SQL_MEANINGS + " SELECT text_slug, key, CAST(seq AS INTEGER) AS seq, language, md5(text) AS text_md5, source_id FROM m"),
    "meanings_first": (
        meanings_first,
        SQL_MEANINGS
        + """, f AS (SELECT text_slug, key, language, arg_min(source_id, seq) AS source_id FROM m GROUP BY 1, 2, 3)
        SELECT text_slug, language, source_id, count(*) AS keys FROM f GROUP BY 1, 2, 3""",
    ),
    "first_block_fallback": (first_block_fallback, f"WITH {SQL_FIRST} SELECT doc_id AS unit_id, coalesce(t, '') AS text FROM ft"),
    "truncate_blocks": (
        truncate_blocks,
        f"""WITH {SQL_CAPPED}, x AS (SELECT unit_id, bl, unnest(range(1, len(bl) + 1)) AS j FROM cb)
        SELECT unit_id, CAST(j - 1 AS INTEGER) AS i, bl[j].k AS kind, CAST(least(length(bl[j].t), 300) AS INTEGER) AS chars,
        length(bl[j].t) > 300 AS truncated, md5(substr(bl[j].t, 1, 300)) AS md5 FROM x""",
    ),
    "batches": (
        batches,
        f"""WITH {SQL_CAPPED}, r AS (SELECT text_slug, unit_id, len(bl) AS n_blocks, row_number() OVER (PARTITION BY text_slug ORDER BY unit_id) - 1 AS unit_pos,
          count(*) OVER (PARTITION BY text_slug) AS n FROM cb WHERE root <> '' OR len(bl) > 0)
        SELECT text_slug, unit_id, unit_pos, CAST(unit_pos // 8 AS INTEGER) AS batch_index, CAST(ceil(n / 8.0) AS INTEGER) AS total_batches,
        CAST(n_blocks AS INTEGER) AS n_blocks FROM r""",
    ),
    "ingest_last_wins": (
        ingest_last_wins,
        f"WITH {SQL_PIECES} SELECT slug, 'en' AS language, key, arg_max(text, unit_pos) AS text FROM j WHERE reason IS NULL GROUP BY slug, key",
    ),
    "ingest_rejects": (ingest_rejects, f"WITH {SQL_PIECES} SELECT dir_slug, reason, count(*) AS n FROM j WHERE reason IS NOT NULL GROUP BY 1, 2"),
    "resolve_refs": (resolve_refs, SQL_REFS),
    "resolve_refs_in_parent": (resolve_refs_in_parent, SQL_REFS_IN_PARENT),
    "describe_units": (
        describe_units,
        """SELECT CASE WHEN o_orderstatus <> 'P' THEN 'अध्याय ' || month(o_orderdate) || ' · ' ELSE '' END ||
          CASE o_orderstatus WHEN 'F' THEN 'वल्ली ' || o_custkey || ' · ' WHEN 'O' THEN 'book ' || o_custkey || ' · ' ELSE '' END ||
          CASE l_returnflag WHEN 'A' THEN 'मन्त्र ' WHEN 'N' THEN 'सूत्र ' ELSE 'line ' END || l_linenumber AS label, count(*) AS n
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
    ),
    "prefix_chapters": (
        prefix_chapters,
        r"""WITH c AS (SELECT DISTINCT lang, source, CAST(regexp_extract(source, '(\d+)', 1) AS INTEGER) AS o FROM documents)
        SELECT d.lang AS text_slug, d.source || '_' || d.doc_id AS unit_id, arg_min(c.source, c.o) AS chapter_id FROM documents d JOIN c
        ON d.lang = c.lang AND starts_with(d.source || '_' || d.doc_id, c.source) GROUP BY 1, 2""",
    ),
    "link_check": (link_check, "SELECT * FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')"),
    "link_report": (
        link_report,
        "SELECT count(*) AS checked, CAST(count_if(d.doc_id IS NULL) AS BIGINT) AS broken FROM labels l LEFT JOIN (SELECT * FROM documents WHERE lang = 'en') d USING (doc_id)",
    ),
    "gold_check": (
        gold_check,
        """WITH s AS (SELECT s_suppkey, s_acctbal FROM supplier UNION ALL SELECT s_suppkey, s_acctbal FROM supplier WHERE s_nationkey = 0)
        SELECT 'required field' AS rule, CAST(o_orderkey AS VARCHAR) AS subject FROM orders WHERE o_orderpriority LIKE '4%' OR o_orderstatus = 'P'
        UNION ALL SELECT 'unknown reviewer', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus <> 'F' AND o_custkey % 120 NOT IN (SELECT s_suppkey FROM supplier)
        UNION ALL SELECT 'unknown unit', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
        UNION ALL SELECT 'duplicate reviewer', CAST(s_suppkey AS VARCHAR) FROM s GROUP BY s_suppkey HAVING count(*) > 1
        UNION ALL SELECT 'specialisation', CAST(s_suppkey AS VARCHAR) FROM s WHERE NOT s_acctbal > 0""",
    ),
    "recent_history": (
        recent_history,
        """WITH o AS (SELECT user_id, props AS query, max(epoch_us(ts)) AS ts FROM events GROUP BY 1, 2)
        SELECT user_id, query, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, query) AS INTEGER) AS rank FROM o QUALIFY rank <= 12""",
    ),
    "latest_position": (latest_position, f"WITH {SQL_LATEST} SELECT user_id, event_type, event_id FROM pos"),
    "resume_list": (
        resume_list,
        f"""WITH {SQL_LATEST} SELECT user_id, event_type, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type) AS INTEGER) AS rank
        FROM pos WHERE event_type <> 'error' QUALIFY rank <= 4""",
    ),
    "bookmarks_newest": (bookmarks_newest, f"WITH {SQL_LATEST} SELECT user_id, event_type, event_id FROM pos ORDER BY ts DESC"),
    "debounced": (
        debounced,
        """SELECT user_id, event_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
        WHERE n IS NULL OR epoch_ms(n) - epoch_ms(ts) >= 6 * 3600000""",
    ),
    "catalog_upsert": (catalog_upsert, SQL_UPSERT),
    "source_merge": (source_merge, "SELECT s_suppkey AS id, CASE WHEN s_nationkey < 10 THEN 'old' ELSE 'new' END AS note FROM supplier"),
    "token_positions": (
        token_positions,
        f"""WITH {SQL_STREAM} SELECT text_slug, unit_id, min(pos) AS start, max(pos) AS last, count(*) AS n,
        CAST(sum(length(token) * (unit_offset + 1)) AS BIGINT) AS weighted FROM tok GROUP BY 1, 2""",
    ),
    "best_window": (best_window, f"SELECT utt_id, text_slug, start, \"end\", score FROM ({sql_windows('CAST(NULL AS BIGINT)', 0.25, 80)})"),
    "follow_neighbourhood": (follow_neighbourhood, sql_windows("item_id * 1000", 0.1, 20_000)),
    "stitch_pages": (
        stitch_pages,
        """WITH c AS (SELECT conv_id, min(turn) AS f, min(CASE WHEN length(text) < 40 THEN turn END) AS e FROM conversations GROUP BY 1),
        n AS (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM conversations),
        g AS (SELECT conv_id, min(turn + 1) AS g FROM n WHERE nx IS NULL OR nx > turn + 1 GROUP BY 1)
        SELECT conv_id AS source, turn AS page, CAST(CASE WHEN length(text) < 40 THEN 1 ELSE length(text) END AS INTEGER) AS chars
        FROM conversations JOIN c USING (conv_id) JOIN g USING (conv_id) WHERE turn = f OR turn < least(coalesce(e, g), g)""",
    ),
    "page_blocks": (
        page_blocks,
        r"""WITH a AS (SELECT CAST(page_id AS VARCHAR) AS source, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS t FROM pages),
        p AS (SELECT source, unnest(string_split(replace(t, '</p>', ''), '<p>')[2:]) AS x FROM a),
        c AS (SELECT source, trim(regexp_replace(replace(replace(replace(x, '<br>', chr(10)), '&quot;', '"'), '&amp;', '&'), '<[^>]+>', '', 'g')) AS x FROM p)
        SELECT source, 'C1_OUTRO1' AS unit_id, 'intro' AS unit_kind, count(*) AS n_blocks,
        CAST(sum(len(regexp_extract_all(x, '\p{L}+'))) AS BIGINT) AS words FROM c WHERE x <> '' GROUP BY 1""",
    ),
    "stream_matches": (stream_matches, SQL_MATCHES),
    "stream_latest": (
        stream_latest,
        """SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events)
        WHERE r = 1 AND value >= 1""",
    ),
    "stream_debounced": (
        stream_debounced,
        """SELECT user_id, event_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events)
        WHERE nx IS NULL OR epoch_ms(nx) - epoch_ms(ts) >= 6 * 3600000""",
    ),
    "stream_follow": (
        stream_follow,
        """WITH b AS (SELECT user_id, event_id, list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id
          ROWS BETWEEN 79 PRECEDING AND CURRENT ROW) AS buf FROM events)
        SELECT user_id, event_id, CAST(len(buf) AS INTEGER) AS n_buffered, md5(array_to_string(buf, ',')) AS buffer_md5 FROM b""",
    ),
}
