"""Scripts, syllables, labels, lexicon dumps, translation lines and manifests derived from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpuskit.functions import scripts as S
from corpuskit.functions import text as T
from corpuskit.functions.morph import morph_features
from corpuskit.operators import integrity, lexicon, meanings
from corpuskit.operators.freq import token_stream
from corpuskit.queries.tables import SQL_SPACE, SQL_VOCAB, doc_units, read, vocabulary
from corpuskit.plans import jobs
from corpuskit.queries.texts import SQL_CAPPED, SQL_MEANINGS, meaning_inputs
from corpuskit.session import checkpoint_folder, materialised
from corpuskit.sources import sinks
from corpuskit.sources.files import translation_lines


def words(spark, sf):
    """All words; the conversions run once per distinct word, letters outside the romanisation stay as they are."""
    return materialised(vocabulary(spark, sf).select("token"), "token")


def script_round_trip(spark, sf):
    """Every word read as a romanisation and written back."""
    return words(spark, sf).select("token", S.to_roman(S.from_roman(F.col("token"), "hk"), "hk").alias("back"))


def akshara_counts(spark, sf):
    """Syllables of every word in the canonical script."""
    return words(spark, sf).select("token", F.size(T.aksharas(S.from_roman(F.col("token"), "hk"))).alias("n_aksharas"))


def block_round_trip(spark, sf):
    """Canonical script to another script of the same layout and back."""
    native = S.from_roman(F.col("token"), "hk")
    back = S.to_roman(S.from_script(S.convert(native, "kannada"), "kannada"), "hk")
    return words(spark, sf).select("token", back.alias("back"))


def detect_scripts(spark, sf):
    words = read(spark, sf, "documents").select("lang", F.explode(T.space_tokens(F.col("text"))).alias("token"))
    return words.groupBy("lang", S.detect_script(F.col("token")).alias("script")).agg(F.count("*").alias("n"))


def lookup_words(spark, sf):
    """Tokens stripped of punctuation for the lookup."""
    words = read(spark, sf, "documents").select(F.explode(T.space_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return words.groupBy(T.clean_lookup_word(F.col("token")).alias("word")).agg(F.sum("n").alias("n"))


def morph_labels(spark, sf):
    """Labels put together from the line items, read back as features."""
    items = read(spark, sf, "lineitem")
    case = F.element_at(F.array(*[F.lit(c) for c in ("nom.", "acc.", "instr.", "dat.", "abl.", "gen.", "loc.")]), F.col("l_linenumber"))
    number = F.when(F.col("l_returnflag") == "A", "sg.").when(F.col("l_returnflag") == "N", "pl.").otherwise("")
    stem = F.when(F.col("l_linestatus") == "F", "a-stem").otherwise("fem.")
    out = items.select(F.concat_ws(" ", stem, case, number).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    m = morph_features(F.col("label"))
    return out.select(
        "label", "n", F.coalesce(m["vibhakti"], F.lit(-1)).alias("vibhakti"), F.coalesce(m["vacana"], F.lit("")).alias("vacana"), F.coalesce(m["linga"], F.lit("")).alias("linga")
    )


TENSES = (("perf.", "lit"), ("future", "lrt"), ("pres.", "lat"), ("impv.", "lot"), ("imperfect", "lan"), ("aor.", "lun"), ("opt.", "vidhi-lin"))


def verb_labels(spark, sf):
    """Verb labels put together from the line items, some without person or number."""
    items = read(spark, sf, "lineitem")
    tense = F.element_at(F.array(*[F.lit(t) for t, _ in TENSES]), F.col("l_linenumber"))
    person = F.element_at(F.array(*[F.lit(p) for p in ("1sg", "2 pl.", "3rd person", "")]), (F.col("l_orderkey") % 4 + 1).cast("int"))
    number = F.when(F.col("l_returnflag") == "A", "dual").when(F.col("l_returnflag") == "N", "plural").otherwise("")
    out = items.select(F.concat_ws(" ", tense, person, number).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    m = morph_features(F.col("label"))
    return out.select("label", "n", F.coalesce(m["lakara"], F.lit("")).alias("lakara"), F.coalesce(m["purusha"], F.lit(-1)).alias("purusha"), F.coalesce(m["vacana"], F.lit("")).alias("vacana"))


def lexicon_dump(spark, sf):
    """Parts written as tagged dump records, parsed, cleaned and folded per brand."""
    part = read(spark, sf, "part")
    record = F.concat(
        F.col("p_partkey"), F.lit("<pc>1<k1>"), F.col("p_brand"), F.lit("<k2>x\n<s>"), F.col("p_name"), F.lit("</s>¦  <ls>"), F.col("p_type"), F.lit("</ls>\n<LEND>\nrest")
    )
    raw = part.select(F.col("p_partkey").alias("rec"), record.alias("value"))
    same = lambda c: c
    return lexicon.build_lexicon(raw, "parts", False, 200, same, same).select("dict_id", "head", "iast", "en")


def translation_tsv(spark, sf):
    """Events written as tab-separated lines per user; the last line of a key wins."""
    events = read(spark, sf, "events")
    line = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("# "), "props"))
        .when(F.col("value") < 2, F.lit("no tab"))
        .otherwise(F.concat("event_type", F.lit(" \t"), "props", F.lit("\tx  ")))
    )
    raw = events.select(
        F.col("user_id").alias("text_slug"), F.lit("s").alias("source_id"), F.lit("en").alias("language"), F.col("event_id").alias("line_no"), line.alias("value")
    )
    return translation_lines(raw).select("text_slug", "key", "text", "input_seq")


def meanings_for_units(spark, sf):
    units, entries, sources = meaning_inputs(spark, sf)
    slots = meanings.meanings_for_units(units, meanings.build_meanings(units, entries, sources))
    return slots.groupBy("text_slug", "unit_id").agg(F.count("*").alias("rows"), F.count("text").alias("entries"))


def corpus_tables(spark, sf):
    """Documents as units of chapters, and the chapters: sources of a language."""
    units = doc_units(spark, sf).select(
        "text_slug", "chapter_id", F.col("unit_id").alias("unit_pos"), F.col("unit_id").cast("string").alias("unit_id"), "kind",
        F.col("unit_id").alias("ordinal"), "root", "blocks",
    )
    chapters = units.select("text_slug", "chapter_id").distinct().select(
        "*", F.regexp_extract("chapter_id", r"(\d+)", 1).cast("int").alias("chapter_ord"), F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("string").alias("parent_title"), F.lit(None).cast("int").alias("parent_ord"), F.lit("pada").alias("chapter_kind"),
    )
    return units, chapters


def manifests(spark, sf):
    """Texts with the number of their chapters and units, and the chunked flag."""
    return sinks.split_manifest(*corpus_tables(spark, sf))[0].select("text_slug", "chapters", "units", "chunked")


def chunk_check(spark, sf):
    """Chapters without a published line of a labelled document."""
    units, chapters = corpus_tables(spark, sf)
    labelled = units.join(read(spark, sf, "labels").select(F.col("doc_id").alias("unit_pos")), "unit_pos", "left_semi")
    lines = sinks.split_manifest(labelled, chapters)[2].filter("unit_pos IS NOT NULL")
    return integrity.dangling(chapters, lines, ["text_slug", "chapter_id"]).select("text_slug", "chapter_id")


def token_list_sorted(spark, sf):
    """The token list in code-point order."""
    docs = read(spark, sf, "documents")
    words = token_stream(docs, F.lower("text"), T.LATIN_WORD).groupBy("token").agg(F.count("*").alias("freq"))
    return words.filter("freq >= 2").orderBy("token")


def writer_totals(spark, sf):
    """Totals that the writers took while they published the documents, and the rows found in what they wrote."""
    root = f"{checkpoint_folder(spark)}/publish-{uuid.uuid4().hex}"
    totals = jobs.publish(*corpus_tables(spark, sf), root)
    totals["tokens"] = sinks.write_token_list(token_list_sorted(spark, sf), f"{root}/tokens")
    batches = meanings.prepare_batches(doc_units(spark, sf), "unit_id")
    totals["batches"] = sinks.write_batches(batches, f"{root}/batches")
    found = None
    for name, total in totals.items():
        size = next((total[k] for k in ("bytes", "occurrences", "blocks") if k in total), None)
        back = {"chunks": spark.read.text, "batches": spark.read.schema(batches.schema).json}.get(name, spark.read.option("recursiveFileLookup", "true").parquet)(f"{root}/{name}")
        row = back.agg(F.count(F.lit(1)).alias("found")).select(F.lit(name).alias("writer"), F.lit(total["rows"]).cast("bigint").alias("written"), "found", F.lit(size).cast("bigint").alias("size"))
        found = row if found is None else found.unionByName(row)
    return found.select("writer", "written", "found", F.when(F.col("writer") != "chunks", F.coalesce("size", F.lit(-1))).otherwise((F.col("size") > 0).cast("bigint")).alias("size"))


SQL_WORDS = f"WITH {SQL_VOCAB}, w AS (SELECT token FROM vocab)"

QUERIES = {
    "script_round_trip": (script_round_trip, f"{SQL_WORDS} SELECT token, token AS back FROM w"),
    "block_round_trip": (block_round_trip, f"{SQL_WORDS} SELECT token, token AS back FROM w"),
    "akshara_counts": (
        akshara_counts,
        f"""{SQL_WORDS} SELECT token, CAST(len(regexp_extract_all(token,
        '[bcdghjklmnprstvyz]*(?:ai|au|[aeiou])|[bcdghjklmnprstvyz]+|[^abcdeghijklmnoprstuvyz]')) AS INTEGER) AS n_aksharas FROM w""",
    ),
    "detect_scripts": (
        detect_scripts,
        rf"""WITH t AS (SELECT lang, unnest(list_filter(regexp_split_to_array(text, '{SQL_SPACE}+'), lambda x: x <> '')) AS token FROM documents)
        SELECT lang, CASE WHEN regexp_matches(token, '(?i)[āīūṛṝḷḹṃḥṅñṭḍṇśṣ]') THEN 'iast' WHEN regexp_matches(token, '[A-Z]{{2,}}|\.') THEN 'itrans' ELSE 'hk' END AS script,
        count(*) AS n FROM t GROUP BY 1, 2""",
    ),
    "lookup_words": (
        lookup_words,
        rf"""WITH t AS (SELECT unnest(list_filter(regexp_split_to_array(text, '{SQL_SPACE}+'), lambda x: x <> '')) AS token FROM documents)
        SELECT regexp_replace(token, '[{SQL_SPACE[1:-1]}\x{{0964}}\x{{0965}},.;:?!«»"''()\[\]]+', '', 'g') AS word, count(*) AS n FROM t GROUP BY 1""",
    ),
    "morph_labels": (
        morph_labels,
        """WITH l AS (SELECT CASE l_linestatus WHEN 'F' THEN 'a-stem' ELSE 'fem.' END || ' ' || ['nom.', 'acc.', 'instr.', 'dat.', 'abl.', 'gen.', 'loc.'][l_linenumber]
            || ' ' || CASE l_returnflag WHEN 'A' THEN 'sg.' WHEN 'N' THEN 'pl.' ELSE '' END AS label, l_linenumber AS v,
          CASE l_returnflag WHEN 'A' THEN 'eka' WHEN 'N' THEN 'bahu' ELSE '' END AS c, CASE l_linestatus WHEN 'F' THEN 'm' ELSE 'f' END AS g FROM lineitem)
        SELECT label, count(*) AS n, CAST(CASE WHEN c = '' THEN -1 ELSE v END AS INTEGER) AS vibhakti, c AS vacana, CASE WHEN c = '' THEN '' ELSE g END AS linga
        FROM l GROUP BY label, v, c, g""",
    ),
    "verb_labels": (
        verb_labels,
        f"""WITH t(i, word, lakara) AS (VALUES {", ".join(f"({i}, '{w}', '{v}')" for i, (w, v) in enumerate(TENSES, 1))}),
        x AS (SELECT *, l_orderkey % 4 AS k, CASE l_returnflag WHEN 'A' THEN 'dual' WHEN 'N' THEN 'plural' ELSE '' END AS number FROM lineitem JOIN t ON i = l_linenumber),
        l AS (SELECT word || ' ' || ['1sg', '2 pl.', '3rd person', ''][k + 1] || ' ' || number AS label, lakara, CASE k WHEN 3 THEN NULL ELSE k + 1 END AS purusha,
          CASE WHEN k = 0 THEN 'eka' WHEN number = 'dual' THEN 'dvi' WHEN k = 1 OR number = 'plural' THEN 'bahu' END AS vacana FROM x),
        g AS (SELECT label, count(*) AS n, any_value(lakara) AS lakara, any_value(purusha) AS purusha, any_value(vacana) AS vacana FROM l GROUP BY label)
        SELECT label, n, CASE WHEN purusha IS NULL OR vacana IS NULL THEN '' ELSE lakara END AS lakara,
          CAST(CASE WHEN purusha IS NULL OR vacana IS NULL THEN -1 ELSE purusha END AS INTEGER) AS purusha,
          CASE WHEN purusha IS NULL OR vacana IS NULL THEN '' ELSE vacana END AS vacana FROM g""",
    ),
    "lexicon_dump": (
        lexicon_dump,
        """SELECT 'parts' AS dict_id, p_brand AS head, p_brand AS iast, list_reduce(list(p_name || ' ' || p_type ORDER BY p_partkey), lambda a, y: CASE WHEN length(a) < 170
        THEN substr(a || ' · ' || y, 1, 300) || '…' ELSE a END) AS en FROM part GROUP BY p_brand""",
    ),
    "translation_tsv": (
        translation_tsv,
        """SELECT user_id AS text_slug, event_type AS key, arg_max(props, event_id) || chr(9) || 'x' AS text, max(event_id) AS input_seq
        FROM events WHERE event_type <> 'error' AND value >= 2 GROUP BY 1, 2""",
    ),
    "meanings_for_units": (
        meanings_for_units,
        SQL_MEANINGS
        + """, u AS (SELECT lang AS text_slug, CAST(doc_id AS VARCHAR) AS unit_id, len(string_split(text, chr(10))) AS slots FROM documents),
        c AS (SELECT text_slug, key, count(*) AS n FROM m GROUP BY 1, 2)
        SELECT u.text_slug, unit_id, slots - 1 + greatest(coalesce(n, 0), 1) AS rows, coalesce(n, 0) AS entries FROM u
        LEFT JOIN c ON u.text_slug = c.text_slug AND unit_id = key""",
    ),
    "manifests": (
        manifests,
        """SELECT lang AS text_slug, count(DISTINCT source) AS chapters, count(*) AS units, sum(strlen(text)) >= 102400 AND count(DISTINCT source) > 1 AS chunked
        FROM documents GROUP BY lang""",
    ),
    "chunk_check": (
        chunk_check,
        "SELECT DISTINCT lang AS text_slug, source AS chapter_id FROM documents WHERE (lang, source) NOT IN (SELECT (lang, source) FROM documents JOIN labels USING (doc_id))",
    ),
    "writer_totals": (
        writer_totals,
        f"""WITH {SQL_VOCAB}, {SQL_CAPPED}, ch AS (SELECT DISTINCT lang, source FROM documents), x AS (
          SELECT 'chunks' AS writer, (SELECT count(*) FROM documents) + (SELECT count(*) FROM ch) AS written, 1 AS size
          UNION ALL SELECT 'stubs', count(*), -1 FROM ch UNION ALL SELECT 'manifests', count(DISTINCT lang), -1 FROM ch UNION ALL SELECT 'catalog', count(DISTINCT lang), -1 FROM ch
          UNION ALL SELECT 'tokens', count(*), sum(freq) FROM vocab WHERE freq >= 2
          UNION ALL SELECT 'batches', count(*), sum(len(bl)) FROM cb WHERE root <> '' OR len(bl) > 0)
        SELECT writer, written, written AS found, CAST(size AS BIGINT) AS size FROM x""",
    ),
    "token_list_sorted": (
        token_list_sorted,
        f"WITH {SQL_VOCAB} SELECT token, freq FROM vocab WHERE freq >= 2 ORDER BY token",
    ),
}
