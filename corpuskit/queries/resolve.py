"""Vocabulary resolution over the documents: layers, coverage, reduction, splits, nearest heads."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.operators import compound as C
from corpuskit.operators import resolve as R
from corpuskit.operators.similarity import nearest_heads, prefix_lookup
from corpuskit.queries.tables import SQL_LEXICON, SQL_VOCAB, lexicon, read, vocabulary
from corpuskit.functions import text as T
from corpuskit.operators.freq import token_stream
from corpuskit.session import materialised

# Rule tables for the Latin-script test tables, passed as parameters.
SUFFIXES = [
    ("ing", "", "participle"),
    ("ed", "", "past"),
    ("tion", "te", "noun of action"),
    ("tion", "", "noun of action"),
    ("ly", "", "adverb"),
    ("mente", "", "adverb"),
    ("ment", "", "noun of result"),
    ("ung", "en", "noun of action"),
    ("eux", "", "adjective"),
    ("er", "", "agent"),
    ("es", "", "plural"),
    ("s", "", "plural"),
]
VARIANTS = [("e", "a", "final vowel", 3), ("ou", "o", "final diphthong", 1)]
MANUAL = [("was", "be", "past sg.", "to be"), ("is", "be", "pres. sg.", "to be"), ("are", "be", "pres. pl.", None), ("una", "un", "f. sg.", None)]
OPTIONS = {"segment": C.characters, "max_parts": 5}


def rules(spark):
    return R.rule_table(spark, SUFFIXES, VARIANTS)


def manual(spark):
    return spark.createDataFrame(MANUAL, "form string, lemma string, label string, gloss string")


def lexicons(spark, sf):
    return materialised(lexicon(spark, sf), "head")


def vocab(spark, sf):
    return materialised(vocabulary(spark, sf), "token")


def lemma_candidates(spark, sf):
    cands = R.lemma_candidates(vocabulary(spark, sf), manual(spark), rules(spark))
    return cands.select("token", "seq", "lemma", "label", "method")


def direct_lookup(spark, sf):
    return R.direct_hits(vocabulary(spark, sf), lexicon(spark, sf)).select("token", "dict_id", "dict_order")


def inflection_lookup(spark, sf):
    hits = R.inflection_hits(R.lemma_candidates(vocab(spark, sf), manual(spark), rules(spark)), lexicons(spark, sf))
    return hits.select("token", "seq", "lemma", "label", "dict_id")


def seed_lookup(spark, sf):
    heads = lexicons(spark, sf).filter("dict_id = 'bench'").select("head")
    strip = R.rule_table(spark, [], [(s, "", "ending", len(s) + 2) for s, _, _ in SUFFIXES])
    return R.seed_lookup(vocab(spark, sf), heads, strip)


def prefix_heads(spark, sf):
    heads = lexicons(spark, sf).filter("dict_id = 'bench'").select("head")
    return prefix_lookup(vocabulary(spark, sf), heads)


def layer_verdicts(spark, sf):
    lex = lexicons(spark, sf)
    return R.verdicts(
        vocab(spark, sf), lex, rules(spark), manual(spark), pool=lex.filter("dict_id = 'bench'"), split_options=OPTIONS
    )


def coverage(spark, sf):
    return R.coverage(layer_verdicts(spark, sf))


def unresolved_top(spark, sf):
    return R.unresolved_top(layer_verdicts(spark, sf))


def resolve_layers(spark, sf):
    bench = materialised(token_stream(read(spark, sf, "benchmark"), F.lower("text"), T.LATIN_WORD).distinct(), "token")
    lex = lexicons(spark, sf).filter("dict_id = 'conv'")
    return R.resolve_tokens(bench, lex, rules(spark), manual(spark), split_options=OPTIONS).select(
        "token", "layer", "seq", "lemma", F.coalesce("dict_id", F.lit("")).alias("dict_id"), F.round(F.coalesce("score", F.lit(-1.0)), 6).alias("score")
    )


def coverage_gate(spark, sf):
    """Layer shares of the direct/other split in source src0 (baseline) against src1 (current)."""
    docs = read(spark, sf, "documents")
    lex = lexicon(spark, sf).groupBy("head").agg(F.min("dict_order").alias("o"))

    def share(source):
        words = docs.filter(F.col("source") == source).select(F.explode(T.matches(F.lower("text"), T.LATIN_WORD)).alias("head"))
        freq = words.groupBy("head").agg(F.count("*").alias("freq")).join(lex, "head", "left")
        layer = F.when(F.col("o") == 1, "direct").when(F.col("o") == 2, "inflection").otherwise("none")
        verdict = freq.select(F.col("head").alias("token"), "freq", layer.alias("layer"))
        cov = R.coverage(verdict)
        long = cov.select("layer", F.expr("stack(2, 'distinct', pct_tokens, 'occurrence', pct_occurrences) AS (basis, pct)"))
        return long.select("basis", "layer", "pct")

    return R.coverage_gate(share("src1"), share("src0"))


def nearest(spark, sf):
    """Three nearest benchmark words of every document word no lexicon has."""
    lex = lexicons(spark, sf)
    unknown = vocab(spark, sf).join(lex, F.col("token") == F.col("head"), "left_anti").filter(F.length("token") >= 3)
    return nearest_heads(unknown, lex.filter("dict_id = 'bench'"), 3, 0.5).select(
        "token", "head", F.round("score", 6).alias("score"), "rank"
    )


def compound_splits(spark, sf):
    lex = lexicons(spark, sf)
    unknown = vocab(spark, sf).join(lex, F.col("token") == F.col("head"), "left_anti")
    best = C.split_compounds(unknown, lex, lemma_rules=rules(spark), keep=1, min_score=0.6, strict=False, **OPTIONS)
    return best.select("token", F.array_join("parts", "+").alias("parts"), F.round("score", 6).alias("score"))


def compound_two_part(spark, sf):
    """All two-part cuts of a document word into two known heads."""
    lex = lexicons(spark, sf).select("head").distinct()
    cuts = C.boundary_candidates(vocab(spark, sf), segment=C.characters).filter((F.length("left") >= 2) & (F.length("right") >= 1))
    left = cuts.join(lex.select(F.col("head").alias("left")), "left", "left_semi")
    return left.join(lex.select(F.col("head").alias("right")), "right", "left_semi").select("token", "left", "right")


def known_parts(spark, sf):
    return C.known_parts(vocab(spark, sf), lexicons(spark, sf), segment=C.characters)


def reduction(spark, sf):
    lex = lexicons(spark, sf)
    needed = R.needed_heads(vocab(spark, sf), lex, manual(spark), rules(spark), {"segment": C.characters})
    return R.reduce_lexicon(lex, materialised(needed, "head"))


def reduce_lexicon(spark, sf):
    return reduction(spark, sf)[0].select("dict_id", "head")


def reduce_report(spark, sf):
    return reduction(spark, sf)[1]


def _values(rows) -> str:
    def lit(v):
        return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


def sql_rules(suffixes, variants) -> str:
    rows = list(variants) + [(s, r, label, len(s) + 1) for s, r, label in sorted(suffixes, key=lambda r: -len(r[0]))]
    return f"rules(seq, suffix, replacement, label, min_len) AS (VALUES {_values([(i + 1, *r) for i, r in enumerate(rows)])})"


SQL_RULES = f"""{sql_rules(SUFFIXES, VARIANTS)}, manual(form, lemma, label, gloss) AS (VALUES {_values(MANUAL)})"""


def sql_lemmas(source: str, name: str) -> str:
    return f"""{name}_raw AS (SELECT token, CAST(seq AS INTEGER) AS seq, substr(token, 1, length(token) - length(suffix)) || replacement AS lemma,
      label, 'rule' AS method, NULL AS gloss FROM {source} JOIN rules ON ends_with(token, suffix) AND length(token) >= min_len
    UNION ALL SELECT token, 0, lemma, label, 'manual', gloss FROM {source} JOIN manual ON token = form),
  {name} AS (SELECT token, lemma, label, CAST(min(seq) AS INTEGER) AS seq, arg_min(method, seq) AS method, arg_min(coalesce(gloss, ''), seq) AS gloss
    FROM {name}_raw GROUP BY 1, 2, 3)"""


SQL_BASE = f"{SQL_VOCAB}, {SQL_LEXICON}, {SQL_RULES}, {sql_lemmas('vocab', 'cand')}"
SQL_HEADS = "heads AS (SELECT head, arg_min(dict_id, dict_order) AS via, min(dict_order) AS dict_order FROM lexicon GROUP BY 1)"


def sql_splits(open_: str, name: str, threshold: str, use_rules: str = "rules_and_manual", heads: str = "heads", most: int = 5) -> str:
    """Best splits into two to ``most`` parts of the tokens of ``open_``.

    Level k holds the four best ways, per place reached, to cut k parts of at least two
    characters off the front (what follows adds the same to each); what is left is the last part.
    """
    man = "UNION ALL SELECT form, lemma FROM manual" if use_rules == "rules_and_manual" else ""
    levels = [f"""{name}_1 AS (SELECT t.token, n, pos, coalesce(c, 0) AS tenths, [pos] AS cuts FROM
      (SELECT token, length(token) AS n, unnest(range(2, length(token))) AS pos FROM {open_} WHERE length(token) > 2) t
      LEFT JOIN {name}_c a ON a.token = t.token AND a.s = 0 AND a.e = pos)"""]
    best = "row_number() OVER (PARTITION BY t.token, nx ORDER BY tenths + coalesce(c, 0) DESC, list_append(cuts, nx))"
    for k in range(2, most):
        levels.append(f"""{name}_{k} AS (SELECT t.token, n, nx AS pos, tenths + coalesce(c, 0) AS tenths, list_append(cuts, nx) AS cuts FROM
      (SELECT *, unnest(range(pos + 2, n)) AS nx FROM {name}_{k - 1}) t LEFT JOIN {name}_c a ON a.token = t.token AND a.s = t.pos AND a.e = nx
      QUALIFY {best} <= 4)""")
    whole = " UNION ALL ".join(f"SELECT *, {k + 1} AS k FROM {name}_{k}" for k in range(1, most))
    return f"""{name}_sub AS (SELECT token, s, e, substr(token, s + 1, e - s) AS part FROM (SELECT token, s, unnest(range(s + 1, length(token) + 1)) AS e
      FROM (SELECT token, unnest(range(0, length(token))) AS s FROM {open_} WHERE length(token) > 2))
      WHERE e - s < length(token)),
  {name}_p AS (SELECT DISTINCT part FROM {name}_sub),
  {name}_lem AS (SELECT part, substr(part, 1, length(part) - length(suffix)) || replacement AS lemma FROM {name}_p JOIN rules
      ON ends_with(part, suffix) AND length(part) >= min_len {man}),
  {name}_cr AS (SELECT part, max(c) AS c FROM (SELECT part, 10 AS c FROM {name}_p SEMI JOIN {heads} ON part = head
      UNION ALL SELECT part, 6 FROM {name}_lem SEMI JOIN {heads} ON lemma = head) GROUP BY 1),
  {name}_c AS (SELECT token, s, e, c FROM {name}_sub JOIN {name}_cr USING (part)),
  {", ".join(levels)},
  {name}_all AS (SELECT t.token, n, k, cuts, tenths + coalesce(a.c, 0) AS tenths FROM ({whole}) t
      LEFT JOIN {name}_c a ON a.token = t.token AND a.s = t.pos AND a.e = n),
  {name}_best AS (SELECT *, tenths / (10.0 * k) AS score, row_number() OVER (PARTITION BY token ORDER BY tenths * 60 // k DESC, k, cuts) AS rank
      FROM {name}_all WHERE tenths / (10.0 * k) {threshold} QUALIFY rank <= 4),
  {name} AS (SELECT token, score, rank, array_to_string(list_transform(list_zip(list_prepend(0, cuts), list_append(cuts, n)),
      lambda x: substr(token, x[1] + 1, x[2] - x[1])), '+') AS parts FROM {name}_best)"""


def sql_nearest(asked: str, pool: str, name: str, k: int, threshold: float) -> str:
    """Dice over trigrams, all pairs with a common gram."""
    grams = lambda c: f"CASE WHEN length({c}) < 3 THEN [{c}] ELSE list_transform(range(1, length({c}) - 1), lambda i: substr({c}, i, 3)) END"
    return f"""{name}_h AS (SELECT head, list_distinct({grams('head')}) AS g FROM (SELECT DISTINCT head FROM {pool})),
  {name}_hg AS (SELECT head, len(g) AS nh, unnest(g) AS gram FROM {name}_h),
  {name}_q AS (SELECT token, len({grams('token')}) AS nq, unnest({grams('token')}) AS gram FROM {asked}),
  {name}_s AS (SELECT token, head, 2.0 * count(*) / (nq + nh) AS score FROM {name}_q JOIN {name}_hg USING (gram)
    WHERE abs(length(head) - length(token)) <= greatest(3.0, length(token) * 0.5) GROUP BY token, head, nq, nh),
  {name} AS (SELECT token, head, score, row_number() OVER (PARTITION BY token ORDER BY score DESC, head) AS rank
    FROM {name}_s WHERE score >= {threshold} QUALIFY rank <= {k})"""


SQL_VERDICTS = f"""{SQL_BASE}, {SQL_HEADS},
  infl AS (SELECT token, arg_min(via, seq * 100 + dict_order) AS via FROM cand JOIN heads ON lemma = head
    WHERE token NOT IN (SELECT head FROM heads) GROUP BY 1),
  open1 AS (SELECT token FROM vocab WHERE token NOT IN (SELECT head FROM heads) AND token NOT IN (SELECT token FROM infl)),
  {sql_splits('open1', 'comp', '>= 0.5999')},
  open2 AS (SELECT token FROM open1 WHERE length(token) >= 3 AND token NOT IN (SELECT token FROM comp)),
  pool AS (SELECT head FROM lexicon WHERE dict_id = 'bench'),
  {sql_nearest('open2', 'pool', 'fuzz', 1, 0.5)},
  verdict AS (SELECT v.token, v.freq, CASE WHEN h.via IS NOT NULL THEN 'direct' WHEN i.via IS NOT NULL THEN 'inflection'
      WHEN c.token IS NOT NULL THEN 'compound' WHEN f.head IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS layer,
      coalesce(h.via, i.via, CASE WHEN c.token IS NOT NULL THEN 'split' END, f.head, '') AS via
    FROM vocab v LEFT JOIN heads h ON v.token = h.head LEFT JOIN infl i ON v.token = i.token
      LEFT JOIN (SELECT DISTINCT token FROM comp) c ON v.token = c.token LEFT JOIN fuzz f ON v.token = f.token)"""
SQL_STRIP = sql_rules([], [(s, "", "ending", len(s) + 2) for s, _, _ in SUFFIXES])


def sql_parts_level(source: str, name: str) -> str:
    return f"""{name}_cut AS (SELECT DISTINCT substr(token, 1, i) AS l, substr(token, i + 1) AS r FROM
      (SELECT token, unnest(range(1, length(token) - 1)) AS i FROM {source} WHERE length(token) >= 4)),
  {name} AS (SELECT l, r, a.head IS NOT NULL AS lk, b.head IS NOT NULL AS rk FROM {name}_cut LEFT JOIN heads a ON l = a.head
      LEFT JOIN heads b ON r = b.head WHERE a.head IS NOT NULL OR b.head IS NOT NULL),
  {name}_open AS (SELECT DISTINCT r AS token FROM {name} WHERE NOT rk UNION SELECT l FROM {name} WHERE NOT lk)"""


SQL_PARTS = f"""{sql_parts_level('vocab', 'l1')}, {sql_parts_level('l1_open', 'l2')}, {sql_parts_level('l2_open', 'l3')},
  parts AS (SELECT l AS head FROM l1 WHERE lk UNION SELECT r FROM l1 WHERE rk UNION SELECT l FROM l2 WHERE lk UNION SELECT r FROM l2 WHERE rk
    UNION SELECT l FROM l3 WHERE lk UNION SELECT r FROM l3 WHERE rk)"""
SQL_REDUCE = f"""{SQL_BASE}, {SQL_HEADS}, {SQL_PARTS},
  needed AS (SELECT token AS head FROM vocab UNION SELECT lemma FROM cand UNION SELECT head FROM parts)"""
SQL_BENCH = r"bench AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS token FROM benchmark)"

QUERIES = {
    "lemma_candidates": (lemma_candidates, f"WITH {SQL_BASE} SELECT token, seq, lemma, label, method FROM cand"),
    "direct_lookup": (
        direct_lookup,
        f"WITH {SQL_VOCAB}, {SQL_LEXICON} SELECT token, dict_id, CAST(dict_order AS INTEGER) AS dict_order FROM vocab JOIN lexicon ON token = head",
    ),
    "inflection_lookup": (
        inflection_lookup,
        f"""WITH {SQL_BASE} SELECT token, seq, lemma, label, dict_id FROM cand JOIN lexicon ON lemma = head
        UNION ALL SELECT token, seq, lemma, label, 'manual-table' FROM cand WHERE gloss <> '' AND lemma NOT IN (SELECT head FROM lexicon)""",
    ),
    "seed_lookup": (
        seed_lookup,
        f"""WITH {SQL_VOCAB}, {SQL_LEXICON}, {SQL_STRIP}, h AS (SELECT head FROM lexicon WHERE dict_id = 'bench'),
        s AS (SELECT token, substr(token, 1, length(token) - length(suffix)) AS lemma, seq FROM vocab JOIN rules
          ON ends_with(token, suffix) AND length(token) >= min_len WHERE token NOT IN (SELECT head FROM h))
        SELECT token, token AS lemma, true AS exact FROM vocab WHERE token IN (SELECT head FROM h)
        UNION ALL SELECT token, arg_max(lemma, length(lemma) * 100 - seq), false FROM s SEMI JOIN h ON lemma = head GROUP BY token""",
    ),
    "prefix_heads": (
        prefix_heads,
        f"""WITH {SQL_VOCAB}, {SQL_LEXICON}, h AS (SELECT DISTINCT head FROM lexicon WHERE dict_id = 'bench'),
        p AS (SELECT token, head FROM vocab JOIN h ON length(token) >= 3 AND starts_with(head, substr(token, 1, 6))
          AND substr(head, 1, 3) = substr(token, 1, 3))
        SELECT token, head, CAST(row_number() OVER (PARTITION BY token ORDER BY head) AS INTEGER) AS rank FROM p QUALIFY rank <= 5""",
    ),
    "layer_verdicts": (layer_verdicts, f"WITH {SQL_VERDICTS} SELECT * FROM verdict"),
    "coverage": (
        coverage,
        f"""WITH {SQL_VERDICTS}, c AS (SELECT layer, count(*) AS tokens, CAST(sum(freq) AS BIGINT) AS occurrences FROM verdict GROUP BY 1)
        SELECT *, round(tokens * CAST(100 AS DOUBLE) / sum(tokens) OVER (), 2) AS pct_tokens,
        round(occurrences * CAST(100 AS DOUBLE) / sum(occurrences) OVER (), 2) AS pct_occurrences FROM c""",
    ),
    "unresolved_top": (
        unresolved_top,
        f"WITH {SQL_VERDICTS} SELECT token, freq FROM verdict WHERE layer = 'none' ORDER BY freq DESC, token LIMIT 100",
    ),
    "resolve_layers": (
        resolve_layers,
        f"""WITH {SQL_BENCH}, {SQL_LEXICON}, {SQL_RULES}, {sql_lemmas('bench', 'cand')},
        heads AS (SELECT head FROM lexicon WHERE dict_id = 'conv'),
        early AS (SELECT token, 'direct' AS layer, 2 AS seq, token AS lemma, 'conv' AS dict_id FROM bench SEMI JOIN heads ON token = head
          UNION ALL SELECT token, 'inflection', seq * 100 + 2, lemma, 'conv' FROM cand SEMI JOIN heads ON lemma = head
          UNION ALL SELECT token, 'inflection', seq * 100 + 99, lemma, 'manual-table' FROM cand
            WHERE gloss <> '' AND lemma NOT IN (SELECT head FROM heads)),
        open1 AS (SELECT token FROM bench WHERE token NOT IN (SELECT token FROM early)),
        {sql_splits('open1', 'comp', '> 0.5001')},
        open2 AS (SELECT token FROM open1 WHERE length(token) >= 2 AND token NOT IN (SELECT token FROM comp)),
        {sql_nearest('open2', 'heads', 'fuzz', 5, 0.45)}
        SELECT token, layer, CAST(seq AS INTEGER) AS seq, lemma, dict_id, CAST(-1 AS DOUBLE) AS score FROM early
        UNION ALL SELECT token, 'compound', CAST(rank AS INTEGER), replace(parts, '+', ' + '), '', round(score, 6) FROM comp WHERE rank <= 4
        UNION ALL SELECT token, 'fuzzy', CAST(rank AS INTEGER), head, '', round(score, 6) FROM fuzz""",
    ),
    "coverage_gate": (
        coverage_gate,
        rf"""WITH {SQL_LEXICON}, lx AS (SELECT head, min(dict_order) AS o FROM lexicon GROUP BY 1),
        w AS (SELECT source, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS head FROM documents WHERE source IN ('src0', 'src1')),
        f AS (SELECT source, head, count(*) AS freq FROM w GROUP BY 1, 2),
        c AS (SELECT source, CASE WHEN o = 1 THEN 'direct' WHEN o = 2 THEN 'inflection' ELSE 'none' END AS layer, count(*) AS t, sum(freq) AS occ
          FROM f LEFT JOIN lx USING (head) GROUP BY 1, 2),
        p AS (SELECT source, layer, round(t * CAST(100 AS DOUBLE) / sum(t) OVER (PARTITION BY source), 2) AS "distinct",
          round(occ * CAST(100 AS DOUBLE) / sum(occ) OVER (PARTITION BY source), 2) AS occurrence FROM c),
        u AS (SELECT source, layer, 'distinct' AS basis, "distinct" AS pct FROM p UNION ALL SELECT source, layer, 'occurrence', occurrence FROM p),
        j AS (SELECT basis, layer, coalesce(a.pct, 0) AS now, coalesce(b.pct, 0) AS "then" FROM (SELECT * FROM u WHERE source = 'src1') a
          FULL JOIN (SELECT * FROM u WHERE source = 'src0') b USING (basis, layer))
        SELECT basis, layer, now, "then", round(now - "then", 4) AS delta,
          round(CASE WHEN layer = 'none' THEN now - "then" ELSE "then" - now END, 4) > 1.0 AS failed FROM j""",
    ),
    "nearest_heads": (
        nearest,
        f"""WITH {SQL_VOCAB}, {SQL_LEXICON}, pool AS (SELECT head FROM lexicon WHERE dict_id = 'bench'),
        o AS (SELECT token FROM vocab WHERE length(token) >= 3 AND token NOT IN (SELECT head FROM lexicon)),
        {sql_nearest('o', 'pool', 'fuzz', 3, 0.5)} SELECT token, head, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM fuzz""",
    ),
    "compound_splits": (
        compound_splits,
        f"""WITH {SQL_VOCAB}, {SQL_LEXICON}, {SQL_RULES}, heads AS (SELECT DISTINCT head FROM lexicon),
        o AS (SELECT token FROM vocab WHERE token NOT IN (SELECT head FROM heads)),
        {sql_splits('o', 'comp', '>= 0.5999', use_rules='rules')}
        SELECT token, parts, round(score, 6) AS score FROM comp WHERE rank = 1""",
    ),
    "compound_two_part": (
        compound_two_part,
        f"""WITH {SQL_VOCAB}, {SQL_LEXICON}, heads AS (SELECT DISTINCT head FROM lexicon),
        c AS (SELECT token, substr(token, 1, i) AS "left", substr(token, i + 1) AS "right" FROM
          (SELECT token, unnest(range(2, length(token))) AS i FROM vocab))
        SELECT * FROM c WHERE "left" IN (SELECT head FROM heads) AND "right" IN (SELECT head FROM heads)""",
    ),
    "known_parts": (known_parts, f"WITH {SQL_VOCAB}, {SQL_LEXICON}, {SQL_HEADS}, {SQL_PARTS} SELECT head FROM parts"),
    "reduce_lexicon": (reduce_lexicon, f"WITH {SQL_REDUCE} SELECT dict_id, head FROM lexicon SEMI JOIN needed USING (head)"),
    "reduce_report": (
        reduce_report,
        f"""WITH {SQL_REDUCE} SELECT dict_id, count(*) AS total, count(n.head) AS kept FROM lexicon l
        LEFT JOIN needed n ON l.head = n.head GROUP BY 1""",
    ),
}
