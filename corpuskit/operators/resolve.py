"""Resolving vocabulary against lexicons, layer by layer."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuskit.operators.similarity import nearest_heads
from corpuskit.session import checkpointed, small_or_shuffled

# Layers in the order they are tried.
LAYERS = ("direct", "inflection", "compound", "fuzzy", "none")


def rule_table(
    spark: SparkSession, suffix_rules: Iterable[Sequence[str]], variants: Iterable[Sequence] = ()
) -> DataFrame:
    """Rules as rows: surface variants first, then suffixes, longest first.

    ``suffix_rules`` holds (suffix, replacement, label); ``variants`` adds the
    shortest word length a variant applies to.
    """
    rows = [(s, r, label, shortest) for s, r, label, shortest in variants]
    ordered = sorted(enumerate(suffix_rules), key=lambda p: (-len(p[1][0]), p[0]))
    rows += [(s, r, label, len(s) + 1) for _, (s, r, label) in ordered]
    rows = [(i + 1, *row) for i, row in enumerate(rows)]
    return spark.createDataFrame(rows, "seq int, suffix string, replacement string, label string, min_len int")


def lemma_candidates(tokens: DataFrame, manual: DataFrame | None, rules: DataFrame | None, dedupe: bool = True) -> DataFrame:
    """``token, seq, lemma, label, method, gloss``: table forms, then variants, then suffix rules.

    A suffix rule is an equi-join between the endings of the token and the rule
    table, so no rule is tested against every token.
    """
    found = []
    if manual is not None:
        found.append(
            tokens.select("token")
            .join(small_or_shuffled(manual), F.col("token") == F.col("form"))
            .select("token", F.lit(0).alias("seq"), "lemma", "label", F.lit("manual").alias("method"), "gloss")
        )
    if rules is not None:
        longest = rules.agg(F.max(F.length("suffix"))).first()[0]
        ends = F.explode(F.sequence(F.lit(1), F.least(F.length("token"), F.lit(longest)))).alias("n")
        endings = tokens.filter(F.length("token") > 0).select("token", ends).withColumn("suffix", F.right("token", F.col("n")))
        stem = F.substr("token", F.lit(1), F.length("token") - F.length("suffix"))
        found.append(
            endings.join(small_or_shuffled(rules), "suffix")
            .filter(F.length("token") >= F.col("min_len"))
            .select(
                "token", "seq", F.concat(stem, "replacement").alias("lemma"), "label", F.lit("rule").alias("method"),
                F.lit(None).cast("string").alias("gloss"),
            )
        )
    out = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    if not dedupe:
        return out
    first = F.min_by(F.struct("method", "gloss"), F.col("seq"))
    return out.groupBy("token", "lemma", "label").agg(F.min("seq").alias("seq"), first.alias("f")).select(
        "token", "seq", "lemma", "label", F.col("f.method").alias("method"), F.col("f.gloss").alias("gloss")
    )


def direct_hits(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Every lexicon entry of a token, with the priority of its lexicon."""
    return tokens.select("token").join(lexicon, F.col("token") == F.col("head"))


def inflection_hits(candidates: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Candidates whose lemma is a head; a table gloss stands in where no lexicon has it."""
    joined = candidates.join(lexicon.select("head", "dict_id", "dict_order"), F.col("lemma") == F.col("head"), "left")
    return (
        joined.filter(F.col("head").isNotNull() | F.col("gloss").isNotNull())
        .withColumn("dict_id", F.coalesce("dict_id", F.lit("manual-table")))
        .withColumn("dict_order", F.coalesce("dict_order", F.lit(99)))
        .drop("head")
    )


def first_resolved(freq: DataFrame, lexicon: DataFrame, manual: DataFrame | None, rules: DataFrame) -> DataFrame:
    """Vocabulary with the first lexicon that has it, directly or through a candidate."""
    best = lexicon.groupBy("head").agg(F.min_by("dict_id", "dict_order").alias("via"), F.min("dict_order").alias("dict_order"))
    marked = freq.join(best.select(F.col("head").alias("token"), F.col("via").alias("direct_via")), "token", "left")
    open_ = marked.filter(F.col("direct_via").isNull())
    cands = lemma_candidates(open_, manual, rules)
    inflected = (
        cands.join(best, F.col("lemma") == F.col("head"))
        .groupBy("token")
        .agg(F.min_by(F.struct("via", "lemma"), F.struct("seq", "dict_order")).alias("m"))
        .select("token", F.col("m.via").alias("inflection_via"), F.col("m.lemma").alias("inflection_lemma"))
    )
    return marked.join(inflected, "token", "left")


def verdicts(
    freq: DataFrame,
    lexicon: DataFrame,
    rules: DataFrame,
    manual: DataFrame | None = None,
    pool: DataFrame | None = None,
    split_options: dict | None = None,
    compound_score: float = 0.6,
    fuzzy_score: float = 0.5,
    fuzzy_min_len: int = 3,
) -> DataFrame:
    """One layer per vocabulary token: ``token, freq, layer, via``.

    Costly layers see only what the cheap ones left open.
    """
    from corpuskit.operators.compound import in_two_parts, part_credits, split_compounds

    heads = lexicon.select("head").distinct()
    base = checkpointed(first_resolved(freq, lexicon, manual, rules))
    open_ = base.filter(F.col("direct_via").isNull() & F.col("inflection_via").isNull()).select("token")
    # That a split reaches the score is all that is asked, and mostly two parts do.
    credits = checkpointed(part_credits(heads, rules, manual))
    options = {"credits": credits, "min_score": compound_score, "strict": False, **(split_options or {})}
    paired = checkpointed(in_two_parts(open_, **options))
    unpaired = open_.join(paired, "token", "left_anti")
    splits = split_compounds(unpaired, heads, lemma_rules=rules, manual=manual, keep=1, **options)
    compounds = paired.unionByName(splits.filter(F.col("rank") == 1).select("token"))
    compounds = checkpointed(compounds.withColumn("compound_via", F.lit("split")))
    left = open_.join(compounds, "token", "left_anti").filter(F.length("token") >= fuzzy_min_len)
    near = nearest_heads(left, heads if pool is None else pool, 1, fuzzy_score).select("token", F.col("head").alias("fuzzy_via"))
    merged = base.join(compounds, "token", "left").join(near, "token", "left")
    layer = (
        F.when(F.col("direct_via").isNotNull(), "direct")
        .when(F.col("inflection_via").isNotNull(), "inflection")
        .when(F.col("compound_via").isNotNull(), "compound")
        .when(F.col("fuzzy_via").isNotNull(), "fuzzy")
        .otherwise("none")
    )
    via = F.coalesce("direct_via", "inflection_via", "compound_via", "fuzzy_via", F.lit(""))
    return merged.select("token", "freq", layer.alias("layer"), via.alias("via"))


def coverage(verdict: DataFrame) -> DataFrame:
    """Distinct and occurrence counts and percentages per layer."""
    per_layer = verdict.groupBy("layer").agg(F.count("*").alias("tokens"), F.sum("freq").alias("occurrences"))
    everything = Window.partitionBy(F.lit(0))  # over the five layer rows
    share = lambda c: F.round(F.col(c) * 100 / F.sum(c).over(everything), 2)
    return per_layer.select(
        "layer", "tokens", "occurrences", share("tokens").alias("pct_tokens"), share("occurrences").alias("pct_occurrences")
    )


def unresolved_top(verdict: DataFrame, n: int = 100) -> DataFrame:
    return verdict.filter(F.col("layer") == "none").orderBy(F.desc("freq"), F.asc("token")).limit(n).select("token", "freq")


def coverage_gate(current: DataFrame, baseline: DataFrame, max_pts: float = 1.0) -> DataFrame:
    """Layers (``basis, layer, pct``) that got worse by more than ``max_pts`` points."""
    now = current.select("basis", "layer", F.col("pct").alias("now"))
    then = baseline.select("basis", "layer", F.col("pct").alias("then"))
    delta = F.coalesce("now", F.lit(0.0)) - F.coalesce("then", F.lit(0.0))
    worse = F.when(F.col("layer") == "none", delta).otherwise(-delta)
    return now.join(then, ["basis", "layer"], "full_outer").select(
        "basis",
        "layer",
        F.coalesce("now", F.lit(0.0)).alias("now"),
        F.coalesce("then", F.lit(0.0)).alias("then"),
        F.round(delta, 4).alias("delta"),
        (F.round(worse, 4) > max_pts).alias("failed"),
    )


def resolve_tokens(
    tokens: DataFrame,
    lexicon: DataFrame,
    rules: DataFrame,
    manual: DataFrame | None = None,
    split_options: dict | None = None,
    compound_score: float = 0.5,
    k: int = 5,
    fuzzy_score: float = 0.45,
) -> DataFrame:
    """Long report ``token, layer, seq, lemma, label, method, dict_id, score``.

    Direct and inflection hits always run; compounds only where both are empty,
    nearest heads only where compounds are empty too.
    """
    from corpuskit.operators.compound import split_compounds

    vocab = tokens.select("token").distinct().filter(F.col("token") != "")
    heads = lexicon.select("head").distinct()
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    direct = direct_hits(vocab, lexicon).select(
        "token", F.lit("direct").alias("layer"), F.col("dict_order").alias("seq"), F.col("token").alias("lemma"), text.alias("label"),
        F.lit("exact").alias("method"), "dict_id", number.alias("score"),
    )
    inflected = inflection_hits(lemma_candidates(vocab, manual, rules), lexicon).select(
        "token", F.lit("inflection").alias("layer"), (F.col("seq") * 100 + F.col("dict_order")).alias("seq"), "lemma", "label", "method",
        "dict_id", number.alias("score"),
    )
    early = checkpointed(direct.unionByName(inflected))
    open_ = checkpointed(vocab.join(early, "token", "left_anti"))
    split = checkpointed(
        split_compounds(open_, heads, lemma_rules=rules, manual=manual, keep=4, min_score=compound_score, **(split_options or {}))
    )
    compounds = split.select(
        "token", F.lit("compound").alias("layer"), F.col("rank").alias("seq"), F.array_join("parts", " + ").alias("lemma"),
        F.array_join("rules", ", ").alias("label"), F.lit("compound").alias("method"), text.alias("dict_id"), "score",
    )
    left = open_.join(split, "token", "left_anti").filter(F.length("token") >= 2)
    near = nearest_heads(left, heads, k, fuzzy_score).select(
        "token", F.lit("fuzzy").alias("layer"), F.col("rank").alias("seq"), F.col("head").alias("lemma"), text.alias("label"),
        F.lit("fuzzy").alias("method"), text.alias("dict_id"), "score",
    )
    return early.unionByName(compounds).unionByName(near)


LAYERS = ("direct", "inflection", "compound", "fuzzy")


def resolve_in_texts(tokens: DataFrame, report: DataFrame, found: DataFrame) -> DataFrame:
    """Results per layer and the ``resolved`` flag of every ``(text_slug, token)``.

    ``report`` is that of ``resolve_tokens``, ``found`` the definitions of ``token_glosses``.
    Definitions count for the token's own text only, so a token without a text (null) has none.
    A token is resolved if any layer has a result.
    """
    counts = report.groupBy("token").agg(*[F.count_if(F.col("layer") == layer).alias(layer) for layer in LAYERS])
    defined = found.groupBy("text_slug", "token").agg(F.count("*").alias("gloss"))
    all_layers = [F.coalesce(layer, F.lit(0)).cast("long").alias(layer) for layer in (*LAYERS, "gloss")]
    joined = tokens.select("text_slug", "token").distinct().join(counts, "token", "left").join(defined, ["text_slug", "token"], "left")
    joined = joined.select("text_slug", "token", *all_layers)
    return joined.withColumn("resolved", F.greatest(*LAYERS, "gloss") > 0)


def gloss_rows(found: DataFrame) -> DataFrame:
    """Definitions in the shape of the ``resolve_tokens`` report, with their text, unit and snippet."""
    text = F.lit(None).cast("string")
    return found.select(
        "text_slug", "token", F.lit("gloss").alias("layer"), F.col("rank").alias("seq"), text.alias("lemma"), text.alias("label"),
        F.col("rule").alias("method"), text.alias("dict_id"), "score", "unit_id", "snippet",
    )


def needed_heads(tokens: DataFrame, heads: DataFrame, manual: DataFrame | None, rules: DataFrame, split_options: dict | None = None) -> DataFrame:
    """Tokens, their lemma candidates and the known parts of their splits."""
    from corpuskit.operators.compound import known_parts

    vocab = tokens.select("token").distinct()
    lemmas = lemma_candidates(vocab, manual, rules, dedupe=False).select(F.col("lemma").alias("head"))
    parts = known_parts(vocab, heads, **(split_options or {}))
    return vocab.select(F.col("token").alias("head")).unionByName(lemmas).unionByName(parts).distinct()


def reduce_lexicon(lexicon: DataFrame, needed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries whose head is needed, and how many each lexicon keeps."""
    kept = lexicon.join(needed, "head", "left_semi")
    flags = lexicon.join(needed.select("head", F.lit(1).alias("kept")), "head", "left")
    report = flags.groupBy("dict_id").agg(F.count("*").alias("total"), F.count("kept").alias("kept"))
    return kept, report


def seed_lookup(tokens: DataFrame, heads: DataFrame, rules: DataFrame) -> DataFrame:
    """Seed lookup: the word itself, else the longest stem left by stripping one ending.

    ``rules`` has empty replacements; an ending needs two more characters before it.
    """
    exact = tokens.select("token").join(heads, F.col("token") == F.col("head")).select("token", F.col("token").alias("lemma"), F.lit(True).alias("exact"))
    open_ = tokens.join(exact, "token", "left_anti")
    stems = lemma_candidates(open_, None, rules, dedupe=False).join(heads, F.col("lemma") == F.col("head"))
    best = stems.groupBy("token").agg(F.max_by("lemma", F.struct(F.length("lemma"), -F.col("seq"))).alias("lemma"))
    return exact.unionByName(best.select("token", "lemma", F.lit(False).alias("exact")))
