"""Splitting words into known parts.

All candidate parts of all words are looked up at once (one join on the distinct
parts); the best arrangement of a word's own parts is a dynamic programme over its
boundaries, written as array functions, whose work is bounded by the word length.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuskit.functions import text as T
from corpuskit.operators.resolve import lemma_candidates
from corpuskit.session import checkpointed, materialised

VIRAMA = "्"
# Fixed value: the plain cut.  A rule is (mark at the end of the left side, text
# that replaces the mark, text put before the right side, name).
NO_CHANGE = ("", "", "", "no-sandhi")
# Credit of a known part and of a part known through its lemma, in tenths.
KNOWN, VIA_LEMMA = 10, 6
# Fixed value: strings are put in order inside groups of so many equal first characters.
GROUP = 5

def _rule_array(rules: Sequence[tuple[str, str, str, str]]) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, ("mark", "left", "right", "rule"))]) for r in rules])


def _with_cuts(words: DataFrame, rules: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """``token, n, cuts``: every inner boundary (``at``, character offset ``off``) with every rule that fits it."""
    places = words.withColumn("n", F.size("segments")).filter(F.col("n") > 1)
    places = places.withColumn("offs", F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda i: F.length(F.array_join(F.slice("segments", F.lit(1), i), ""))))

    def at(off: Column, i: Column) -> Column:
        end = F.get("segments", i)
        fits = lambda r: (r["mark"] == "") | (F.endswith(end, r["mark"]) & ~F.endswith(end, F.concat(F.lit(VIRAMA), r["mark"])))
        table = _rule_array(rules)
        return F.transform(
            table if len(rules) == 1 else F.filter(table, fits),
            lambda r: F.struct(
                (i + 1).alias("at"), off.alias("off"), F.length(r["mark"]).alias("drop"), r["left"].alias("left"), r["right"].alias("right"),
                r["rule"].alias("rule"),
            ),
        )

    return places.select("token", "n", F.flatten(F.transform("offs", at)).alias("cuts"))


def _plain(rules: Sequence[tuple[str, str, str, str]], segment: Callable[[Column], Column] | None) -> bool:
    """Cuts between any two characters that change nothing: places and parts are plain numbers and substrings."""
    return segment is characters and list(rules) == [NO_CHANGE]


def candidate_parts(
    words: DataFrame, rules: Sequence[tuple[str, str, str, str]], longest: int, segment: Callable[[Column], Column] | None = None
) -> DataFrame:
    """``token, part``: every string that can be a part of the word, no longer than ``longest``."""
    if _plain(rules, segment):
        size = F.length("token")
        starts = words.filter(size > 1).select("token", F.explode(F.sequence(F.lit(0), size - 1)).alias("s"))
        spans = starts.select("token", "s", F.explode(F.sequence(F.col("s") + 1, F.least(size, F.col("s") + max(longest, 1)))).alias("e"))
        # A part of one character is the last one, so none starts after the first character.
        able = (F.col("e") - F.col("s") <= longest) & (F.col("s") != 1) & ((F.col("e") - F.col("s") > 1) | (F.col("e") == size))
        spans = spans.filter(able & ((F.col("s") > 0) | (F.col("e") < size)))
        return spans.select("token", F.substr("token", F.col("s") + 1, F.col("e") - F.col("s")).alias("part"))
    zero, none, size = F.lit(0), F.lit(""), F.length("token")
    starts = F.transform("cuts", lambda c: F.struct(c["at"].alias("at"), c["off"].alias("off"), c["right"].alias("add")))
    ends = F.transform("cuts", lambda c: F.struct(c["at"].alias("at"), c["off"].alias("off"), c["drop"].alias("drop"), c["left"].alias("put")))
    first = F.array(F.struct(zero.alias("at"), zero.alias("off"), none.alias("add")))
    last = F.array(F.struct(F.col("n").alias("at"), size.alias("off"), zero.alias("drop"), none.alias("put")))
    spans = (
        _with_cuts(words, rules)
        .select("token", "n", F.concat(F.array_distinct(ends), last).alias("ends"), F.explode(F.concat(F.array_distinct(starts), first)).alias("s"))
        .withColumn("e", F.explode("ends"))
        .filter((F.col("e.off") > F.col("s.off")) & (F.col("e.off") - F.col("s.off") <= F.col("e.drop") + longest))
        .filter((F.col("s.at") > 0) | (F.col("e.at") < F.col("n")))
    )
    raw = F.substr("token", F.col("s.off") + 1, F.col("e.off") - F.col("s.off") - F.col("e.drop"))
    return spans.select("token", F.concat("s.add", raw, "e.put").alias("part")).filter(
        (F.col("part") != "") & (F.length("part") <= longest)
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def best_splits(rules: Sequence[tuple[str, str, str, str]], max_parts: int, keep: int, count: Callable[[Column], Column]) -> Column:
    """The best arrangements ``(mean, parts, path, names, total)`` of a word: highest mean credit, then fewer parts, then earliest cuts.

    Reads ``token``, its ``segments`` and the map ``credit`` of known parts in tenths.  A
    dynamic programme from the last boundary to the first: for every boundary, every rule that
    fits it and every number of parts it holds the ``keep`` best ways to cut what follows, as
    (credit taken off 0, path of (boundary, rule), parts), which sort as they are to be ranked.
    """
    size = F.size("segments")
    table = F.array(*[F.struct(F.lit(i).alias("r"), *[F.lit(v).alias(n) for v, n in zip(rule, ("mark", "left", "right"))]) for i, rule in enumerate(rules)])
    offs = F.transform(F.sequence(F.lit(0), size), lambda i: F.length(F.array_join(F.slice("segments", F.lit(1), i), "")))

    def options(i: Column) -> Column:
        if len(rules) == 1:
            return table
        end = F.get("segments", i - 1)
        return F.filter(table, lambda o: (o["mark"] == "") | (F.endswith(end, o["mark"]) & ~F.endswith(end, F.concat(F.lit(VIRAMA), o["mark"]))))

    opts = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.when(i == 0, F.slice(table, 1, 1)).otherwise(options(i)))
    own = lambda piece: -F.coalesce(F.try_element_at("credit", piece), F.lit(0))
    step = "struct<total: int, path: array<struct<j: int, r: int>>, names: array<string>>"

    def programme(w: Column) -> Column:
        offs, opts = w["offs"], w["opts"]
        cut = lambda i, j, o, p: F.concat(o["right"], F.substr("token", F.get(offs, i) + 1, F.greatest(F.get(offs, j) - F.get(offs, i) - F.length(p["mark"]), F.lit(0))), p["left"])

        def spans(i: Column, o: Column) -> Column:
            """Every admissible next part from boundary ``i``: where it ends, by which rule, its text and credit."""
            inner = F.when(i + 1 < size, F.sequence(i + 1, size - 1)).otherwise(F.array().cast("array<int>"))
            one = lambda j, p, q: F.struct(j.alias("j"), q.alias("q"), p["r"].alias("r"), cut(i, j, o, p).alias("piece"))
            every = F.flatten(F.transform(inner, lambda j: F.transform(F.get(opts, j), lambda p, q: one(j, p, q))))
            return F.transform(F.filter(every, lambda x: (x["piece"] != "") & (count(x["piece"]) >= 2)), lambda x: x.withField("own", own(x["piece"])))

        def ways(found: Column, i: Column, o: Column) -> Column:
            """By number of parts: the best ways to cut from boundary ``i`` on; ``found`` holds the later boundaries."""
            last = F.concat(o["right"], F.substr("token", F.get(offs, i) + 1, F.length("token")))
            whole = F.array(F.struct(own(last).alias("total"), F.array().cast("array<struct<j: int, r: int>>").alias("path"), F.array(last).alias("names")).cast(step))

            def more(x: Column, rest: Column) -> Column:
                way = (x["own"] + rest["total"]).alias("total"), F.concat(F.array(F.struct(x["j"].alias("j"), x["r"].alias("r"))), rest["path"]).alias("path")
                return F.struct(*way, F.concat(F.array(x["piece"]), rest["names"]).alias("names")).cast(step)

            def level(levels: Column, k: Column, parts: Column) -> Column:
                rests = lambda x: F.get(F.get(F.get(found, size - 1 - x["j"]), x["q"]), k - 2)
                every = F.flatten(F.transform(parts, lambda x: F.transform(rests(x), lambda rest: more(x, rest))))
                best = F.filter(F.array(F.array_min(every)), lambda x: x.isNotNull()) if keep == 1 else F.slice(F.array_sort(every), 1, keep)
                return F.concat(levels, F.array(best))

            most = F.when(i == 0, max_parts).otherwise(max_parts - 1)
            return _let(spans(i, o), lambda parts: F.aggregate(F.when(most > 1, F.sequence(F.lit(2), most)).otherwise(F.array().cast("array<int>")), F.array(whole), lambda levels, k: level(levels, k, parts)))

        empty = F.array().cast(f"array<array<array<array<{step}>>>>")
        return F.aggregate(F.sequence(size - 1, F.lit(0), F.lit(-1)), empty, lambda found, i: F.concat(found, F.array(F.transform(F.get(opts, i), lambda o: ways(found, i, o)))))

    table_of = _let(F.struct(offs.alias("offs"), opts.alias("opts")), programme)
    first = F.slice(F.get(F.get(table_of, size - 1), F.lit(0)), 2, max_parts - 1)  # two parts or more
    ranked = F.flatten(F.transform(first, lambda ways: F.transform(ways, lambda x: F.struct((x["total"] / F.size(x["names"])).alias("mean"), F.size(x["names"]).alias("parts"), x["path"].alias("path"), x["names"].alias("names"), (-x["total"]).alias("total")))))
    return F.slice(F.array_sort(ranked), 1, keep)


def best_plain_split(max_parts: int) -> Column:
    """What :func:`best_splits` keeps first, for plain cuts between characters.

    The same programme on numbers: a way is ``credit taken off 0 * (n + 1) ** (max_parts - 1)``
    plus its boundaries as digits to the base ``n + 1``, so the least number is the best way.
    Exact for words of up to :func:`_plain_longest` characters.
    """
    size = F.length("token")
    base = (size + 1).cast("long")
    powers = [F.lit(1).cast("long")]
    for _ in range(max_parts - 1):
        powers.append(powers[-1] * base)

    def programme(w: Column) -> Column:
        power = lambda k: F.get(w, k if isinstance(k, Column) else F.lit(k))
        scale = power(max_parts - 1)
        own = lambda i, j: F.coalesce(F.try_element_at("credit", F.substr("token", i + 1, j - i)), F.lit(0)) * -scale

        def ways(found: Column, i: Column, most: int) -> Column:
            """By number of parts: the best way to cut from boundary ``i`` on; ``found`` holds the later boundaries."""
            ends = F.when(i + 2 < size, F.sequence(i + 2, size - 1)).otherwise(F.array().cast("array<int>"))
            spans = F.transform(ends, lambda j: F.struct(j.alias("j"), own(i, j).alias("own")))

            def level(parts: Column, k: int) -> Column:
                return F.array_min(F.transform(parts, lambda x: x["own"] + x["j"] * power(k - 2) + F.get(F.get(found, size - 1 - x["j"]), F.lit(k - 2))))

            return _let(spans, lambda parts: F.array(own(i, size), *[level(parts, k) for k in range(2, most + 1)]))

        inner = F.when(size > 2, F.sequence(size - 1, F.lit(2), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        found = F.aggregate(inner, F.array().cast("array<array<bigint>>"), lambda found, i: F.concat(found, F.array(ways(found, i, max_parts - 1))))

        def ranked(v: Column, k: int) -> Column:
            path = F.pmod(v, scale)
            total = F.round((v - path) / scale).cast("int")
            return F.when(v.isNotNull(), F.struct((total / k).alias("mean"), F.lit(k).alias("parts"), path.alias("path"), (-total).alias("total")))

        every = _let(_let(found, lambda found: ways(found, F.lit(0), max_parts)), lambda top: F.array(*[ranked(F.get(top, F.lit(k - 1)), k) for k in range(2, max_parts + 1)]))
        digit = lambda b, d: (F.floor(b["path"] / power(b["parts"] - 1 - d)) % base).cast("int")
        cuts = lambda b: F.transform(F.sequence(F.lit(1), b["parts"] - 1), lambda d: digit(b, d))

        def written(b: Column, at: Column) -> Column:
            names = F.transform(F.arrays_zip(F.concat(F.array(F.lit(0)), at).alias("s"), F.concat(at, F.array(size)).alias("e")), lambda x: F.substr("token", x["s"] + 1, x["e"] - x["s"]))
            return F.struct(b["mean"].alias("mean"), b["parts"].alias("parts"), F.transform(at, lambda j: F.struct(j.alias("j"), F.lit(0).alias("r"))).alias("path"), names.alias("names"), b["total"].alias("total"))

        return _let(F.array_min(every), lambda b: F.when(b.isNotNull(), F.array(_let(cuts(b), lambda at: written(b, at)))))

    return _let(F.array(*powers), programme)


def _plain_longest(max_parts: int) -> int:
    """Length up to which every number of :func:`best_plain_split` is exact as a double too."""
    longest = 1
    while (KNOWN * max_parts + 1) * (longest + 2) ** (max_parts - 1) < 2**52 and longest < 10**6:
        longest += 1
    return longest


def split_compounds(
    tokens: DataFrame,
    heads: DataFrame,
    split_rules: Sequence[tuple[str, str, str, str]] = (NO_CHANGE,),
    lemma_rules: DataFrame | None = None,
    manual: DataFrame | None = None,
    segment: Callable[[Column], Column] = T.aksharas,
    max_parts: int = 5,
    keep: int = 4,
    min_score: float = 0.5,
    strict: bool = True,
    count: Callable[[Column], Column] | None = None,
    credits: DataFrame | None = None,
) -> DataFrame:
    """Best splits of every token into two or more parts: ``rank, parts, rules, score``.

    The score is the mean credit of the parts (known 1.0, through a lemma 0.6,
    otherwise 0).  Scores above ``min_score`` are kept (``strict=False``: from).
    Tokens without any known part leave before the arrangement step.  A part but the last
    one has two segments at least; ``count`` counts the segments of a string and comes
    with any ``segment`` of the caller's own.  ``credits`` are those of :func:`part_credits`,
    if they are there already.
    """
    count = count or COUNTERS.get(segment)
    if count is None:
        raise ValueError("a segmenter of your own needs its counter")
    rules = [NO_CHANGE, *[r for r in split_rules if r != NO_CHANGE]]
    words = tokens.select("token").distinct().withColumn("segments", segment(F.col("token"))).filter(F.size("segments") > 1)
    known = heads.select("head").distinct()
    # A longer part cannot be a head, and no rule shortens a part by more than its suffix.
    longest = known.agg(F.max(F.length("head"))).first()[0] or 0
    if lemma_rules is not None:
        longest += lemma_rules.agg(F.max(F.length("suffix"))).first()[0] or 0
    if manual is not None:
        longest = max(longest, manual.agg(F.max(F.length("form"))).first()[0] or 0)
    words = materialised(words, "token")
    parts = candidate_parts(words, rules, longest, segment)
    if not _plain(rules, segment):  # read three times below; plain parts are cheaper to cut again than to keep
        parts = checkpointed(parts)
    if credits is None:
        distinct_parts = parts.select("part").distinct()
        credits = distinct_parts.join(known, F.col("part") == F.col("head"), "left_semi").select("part", F.lit(KNOWN).alias("credit"))
        if lemma_rules is not None or manual is not None:
            lemmas = lemma_candidates(distinct_parts.select(F.col("part").alias("token")), manual, lemma_rules, dedupe=False)
            through = lemmas.join(known, F.col("lemma") == F.col("head"), "left_semi").select(F.col("token").alias("part"), F.lit(VIA_LEMMA).alias("credit"))
            credits = credits.unionByName(through).groupBy("part").agg(F.max("credit").alias("credit"))
    per_word = (
        parts.join(credits.hint("merge"), "part")
        .groupBy("token")
        .agg(F.map_from_entries(F.collect_set(F.struct("part", "credit"))).alias("credit"))
        .join(words.hint("merge"), "token")
    )
    names = F.array(*[F.lit(r[3]) for r in rules])
    best = best_splits(rules, max_parts, keep, count)
    if _plain(rules, segment) and count is F.length and keep == 1 and max_parts > 1:
        best = F.when(F.length("token") <= _plain_longest(max_parts), best_plain_split(max_parts)).otherwise(best)
    # Outer, as Spark works the array of a plain explode out twice: once to drop the empty ones.
    out = per_word.select("token", F.posexplode_outer(best).alias("at", "s")).select(
        "token",
        F.col("at").alias("at"),
        F.col("s.names").alias("parts"),
        F.transform("s.path", lambda p: F.get(names, p["r"])).alias("rules"),
        (F.col("s.total") / (10 * F.col("s.parts"))).alias("score"),
    )
    good = F.col("score") > min_score + 1e-9 if strict else F.col("score") >= min_score - 1e-9
    return out.filter(good).withColumn("rank", F.col("at") + 1).drop("at")


def boundary_candidates(
    words: DataFrame, rules: Sequence[tuple[str, str, str, str]] = (NO_CHANGE,), segment: Callable[[Column], Column] = T.aksharas
) -> DataFrame:
    """``token, cut, left, right, rule``: every inner boundary with every rule that fits it."""
    rules = [NO_CHANGE, *[r for r in rules if r != NO_CHANGE]]
    if _plain(rules, segment):
        size, cut = F.length("token"), F.col("cut")
        places = words.filter(size > 1).select("token", F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"))
        sides = F.substr("token", F.lit(1), cut).alias("left"), F.substr("token", cut + 1, size).alias("right")
        return places.select("token", "cut", *sides, F.lit(NO_CHANGE[3]).alias("rule"))
    cuts = _with_cuts(words.select("token", segment(F.col("token")).alias("segments")), rules).select("token", F.explode("cuts").alias("c"))
    return cuts.select(
        "token",
        F.col("c.at").alias("cut"),
        F.concat(F.substr("token", F.lit(1), F.col("c.off") - F.col("c.drop")), F.col("c.left")).alias("left"),
        F.concat(F.col("c.right"), F.substr("token", F.col("c.off") + 1, F.length("token"))).alias("right"),
        F.col("c.rule").alias("rule"),
    )


def part_credits(heads: DataFrame, lemma_rules: DataFrame | None = None, manual: DataFrame | None = None) -> DataFrame:
    """``part, credit`` in tenths of every string that is a head or leads to one through a rule or the table.

    Made from the heads, one row per head and rule that it may come from, so no word is looked at.
    """
    known = heads.select("head").distinct()
    credits = known.select(F.col("head").alias("part"), F.lit(KNOWN).alias("credit"))
    if lemma_rules is not None:
        rules = F.broadcast(lemma_rules.filter("suffix <> ''"))  # as in lemma_candidates, a rule has an ending
        stem = F.substr("head", F.lit(1), F.length("head") - F.length("replacement"))
        from_rules = known.join(rules, F.endswith("head", "replacement")).select(F.concat(stem, "suffix").alias("part"), "min_len")
        credits = credits.unionByName(from_rules.filter(F.length("part") >= F.col("min_len")).select("part", F.lit(VIA_LEMMA).alias("credit")))
    if manual is not None:
        forms = manual.join(known, F.col("lemma") == F.col("head"), "left_semi")
        credits = credits.unionByName(forms.select(F.col("form").alias("part"), F.lit(VIA_LEMMA).alias("credit")))
    return credits.groupBy("part").agg(F.max("credit").alias("credit"))


def in_two_parts(
    tokens: DataFrame,
    credits: DataFrame,
    min_score: float = 0.5,
    strict: bool = True,
    segment: Callable[[Column], Column] = T.aksharas,
    split_rules: Sequence[tuple[str, str, str, str]] = (NO_CHANGE,),
    max_parts: int = 5,
    **_,
) -> DataFrame:
    """Tokens that two parts with ``credits`` already bring to the score of :func:`split_compounds`.

    A row per cut and two joins, where all splits take a row per part of the word.  Plain cuts
    only; for others no token is given, so all of them are left to :func:`split_compounds`.
    """
    rules = [NO_CHANGE, *[r for r in split_rules if r != NO_CHANGE]]
    if not _plain(rules, segment) or max_parts < 2:
        return tokens.select("token").limit(0)
    cuts = boundary_candidates(tokens.select("token").distinct(), rules, segment).filter(F.length("left") >= 2).select("token", "left", "right")
    both = cuts.join(credits.select(F.col("part").alias("left"), F.col("credit").alias("l")).hint("merge"), "left")
    both = both.join(credits.select(F.col("part").alias("right"), F.col("credit").alias("r")).hint("merge"), "right")
    score = (F.col("l") + F.col("r")) / (2 * KNOWN)
    return both.filter(score > min_score + 1e-9 if strict else score >= min_score - 1e-9).select("token").distinct()


def _own_beginnings(texts: DataFrame, known: DataFrame) -> DataFrame:
    """``text, sizes``: the lengths of the heads (``known.head``) that each text begins with, or is; one row per beginning is looked up."""
    places = texts.select("text", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("i"))
    heads = known.select(F.col("head").alias("start"))
    found = places.withColumn("start", F.substr("text", F.lit(1), F.col("i"))).join(heads.hint("merge"), "start")
    return found.groupBy("text").agg(F.collect_list("i").alias("sizes"))


def known_beginnings(rows: DataFrame, text: Column, known: DataFrame, marks: DataFrame, out: str) -> DataFrame:
    """``rows`` with ``out``, the lengths of the heads that ``text`` begins with, or is; ``text`` is not empty.

    ``marks`` are the :func:`_own_beginnings` of the distinct heads ``known``.  In alphabetic order every head
    that a text begins with is also a beginning of the last head up to it, so a text is one row of a
    sort and no lookup per beginning.  The order is kept inside groups of the same ``GROUP`` first
    characters, which are marks themselves.
    """
    group = lambda c: F.substr(c, F.lit(1), F.lit(GROUP))
    rows = rows.withColumn("__text", text)
    groups = _own_beginnings(rows.select(group(F.col("__text")).alias("text")).distinct(), known)
    marks = marks.unionByName(groups).select(F.col("text").alias("__text"), F.struct("text", "sizes").alias("__mark"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    # Nulls come last, so a mark comes before the equal texts.
    order = Window.partitionBy(group(F.col("__text"))).orderBy("__text", F.col("__mark").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.select(*rows.columns, F.col("__mark").isNull().alias("__row"), F.last("__mark", ignorenulls=True).over(order).alias("__last"))
    fits = F.filter("__last.sizes", lambda i: F.startswith("__text", F.substr("__last.text", F.lit(1), i)))
    none = F.array().cast("array<int>")
    return both.filter("__row").withColumn(out, F.coalesce(fits, none)).drop("__text", "__row", "__last")


def _plain_known_parts(words: DataFrame, heads: DataFrame, depth: int) -> DataFrame:
    """:func:`known_parts` for plain cuts: a row per open string, not per cut, with the lengths of its known sides."""
    size = F.length("token")
    known = heads.select("head").filter(F.length("head") > 0).distinct()
    # The right side has two characters at least and is read from its end.
    known = checkpointed(known)
    ends = known.filter(F.length("head") > 1).select(F.reverse("head").alias("head"))
    marks, end_marks = (checkpointed(_own_beginnings(k.select(F.col("head").alias("text")), k)) for k in (known, ends))

    # A string cut at an earlier level has been followed further than it would be now.
    frontier, seen, found = words.select("token").filter(size >= 4).distinct(), [], []
    for level in range(depth):
        frontier = checkpointed(frontier)
        sides = known_beginnings(frontier, F.substr("token", F.lit(1), size - 2), known, marks, "lefts")
        sides = known_beginnings(sides, F.reverse(F.substr("token", F.lit(2), size - 1)), ends, end_marks, "rights")
        sides = checkpointed(sides.filter((F.size("lefts") > 0) | (F.size("rights") > 0)))
        # Outer, as Spark works the array of a plain explode out twice.
        lefts, rights = (sides.select("*", F.explode_outer(side).alias("n")).filter("n IS NOT NULL") for side in ("lefts", "rights"))
        left, right, rest = F.substr("token", F.lit(1), F.col("n")), F.substr("token", size - F.col("n") + 1, F.col("n")), size - F.col("n")
        found.append(lefts.select(left.alias("head")).unionByName(rights.select(right.alias("head"))).distinct())
        if level + 1 < depth:
            open_rights = lefts.filter((rest >= 4) & ~F.array_contains("rights", rest)).select(F.substr("token", F.col("n") + 1, rest).alias("token"))
            open_lefts = rights.filter((rest >= 4) & ~F.array_contains("lefts", rest)).select(F.substr("token", F.lit(1), rest).alias("token"))
            seen.append(frontier)
            frontier = open_rights.unionByName(open_lefts).distinct()
            for before in seen:
                frontier = frontier.join(before.hint("merge"), "token", "left_anti")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def known_parts(
    words: DataFrame,
    heads: DataFrame,
    split_rules: Sequence[tuple[str, str, str, str]] = (NO_CHANGE,),
    segment: Callable[[Column], Column] = T.aksharas,
    depth: int = 3,
) -> DataFrame:
    """Heads reached by cutting known parts off the words, ``depth`` levels deep.

    A known left part is kept and an unknown right one cut further, and the other
    way round.  Each level works on the distinct open strings only.
    """
    if _plain([NO_CHANGE, *[r for r in split_rules if r != NO_CHANGE]], segment):
        return _plain_known_parts(words, heads, depth)
    known = heads.select("head").distinct()
    frontier, found = words.select("token").distinct(), []
    for level in range(depth):
        cuts = boundary_candidates(frontier.filter(F.length("token") >= 4), split_rules, segment)
        cuts = cuts.filter((F.length("left") >= 1) & (F.length("right") >= 2)).select("left", "right").distinct()
        cuts = cuts.join(known.select(F.col("head").alias("left"), F.lit(True).alias("lk")), "left", "left")
        cuts = cuts.join(known.select(F.col("head").alias("right"), F.lit(True).alias("rk")), "right", "left")
        cuts = checkpointed(cuts.filter(F.col("lk") | F.col("rk")))
        found.append(cuts.filter("lk").select(F.col("left").alias("head")).unionByName(cuts.filter("rk").select(F.col("right").alias("head"))))
        if level + 1 < depth:
            frontier = (
                cuts.filter("rk IS NULL").select(F.col("right").alias("token"))
                .unionByName(cuts.filter("lk IS NULL").select(F.col("left").alias("token")))
                .distinct()
            )
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def characters(c: Column) -> Column:
    """Segments of a script without syllable signs: its characters."""
    return F.filter(F.split(c, ""), lambda x: x != "")


# How to count the segments of a string, by the segmenter that cuts words.
COUNTERS = {characters: F.length, T.aksharas: lambda c: F.size(T.aksharas(c))}
