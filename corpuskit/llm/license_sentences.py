"""License scan by sentences, in DataFrame expressions only.

A text is normalised with its line and sentence breaks marked.  A known license sentence is
found where its words stand between two marks; marks inside it do not matter, so hard-wrapped
texts and sentences with breaks of their own ("free software: you", "v. 2.0") are found too.
The identifiers found, in text order, are matched against ordered rules: a rule names a
license and the consecutive identifiers that make it.  Earlier rules go first, and what a rule
matched is consumed, so a full license text is one license and not also its parts.

Everything is done row by row, without a shuffle; texts of any length and hot sources cost
what their length costs.

Defined cases: a null or empty text has no sentences; known sentences that no rule uses up are
counted as ``unmatched``; repeated rows are scanned one by one; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised sentences of published license texts and notices, with their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache-2.0-notice",
    "licensed under the apache license version 2 0 the license": "apache-2.0-notice",
    "you may not use this file except in compliance with the license": "apache-compliance",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-copy",
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "this project is licensed under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-condition",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0-notice",
    "licensed under the gnu general public license version 3": "gpl-3.0-notice",
    "licensed under the gnu general public license version 2": "gpl-2.0-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3.0-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-2.0-grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "see the gnu general public license for more details": "gpl-details",
    "you should have received a copy of the gnu general public license along with this program": "gpl-copy",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0-notice",
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
    "licensed under cc by 4 0": "cc-by-4.0-notice",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0-notice",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0-notice",
    "licensed under cc by nd 4 0": "cc-by-nd-4.0-notice",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0-notice",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-4.0-notice",
    "all rights reserved": "all-rights-reserved",
}

# Rules in order, license and its consecutive sentences.
RULES = [
    ("Apache-2.0", ["apache-2.0-notice", "apache-compliance", "apache-copy"]),
    ("Apache-2.0", ["apache-2.0-notice", "apache-compliance"]),
    ("MIT", ["mit-grant", "mit-condition", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-condition"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later", ["gpl-3.0-grant", "gpl-warranty", "gpl-details", "gpl-copy"]),
    ("GPL-2.0-or-later", ["gpl-2.0-grant", "gpl-warranty", "gpl-details", "gpl-copy"]),
    ("GPL-3.0-or-later", ["gpl-3.0-grant"]),
    ("GPL-2.0-or-later", ["gpl-2.0-grant"]),
    ("GPL-3.0-only", ["gpl-3.0-notice"]),
    ("GPL-2.0-only", ["gpl-2.0-notice"]),
    ("Apache-2.0", ["apache-2.0-notice"]),
    ("MIT", ["mit-notice"]),
    ("ISC", ["isc-grant"]),
    ("MPL-2.0", ["mpl-2.0-notice"]),
    ("Unlicense", ["unlicense-grant"]),
    ("CC-BY-4.0", ["cc-by-4.0-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4.0-notice"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4.0-notice"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-4.0-notice"]),
    ("Proprietary", ["all-rights-reserved"]),
]

BREAK = r"\n|[.!?;:]+[\x20\x09-\x0D]+"


def marked(text: Column) -> Column:
    """Lower-case letters and digits, a bar for every run with a break, everything else as single spaces."""
    bars = F.regexp_replace(F.regexp_replace(F.lower(text), BREAK, "|"), r"[^a-z0-9|]+", " ")
    return F.trim(F.regexp_replace(bars, r" ?\|[ |]*", "|"))


def pattern(sentences: dict[str, str]) -> str:
    """One of the sentences between two breaks, the longest first."""
    words = sorted(sentences, key=lambda s: (-len(s), s))
    return "(?<![^|])(" + "|".join(s.replace(" ", "[ |]") for s in words) + ")(?![^|])"


def scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """Per row: doc_id, sentence_ids (in text order), licenses (in rule order, each once) and unmatched, the known sentences left over."""
    known = F.create_map(*(F.lit(x) for pair in sentences.items() for x in pair))
    found = F.regexp_extract_all(marked(F.col("text").cast("string")), F.lit(pattern(sentences)), F.lit(1))
    ids = F.transform(found, lambda x: F.element_at(known, F.replace(x, F.lit("|"), F.lit(" "))))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(ids, F.array().cast("array<string>")).alias("ids"))
    # <id> per sentence; a consumed run becomes "|", so that its neighbours do not meet.
    left = F.array_join(F.transform("ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")
    df = df.withColumn("left0", left)
    found = []
    for i, (license_id, parts) in enumerate(rules):
        run = "".join(f"<{p}>" for p in parts)
        found.append(F.when(F.col(f"left{i}").contains(run), F.lit(license_id)))
        df = df.withColumn(f"left{i + 1}", F.replace(F.col(f"left{i}"), F.lit(run), F.lit("|")))
    rest = F.col(f"left{len(rules)}")
    return df.select(
        "doc_id",
        F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join(F.array_distinct(F.array_compact(F.array(*found))), ",").alias("licenses"),
        (F.length(rest) - F.length(F.replace(rest, F.lit("<"), F.lit("")))).cast("long").alias("unmatched"),
    )


def oracle_sql() -> str:
    """The scan in SQL for sentences that stand whole between two breaks: sentences as rows, rules as nested replacements."""
    values = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    steps, cases, prev = [], [], "s0"
    for i, (license_id, parts) in enumerate(RULES):
        run = "".join(f"<{p}>" for p in parts)
        steps.append(f"s{i + 1} AS (SELECT *, replace(x{i}, '{run}', '|') AS x{i + 1} FROM {prev})")
        cases.append(f"CASE WHEN contains(x{i}, '{run}') THEN '{license_id}' END")
        prev = f"s{i + 1}"
    return rf"""
WITH known(sentence, id) AS (VALUES {values}),
p AS (SELECT rid, i, parts[i] AS part FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM
  (SELECT row_number() OVER () AS rid, string_split_regex(text, '\n|[.!?;:]+[\x20\x09-\x0D]+') AS parts FROM documents))),
hit AS (SELECT rid, string_agg(id, ',' ORDER BY i) AS ids, string_agg('<' || id || '>', '' ORDER BY i) AS x
  FROM p JOIN known ON sentence = trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g')) GROUP BY rid),
s0 AS (SELECT doc_id, coalesce(ids, '') AS sentence_ids, coalesce(x, '') AS x0
  FROM (SELECT row_number() OVER () AS rid, doc_id FROM documents) d LEFT JOIN hit USING (rid)),
{", ".join(steps)}
SELECT doc_id, sentence_ids, coalesce(array_to_string(list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(list_filter([{", ".join(cases)}], lambda c: c IS NOT NULL), lambda c: [c])),
  lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END), ','), '') AS licenses,
  (length({f"x{len(RULES)}"}) - length(replace({f"x{len(RULES)}"}, '<', '')))::BIGINT AS unmatched FROM {prev}
"""
