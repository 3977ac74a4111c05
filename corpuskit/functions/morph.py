"""Morphological features from a free-text inflection label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that name a feature's values; of several named values the one
# listed first counts.  A word with a full stop counts only with it.
VOCABULARY = {
    "lakara": [
        ("lit", ["perf.", "perfect"]),
        ("lrt", ["fut.", "future"]),
        ("lat", ["pres.", "present"]),
        ("lot", ["impv.", "imperative"]),
        ("lan", ["impf.", "imperfect"]),
        ("lun", ["aor.", "aorist"]),
        ("vidhi-lin", ["opt.", "optative"]),
    ],
    "purusha": [(n, [f"{n}{end}" for end in ("", ordinal, "p", "per", "person", "sg", "pl")]) for n, ordinal in ((1, "st"), (2, "nd"), (3, "rd"))],
    "vacana": [
        ("eka", ["sg", "sing", "singular", "1sg", "2sg", "3sg"]),
        ("dvi", ["dual", "du", "1du", "2du", "3du"]),
        ("bahu", ["pl", "plural", "1pl", "2pl", "3pl"]),
    ],
    "vibhakti": [(n, [name]) for n, name in ((1, "nom."), (8, "voc."), (2, "acc."), (3, "instr."), (4, "dat."), (5, "abl."), (6, "gen."), (7, "loc."))],
    "linga": [("m", ["masc.", "m", "m-stem"]), ("f", ["fem.", "feminine", "f", "f-stem"]), ("n", ["neut.", "n", "n-stem"])],
}
# Stems of nouns that are masculine where no gender is named.
MASCULINE_STEMS = ["a-stem", "i-stem", "u-stem"]
# What a form needs to be complete, by the feature that makes it a verb or a noun.
NEEDS = {"lakara": ["purusha", "vacana"], "vibhakti": ["vacana"]}


def morph_features(label: Column) -> Column:
    """``struct(lakara, purusha, vacana, vibhakti, linga)``, or null where the label is not enough."""
    words = F.filter(F.split(F.lower(label), r"[^\p{L}\p{N}.-]+"), lambda w: w != "")
    words = F.array_union(words, F.transform(words, lambda w: F.rtrim(w, F.lit("."))))
    names = lambda some: F.arrays_overlap(words, F.array(*map(F.lit, some)))
    found = {feature: F.coalesce(*(F.when(names(some), F.lit(value)) for value, some in values)) for feature, values in VOCABULARY.items()}
    found["linga"] = F.coalesce(found["linga"], F.when(found["vibhakti"].isNotNull() & names(MASCULINE_STEMS), F.lit("m")))
    complete = F.coalesce(*(value.cast("string") for value in found.values())).isNotNull()
    for feature, needed in NEEDS.items():
        for other in needed:
            complete &= found[feature].isNull() | found[other].isNotNull()
    return F.when(complete, F.struct(*(value.alias(feature) for feature, value in found.items())))
