"""Referential checks; every check returns the rows that violate it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Accepted reviewer specialisations and the shape of a reviewer id.
SPECIALISATIONS = ("vyakarana", "vedanta-advaita", "bilingual-ml-en")
REVIEWER_ID = "^[a-z][a-z0-9-]+$"


def dangling(rows: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key has no target: index documents without unit, chapters without chunk."""
    return rows.join(targets.select(*keys), list(keys), "left_anti")


def link_report(rows: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many rows were checked and how many dangle."""
    marks = targets.select(*keys).distinct().withColumn("found", F.lit(1))
    return rows.join(marks, list(keys), "left").agg(
        F.count("*").alias("checked"), (F.count("*") - F.count("found")).alias("broken")
    )


def verify_gold(forms: DataFrame, reviewers: DataFrame, units: DataFrame, specialisations: Sequence[str] = SPECIALISATIONS, id_shape: str = REVIEWER_ID) -> DataFrame:
    """Violations ``rule, subject`` of a reviewed-forms table.

    ``forms(form_id, form, source, lemma, reviewer, unverified)``,
    ``reviewers(id, specialisation)``, ``units(unit_id)``.
    """
    text = F.col("form_id").cast("string")
    required = forms.filter(
        (F.coalesce("form", F.lit("")) == "") | F.col("source").isNull() | F.col("lemma").isNull()
    ).select(F.lit("required field").alias("rule"), text.alias("subject"))
    signed = forms.filter(~F.coalesce("unverified", F.lit(False)))
    unknown = signed.join(reviewers.select(F.col("id").alias("reviewer")), "reviewer", "left_anti").select(
        F.lit("unknown reviewer").alias("rule"), text.alias("subject")
    )
    lost = forms.filter(F.col("source").isNotNull()).join(units.select(F.col("unit_id").alias("source")), "source", "left_anti").select(
        F.lit("unknown unit").alias("rule"), text.alias("subject")
    )
    person = F.col("id").cast("string").alias("subject")
    twice = reviewers.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate reviewer").alias("rule"), person)
    shape = reviewers.filter(~F.col("id").cast("string").rlike(id_shape)).select(F.lit("reviewer id").alias("rule"), person)
    field = reviewers.filter(~F.coalesce(F.col("specialisation").isin(*specialisations), F.lit(False))).select(
        F.lit("specialisation").alias("rule"), person
    )
    out = required
    for more in (unknown, lost, twice, shape, field):
        out = out.unionByName(more)
    return out
