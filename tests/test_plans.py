"""The plans of the big jobs: no Cartesian product, no row-at-a-time Python, pruned scans."""

import pytest

import __spark_entry__ as entry

HEAVY = ["token_freq", "volume_rollup", "glosses_top10", "search_ranked", "nearest_heads", "meanings_order", "resolve_refs", "best_window", "intro_islands", "reduce_report", "compound_splits", "follow_neighbourhood"]


def plan(spark, sf, name):
    return entry.queries()[name](spark, sf)._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", HEAVY)
def test_no_cartesian_and_no_row_python(spark, sf, name):
    text = plan(spark, sf, name)
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text


@pytest.mark.parametrize("name", ["compound_splits", "resolve_layers"])
def test_splits_stay_in_the_jvm(spark, sf, name):
    assert "Python" not in plan(spark, sf, name)


def test_scan_is_pruned(spark, sf):
    text = plan(spark, sf, "token_freq")
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text or "ReadSchema: struct<text:string>" in text


def test_scope_filter_reaches_the_scan(spark, sf):
    text = plan(spark, sf, "link_check")
    assert "EqualTo(lang,en)" in text


def test_every_query_has_a_name_and_a_reader():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) > 80


def test_entry_runs(spark):
    assert entry.entry(spark).limit(5).count() == 5
