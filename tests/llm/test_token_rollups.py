import pytest
from pyspark.sql import functions as F

from corpuskit.llm import token_rollups as T


def totals(ledger):
    return sorted((tuple(r) for r in ledger.totals().select("source", "lang", "version", "docs", "tokens").collect()), key=repr)


def batch(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, op string, seq long, source string, lang string, version string, tokens long")


def test_deltas_equal_a_recount(spark, tmp_path):
    ledger, live = T.Ledger(spark, str(tmp_path / "l")), {}
    batches = [
        [(1, "insert", 0, "a", "en", "v1", 10), (2, "insert", 0, "a", "en", "v1", 5), (3, "insert", 0, None, None, "v1", 7), (None, "insert", 0, "a", "en", "v1", 9)],
        [(1, "revise", 0, "a", "en", "v2", 12), (2, "delete", 0, None, None, None, None), (9, "delete", 0, None, None, None, None)],
        [(2, "insert", 1, "b", "fr", "v2", 3), (2, "insert", 2, "b", "fr", "v2", 4), (1, "insert", 0, "c", "en", "v2", 1), (3, "delete", 5, None, None, None, None), (3, "insert", 4, "z", "z", "z", 1)],
        [],
    ]
    for number, rows in enumerate(batches, 1):
        assert ledger.commit(number, batch(spark, rows)) is True
        assert ledger.commit(number, batch(spark, rows)) is False  # sent again
        for doc, op, _, *row in sorted((r for r in rows if r[0] is not None), key=lambda r: r[2]):
            live.pop(doc, None)
            if op != "delete":
                live[doc] = tuple(row)
        want = {}
        for source, lang, version, tokens in live.values():
            docs, total = want.get((source, lang, version), (0, 0))
            want[(source, lang, version)] = (docs + 1, total + tokens)
        assert totals(ledger) == sorted(((*k, *v) for k, v in want.items()), key=repr)
    with pytest.raises(ValueError):
        T.Ledger(spark, str(tmp_path / "l")).commit(0, batch(spark, []))


def test_a_broken_batch_is_not_seen_and_written_anew(spark, tmp_path):
    ledger = T.Ledger(spark, str(tmp_path / "l"))
    ledger.commit(1, batch(spark, [(1, "insert", 0, "a", "en", "v1", 10)]))
    before = totals(ledger)
    # rows of batch 2 written, deltas written without their marker
    batch(spark, [(1, "revise", 0, "a", "en", "v1", 99)]).selectExpr("doc_id", "source", "lang", "version", "tokens", "true AS live").write.parquet(str(tmp_path / "l/rows/batch=2"))
    (tmp_path / "l/deltas/batch=2").mkdir()
    assert totals(ledger) == before
    assert ledger.commit(2, batch(spark, [(1, "revise", 0, "a", "en", "v1", 11)]))
    assert totals(ledger) == [("a", "en", "v1", 1, 11)]


def test_counts_and_odd_documents(spark, odd_docs, no_docs, tmp_path):
    counts = odd_docs.select("doc_id", T.count_tokens(F.col("text"), T.SPACE_WORDS).alias("a"), T.count_tokens(F.col("text"), T.SCRIPT_RUNS).alias("b")).collect()
    assert {(r.doc_id, r.a) for r in counts} >= {(1, 6), (2, 0), (3, 0), (4, 0), (5, 30_000)}
    ledger = T.Ledger(spark, str(tmp_path / "l"))
    ledger.commit(1, T.changes(odd_docs, "insert", T.SPACE_WORDS))
    assert sum(r[3] for r in totals(ledger)) == 7  # ids 1..7, the repeated row once
    ledger.commit(2, T.changes(no_docs, "insert", T.SPACE_WORDS))
    ledger.commit(3, T.changes(odd_docs, "delete"))
    assert totals(ledger) == []
