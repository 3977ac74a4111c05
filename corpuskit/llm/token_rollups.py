"""Token totals by source, language and tokenizer version, maintained by signed deltas.

A batch of changes inserts, deletes or revises documents.  The rows that the changed documents
had before give negative deltas, their new rows positive ones; only the summed deltas are
added to the totals, nothing is recounted.  A ledger folder holds, per batch, the new rows of
the changed documents and the deltas.  Writing the deltas is the commit: their ``_SUCCESS``
file appears last, readers look at committed batches only, a batch that is sent again after it
committed changes nothing, and one that broke off is written anew.  Batches come in rising
order of their ids.

Defined cases: a null text has 0 tokens; null source, language or version are groups of their
own; changes without a doc_id are left out, as nothing could refer to them; of several changes
of one document in a batch the one with the largest ``seq`` counts (ties: the larger op, then
the larger count); inserting a document that exists revises it, deleting one that does not
changes nothing; other columns are ignored; an empty batch commits and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = ("source", "lang", "version")
ROW = "doc_id long, source string, lang string, version string, tokens long, live boolean"
DELTA = "source string, lang string, version string, docs long, tokens long"

# Rule tokenizers by version name; a count column of any other tokenizer may be used instead.
SPACE_WORDS = "space-1"
SCRIPT_RUNS = "runs-2"


def count_tokens(text: Column, version: str) -> Column:
    """Number of tokens: white-space words, or runs of letters, of digits and of other signs."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    if version == SPACE_WORDS:
        return F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")).cast("long")
    return F.size(F.regexp_extract_all(text, F.lit(r"\p{L}+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{N}]+"), F.lit(0))).cast("long")


def changes(docs: DataFrame, op: str, version: str | None = None) -> DataFrame:
    """``docs`` as a batch of changes of one kind: insert, revise or delete."""
    tokens = count_tokens(F.col("text"), version) if version else F.lit(None).cast("long")
    columns = [F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("source", "lang")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(op).alias("op"), F.lit(0).cast("long").alias("seq"), *columns, F.lit(version).cast("string").alias("version"), tokens.alias("tokens"))


class Ledger:
    """The ledger in folder ``root``, which all executors must share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def committed(self) -> list[int]:
        """Ids of the committed batches, rising."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/deltas/batch=*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found or [])

    def _read(self, part: str, schema: str) -> DataFrame:
        batches = [(b, f"{self.root}/{part}/batch={b}") for b in self.committed()]
        if not batches:
            return self.spark.createDataFrame([], schema + ", batch long")
        return self.spark.read.schema(schema + ", batch long").option("basePath", f"{self.root}/{part}").parquet(*(p for _, p in batches))

    def current(self, doc_ids: DataFrame | None = None) -> DataFrame:
        """The live row of every document, or of those in ``doc_ids``."""
        rows = self._read("rows", ROW)
        if doc_ids is not None:
            rows = rows.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
        fields = [c.split()[0] for c in ROW.split(", ")][1:]
        last = rows.groupBy("doc_id").agg(F.max_by(F.struct(*fields), "batch").alias("r"))
        return last.select("doc_id", "r.*").filter("live").drop("live")

    def commit(self, batch: int, batch_changes: DataFrame) -> bool:
        """Apply a batch once; False if it was committed before."""
        done = self.committed()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after committed batch {done[-1]}")
        fields = ("op", "tokens", "source", "lang", "version")
        last = batch_changes.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max_by(F.struct(*fields), F.struct("seq", *fields)).alias("c"))
        last = last.select("doc_id", "c.*")
        new = last.select("doc_id", *GROUP, F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), (F.col("op") != "delete").alias("live"))
        rows_path = f"{self.root}/rows/batch={batch}"
        new.write.mode("overwrite").parquet(rows_path)
        written = self.spark.read.schema(ROW).parquet(rows_path)  # the deltas follow what was written, also after a retry
        before = self.current(written) if done else self.spark.createDataFrame([], ROW).drop("live")
        signed = before.select(*GROUP, F.lit(-1).alias("docs"), (-F.col("tokens")).alias("tokens"))
        signed = signed.unionByName(written.filter("live").select(*GROUP, F.lit(1).alias("docs"), "tokens"))
        deltas = signed.groupBy(*GROUP).agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens"))
        deltas.write.mode("overwrite").parquet(f"{self.root}/deltas/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, version, docs and tokens of the groups that hold documents."""
        deltas = self._read("deltas", DELTA)
        sums = deltas.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.filter("docs <> 0 OR tokens <> 0")


ORACLE_SQL = r"""
WITH gone AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0)
SELECT source, lang, 'runs-2' AS version, count(*)::BIGINT AS docs,
  sum(len(regexp_extract_all(coalesce(text, ''), '\p{L}+|\p{N}+|[^\x20\x09-\x0D\p{L}\p{N}]+')))::BIGINT AS tokens
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM gone) GROUP BY source, lang
"""
