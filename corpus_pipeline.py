"""Documents made ready for training: five stages, each a job of its own.

Every stage works on all rows that the one before it kept; rows pass between
stages as Parquet.  All stages but the last return the columns of ``documents``.

Every stage takes rows with a null text as empty ones, keeps columns that it
doesn't know, and gives no rows for an empty table.  Rows are kept or dropped,
not doc_ids: rows with a null or repeated doc_id are rows of their own, and of a
group the row with the least doc_id stays (a null one last; among equal ones any,
always one).  Texts of any length are worked on whole.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm import common, exact_dedup, ngram_join, packing, pii, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that failed."""
    return _unfolded(docs, quality.quality(_folded(docs)).filter("kept"), F.col("clean_text"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text."""
    rows, row = common.numbered(docs, "doc_id")
    return _first_of_each(docs, rows, row, exact_dedup.once(rows, row).filter("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates."""
    rows, row = common.numbered(docs, "doc_id")
    return _first_of_each(docs, rows, row, ngram_join.near_duplicates(rows, key=row).filter("doc_id = component_id"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets replaced."""
    return _unfolded(docs, pii.replaced(_folded(docs), pii.secret(spark)), F.col("text"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, or pieces of long ones, packed into sequences."""
    return packing.best_fit(docs, packing.n_words())


def _folded(docs: DataFrame) -> DataFrame:
    """The text, and all other columns in one, so that none has a name that an
    operator gives to a column of its own."""
    return docs.select("text", F.struct(F.lit(0).alias("text"), *(c for c in docs.columns if c != "text")).alias(_CARRIED))


def _unfolded(docs: DataFrame, rows: DataFrame, text: Column) -> DataFrame:
    """The columns of ``docs`` with the new ``text``, and n_chars to go with it."""
    own = lambda c: F.char_length(text).cast("long") if c == "n_chars" else F.col(_CARRIED)[c]
    return rows.select(*((text if c == "text" else own(c)).alias(c) for c in docs.columns))


_CARRIED = "_carried"


def _first_of_each(docs: DataFrame, rows: DataFrame, row: str, first: DataFrame) -> DataFrame:
    """The ``rows`` whose number is the doc_id of ``first``.  The join has one way at
    every size; numbers are distinct, so none is skewed."""
    keep = first.select(F.col("doc_id").alias(row))
    return rows.join(keep.hint("merge"), row, "left_semi").select(docs.columns)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact), ("ngram_join", near), ("pii", private), ("packing", packed)]

#: PII's surrogates come from a keyed digest, which SQL can't express.  Tests hold
#: the dedup stages against brute force, and the others against their operators,
#: which have SQL or a brute-force test of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.  What a stage wrote on the way to its rows goes
    when these are written."""
    docs = common.documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = common.finished(spark, partial(stage, spark, docs, sf_dir))
    return docs
