"""Exact dedup against a persistent digest index.

The index has its digests in tables bucketed and sorted by digest.  A batch of new
rows is reduced to one row for each digest, sort-merge anti-joins against the
index find digests not seen before, and those are appended.  Digests, not texts,
are shuffled; of the index nothing is shuffled or sorted.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: With it, a scan of buckets of one sorted file each counts as sorted.
IN_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"

def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), common.SPACE_CLASS + "+", " ")


class DigestIndex:
    """Rows (digest binary, keep_id long, batch string) in segments: a table for each
    batch, bucketed and sorted by digest, with one file in each bucket, and each
    digest in one segment only.  Joins on the digest leave segments where they are
    and read them in their order: only the batch is moved and sorted.

    Segment ``name_a_z`` has batches number a to z.  A table gets into the catalog
    when its files are whole, and a segment within another's range doesn't count, so
    an append or a compaction that breaks off anywhere leaves the index as it was or
    as it should be.  One writer at a time.
    """

    #: Segments after which they are merged into one.
    COMPACT_AFTER = 8

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int | None = None):
        """Opens the index ``name``, and makes an empty one below ``path`` if the
        catalog has none.  ``path`` and ``buckets`` count for a new one only."""
        self.spark, self.name, self.path = spark, name, path
        self.buckets = buckets or common.partitions(spark)
        there = self._ranges()
        if there:
            detail = self._detail(self._table(*there[0]))
            self.buckets, self.path = int(detail["Num Buckets"]), detail["Location"].rpartition("/")[0]
            self._clean()
        else:
            self._write(spark.createDataFrame([], "digest binary, keep_id long, batch string"), 0, 0)

    def _table(self, a: int, z: int) -> str:
        return f"{self.name}_{a}_{z}"

    def _detail(self, table: str) -> dict[str, str]:
        return {r.col_name: r.data_type for r in self.spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}

    def _ranges(self) -> list[tuple[int, int]]:
        """The ranges of all tables of this index: at most some more than ``COMPACT_AFTER``."""
        base, _, table = self.name.rpartition(".")
        found = self.spark.sql(f"SHOW TABLES{f' IN {base}' if base else ''} LIKE '{table}_*'").collect()
        ends = (re.fullmatch(rf"{re.escape(table)}_(\d+)_(\d+)", r.tableName, re.I) for r in found)
        return sorted((int(m[1]), int(m[2])) for m in ends if m)

    def segments(self) -> list[tuple[int, int]]:
        """The ranges that count, in order: those that aren't within another."""
        out: list[tuple[int, int]] = []
        for a, z in sorted(self._ranges(), key=lambda r: (r[0], -r[1])):
            if not out or z > out[-1][1]:
                out.append((a, z))
        return out

    def _tables(self) -> list[DataFrame]:
        return [self.spark.table(self._table(*r)) for r in self.segments()]

    def _write(self, rows: DataFrame, a: int, z: int) -> None:
        out = rows.write.bucketBy(self.buckets, "digest").sortBy("digest").format("parquet")
        # A folder of its own, as one that broke off may have left files.
        out.option("path", f"{self.path}/{self.name}_{uuid.uuid4().hex}").saveAsTable(self._table(a, z))

    def append(self, rows: DataFrame) -> None:
        """Adds a segment of rows that lie by digest in ``buckets`` partitions."""
        number = self.segments()[-1][1] + 1
        self._write(rows, number, number)

    def rows(self) -> DataFrame:
        return reduce(DataFrame.union, self._tables())

    def _remove(self, table: str) -> None:
        location = self._detail(table)["Location"]
        self.spark.sql(f"DROP TABLE {table}")
        common.remove(self.spark, location)

    def _clean(self) -> None:
        """Removes segments that another one took the place of."""
        for r in {*self._ranges()} - {*self.segments()}:
            self._remove(self._table(*r))

    def drop(self) -> None:
        """Removes the index; results of ``dedup`` stay."""
        for r in self._ranges():
            self._remove(self._table(*r))

    def compact(self) -> None:
        """Writes all segments as one, then removes them."""
        own = self.segments()
        if len(own) > 1:
            self._write(self.rows().repartition(self.buckets, "digest").sortWithinPartitions("digest"), own[0][0], own[-1][1])
        self._clean()

    def dedup(self, docs: DataFrame, batch: str, key: str = "doc_id", text: str = "text") -> DataFrame:
        """Each row of ``docs`` with keep_id, group_size, kept and text_sha256.

        Texts are equal when they are after each run of ASCII white space became
        one space; a null counts as empty.  Of equal texts in the batch the least
        ``key`` stays, unless an earlier batch has the text: then keep_id is that
        batch's, and no row stays.  group_size counts the batch's equal rows.
        Rows with the same key and text are counted each and all say kept; a null
        key sorts before none and stays only if its whole group has null keys.
        An empty table gives no rows and appends nothing.  Other columns aren't
        carried, so their names don't matter.  A text of any length is hashed
        within its row.  A batch that is given again after its append (``batch``
        is the same) gets the same result, and nothing is appended twice.
        """
        with common.setting(self.spark, IN_ORDER, "true"):
            return common.finished(self.spark, lambda: self._dedup(docs, batch, key, text))

    def _dedup(self, docs: DataFrame, batch: str, key: str, text: str) -> DataFrame:
        digests = common.staged(docs.select(F.col(key).alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text)), 256)).alias("digest")))
        groups = digests.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("group_size"))
        groups = common.staged(groups.repartition(self.buckets, "digest").sortWithinPartitions("digest"))
        self.append(self.fresh(groups, batch))
        known = self.known(groups)
        # A text that stands alone needs no look-up of its group: fewer rows meet in the join below.
        shared = common.staged(known.filter((F.col("group_size") > 1) | (F.col("batch") != batch)))
        # Both sides are shuffled afresh, so Spark can split a digest that many rows share.
        out = digests.join(shared.hint("merge"), "digest", "left")
        new = F.coalesce(F.col("batch"), F.lit(batch)) == batch
        keep = F.when(F.col("batch").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
        out = out.select(
            "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
            (new & keep.eqNullSafe(F.col("doc_id"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
        )
        out = common.staged(out)
        if len(self.segments()) > self.COMPACT_AFTER:
            self.compact()
        return out

    def fresh(self, groups: DataFrame, batch: str) -> DataFrame:
        """Rows to append: the batch's digests that no batch, this one included, has.
        Of segments only digests are read; the batch keeps its order from join to join."""
        new = groups.select("digest", F.col("first_id").alias("keep_id")).repartition(self.buckets, "digest")
        for segment in self._tables():
            new = new.join(segment.select("digest").hint("merge"), "digest", "left_anti")
        return new.withColumn("batch", F.lit(batch)).sortWithinPartitions("digest")

    def known(self, groups: DataFrame) -> DataFrame:
        """What the index has of the batch's digests, now that they are in it."""
        out, at = groups.select("digest", "group_size").repartition(self.buckets, "digest"), range(len(self.segments()))
        for n, segment in enumerate(self._tables()):
            out = out.join(segment.toDF("digest", f"keep_{n}", f"batch_{n}").hint("merge"), "digest", "left")
        # A digest is in one segment, so the others' values are null.
        keep, batch = (F.coalesce(*(F.col(f"{c}_{n}") for n in at)) for c in ("keep", "batch"))
        return out.select("digest", "group_size", keep.alias("keep_id"), batch.alias("batch")).filter("batch IS NOT NULL")


def new_index(spark: SparkSession) -> DigestIndex:
    """An index of its own, in scratch space."""
    return DigestIndex(spark, f"digests_{uuid.uuid4().hex}", common.scratch_dir(spark))


def once(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """As ``dedup``, by an index that only this call has."""
    index = new_index(docs.sparkSession)
    try:
        return index.dedup(docs, "once", key)
    finally:
        index.drop()


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` as the first batch of a new index."""
    return once(common.documents(spark, sf_dir))


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
