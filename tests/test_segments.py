"""Increments by segments: no task has more than its share of the rows."""

from pyspark.sql import functions as F

from skylattice.plans import driver_queries


def test_tasks_hold_a_share_of_the_rows(spark, sf_dir, monkeypatch):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    monkeypatch.setattr(driver_queries, "SEGMENT_ROWS", rows // 10, raising=False)
    out = driver_queries.queries()["W1_J4_segments"](spark, sf_dir)
    held = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == rows and max(held) < rows / 4
