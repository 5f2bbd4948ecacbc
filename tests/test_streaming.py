"""The stream gives what the batch gives, over several files one by one."""

from pyspark.sql import functions as F

from skylattice.operators import accum
from skylattice.streaming.increments import stream_increments


def test_stream_as_batch(spark, tmp_path):
    rows = [(c, f"2024-01-01 {h:02d}:00:00", float(h * h + c)) for c in (1, 2, 3) for h in range(9)]
    df = spark.createDataFrame(rows, "cell int, time string, total double").withColumn("time", F.col("time").cast("timestamp"))
    for k in range(3):
        df.filter(F.floor(F.hour("time") / 3) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stream_increments(stream, ["cell"], "time", "total").writeStream.format("memory").queryName("increments").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r.cell, r.time): r.increment for r in spark.table("increments").collect()}
    want = {(r.cell, r.time): r.increment for r in accum.increments(df, F.col("total"), ["cell"], ["time"], "increment").collect()}
    assert {*got} == {*want}
    assert all((got[k] is None or got[k] != got[k]) if v is None else got[k] == v for k, v in want.items())
