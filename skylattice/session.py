"""The session that the library expects: UTC, ANSI, adaptive execution."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A side of a join is broadcast only if Spark's own estimate of it is below this.
BROADCAST_BYTES = 64 << 20


def session(name: str = "skylattice", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    }
    return builder.config(map=defaults | conf).getOrCreate()


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; huge where it knows nothing."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it is estimated below ``limit``; beyond it
    the join is left to the optimizer, which shuffles."""
    return df.hint("broadcast") if estimated_bytes(df) < limit else df


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, on one
    machine, a temporary one that goes with the process."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="grid-")
        atexit.register(shutil.rmtree, base, True)
        base = f"file://{base}"
    return f"{base}/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to a scratch folder, which goes when the application ends, and read back."""
    spark, path = df.sparkSession, scratch_folder(df.sparkSession)
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.parquet(path)
