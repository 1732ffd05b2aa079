"""What the operators of this subpackage share: scratch tables, row sizing, digests.

Scratch tables go to the folder in ``spark.checkpoint.dir``, the only place that the driver and
all executors see. A folder is chosen here only where that setting is empty and driver and
executors are one process, as in tests; elsewhere an empty setting is an error.
"""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_BATCH = 512
BYTES_PER_BATCH = 16 << 20


@functools.cache
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="cuewright-")


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application under ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _local_dir()
    return f"{base.rstrip('/')}/cuewright/{spark.sparkContext.applicationId}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: a cut in the lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = ROWS_PER_BATCH) -> None:
    """Bound the rows and bytes that one Arrow batch hands to Python, but for a single longer row.

    Spark reads these settings when the query runs, so they stay set in the caller's session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables. Results that still read them must have been written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
