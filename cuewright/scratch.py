"""Tables that an operator writes and reads again, in the folder that the cluster shares.

That is the folder in ``spark.checkpoint.dir``. One is chosen here only where that setting is empty and driver and
executors are one process, as in tests; elsewhere an empty setting is an error.
"""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="cuewright-")


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application under ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _own_dir()
    return f"{base.rstrip('/')}/cuewright/{spark.sparkContext.applicationId}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and read back where executors are lost."""
    path = f"{scratch_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
