"""Echo removal asks for Arrow batches that are bounded in rows and bytes."""

import pandas as pd
from pyspark.sql import functions as F

from cuewright.functions import text as X


def test_batches_are_bounded(spark):
    for key in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{key}")

    @F.pandas_udf("struct<rows:long,bytes:long>")
    def sizes(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"rows": [len(texts)] * len(texts), "bytes": [int(texts.str.len().sum())] * len(texts)})

    docs = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("abcdefgh"), F.when(F.col("id") < 1500, 1).otherwise(6000)).alias("text"))
    X.collapse_repeats("text")
    got = docs.select(sizes("text").alias("s")).agg(F.max("s.rows"), F.max("s.bytes")).first()
    assert got[0] <= 512 and got[1] <= 5 << 20
