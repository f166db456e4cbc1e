"""Tables written in the folder that driver and executors share, so that what is used again is computed once and lost executors lose nothing."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame

#: The folder of a single machine, where none is set.
LOCAL = "/tmp/checkpoints"


def written(df: DataFrame, *parts: str) -> DataFrame:
    """``df`` written as Parquet below ``spark.checkpoint.dir`` and read again, in a folder for each value of ``parts``. Unset, which only a single machine allows, it is LOCAL."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = LOCAL
    path = f"{base.rstrip('/')}/tw-{uuid.uuid4().hex}"
    (df.write.partitionBy(*parts) if parts else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
