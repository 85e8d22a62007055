"""Cutting lineage by tables in a folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """Computed once and kept as Parquet in the folder of ``spark.checkpoint.dir`` (a local one only where
    that is unset, as in tests): what follows reads the columns it needs, and partition numbers stay what
    they were if an executor is lost. The table goes when the driver's JVM ends."""
    sc = df.sparkSession.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", "file://" + os.path.join(tempfile.gettempdir(), "checkpoints"))
    at = f"{base.rstrip('/')}/tables-{sc.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(at)
    path = sc._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return df.sparkSession.read.schema(df.schema).parquet(at)
