"""Structured Streaming over an inbox folder; each micro-batch is an import run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.importer import ImportResult, run_import
from ..schema import Schema

FILE_DDL = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, schema: Schema, sink: Callable[[ImportResult, int], None], checkpoint: str, agent: Callable[[Column], Column] | None = None, grammar: str | None = None, once: bool = False, most_files: int = 1000) -> StreamingQuery:
    """``sink`` gets the result and the number of each micro-batch; a batch may be replayed after a
    failure, with the same number."""
    files = spark.readStream.format("binaryFile").schema(FILE_DDL).option("pathGlobFilter", "*.xml").option("maxFilesPerTrigger", most_files).load(folder)

    def batch(rows: DataFrame, number: int) -> None:
        key = F.xxhash64("path")
        docs = rows.select(key.alias("doc_ndx"), "path", key.alias("out_doc_id"), "content").withColumn("agent_id", (agent(F.col("path")) if agent else F.lit(0)).cast("smallint"))
        sink(run_import(docs, schema, grammar), number)

    q = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if once else q).start()
