"""Blocks of transactions and their documents.

Numbers within a drain come from a range partitioning by drain and id: a count per drain and
partition, offsets over those counts, and a running number within each partition. So a drain that
holds a third of all rows is many tasks, not one window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ExportError
from .shared import stored

HEADER_BYTES = 2048


def check_config(drains: list[dict] | DataFrame, threads: int = 1) -> None:
    """Drains need a row and a positive block size each; there must be a worker."""
    rows = drains.collect() if isinstance(drains, DataFrame) else drains
    if not rows:
        raise ExportError("invalid_config", "no drains")
    if threads < 1:
        raise ExportError("invalid_config", "no worker threads")
    for r in rows:
        if r["max_doc_txn"] is None or r["max_doc_txn"] < 1:
            raise ExportError("invalid_config", f"drain {r['drain_id']}: at most {r['max_doc_txn']} transactions a document")


def plan_blocks(transactions: DataFrame, drains: DataFrame, order: tuple[str, ...] = ("id",)) -> DataFrame:
    """``transactions`` (drain_id, ``order`` and more) with block (from 0), ndx (from 1 in the block), doc_id
    (after the drain's ``existing`` documents) and total (blocks of the drain).

    ``drains``: drain_id, name, max_doc_txn, existing. Transactions of other drains are left out.
    """
    t = transactions.join(drains, "drain_id")
    dealt = stored(t.repartitionByRange("drain_id", *order).sortWithinPartitions("drain_id", *order).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy("drain_id", "_part").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("drain_id").orderBy("_part")  # a row for each drain and partition
    sums = sums.select("drain_id", "_part", (F.sum("_n").over(w) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy("drain_id")).alias("_all"))
    within = Window.partitionBy("drain_id", "_part").orderBy(*order)
    at = F.col("_before") + F.row_number().over(within) - 1
    out = dealt.join(sums, ["drain_id", "_part"]).withColumn("_at", at)
    size = F.col("max_doc_txn")
    return out.select(
        *transactions.columns, "name", F.floor(F.col("_at") / size).cast("long").alias("block"), (F.col("_at") % size + 1).cast("long").alias("ndx"),
        (F.col("existing") + F.floor(F.col("_at") / size) + 1).cast("long").alias("doc_id"), F.ceil(F.col("_all") / size).cast("long").alias("total"),
    )


def initial_future_doc_count(n: Column, max_doc_txn: Column) -> Column:
    """The planning estimate: one too many on exact multiples."""
    return F.floor(n / max_doc_txn) + 1


def document_name(prefix: str, run_id: int, extension: str = "xml", with_total: bool = True) -> Column:
    """prefix-run-drain-block-total.extension; the total is 0 unless ``with_total``."""
    return F.format_string(f"{prefix}-{run_id}-%s-%02d-%02d.{extension}", F.col("name"), F.col("doc_id"), F.col("total") if with_total else F.lit(0))


def render_documents(planned: DataFrame, transaction: Callable[[], Column], name: Column, header: Column | None = None, footer: Column | None = None, header_limit: int | None = None) -> DataFrame:
    """A row per document: drain_id, doc_id, doc_name, n_txn, content.

    ``transaction``: text of a row, which has ndx. ``header`` and ``footer`` see drain_id, name, doc_id,
    block, total and n_txn; by default empty. A group is one block, so its size is bounded.
    """
    keys = ["drain_id", "name", "doc_id", "block", "total"]
    text = planned.select(*keys, "ndx", transaction().alias("_xml"))
    missing = F.raise_error(F.concat(F.lit("[prepare_transaction_failed] document "), F.col("doc_id").cast("string")))
    text = text.withColumn("_xml", F.when(F.col("_xml").isNull(), missing).otherwise(F.col("_xml")))
    docs = text.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ndx", "_xml"))).alias("_txns"), F.count("*").alias("n_txn"))
    top = header if header is not None else F.lit("")
    if header_limit:
        docs = docs.withColumn("_top", top)
        top = F.when(F.octet_length("_top") > header_limit, F.raise_error(F.lit(f"[prepare_header_failed] header over {header_limit} bytes"))).otherwise(F.col("_top"))
    body = F.array_join(F.transform("_txns", lambda x: x["_xml"]), "")
    return docs.select("drain_id", "doc_id", name.alias("doc_name"), "n_txn", F.concat(top, body, footer if footer is not None else F.lit("")).alias("content"))


def export_totals(documents: DataFrame) -> DataFrame:
    return documents.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n_txn"), F.lit(0)).cast("long").alias("transactions"))


def per_drain(documents: DataFrame) -> DataFrame:
    return documents.groupBy("drain_id").agg(F.count("*").alias("documents"), F.sum("n_txn").cast("long").alias("transactions"))
