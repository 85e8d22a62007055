"""An export run: plan blocks, render, publish, and return the manifest."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from ..errors import ExportError
from ..operators.export import check_config, document_name, plan_blocks, render_documents
from ..operators.shared import stored
from ..sources.publish import PublishSource


@dataclass(frozen=True)
class Qualifiers:
    """What a whole run knows."""

    run_id: int = 1
    prefix: str = "doc"
    extension: str = "xml"


def run_export(
    transactions: DataFrame, drains: DataFrame, folder: str, transaction: Callable[[], Column], header: Column | None = None, footer: Column | None = None,
    qualifiers: Qualifiers = Qualifiers(), order: tuple[str, ...] = ("id",), header_limit: int | None = None,
    on_init: Callable[[], None] | None = None, document_prepared: Column | None = None, on_finalized: Callable[[DataFrame], None] | None = None,
) -> DataFrame:
    """Publishes all documents or none; the manifest has drain_id, doc_id, doc_name and n_txn.

    ``document_prepared``: boolean column over a rendered document; one that is false fails the run.
    """
    check_config(drains)
    spark = transactions.sparkSession
    if on_init:
        on_init()
    q = qualifiers
    docs = stored(render_documents(plan_blocks(transactions, drains, order), transaction, document_name(q.prefix, q.run_id, q.extension), header, footer, header_limit))
    if document_prepared is not None and (bad := docs.where(~document_prepared).select("doc_name").first()):
        raise ExportError("document_rejected", bad.doc_name)
    spark.dataSource.register(PublishSource)
    docs.select("doc_name", "content").write.format("publish").mode("append").option("path", folder).save()
    manifest = docs.drop("content")
    if on_finalized:
        on_finalized(manifest)
    return manifest
