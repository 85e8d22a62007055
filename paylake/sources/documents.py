"""Document sets, reference lists and synthetic documents."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

NAMESPACE = "urn:iso:std:iso:20022:tech:xsd:pacs.008.001.08"


class DocumentError(RuntimeError):
    """A document that cannot be opened fails the run."""


def split_arguments(arguments: list[str]) -> tuple[list[str], str | None]:
    """Documents and the grammar (``*.xsd``; the last one) of a command line, as absolute paths."""
    at = [os.path.normpath(os.path.abspath(a)) for a in arguments]
    grammars = [a for a in at if a.endswith(".xsd")]
    return [a for a in at if not a.endswith(".xsd")], grammars[-1] if grammars else None


def document_set(spark: SparkSession, paths: list[str], ids: list[int] | None = None, agent: Callable[[Column], Column] | None = None) -> DataFrame:
    """doc_ndx, path, out_doc_id, agent_id and content of listed files, in their order.

    ``ids``: 0 or None stands for a generated id (1, 2, 3, ...). ``agent``: from the path column to an
    agent id; 0 rejects, null passes; by default 0 for all (fail closed).
    """
    missing = [p for p in paths if "://" not in p and not os.path.isfile(p)]
    if missing:
        raise DocumentError(f"cannot open {missing[0]}")
    uris = [p if "://" in p else "file://" + os.path.abspath(p) for p in paths]
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for u in dict.fromkeys(u for u, p in zip(uris, paths) if "://" in p):
        at = jvm.org.apache.hadoop.fs.Path(u)
        if not at.getFileSystem(hadoop).exists(at):
            raise DocumentError(f"cannot open {u}")
    listed = spark.createDataFrame([(k, p, (ids[k] if ids and ids[k] else k + 1)) for k, p in enumerate(uris)], "doc_ndx int, path string, out_doc_id long")
    # a path is read once however often it is listed, and its characters stand for themselves
    once = sorted({re.sub(r"([\\*?\[\]{}])", r"\\\1", u) for u in uris})
    files = spark.read.format("binaryFile").load(once) if uris else spark.createDataFrame([], "path string, content binary")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    found = files.select(plain(F.col("path")).alias("at"), "content")
    out = listed.join(found, plain(F.col("path")) == F.col("at"), "left").drop("at")
    return out.withColumn("agent_id", (agent(F.col("path")) if agent else F.lit(0)).cast("smallint"))


def folder(spark: SparkSession, path: str, agent: Callable[[Column], Column] | None = None, pattern: str = "*.xml") -> DataFrame:
    """The same for all files of a folder of any size; ids are hashes of the paths, so no ordering of
    all files is needed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    key = F.xxhash64("path")
    return files.select(key.alias("doc_ndx"), "path", key.alias("out_doc_id"), "content").withColumn("agent_id", (agent(F.col("path")) if agent else F.lit(0)).cast("smallint"))


def agents_from(table: DataFrame, key: str, agent: str) -> Callable[[DataFrame], DataFrame]:
    """Resolves agents by a reference table: adds agent_id to documents that have column ``key``; 0 if unknown."""
    t = table.select(F.col(key), F.col(agent).cast("smallint").alias("agent_id")).dropDuplicates([key])
    return lambda docs: docs.drop("agent_id").join(t, key, "left").withColumn("agent_id", F.coalesce("agent_id", F.lit(0).cast("smallint")))


def reference_list(spark: SparkSession, path: str) -> DataFrame:
    """name, bank_id, bic, iban of a JSON list of banks."""
    return spark.read.schema("name string, bank_id string, bic string, iban string").json(path, multiLine=True)


def synthetic_transactions(spark: SparkSession, n: int, seed: int = 1, partitions: int | None = None) -> DataFrame:
    """Seeded random transactions: ndx, txn_id, amount 1.00, EE IBANs with random check digits, BICs."""
    digits = lambda size, s: F.lpad(F.pmod(F.xxhash64("ndx", F.lit(seed), F.lit(s)), F.lit(10**size)).cast("string"), size, "0")
    letters = lambda s: F.translate(digits(4, s), "0123456789", "ABCDEFGHIJ")
    iban = lambda s: F.concat(F.lit("EE"), digits(18, s))
    bic = lambda s: F.concat(letters(s), F.lit("EE2X"))
    return spark.range(0, n, 1, partitions).withColumnRenamed("id", "ndx").select(
        "ndx", F.concat(F.lit("TX"), digits(12, "id")).alias("txn_id"), F.lit("1.00").alias("amount"),
        iban("debtor").alias("debtor_iban"), bic("dbic").alias("debtor_bic"), iban("creditor").alias("creditor_iban"), bic("cbic").alias("creditor_bic"),
    )


def transaction_xml() -> Column:
    """A credit transfer of the columns of ``synthetic_transactions``."""
    e, c = X.element, lambda n: X.escape(F.col(n).cast("string"))
    agent = lambda tag, n: e(tag, e("FinInstnId", e("BICFI", c(n))))
    account = lambda tag, n: e(tag, e("Id", e("IBAN", c(n))))
    return e(
        "CdtTrfTxInf", e("PmtId", e("TxId", c("txn_id"))), e("IntrBkSttlmAmt", c("amount"), attributes=' Ccy="EUR"'), agent("InstgAgt", "debtor_bic"),
        account("DbtrAcct", "debtor_iban"), agent("DbtrAgt", "debtor_bic"), agent("CdtrAgt", "creditor_bic"), account("CdtrAcct", "creditor_iban"),
    )


def document_xml(header: Column, transactions: Column, close: Column | None = None) -> Column:
    """``close``: the last close tag, for documents with a fault there."""
    end = close if close is not None else F.lit("</Document>")
    return F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<Document xmlns="{NAMESPACE}" xmlns:x="{NAMESPACE}">\n<FIToFICstmrCdtTrf>\n'), header, F.lit("\n"), transactions, F.lit("\n</FIToFICstmrCdtTrf>\n"), end, F.lit("\n"))


def synthetic_documents(spark: SparkSession, n: int, per_document: int, seed: int = 1) -> DataFrame:
    """``n`` transactions in documents of ``per_document``: doc_ndx, out_doc_id, agent_id, content."""
    t = synthetic_transactions(spark, n, seed).select(F.floor(F.col("ndx") / per_document).alias("doc_ndx"), "ndx", transaction_xml().alias("xml"))
    d = t.groupBy("doc_ndx").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ndx", "xml"))), lambda x: x["xml"]), "\n").alias("txns"))
    e = X.element
    header = e("x:GrpHdr", e("x:MsgId", F.concat(F.lit("MSG"), F.col("doc_ndx").cast("string"))), e("x:CreDtTm", F.lit("2024-01-02T03:04:05.678Z")), e("x:NbOfTxs", F.col("n").cast("string")),
               e("x:TtlIntrBkSttlmAmt", F.concat(F.col("n").cast("string"), F.lit(".00")), attributes=' Ccy="EUR"'), e("x:IntrBkSttlmDt", F.lit("2024-01-02")))
    return d.select("doc_ndx", (F.col("doc_ndx") + 1).alias("out_doc_id"), F.lit(1).cast("smallint").alias("agent_id"), document_xml(header, F.col("txns")).alias("content"))
