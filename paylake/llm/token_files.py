"""Token ids in Parquet files: one list column of ids beside small metadata columns.

Ids are list<int32>, dictionary-encoded or, with ``encoding="delta"``, delta-packed; row groups and
pages are bounded by bytes and rows, and the writer stores page indexes, so a reader fetches single
documents (by ``doc_id``) or the metadata alone without touching the other ids. Files are in
ascending doc_id order: file k holds smaller ids than file k + 1, and rows are sorted within each.
Spark's committed writer makes the files, so a lost executor leaves no partial ones.

Defined results: null doc_ids come first; rows of equal doc_id follow each other, ordered by hash
of the text; ``ndx`` numbers the rows of a file, and starts follow it. Strings of the vocabulary's added
tokens are those tokens, as in the library. A text of any length is taken whole. A null text counts as empty and holds the end id alone. An empty table gives an empty
file set and an empty result. Input columns besides doc_id and text are not written.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .pretokens import PieceEncoder
from .shared import BATCH_BYTES, bounded, open_fs, release, shared_root

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
FILE_BYTES = 24 << 20  # of text in one file
MOST_PIECES, AT_ONCE, MOST_NEW = 500_000, 4000, 30_000  # see PieceEncoder


@functools.lru_cache(2)
def _encoder(path: str) -> PieceEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    t = Tokenizer.from_file(path)
    lengths = np.zeros(t.get_vocab_size(), np.int64)
    letters = set(ByteLevel.alphabet())  # a byte each
    for token, i in t.get_vocab().items():
        lengths[i] = len(token) if letters.issuperset(token) else len(token.encode())
    added = {i: str(a.content) for i, a in t.get_added_tokens_decoder().items()}
    for i, content in added.items():  # their strings in a text stand for themselves, whatever is beside them
        lengths[i] = len(content.encode())
    return PieceEncoder(lambda text: np.array(t.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<i4"), lengths, MOST_PIECES, AT_ONCE, MOST_NEW, tuple(added.values()))


def token_rows(docs: DataFrame, path: str | None = None, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids in ascending doc_id order over the partitions; ``part`` numbers them, and ``ndx`` the rows in each."""
    path = path or public_tokenizers.path(VOCABULARY)
    bounded(docs.sparkSession, 4 * BATCH_BYTES)  # many texts share more of their pieces
    tail = np.array([end_id], "<i4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, done = _encoder(path), 0
        for whole in batches:
            for k in range(0, whole.num_rows, AT_ONCE):
                b = whole.slice(k, AT_ONCE)
                ids = [x + tail for x in enc.texts(b.column(1))]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(done, done + len(n))), b.column(0), pa.array(n), lists], names=["ndx", "doc_id", "n_tokens", "ids"])
                done += len(n)
            del whole, b, ids, lists
            release()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    files = max(1, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // file_bytes))
    ordered = texts.repartitionByRange(files, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return ordered.mapInArrow(run, "ndx long, doc_id long, n_tokens long, ids array<int>").select(F.spark_partition_id().alias("part"), "ndx", "doc_id", "n_tokens", "ids")


def write_tokens(rows: DataFrame, path: str, encoding: str = "dictionary", row_group_bytes: int = 16 << 20, page_rows: int = 2000) -> None:
    """Writes ``token_rows``; both encodings keep page indexes."""
    w = rows.write.option("parquet.block.size", row_group_bytes).option("parquet.page.row.count.limit", page_rows).option("compression", "zstd")
    if encoding == "delta":
        w = w.option("parquet.enable.dictionary", "false").option("parquet.writer.version", "PARQUET_2_0")
    elif encoding != "dictionary":
        raise ValueError(encoding)
    w.mode("error").parquet(path)


def read_documents(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """Selected documents: the predicate reaches row groups and pages."""
    return spark.read.parquet(path).where(F.col("doc_id").isin(ids)).select("doc_id", "n_tokens", "ids")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens and start (ids of all documents before it); the ids themselves are not read.

    The running sum is one sum per file, offsets over those (one row a file), and a running sum
    within each file.
    """
    t = spark.read.parquet(path)
    return with_start(t.select("part", "ndx", "doc_id", "n_tokens"), t)


def with_start(t: DataFrame, stored: DataFrame) -> DataFrame:
    """``t`` with start; ``stored``: the files, of which part and n_tokens are read."""
    sums = stored.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = Window.partitionBy("part").orderBy("ndx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t.withColumn("upto", F.sum("n_tokens").over(within)).join(sums, "part").withColumn("start", F.col("before") + F.col("upto") - F.col("n_tokens")).drop("before", "upto", "part", "ndx")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """part, ndx, doc_id, n_tokens and ids_crc32 of what the files hold. A task reads its files with Arrow, ``AT_ONCE``
    documents at a time, so ids do not pass through rows of the JVM; a retried task reads them again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        names = ["part", "ndx", "doc_id"]
        for files in batches:
            for uri in files.column(0).to_pylist():
                fs, at = open_fs(uri)
                with fs.open_input_file(at) as f:
                    for b in pq.ParquetFile(f).iter_batches(AT_ONCE, columns=[*names, "ids"], use_threads=False):
                        lists = b.column("ids")
                        data = memoryview(lists.values.to_numpy().astype("<u4", copy=False)).cast("B")
                        cuts = lists.offsets.to_numpy().astype(np.int64)
                        ends = (cuts * 4).tolist()
                        crc = [zlib.crc32(data[x:y]) for x, y in zip(ends, ends[1:])]
                        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(np.diff(cuts)), pa.array(crc, pa.int64())], names=[*names, "n_tokens", "ids_crc32"])
                        del b, lists, data
            release()

    # the files' names, dealt by size; their contents are not read here
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")
    return files.mapInArrow(run, "part int, ndx long, doc_id long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_root(spark)}/tokens-{uuid.uuid4().hex[:12]}"
    write_tokens(token_rows(spark.read.parquet(f"{sf_dir}/documents.parquet")), path)
    stored = spark.read.parquet(path)
    return with_start(checksums(spark, path), stored).select("doc_id", "start", "n_tokens", "ids_crc32")
