"""A corpus pipeline: language ID, line dedup, SimHash near-dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents, in their order, others included. A stage's result is written and read again before the next stage,
which removes what the stages before have left in the shared folder.

Null, empty and wordless texts go in the first stage (no language); a row of null doc_id and rows that repeat one are
documents of their own in every stage; an empty table gives an empty table with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylake.llm import byte_bpe, language_id, line_dedup, mixing, similar
from paylake.llm.shared import hand_over, new_name, save, scratch, stage

#: A document goes if no language is found in it at all, or the best one is no likelier than this.
LEAST_SCORE = 0.3


def _text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with n_chars (if there) of the text as it is now."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go, and so do those of null or empty text."""
    with stage(spark, docs):
        out = language_id.language_id(docs)
        return out.where((F.col("lang_pred") != language_id.UND) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines repeated across documents go, except where the largest doc_id holds them."""
    with stage(spark, docs):
        return _text(line_dedup.line_dedup(spark, docs), docs.columns)


def _numbered(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that tells its rows apart, whatever their doc_ids, and its name."""
    row = new_name(docs, "row_of_docs")
    return save(spark, docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id; of rows that repeat it, one row) of each component of similar
    documents (0.8 of their five-word shingles) stays. A row of null doc_id goes only where its component has
    another."""
    with stage(spark, docs):
        rows, row = _numbered(spark, docs)
        with scratch(spark):
            gone = similar.near_documents(spark, rows, row_col=row).where("not kept").select(F.col("row").alias(row))
            gone = save(spark, gone, "copies", keep=True)
        return rows.join(gone, row, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's text becomes what the mix takes of it; untaken documents go. Rows of null or
    repeated doc_id are documents of their own."""
    with stage(spark, docs):
        rows, row = _numbered(spark, docs)
        cuts = new_name(docs, "cuts_of_docs")
        with scratch(spark):
            plan = save(spark, mixing.mix(spark, rows, keep=(row,)).where("taken > 0").select(row, mixing.cuts().alias(cuts)), "mix", keep=True)
        return _text(rows.join(plan, row).withColumn("text", mixing.taken_text("text", cuts)), docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to."""
    with stage(spark, docs):
        return byte_bpe.digests(byte_bpe.encode_decode(docs))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash", dedup_documents),
    ("mixing", mix_sources),
    ("byte_bpe", tokenize),
]
ORACLE_SQL = None  # SQL has neither the classifier nor XXH64 nor the merges


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = hand_over(spark, function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
