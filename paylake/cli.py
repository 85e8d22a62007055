"""Command line: validate documents, generate synthetic ones, import a folder.

    python -m paylake.cli validate doc.xml ... schema.xsd [-q]     exit 0 if all are valid, else 1
    python -m paylake.cli gen --transactions 1000 --per-document 100 --out folder
    python -m paylake.cli import folder [--grammar schema.xsd] [--out folder]
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .messages import pacs8
from .operators.verdict import report
from .operators.xsd import GrammarError, load_grammar, violates
from .plans.importer import run_import
from .sources import documents as D
from .sources.publish import PublishSource


def validate(spark: SparkSession, files: list[str], quiet: bool = False) -> int:
    paths, grammar = D.split_arguments(files)
    if not paths or not grammar:
        print("documents and a grammar (*.xsd) are needed", file=sys.stderr)
        return 1
    try:
        name = load_grammar(spark, grammar)
        if name is None:
            raise GrammarError(f"cannot open {grammar}")
        docs = D.document_set(spark, paths)
    except (GrammarError, D.DocumentError) as e:
        print(e, file=sys.stderr)
        return 1
    bad = 0
    for r in docs.select("doc_ndx", "path", violates(F.col("content"), name).alias("bad")).orderBy("doc_ndx").collect():
        bad += r.bad
        if not quiet:
            print(f"{r.path}: {'invalid' if r.bad else 'valid'}")
    return int(bad > 0)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="paylake")
    sub = p.add_subparsers(dest="command", required=True)
    v = sub.add_parser("validate")
    v.add_argument("files", nargs="+")
    v.add_argument("-q", "--quiet", action="store_true")
    g = sub.add_parser("gen")
    g.add_argument("--transactions", type=int, default=1000)
    g.add_argument("--per-document", type=int, default=1000)
    g.add_argument("--seed", type=int, default=1)
    g.add_argument("--out", required=True)
    i = sub.add_parser("import")
    i.add_argument("folder")
    i.add_argument("--grammar")
    i.add_argument("--out")
    a = p.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("paylake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "validate":
        return validate(spark, a.files, a.quiet)
    if a.command == "gen":
        spark.dataSource.register(PublishSource)
        docs = D.synthetic_documents(spark, a.transactions, a.per_document, a.seed)
        docs.select(F.format_string("doc-%d.xml", "out_doc_id").alias("doc_name"), "content").write.format("publish").mode("append").option("path", a.out).save()
        return 0
    result = run_import(D.folder(spark, a.folder, lambda path: F.lit(1)), pacs8(), a.grammar)
    print(report(result.documents))
    if a.out:
        for kind in result.segments:
            result.stored(kind).write.parquet(f"{a.out}/{kind}")
            result.failed(kind).write.parquet(f"{a.out}/{kind}_failed")
        result.documents.write.parquet(f"{a.out}/documents")
    return 0


if __name__ == "__main__":
    sys.exit(main())
