"""Jobs for ``spark-submit``: fetch pages, read PDFs, validate chunk files."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import validate
from quillspark.session import prepared
from quillspark.sources import keyed, readers, sinks


def _pages(spark: SparkSession, args: argparse.Namespace) -> int:
    """Pages of a URL list, or local ones, as Markdown and text; those that failed set the exit code."""
    local = None if args.urls else readers.html_files(spark, args.html).withColumn("error", F.lit(None).cast("string"))
    pages = readers.articles(local if args.urls is None else readers.fetched(readers.url_list(spark, args.urls))).cache()
    keyed.append_absent(sinks.markdown(pages.where("error is null")), args.out, "name")
    failed = pages.where("error is not null").count()
    pages.unpersist()
    return int(failed > 0)


def _pdfs(spark: SparkSession, args: argparse.Namespace) -> int:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(args.pdfs)
    texts = readers.pdf_text(files).where("text <> ''")
    keyed.append_absent(texts, args.out, "path")
    return 0


def _headers(spark: SparkSession, path: str) -> DataFrame:
    parsed = readers.parse_chunks(readers.text_files(spark, path), min_words=0)
    return parsed.select("parsed", "meta.*")


def _validate(spark: SparkSession, args: argparse.Namespace) -> int:
    """The report and the first errors as JSON; 1 where a header breaks a rule."""
    headers = _headers(spark, args.chunks).cache()
    report = validate.report(headers).first().asDict()
    report["errors"] = [r.asDict() for r in validate.shown_errors(headers).collect()]  # at most 40
    print(json.dumps(report, ensure_ascii=False))
    code = validate.exit_code(headers)
    headers.unpersist()
    return code


def main(argv: list[str]) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    jobs = parser.add_subparsers(required=True)
    pages = jobs.add_parser("pages")
    where = pages.add_mutually_exclusive_group(required=True)
    where.add_argument("--urls")
    where.add_argument("--html")
    pages.add_argument("--out", required=True)
    pages.set_defaults(run=_pages)
    pdfs = jobs.add_parser("pdfs")
    pdfs.add_argument("pdfs")
    pdfs.add_argument("--out", required=True)
    pdfs.set_defaults(run=_pdfs)
    check = jobs.add_parser("validate")
    check.add_argument("chunks")
    check.set_defaults(run=_validate)
    args = parser.parse_args(argv)
    return args.run(prepared(SparkSession.builder.getOrCreate()), args)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
