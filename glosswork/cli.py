"""python -m glosswork.cli FILE... : analyse transcript files as one corpus and write a report."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession, functions as F

from . import __version__
from .plans.analysis import analyze, release
from .settings import Settings
from .sources import files, reports


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="glosswork", description="Suggest themes and quote evidence from transcripts.")
    p.add_argument("inputs", nargs="+", help="transcript files: " + ", ".join(k[1:] for k in files.FILE_KINDS))
    p.add_argument("--out", default="analysis_report.md", help="report to write")
    p.add_argument("--format", choices=tuple(reports.FORMATS), default="markdown")
    p.add_argument("--themes", type=int, default=8, help="most themes to suggest")
    p.add_argument("--quotes", type=int, default=0, help="quotes for each theme; 0: all")
    p.add_argument("--central-theme", default="", help="topic that grouping and ranking favour")
    p.add_argument("--version", action="version", version=f"%(prog)s {__version__}")
    args = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    cores = spark.sparkContext.defaultParallelism
    if spark.sparkContext.master.startswith("local"):  # a few files on one machine: no more parts than cores
        spark.conf.set("spark.sql.shuffle.partitions", str(min(cores, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    documents = files.read_files(spark, [os.path.abspath(x) for x in args.inputs])
    bad = documents.where("error is not null").select("source_name", "error").take(1)
    if bad:
        p.error(f"{bad[0].source_name}: {bad[0].error}")
    settings = Settings(theme_count=args.themes, quotes_per_theme=args.quotes, central_theme=args.central_theme)
    result = analyze(documents, settings)
    try:
        reports.save(result, args.out, args.format)
        n = result.select("document_count", F.size("themes").alias("themes"), "quote_count").first()
    finally:
        release(result)
    print(
        f"Wrote {args.out}\nDocuments analyzed: {n.document_count}\nSuggested themes: {n.themes}\nQuote units analyzed: {n.quote_count}"
    )
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
