"""Command line: python -m gridquarry INPUT --mode {list,table,figure} [--keywords WORD ...] [--keywords-file FILE] [-o DIR] [--prefix NAME].

INPUT is a folder of Parquet tables by the names of gridquarry.sources.schemas (lines, pages, ...), of any number of
documents, or a PDF file for the list mode, if its reader is installed. Exit codes: 0, 2 (no such input), 4 (no
document has a caption; not in list mode).
"""

from __future__ import annotations

import argparse
import csv
import os
import sys

from pyspark.sql import functions as F

from gridquarry.functions import keywords as K
from gridquarry.operators import manifest
from gridquarry.plans import modes
from gridquarry.sources import adapters
from gridquarry.sources.schemas import CAPTION_COLUMNS
from gridquarry.sources.session import session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gridquarry")
    p.add_argument("input")
    p.add_argument("--mode", choices=("list", "table", "figure"), required=True)
    p.add_argument("--keywords", nargs="*", default=[])
    p.add_argument("--keywords-file", action="append", default=[])
    p.add_argument("-o", "--outdir")
    p.add_argument("--prefix")
    p.add_argument("--cpus", default="*")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if not os.path.exists(args.input):
        print(f"error: no such input: {args.input}", file=sys.stderr)
        return 2
    spark = session(cores=args.cpus)
    words = list(args.keywords)
    for path in args.keywords_file:
        words += [r["keyword"] for r in K.read_words(spark, path).orderBy("pos").collect()]
    words = K.deduped(words)
    out = manifest.outdir(args.outdir, args.prefix, os.path.splitext(os.path.basename(args.input.rstrip("/")))[0])

    def read(name: str):
        return spark.read.parquet(f"{args.input}/{name}")

    if args.mode == "list":
        lines = read("lines") if os.path.isdir(args.input) else adapters.lines(adapters.files(spark, args.input))
        rows = modes.list_mode(lines, words).withColumn("absent", F.col("present_in_pdf") == "no")
        w = csv.writer(sys.stdout)
        w.writerow(CAPTION_COLUMNS)
        for r in rows.orderBy("doc_id", "absent", F.when(~F.col("absent"), F.col("page")), "label").toLocalIterator():
            w.writerow([r[c] for c in CAPTION_COLUMNS])
        if args.outdir or args.prefix:
            rows.drop("absent").write.mode("overwrite").parquet(f"{out}/captions")
        return 0
    if args.mode == "table":
        names = ("lines", "pages", "tables", "grid", "spans", "cells", "words", "caption_rects")
        result = modes.table_mode(*map(read, names), words)
    else:
        result = modes.figure_mode(*map(read, ("lines", "pages", "boxes", "reads", "page_texts")), words)
    if result.exit_codes.where("code = 0").isEmpty():
        print("error: no table or figure captions in any document", file=sys.stderr)
        return 4
    manifest.write_manifest(result.rows.drop("doc_id"), f"{out}/manifest")
    folder = F.col("doc_id").cast("string")
    grids = result.grids.withColumn("table_no", F.col("name"))
    for column, end in (("value", ".csv"), *([("flag", "_flags.csv")] if args.mode == "figure" else [])):
        files = manifest.csv_files(grids, column)
        manifest.write_csv(files.select(F.concat(folder, F.lit("/"), F.replace("table_no", F.lit(".csv"), F.lit(end))).alias("path"), "content"), out)
    for r in manifest.summary(result.rows).collect():
        print(f"{r['query']}: exported {r['exported']} table(s), {r['not_exported']} not exported, {r['low_confidence']} of low confidence; see {out}/manifest")
    return 0


if __name__ == "__main__":
    sys.exit(main())
