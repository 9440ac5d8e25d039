"""Text of PDF files from the command line."""

from __future__ import annotations

import argparse
import os
import sys

from . import __version__


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="inkspark", description="Text of PDF files, by Spark")
    parser.add_argument("files", nargs="+", metavar="PDF")
    parser.add_argument("-p", "--pages", metavar="SPEC", help="pages such as 1-3,5,8- (all by default)")
    parser.add_argument("-o", "--output", metavar="FILE", help="write to a file instead of standard output")
    parser.add_argument("-l", "--layout", action="store_true", help="keep columns by the place of the text")
    parser.add_argument("-j", "--json", action="store_true", help="pages and lines as JSON, one document a line")
    parser.add_argument("-s", "--stats", action="store_true", help="counts only")
    parser.add_argument("-q", "--quiet", action="store_true", help="no notes on standard error")
    parser.add_argument("-V", "--version", action="version", version=f"inkspark {__version__}")
    return parser


def session():
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.appName("inkspark").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
    if not os.environ.get("SPARK_REMOTE") and not os.environ.get("MASTER"):
        builder = builder.master("local[*]").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8")
    return builder.getOrCreate()


def outputs(found, args):
    """(doc_id, output) by the first of stats, json, layout and text that is asked for."""
    from pyspark.sql import functions as F

    if args.stats:
        line = lambda name, *values: F.concat(F.lit(name + ": "), *(F.col(v).cast("string") if isinstance(v, str) else v for v in values))
        rows = [line("file", "doc_id"), line("version", "version"), line("objects", "n_objects"), line("pages", "page_count"), line("processed", "processed"), line("characters", "chars"), line("pages with text", "pages_with_text", F.lit("/"), "processed")]
        rows.append(F.when(F.col("scanned"), F.lit("no text: the file seems to be scanned")))
        return found.stats().select("doc_id", F.concat_ws("\n", *rows).alias("output"))
    if args.json:
        return found.json().withColumnRenamed("json", "output")
    return (found.layouts("\n\f") if args.layout else found.texts("\f")).withColumnRenamed("text", "output")


def results(args, spark, there):
    """(path, error, repaired, output) of each file in the order of the arguments; the driver holds some of them at a time."""
    from pyspark.sql import functions as F

    from .plans.extract import Extraction, read_files

    uris = [(i, p, p if "://" in p else "file:" + os.path.abspath(p)) for i, p in enumerate(there)]
    names = spark.createDataFrame(uris, "place int, path string, doc_id string")
    files = read_files(spark, sorted({u for _, _, u in uris})).withColumn("doc_id", F.regexp_replace("doc_id", "^file:/+", "file:/"))
    found = Extraction(files, pages=args.pages, keep=True)
    docs = found.docs().select("doc_id", "error_class", "error_msg", "repaired")
    both = names.join(docs, "doc_id", "left").join(outputs(found, args), "doc_id", "left").orderBy("place")
    for r in both.toLocalIterator():
        error = None if r.output is not None and not r.error_class else r.error_msg or "not read"
        text = r.output if error is None else ""
        yield r.path, error, r.repaired, text.replace(r.doc_id, r.path, 1) if args.stats or args.json else text


def write_out(text: str, stream=None) -> None:
    """``text`` to standard output; where its encoding lacks a character, as UTF-8, or with "?" if there are no bytes to write."""
    stream = stream or sys.stdout
    try:
        stream.write(text)
    except UnicodeEncodeError:
        raw = getattr(stream, "buffer", None)
        if raw is not None:
            stream.flush()
            raw.write(text.encode("utf-8", "replace"))
        else:
            stream.write(text.encode("ascii", "replace").decode("ascii"))


def main(argv=None, spark=None) -> int:
    args = build_parser().parse_args(argv)
    note = lambda text: None if args.quiet else print(text, file=sys.stderr)
    there = [p for p in args.files if "://" in p or os.path.isfile(p)]
    for p in sorted(set(args.files) - set(there)):
        note(f"{p}: not found")
    try:
        out = open(args.output, "w", encoding="utf-8", newline="\n") if args.output else None
    except OSError as e:
        note(f"{args.output}: {e}")
        return 1
    put = out.write if out else write_out
    done, last = 0, ""
    for path, error, repaired, text in results(args, spark or session(), there) if there else ():
        if error is not None:
            note(f"{path}: {error}")
            continue
        if repaired:
            note(f"{path}: its cross-references are damaged and were rebuilt")
        if done:
            put("\n" if args.json else "\n\n")
        put(text)
        done, last = done + 1, text
    if done and not last.endswith("\n"):
        put("\n")
    if out:
        out.close()
        note(f"written to {args.output}")
    return 1 if not done else 0


if __name__ == "__main__":
    raise SystemExit(main())
