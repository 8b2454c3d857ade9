"""Annotate CSV tables from the command line.

spark-submit tessera/__main__.py cta|cea FOLDER KB --targets FILE --out FOLDER: fill in targets of a folder of tables.
spark-submit tessera/__main__.py cta|cea FOLDER KB: show the annotations of all its tables.

KB is a folder with kb_search, kb_types and kb_parents as Parquet.  A preset (low, medium, high) sets the
sample, column relations and URI analysis; the other options change what it sets.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tessera.config import Config
from tessera.operators.selection import report
from tessera.plans.annotate import run_batch, run_cea, run_cta
from tessera.sources.kb import KnowledgeBase
from tessera.sources.tables import read_cells, write_lines


def parsed(arguments: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("task", choices=["cta", "cea"])
    parser.add_argument("folder")
    parser.add_argument("kb")
    parser.add_argument("--targets")
    parser.add_argument("--out")
    parser.add_argument("--preset", choices=["low", "medium", "high"])
    parser.add_argument("--sample", type=int, help="rows of a table to use, 0 for all")
    parser.add_argument("--threshold", type=float, help="least confidence of a column's type")
    parser.add_argument("--language")
    parser.add_argument("--no-relations", action="store_true")
    parser.add_argument("--no-uris", action="store_true")
    args = parser.parse_args(arguments)
    if bool(args.targets) != bool(args.out):
        parser.error("--targets and --out go together")
    return args


def configured(args: argparse.Namespace) -> Config:
    config = Config.preset(args.preset) if args.preset else Config()
    changes = {"sample_size": args.sample, "confidence_threshold": args.threshold, "language": args.language}
    changes = {k: v for k, v in changes.items() if v is not None}
    if args.no_relations:
        changes["use_column_relations"] = False
    if args.no_uris:
        changes["use_uri_analysis"] = False
    return config.with_(**changes)


def main(arguments: list[str] | None = None) -> None:
    args = parsed(arguments)
    config = configured(args)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    kb = KnowledgeBase(*[spark.read.parquet(f"{args.kb}/{t}") for t in ("kb_search", "kb_types", "kb_parents")])
    if args.targets:
        filled = run_batch(spark, args.folder, args.targets, kb, args.task, config)
        write_lines(filled, ["table_id", "col_idx", "result"] if args.task == "cta" else ["table_id", "row", "col_idx", "uri"], args.out)
        return
    cells = read_cells(spark, args.folder)
    if args.task == "cta":
        shown = report(run_cta(cells, kb, config).types).orderBy("table_id", "col_idx")
    else:
        shown = run_cea(cells, kb, config, "best").orderBy("table_id", "row_idx", "col_idx")
    for row in shown.toLocalIterator():
        print(*(x for x in row if x is not None), sep="\t")


if __name__ == "__main__":
    main()
