"""Command line: ``python -m purchase_insights`` or via ``spark-submit``.

    load     raw CSV file(s) or folder -> cleaned purchases (parquet)
    add      purchases as a load of a growing book (see --load-id)
    reports  all reports, summary, insight and recommendations; prints them too
    charts   the six chart datasets
    export   all purchases as CSV for a BI tool

A purchases source is a parquet folder, ``table:NAME`` for a catalog table, or
``database:NAME`` for a table of the database in ``DATABASE_URL``. For reports it may
also be ``book:FOLDER``, all loads of a growing book together.
"""

from __future__ import annotations

import argparse
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from purchase_insights.plans import growing_book
from purchase_insights.plans.pipeline import build_charts, build_reports, load_checked, load_purchases, write_reports
from purchase_insights.plans.reports import REPORT_NAMES
from purchase_insights.sources import tables
from purchase_insights.sources.csv_files import export_csv

# The one report without a fixed number of rows that has one per product.
LONG_REPORTS = ("rating",)


def read_source(spark: SparkSession, source: str, partitions: int = 8) -> DataFrame:
    kind, _, name = source.partition(":")
    if kind == "table":
        return tables.read_table(spark, name)
    if kind == "database":
        return tables.read_database_table(spark, tables.jdbc_options(tables.database_url()), name, partitions=partitions)
    return spark.read.parquet(source)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(
        prog="purchase_insights", description=__doc__, formatter_class=argparse.RawTextHelpFormatter
    )
    parser.add_argument("command", choices=("load", "add", "reports", "charts", "export"))
    parser.add_argument("source")
    parser.add_argument("target", help="folder to write to")
    parser.add_argument("--format", default="parquet", choices=("parquet", "csv", "json"), help="of reports and charts")
    parser.add_argument("--overwrite", action="store_true", help="replace targets that exist")
    parser.add_argument("--partitions", type=int, default=8, help="parallel ranges of a database read")
    parser.add_argument("--rating-rows", type=int, default=10, help="rows of the rating report to print; all are written")
    parser.add_argument("--refused", help="load: folder for records that don't fit, instead of an error")
    parser.add_argument("--load-id", help="add: name of the load; one that is there already is replaced")
    parser.add_argument("--file-bytes", type=int, help="export: size of the files, about; by default one per partition")
    options = parser.parse_args(arguments)
    if options.command == "add" and not options.load_id:
        parser.error("add needs --load-id")

    mode = "overwrite" if options.overwrite else "error"
    spark = SparkSession.builder.appName("purchase_insights").getOrCreate()
    if options.command == "load":
        if options.refused:
            counts = load_checked(spark, options.source, options.target, options.refused, mode=mode)
            print(f"{counts.accepted:,} rows loaded, {counts.refused:,} refused")
        else:
            load_purchases(spark, options.source, options.target, mode=mode)
        return
    kind, _, folder = options.source.partition(":")
    if options.command == "reports" and kind == "book":
        show_reports(growing_book.grown_reports(spark, folder), options)
        return
    purchases = read_source(spark, options.source, options.partitions)
    if options.command == "export":
        stats = export_csv(purchases, options.target, mode=mode, file_bytes=options.file_bytes)
        print(f"{stats.rows:,} rows, {stats.columns} columns, {stats.files} file(s), {stats.size_kb:.2f} KB")
        return
    if options.command == "add":
        growing_book.add_load(purchases, options.target, options.load_id)
    elif options.command == "charts":
        write_reports(build_charts(purchases), options.target, options.format, mode)
    else:
        show_reports(build_reports(purchases), options)


def show_reports(reports: Mapping[str, DataFrame], options: argparse.Namespace) -> None:
    """Write the reports and print them."""
    write_reports(reports, options.target, options.format, "overwrite" if options.overwrite else "error")
    for name in (*REPORT_NAMES, "executive_summary", "discount_insight", "recommendations", "limitations"):
        rows = reports[name].count()
        shown = min(rows, options.rating_rows) if name in LONG_REPORTS else rows
        print(name if shown == rows else f"{name} (first {shown} of {rows} rows; see --rating-rows)")
        reports[name].show(shown, truncate=False)


if __name__ == "__main__":
    main()
