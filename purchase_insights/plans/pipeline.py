"""From purchases to all reports, and their sinks."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from purchase_insights.operators.cleaning import clean_purchases, normalize_headers
from purchase_insights.operators.report_book import report_book, report_groups
from purchase_insights.plans.from_book import CHART_SEGMENTS, charts_from_book, report_from_book, reports_from_book
from purchase_insights.plans.summary import insight_from_report, limitations, recommendations_from_book, summary_from_book
from purchase_insights.schema import PURCHASE_COLUMNS, conform, require_columns
from purchase_insights.sources.csv_files import PROBLEMS, RECORD, read_checked_csv, read_purchases_csv
from purchase_insights.sources.scratch import materialize, remove_scratch, scratch_path


def load_purchases(
    spark: SparkSession, csv_path: str | list[str], target: str, mode: str = "error", **csv_options
) -> DataFrame:
    """Clean raw CSV purchases, store them as parquet in ``target`` and return them.

    Cleaning passes over the records twice (ratings, then all columns), so the
    text is parsed once into a columnar table first, which goes when ``target`` is
    written. ``mode`` is what to do if ``target`` exists.
    """
    raw = read_purchases_csv(spark, csv_path, **csv_options).transform(normalize_headers)
    copy = scratch_path(spark, "raw-purchases")
    raw.write.parquet(copy)
    clean = clean_purchases(spark.read.schema(raw.schema).parquet(copy))
    clean.write.mode(mode).parquet(target)
    remove_scratch(spark, copy)
    return spark.read.schema(clean.schema).parquet(target)


@dataclass(frozen=True)
class LoadCounts:
    accepted: int
    refused: int


def load_checked(
    spark: SparkSession, csv_path: str | list[str], target: str, refused: str, mode: str = "error", **csv_options
) -> LoadCounts:
    """Clean CSV purchases into ``target``; records that don't fit go to ``refused`` instead of ending the load.

    ``refused`` gets a row per such record: problems (an array of texts) and record, its
    text. Every record is in one of the two, and is parsed once. ``mode`` is what to do
    if either folder exists.
    """
    checked = read_checked_csv(spark, csv_path, **csv_options).transform(normalize_headers)
    good = F.size(PROBLEMS) == 0
    counts = Observation("load")
    observed = checked.observe(counts, F.count_if(good).alias("accepted"), F.count_if(~good).alias("refused"))
    copy = scratch_path(spark, "raw-purchases")
    observed.write.parquet(copy)
    stored = spark.read.schema(checked.schema).parquet(copy)
    bad = stored.where(~good).select(F.col(PROBLEMS).alias("problems"), F.col(RECORD).alias("record"))
    bad.write.mode(mode).parquet(refused)
    clean_purchases(stored.where(good).drop(PROBLEMS, RECORD)).write.mode(mode).parquet(target)
    remove_scratch(spark, copy)
    return LoadCounts(counts.get["accepted"], counts.get["refused"])


def build_reports(purchases: DataFrame) -> dict[str, DataFrame]:
    """All reports, chart datasets, summary, insight and recommendations by name.

    The purchases are read once for all of them. The merged groups are written
    to the shared folder, and every result is read from there.
    """
    purchases = conform(require_columns(purchases, *PURCHASE_COLUMNS))
    return results_of_book(materialize(report_book(purchases), "report-book"))


def results_of_book(book: DataFrame) -> dict[str, DataFrame]:
    """All results by name from a stored book."""
    return {
        **reports_from_book(book),
        **charts_from_book(book),
        "executive_summary": summary_from_book(book),
        "discount_insight": insight_from_report(report_from_book(book, "discount")),
        "recommendations": recommendations_from_book(book),
        "limitations": limitations(book.sparkSession),
    }


def build_charts(purchases: DataFrame) -> dict[str, DataFrame]:
    """The six chart datasets, from one pass over the columns that they need."""
    groups = report_groups(conform(purchases), CHART_SEGMENTS)
    return charts_from_book(materialize(groups, "chart-groups"))


def write_reports(
    reports: Mapping[str, DataFrame], directory: str, file_format: str = "parquet", mode: str = "error"
) -> None:
    """Write each report to its own folder below ``directory``.

    Reports are small; CSV ones have a header, and the actions joined to a text.
    ``mode`` is what to do with folders that exist.
    """
    for name, frame in reports.items():
        options = {"header": True} if file_format == "csv" else {}
        if file_format == "csv" and "actions" in frame.columns:
            frame = frame.withColumn("actions", F.array_join("actions", "; "))
        frame.write.mode(mode).format(file_format).options(**options).save(f"{directory.rstrip('/')}/{name}")
