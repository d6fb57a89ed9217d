"""The reports and chart datasets read from a report book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from purchase_insights.functions.measures import merged_aggregates
from purchase_insights.operators.rating import with_imputed_ratings
from purchase_insights.operators.report_book import BOOK_SEGMENTS, KEY_COLUMNS
from purchase_insights.operators.segments import Segment, finish_report
from purchase_insights.plans.charts import CHARTS
from purchase_insights.plans.reports import REPORT_NAMES, SEGMENTS, finish_overall

_BOOK_SEGMENT = {keys: name for segments in BOOK_SEGMENTS.values() for name, keys in segments.items()}


CHART_SEGMENTS = frozenset(_BOOK_SEGMENT[segment.keys] for segment in CHARTS.values())


def _key(name: str, column: str) -> Column:
    kind = "int" if name == "purchase_frequency_days" else "string"
    return F.col(column).cast(kind).alias(name)


def _segment_from_book(book: DataFrame, segment: Segment) -> DataFrame:
    keys = [_key(name, column) for name, column in zip(segment.keys, KEY_COLUMNS, strict=False)]
    rated = ["n_rated", "rating_total"] if "average_rating" in segment.measures else []
    groups = book.where(F.col("segment") == _BOOK_SEGMENT[segment.keys]).select(
        *keys, "n_rows", "n_priced", "revenue", *rated
    )
    return finish_report(with_imputed_ratings(groups, book) if rated else groups, segment)


def report_from_book(book: DataFrame, name: str) -> DataFrame:
    """One of the reports by name; equal to ``reports.report`` on the cleaned purchases."""
    if name != "overall":
        return _segment_from_book(book, SEGMENTS[name])
    # A global aggregate, so that an empty book still gives its one row.
    measures = ("n_rows", "n_priced", "revenue", "lowest", "highest")
    whole = (F.when(F.col("segment") == "overall", F.col(name)).alias(name) for name in measures)
    totals = book.select(*whole, "n_customers").agg(*merged_aggregates(), F.sum("n_customers").alias("n_customers"))
    return finish_overall(totals.fillna(0, ["n_rows", "n_customers"]))


def reports_from_book(book: DataFrame) -> dict[str, DataFrame]:
    return {name: report_from_book(book, name) for name in REPORT_NAMES}


def charts_from_book(book: DataFrame) -> dict[str, DataFrame]:
    return {name: _segment_from_book(book, segment) for name, segment in CHARTS.items()}
