"""Grouped purchase reports described as data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from purchase_insights.functions.columns import age_rank
from purchase_insights.functions.measures import (
    average_purchase,
    average_rating,
    base_aggregates,
    rating_aggregates,
    share_percent,
)
from purchase_insights.sources.scratch import materialize


@dataclass(frozen=True)
class Segment:
    """A report: purchases grouped by ``keys``.

    ``measures`` are the outputs after the keys, in order. ``order_by`` names
    the measure to sort on, or ``age_band`` for the order of the bands (None: unordered). ``min_rows`` keeps groups of at
    least that many purchases, ``limit`` the first rows of the sorted report.
    """

    keys: tuple[str, ...]
    measures: tuple[str, ...]
    order_by: str | None = "total_revenue"
    ascending: bool = False
    limit: int | None = None
    min_rows: int | None = None


def _measure(name: str) -> Column:
    if name == "total_revenue":
        return F.col("revenue").cast("double")
    if name in ("transactions", "customers"):
        return F.col("n_rows")
    if name == "average_purchase":
        return average_purchase()
    if name == "average_rating":
        return average_rating()
    if name == "revenue_percentage":
        return share_percent(F.col("revenue"), F.col("all_revenue"))
    raise ValueError(f"unknown measure {name!r}")


def _rank(name: str, ascending: bool) -> Column:
    """Order of a measure or of age bands; missing values count as the largest."""
    if name == "age_band":
        band = age_rank(F.col("age_group"))
        return band.asc_nulls_last() if ascending else band.desc_nulls_first()
    value = F.col("revenue") if name == "total_revenue" else _measure(name)
    return value.asc_nulls_last() if ascending else value.desc_nulls_first()


def finish_report(groups: DataFrame, segment: Segment) -> DataFrame:
    """Filter, sort, limit and derive from rows that are already aggregated by key."""
    if segment.min_rows is not None:
        groups = groups.where(F.col("n_rows") >= segment.min_rows)
    if "revenue_percentage" in segment.measures:
        groups = groups.withColumn("all_revenue", groups.agg(F.sum("revenue")).scalar())
    if segment.order_by:
        # The keys break ties, which makes a limited report repeatable.
        groups = groups.orderBy(_rank(segment.order_by, segment.ascending), *segment.keys)
    if segment.limit is not None:
        groups = groups.limit(segment.limit)
    return groups.select(*segment.keys, *(_measure(name).alias(name) for name in segment.measures))


def segment_report(purchases: DataFrame, segment: Segment) -> DataFrame:
    """Aggregate the purchases by the segment's keys and finish the report.

    Groups whose total is needed too are written, so that the purchases are aggregated
    once and the total adds up the groups.
    """
    aggregates = base_aggregates(purchases)
    if "average_rating" in segment.measures:
        aggregates += rating_aggregates()
    groups = purchases.groupBy(*segment.keys).agg(*aggregates)
    if "revenue_percentage" in segment.measures:
        groups = materialize(groups.select(*segment.keys, "n_rows", "n_priced", "revenue"), "groups-and-total")
    return finish_report(groups, segment)
