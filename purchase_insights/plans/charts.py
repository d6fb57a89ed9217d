"""Datasets behind the six charts; drawing them is left to a plotting tool."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from purchase_insights.operators.segments import Segment, segment_report
from purchase_insights.plans.reports import TOP_N
from purchase_insights.schema import conform

CHARTS: dict[str, Segment] = {
    "chart_revenue_by_category": Segment(("category",), ("total_revenue",)),
    "chart_top_products": Segment(("item_purchased",), ("total_revenue",), limit=TOP_N),
    "chart_revenue_by_age_group": Segment(("age_group",), ("total_revenue",)),
    "chart_discount_effectiveness": Segment(("discount_applied",), ("average_purchase",), order_by=None),
    "chart_revenue_by_season": Segment(("season",), ("total_revenue",)),
    "chart_subscription_analysis": Segment(("subscription_status",), ("average_purchase",), order_by=None),
}


def chart_data(purchases: DataFrame, name: str, **changes) -> DataFrame:
    """The dataset of one chart, computed on its own.

    ``changes`` replace fields of its ``Segment``: ``order_by="age_band", ascending=True``
    puts revenue by age group in the order of the bands.
    """
    return segment_report(conform(purchases), replace(CHARTS[name], **changes))
