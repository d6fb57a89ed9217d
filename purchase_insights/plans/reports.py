"""The sixteen business reports over a purchases table."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purchase_insights.functions.columns import loyalty_segment
from purchase_insights.functions.measures import average_purchase, base_aggregates
from purchase_insights.operators.rating import rated_products
from purchase_insights.operators.report_book import sketch_customers
from purchase_insights.operators.segments import Segment, finish_report, segment_report
from purchase_insights.schema import conform, require_columns

TOP_N = 10
MIN_ROWS = 20

_BY_TRANSACTIONS = ("transactions", "total_revenue", "average_purchase")
_BY_CUSTOMERS = ("customers", "total_revenue", "average_purchase")
_PRODUCT = ("total_revenue", "average_purchase", "transactions")

SEGMENTS: dict[str, Segment] = {
    "category": Segment(("category",), (*_PRODUCT, "revenue_percentage")),
    "top_products": Segment(("item_purchased", "category"), _PRODUCT, limit=TOP_N),
    "bottom_products": Segment(("item_purchased", "category"), _PRODUCT, ascending=True, limit=TOP_N),
    "discount": Segment(("discount_applied",), _BY_TRANSACTIONS, order_by="average_purchase"),
    "subscription": Segment(("subscription_status",), _BY_CUSTOMERS),
    "age_group": Segment(("age_group",), _BY_CUSTOMERS),
    "gender": Segment(("gender",), _BY_CUSTOMERS),
    "frequency": Segment(("frequency_of_purchases", "purchase_frequency_days"), _BY_CUSTOMERS),
    "loyalty": Segment(("customer_segment",), _BY_CUSTOMERS),
    "season": Segment(("season",), _BY_TRANSACTIONS),
    "location": Segment(("location",), _BY_CUSTOMERS, limit=TOP_N),
    "high_value_locations": Segment(
        ("location",), _BY_CUSTOMERS, order_by="average_purchase", limit=TOP_N, min_rows=MIN_ROWS
    ),
    "shipping": Segment(("shipping_type",), _BY_TRANSACTIONS, order_by="average_purchase"),
    "rating": Segment(
        ("item_purchased", "category"), ("average_rating", *_PRODUCT), order_by="average_rating", min_rows=MIN_ROWS
    ),
    "customer_segments": Segment(
        ("age_group", "subscription_status", "frequency_of_purchases"), _BY_CUSTOMERS, limit=TOP_N
    ),
}

OVERALL = (
    "total_revenue",
    "average_purchase",
    "minimum_purchase",
    "maximum_purchase",
    "total_transactions",
    "total_customers",
)


def finish_overall(totals: DataFrame) -> DataFrame:
    """Output columns of the one-row overall report."""
    return totals.select(
        F.col("revenue").cast("double").alias("total_revenue"),
        average_purchase().alias("average_purchase"),
        F.col("lowest").cast("double").alias("minimum_purchase"),
        F.col("highest").cast("double").alias("maximum_purchase"),
        F.col("n_rows").alias("total_transactions"),
        F.col("n_customers").alias("total_customers"),
    )


def overall(purchases: DataFrame, approximate_customers: bool = False) -> DataFrame:
    """One row of totals; for no purchases, NULL amounts and zero counts.

    ``approximate_customers`` estimates the number of customers by a sketch of a fixed
    size (standard error 0.8 %), where a group per customer would be too many.
    """
    if not approximate_customers:
        distinct = F.count_distinct("customer_id").alias("n_customers")
        return finish_overall(purchases.agg(*base_aggregates(purchases), distinct))
    estimate = sketch_customers(purchases).select(F.coalesce(F.hll_sketch_estimate("customer_sketch"), F.lit(0)))
    totals = purchases.agg(*base_aggregates(purchases))
    return finish_overall(totals.withColumn("n_customers", estimate.scalar()))


def with_loyalty(purchases: DataFrame) -> DataFrame:
    return purchases.withColumn("customer_segment", loyalty_segment(F.col("previous_purchases")))


def report(purchases: DataFrame, name: str, **changes) -> DataFrame:
    """One of the reports by name, computed on its own.

    ``changes`` replace fields of its ``Segment``, e.g. ``limit`` or ``min_rows``, or are
    the arguments of ``overall``. The
    report ``rating`` takes purchases whose ratings are imputed or not, with the same
    result; without saves a pass over the rows.
    """
    if name == "overall":
        return overall(conform(purchases), **changes)
    segment = replace(SEGMENTS[name], **changes)
    if "customer_segment" in segment.keys:
        purchases = with_loyalty(purchases)
    purchases = conform(require_columns(purchases, *segment.keys, "purchase_amount"))
    if "average_rating" in segment.measures:
        return finish_report(rated_products(require_columns(purchases, "review_rating")), segment)
    return segment_report(purchases, segment)


REPORT_NAMES: tuple[str, ...] = ("overall", *SEGMENTS)
