"""Aggregates shared by all reports, and the columns derived from them.

Sums stay exact until a report is finished, so no result depends on how the
rows were partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ratings are added up as decimals, so that sums do not depend on their order.
RATING = "decimal(38,18)"

# Decimals of at most this size are summed as two longs (see exact_sum).
_SHORT_DIGITS, _SHORT_SCALE = 12, 6


def exact_sum(df: DataFrame, name: str) -> Column:
    """Exact sum of a column.

    The buffer of a decimal sum is too wide for a long, which costs an object
    per row. The units of a short decimal are added up as longs instead, split
    at a million: exact up to nine trillion rows in a group.
    """
    kind = df.schema[name].dataType
    if not isinstance(kind, T.DecimalType) or kind.precision > _SHORT_DIGITS or kind.scale > _SHORT_SCALE:
        return F.sum(name)
    units = f"CAST(`{name}` * 1{'0' * kind.scale}BD AS BIGINT)"
    total = f"CAST(SUM({units} DIV 1000000) AS DECIMAL(20,0)) * 1000000BD + SUM({units} % 1000000)"
    return F.expr(f"CAST(({total}) / 1{'0' * kind.scale}BD AS DECIMAL(28,{kind.scale}))")


def base_aggregates(df: DataFrame, amount: str = "purchase_amount") -> list[Column]:
    """Aggregates of purchase rows. Unused ones are pruned by the optimizer."""
    return [
        F.count(F.lit(1)).alias("n_rows"),
        F.count(amount).alias("n_priced"),
        exact_sum(df, amount).alias("revenue"),
        F.min(amount).alias("lowest"),
        F.max(amount).alias("highest"),
    ]


def merged_aggregates() -> list[Column]:
    """Merge rows of ``base_aggregates`` into coarser groups."""
    return [
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_priced").alias("n_priced"),
        F.sum("revenue").alias("revenue"),
        F.min("lowest").alias("lowest"),
        F.max("highest").alias("highest"),
    ]


def rating_aggregates(rating: str = "review_rating") -> list[Column]:
    return [
        F.count(rating).alias("n_rated"),
        F.sum(F.col(rating).cast(RATING)).alias("rating_total"),
    ]


def mean(total: Column, count: Column) -> Column:
    """Exact total over count, NULL for an empty group."""
    return total.cast("double") / F.nullif(count, F.lit(0))


def average_purchase() -> Column:
    return mean(F.col("revenue"), F.col("n_priced"))


def average_rating() -> Column:
    return mean(F.col("rating_total"), F.col("n_rated"))


def share_percent(part: Column, whole: Column) -> Column:
    """``part`` of ``whole`` in percent, two decimals. A zero whole is an error."""
    return F.round(part.cast("double") * 100.0 / whole.cast("double"), 2)
