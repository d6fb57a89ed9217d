"""Column expressions for purchases; all built-in, so they stay in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from purchase_insights.functions.formats import literal

# Age bands, open on the left and closed on the right.
AGE_EDGES = (17, 29, 44, 59, 70)
AGE_LABELS = ("Young Adult", "Adult", "Middle-aged", "Senior")

# Days between two purchases.
FREQUENCY_DAYS = {
    "Weekly": 7,
    "Bi-Weekly": 14,
    "Fortnightly": 14,
    "Monthly": 30,
    "Quarterly": 90,
    "Every 3 Months": 90,
    "Annually": 365,
}

# Upper bounds of earlier purchases for the first two segments.
NEW_CUSTOMER_MAX = 10
REGULAR_CUSTOMER_MAX = 30

# Texts that stand for a missing value in a CSV file.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)


def null_if_missing(text: Column) -> Column:
    """NULL for a text that marks a missing value, else the text itself."""
    return F.when(~text.isin(*MISSING_TOKENS), text)


def age_group(age: Column) -> Column:
    """Band of an age; NULL for a missing age or one outside all bands."""
    lowest, *upper = AGE_EDGES
    band = F.when(age <= lowest, None)
    for edge, label in zip(upper, AGE_LABELS, strict=True):
        band = band.when(age <= edge, label)
    return band


def age_rank(band: Column) -> Column:
    """Place of an age band among the bands, from 0; NULL for other texts."""
    rank = F.when(band == AGE_LABELS[0], 0)
    for place, label in enumerate(AGE_LABELS[1:], 1):
        rank = rank.when(band == label, place)
    return rank


def frequency_days(frequency: Column) -> Column:
    """Days between purchases for a frequency label; NULL for other labels."""
    pairs = ", ".join(f"{literal(label)}, {days}" for label, days in FREQUENCY_DAYS.items())
    return F.expr(f"map({pairs})")[frequency]


def loyalty_segment(previous_purchases: Column) -> Column:
    """Loyalty by number of earlier purchases; an unknown number counts as loyal."""
    return (
        F.when(previous_purchases <= NEW_CUSTOMER_MAX, F.lit("New Customer"))
        .when(previous_purchases <= REGULAR_CUSTOMER_MAX, F.lit("Regular Customer"))
        .otherwise(F.lit("Loyal Customer"))
    )
