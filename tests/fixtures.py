"""Small purchase tables for the cases the synthetic data lacks."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "customer_id bigint, age int, gender string, item_purchased string, category string,"
    " purchase_amount decimal(12,2), location string, season string, review_rating double,"
    " subscription_status string, shipping_type string, discount_applied string, previous_purchases int,"
    " frequency_of_purchases string, age_group string, purchase_frequency_days int"
)

DEFAULT = {
    "customer_id": 1,
    "age": 30,
    "gender": "Female",
    "item_purchased": "Coat",
    "category": "Outerwear",
    "purchase_amount": "10.00",
    "location": "Maine",
    "season": "Winter",
    "review_rating": 4.0,
    "subscription_status": "Yes",
    "shipping_type": "Express",
    "discount_applied": "Yes",
    "previous_purchases": 5,
    "frequency_of_purchases": "Weekly",
    "age_group": "Adult",
    "purchase_frequency_days": 7,
}


def purchases(spark: SparkSession, *changes: dict) -> DataFrame:
    """A purchases table with one row per argument: ``DEFAULT`` with changes."""
    rows = []
    for change in changes:
        row = {**DEFAULT, **change}
        amount = row["purchase_amount"]
        row["purchase_amount"] = None if amount is None else Decimal(amount)
        rows.append(tuple(row.values()))
    return spark.createDataFrame(rows, SCHEMA)


def mixed(spark: SparkSession) -> DataFrame:
    """Rows with missing keys, amounts and ratings, ties, and an unrated category."""
    rows = []
    for i in range(400):
        rows.append(
            {
                "customer_id": None if i % 41 == 0 else i % 90,
                "gender": (None, "Male", "Female")[i % 3],
                "item_purchased": (None, "Coat", "Hat", "Scarf", "Belt", "Sock")[i % 6],
                "category": (None, "Outerwear", "Accessories", "Unrated")[i % 4],
                "purchase_amount": None if i % 17 == 0 else f"{i * 37 % 101}.{i % 100:02d}",
                "location": (None, "Maine", "Texas", "Ohio")[i % 4] if i % 5 else f"Town {i % 40}",
                "season": ("Winter", "Spring", "Summer", None)[i % 4],
                "review_rating": None if i % 4 == 3 or i % 7 == 0 else (2.5 if i % 11 else float("nan")) + i % 5 * 0.3,
                "subscription_status": ("Yes", "No", None)[i % 3],
                "shipping_type": ("Express", "Standard")[i % 2],
                "discount_applied": ("Yes", "No")[i // 7 % 2],
                "previous_purchases": None if i % 13 == 0 else i % 50,
                "frequency_of_purchases": ("Weekly", "Monthly", "Daily", None)[i % 4],
                "age_group": ("Young Adult", "Adult", "Senior", None)[i // 3 % 4],
                "purchase_frequency_days": (7, 30, None, None)[i % 4],
            }
        )
    return purchases(spark, *rows)
