"""Average ratings of products, with missing ratings imputed by count instead of by row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purchase_insights.functions.measures import RATING
from purchase_insights.operators.median import median_of_counts
from purchase_insights.operators.report_book import report_groups
from purchase_insights.sources.scratch import materialize

# Two of these add up to RATING without losing decimals.
ADDEND = "decimal(37,18)"


def with_imputed_ratings(products: DataFrame, book: DataFrame) -> DataFrame:
    """Count each missing rating of a product as its category's median.

    ``products`` has category and the measures of the segment ``product``, the book the
    segment ``rating``.
    """
    counts = book.where("segment = 'rating' AND n_rated > 0").select(
        F.col("key_1").alias("category"), F.col("key_2").cast("double").alias("rating"), "n_rated"
    )
    medians = median_of_counts(counts, "category", "rating", "n_rated")
    missing = F.when(F.col("median").isNotNull(), F.col("n_rows") - F.col("n_rated")).otherwise(0)
    # a median below ten keeps its 18 decimals, as the types of the factors leave them room
    below_ten = F.col("median").try_cast("decimal(19,18)") * F.col("_missing").cast("decimal(18,0)")
    others = F.col("median").cast(RATING) * F.col("_missing")
    imputed = F.coalesce(below_ten.cast(ADDEND), others.cast(ADDEND))
    total = F.coalesce(F.col("rating_total").cast(ADDEND), F.lit(0).cast(ADDEND)) + imputed
    return (
        products.join(medians, "category", "left")
        .withColumn("_missing", missing)
        .withColumn("n_rated", F.col("n_rated") + F.col("_missing"))
        .withColumn("rating_total", F.when(F.col("_missing") == 0, F.col("rating_total")).otherwise(total.cast(RATING)))
    )


def rated_products(purchases: DataFrame) -> DataFrame:
    """item_purchased, category and measures with ratings, from purchases imputed or not.

    One pass: the purchases are counted by product and rating, and the medians and the
    imputation need only those counts.
    """
    counts = materialize(report_groups(purchases, ("product", "rating")), "rating-counts")
    products = counts.where("segment = 'product'").select(
        F.col("key_1").alias("item_purchased"),
        F.col("key_2").alias("category"),
        "n_rows", "n_priced", "revenue", "n_rated", "rating_total",
    )
    return with_imputed_ratings(products, counts)
