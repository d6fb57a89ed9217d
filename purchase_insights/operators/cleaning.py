"""From raw purchase records to the purchases table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purchase_insights.functions.columns import age_group, frequency_days
from purchase_insights.operators.lookup import look_up
from purchase_insights.operators.median import grouped_median
from purchase_insights.schema import require_columns

# Medians of at most this size are broadcast.
BROADCAST_LIMIT_BYTES = 32 * 1024 * 1024
SALTS = 64


def normalize_headers(df: DataFrame) -> DataFrame:
    """Lower-case the column names and replace spaces by underscores."""
    names = [name.lower().replace(" ", "_") for name in df.columns]
    repeated = sorted({name for name in names if names.count(name) > 1})
    if repeated:
        raise ValueError(f"column names collide after normalising: {', '.join(repeated)}")
    return df.toDF(*names)


def rename_amount(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("purchase_amount_(usd)", "purchase_amount")


def _join_medians(df: DataFrame, medians: DataFrame, group: str) -> DataFrame:
    """Left join of the purchases with one small row per group.

    The medians are broadcast when their measured size allows it. Otherwise both
    sides are shuffled, each group spread over ``SALTS`` partitions: one group may
    hold a large part of the purchases, and a following aggregate must not take
    over a partitioning by group alone.
    """
    row_bytes = F.octet_length(F.col(group).cast("string")) + 64
    if medians.agg(F.coalesce(F.sum(row_bytes), F.lit(0))).first()[0] <= BROADCAST_LIMIT_BYTES:
        return df.join(F.broadcast(medians), group, "left")
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
    spread = medians.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    # Spark sees the size of the medians as written, not of their copies: it may not broadcast them.
    return salted.join(spread.hint("merge"), [group, "_salt"], "left")


def impute_rating(df: DataFrame, group: str = "category", rating: str = "review_rating") -> DataFrame:
    """Fill missing ratings with the median of their group.

    A group without any rating stays NULL, and so does every row without a
    group. The medians are computed when this is called, the join is lazy: a source
    that changes in between mixes two states, so load a changing one first.
    """
    require_columns(df, group, rating)
    medians = grouped_median(df, group, rating).withColumnRenamed("median", "_median")
    given = F.nullif(F.col(rating).cast("double"), F.lit(float("nan")))
    filled = F.when(F.col(group).isNotNull(), F.coalesce(given, F.col("_median")))
    return _join_medians(df, medians, group).withColumn(rating, filled).select(*df.columns)


def add_age_group(df: DataFrame) -> DataFrame:
    return require_columns(df, "age").withColumn("age_group", age_group(F.col("age")))


def add_frequency_days(df: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """``purchase_frequency_days`` from the fixed labels, or from a table with frequency_of_purchases and that column."""
    require_columns(df, "frequency_of_purchases")
    if dictionary is not None:
        return look_up(df, dictionary, "frequency_of_purchases", "purchase_frequency_days", "frequency_of_purchases")
    return df.withColumn("purchase_frequency_days", frequency_days(F.col("frequency_of_purchases")))


def drop_promo_code(df: DataFrame) -> DataFrame:
    return require_columns(df, "promo_code_used").drop("promo_code_used")


def derive_columns(raw: DataFrame) -> DataFrame:
    """Everything of the cleaning but the rating imputation: one narrow pass.

    Enough for every report that does not read ratings.
    """
    return (
        raw.transform(normalize_headers)
        .transform(rename_amount)
        .transform(add_age_group)
        .transform(add_frequency_days)
        .transform(drop_promo_code)
    )


def clean_purchases(raw: DataFrame) -> DataFrame:
    """The full cleaning: raw records in, purchases table out."""
    return raw.transform(derive_columns).transform(impute_rating)
