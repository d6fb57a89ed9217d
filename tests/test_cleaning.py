from __future__ import annotations

import random
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from purchase_insights.functions.columns import MISSING_TOKENS, null_if_missing
from purchase_insights.operators import cleaning, median
from purchase_insights.operators.median import grouped_median


def column(df, name):
    return [row[name] for row in df.collect()]


def imputed(spark, rows):
    df = spark.createDataFrame(rows, "id int, category string, review_rating double")
    return {r["id"]: r["review_rating"] for r in cleaning.impute_rating(df).collect()}


def test_even_count_takes_the_midpoint(spark):
    assert imputed(spark, [(1, "a", 1.0), (2, "a", None), (3, "a", 4.0)]) == {1: 1.0, 2: 2.5, 3: 4.0}


def test_unrated_category_and_missing_category_stay_missing(spark):
    rows = [(1, "b", None), (2, "b", None), (3, None, 3.0), (4, None, None), (5, "a", 2.0)]
    assert imputed(spark, rows) == {1: None, 2: None, 3: None, 4: None, 5: 2.0}


def test_nan_is_missing(spark):
    assert imputed(spark, [(1, "a", float("nan")), (2, "a", 3.0)]) == {1: 3.0, 2: 3.0}


def test_imputation_equals_pandas(spark):
    rng = random.Random(5)
    frame = pd.DataFrame(
        {
            "id": range(3000),
            "category": [rng.choice(["a", "b", "c", "d", None]) for _ in range(3000)],
            "review_rating": [None if rng.random() < 0.2 else round(rng.uniform(1, 5), 1) for _ in range(3000)],
        }
    )
    rows = list(frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None))
    expected = frame.groupby("category")["review_rating"].transform(lambda ratings: ratings.fillna(ratings.median()))
    found = imputed(spark, rows)
    for i, value in enumerate(expected):
        assert found[i] == (None if pd.isna(value) else value)


def test_imputation_is_the_same_for_decimal_ratings(spark):
    rows = [(1, "a", Decimal("2.1")), (2, "a", None), (3, "a", Decimal("2.4"))]
    df = spark.createDataFrame(rows, "id int, category string, review_rating decimal(3,1)")
    assert sorted(column(cleaning.impute_rating(df), "review_rating")) == [2.1, 2.25, 2.4]


def test_imputation_joins_by_shuffle_beyond_the_broadcast_limit(spark, monkeypatch):
    rows = [(i, "hot" if i % 3 else f"c{i % 50}", None if i % 4 else float(i)) for i in range(3000)]
    rows += [(5, None, 1.0), (6, "unrated", None)]
    df = spark.createDataFrame(rows, "id int, category string, review_rating double")
    broadcast = cleaning.impute_rating(df)
    assert "BroadcastHashJoin" in broadcast._jdf.queryExecution().toString()
    monkeypatch.setattr(cleaning, "BROADCAST_LIMIT_BYTES", 0)
    shuffled = cleaning.impute_rating(df)
    assert "BroadcastHashJoin" not in shuffled._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, shuffled.collect())) == sorted(map(str, broadcast.collect()))
    # The group is spread by a salt, and grouping by it combines before a new shuffle.
    plan = shuffled.groupBy("category").count()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [category" in plan and "_salt" in plan
    assert "partial_count" in plan


def test_median_of_many_random_groups(spark):
    rng = np.random.default_rng(11)
    groups = {}
    for key in range(120):
        size = int(rng.integers(1, 60))
        kind = key % 5
        if kind == 0:
            values = np.round(rng.uniform(1, 5, size), 1)
        elif kind == 1:
            values = rng.normal(0, 1e-4, size)  # many values within one band, both signs
        elif kind == 2:
            values = rng.normal(0, 1e6, size)
        elif kind == 3:
            values = rng.choice([0.0, 5e-324, -5e-324, 1e-300, 1e307, -1e307, 3.0, np.nextafter(3.0, 4.0)], size)
        else:
            values = rng.choice([1.0, 1.0005, 4.9995, 5.0], size)
        groups[key] = values
    rows = [(key, float(v)) for key, values in groups.items() for v in values]
    counted = grouped_median(spark.createDataFrame(rows, "k int, v double"), "k", "v")
    found = {r["k"]: r["median"] for r in counted.collect()}
    assert found == {key: float(np.median(values)) for key, values in groups.items()}


def test_median_with_a_hot_group(spark):
    hot = spark.range(200_000).select(F.lit("hot").alias("k"), (F.col("id") % 1001 / 200.0).alias("v"))
    cold = spark.range(1000).select((F.col("id") % 100).cast("string").alias("k"), F.col("id").cast("double").alias("v"))
    rows = hot.union(cold)
    found = {r["k"]: r["median"] for r in grouped_median(rows, "k", "v").collect()}
    expected = {r["k"]: r["m"] for r in rows.groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert found == expected


def test_median_of_many_values_in_one_band(spark, monkeypatch):
    """100,000 values within one band: no window sees more than a bounded number."""
    windows = []
    monkeypatch.setattr(median, "ORDERED_AT_ONCE", 500)
    narrowed = median._narrowed
    monkeypatch.setattr(median, "_narrowed", lambda active: windows.append(active.count()) or narrowed(active))
    values = spark.range(100_000).select(F.lit("k").alias("k"), (1e6 + F.col("id") * F.col("id") / 1e9).alias("v"))
    others = spark.range(101).select(F.lit("few").alias("k"), F.col("id").cast("double").alias("v"))
    found = {r["k"]: r["median"] for r in grouped_median(values.union(others), "k", "v").collect()}
    middle = (1e6 + 49_999.0 * 49_999.0 / 1e9, 1e6 + 50_000.0 * 50_000.0 / 1e9)
    assert found == {"k": sum(middle) / 2, "few": 50.0}
    assert windows[0] > 1000 and windows == sorted(windows, reverse=True) and len(windows) <= 5


def test_age_bands(spark):
    ages = [17, 18, 29, 29.5, 30, 44, 45, 59, 60, 70, 71, None]
    df = spark.createDataFrame([(a if a is None else float(a),) for a in ages], "age double")
    assert column(cleaning.add_age_group(df), "age_group") == [
        None, "Young Adult", "Young Adult", "Adult", "Adult", "Adult",
        "Middle-aged", "Middle-aged", "Senior", "Senior", None, None,
    ]


def test_frequency_days(spark):
    labels = [
        "Weekly", "Bi-Weekly", "Fortnightly", "Monthly", "Quarterly", "Every 3 Months", "Annually", "weekly", "Daily", None,
    ]
    df = spark.createDataFrame([(label,) for label in labels], "frequency_of_purchases string")
    days = column(cleaning.add_frequency_days(df), "purchase_frequency_days")
    assert days == [7, 14, 14, 30, 90, 90, 365, None, None, None]


def test_headers_are_normalized_and_may_not_collide(spark):
    df = spark.createDataFrame([(1, 2)], "`Purchase Amount (USD)` int, `Extra Column` int")
    assert cleaning.normalize_headers(df).columns == ["purchase_amount_(usd)", "extra_column"]
    renamed = df.transform(cleaning.normalize_headers).transform(cleaning.rename_amount)
    assert renamed.columns == ["purchase_amount", "extra_column"]
    with pytest.raises(ValueError, match="collide.*item_id"):
        cleaning.normalize_headers(spark.createDataFrame([(1, 2)], "`Item ID` int, `item_id` int"))


def test_cleaning_keeps_other_columns_and_drops_the_promo_code(spark):
    schema = (
        "`Age` int, `Category` string, `Review Rating` double, `Frequency of Purchases` string,"
        " `Promo Code Used` string, `Color` string"
    )
    df = spark.createDataFrame([(30, "a", None, "Weekly", "No", "red"), (71, "a", 3.5, "Daily", "Yes", "blue")], schema)
    rows = cleaning.clean_purchases(df)
    assert rows.columns == [
        "age", "category", "review_rating", "frequency_of_purchases", "color", "age_group", "purchase_frequency_days",
    ]
    assert [tuple(r) for r in rows.orderBy("age").collect()] == [
        (30, "a", 3.5, "Weekly", "red", "Adult", 7),
        (71, "a", 3.5, "Daily", "blue", None, None),
    ]


@pytest.mark.parametrize("absent", ["Age", "Category", "Review Rating", "Frequency of Purchases", "Promo Code Used"])
def test_a_missing_raw_column_is_an_error(spark, absent):
    columns = {
        "Age": "int", "Category": "string", "Review Rating": "double",
        "Frequency of Purchases": "string", "Promo Code Used": "string",
    }
    del columns[absent]
    df = spark.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t in columns.items()))
    with pytest.raises(ValueError, match=absent.lower().replace(" ", "_")):
        cleaning.clean_purchases(df)


def test_missing_tokens(spark):
    texts = [*MISSING_TOKENS, "Nan", "none", " NA", "0", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    kept = column(df.select(null_if_missing(F.col("t")).alias("t")), "t")
    assert kept == [None] * len(MISSING_TOKENS) + ["Nan", "none", " NA", "0", None]
