from __future__ import annotations

from decimal import Decimal

import pytest
from fixtures import mixed, purchases
from pyspark.sql import functions as F

from purchase_insights.functions.measures import exact_sum
from purchase_insights.operators.cleaning import impute_rating
from purchase_insights.operators.report_book import report_book, report_groups
from purchase_insights.plans.charts import CHARTS, chart_data
from purchase_insights.plans.from_book import charts_from_book, report_from_book, reports_from_book
from purchase_insights.plans.pipeline import build_reports, write_reports
from purchase_insights.plans.reports import REPORT_NAMES, SEGMENTS, report
from purchase_insights.schema import PURCHASE_COLUMNS
from purchase_insights.sources.scratch import materialize


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_loyalty_bounds(spark):
    df = purchases(spark, *({"previous_purchases": n} for n in (10, 11, 30, 31, None)))
    counts = {r["customer_segment"]: r["customers"] for r in report(df, "loyalty").collect()}
    assert counts == {"New Customer": 1, "Regular Customer": 2, "Loyal Customer": 2}


def test_locations_need_twenty_rows(spark):
    df = purchases(
        spark,
        *[{"location": "Few", "purchase_amount": "99.00"}] * 19,
        *[{"location": "Enough", "customer_id": 7}] * 20,
    )
    assert rows(report(df, "high_value_locations")) == [("Enough", 20, 200.0, 10.0)]


def test_ties_are_broken_by_the_keys(spark):
    df = purchases(spark, *({"item_purchased": f"item {i:02d}"} for i in range(12)))
    first_ten = [f"item {i:02d}" for i in range(10)]
    assert [r[0] for r in rows(report(df, "top_products"))] == first_ten
    assert [r[0] for r in rows(report(df, "bottom_products"))] == first_ten
    assert [r[0] for r in rows(chart_data(df, "chart_top_products"))] == first_ten


def test_missing_measures_sort_as_the_largest(spark):
    unrated = [{"item_purchased": "Unrated", "category": "x", "review_rating": None}] * 20
    rated = [{"item_purchased": "Rated", "category": "y", "review_rating": 5.0}] * 20
    df = purchases(spark, *unrated, *rated)
    assert [r[0] for r in rows(report(df, "rating"))] == ["Unrated", "Rated"]
    unpriced = purchases(spark, {"item_purchased": "Free", "purchase_amount": None}, {"item_purchased": "Paid"})
    assert [r[0] for r in rows(report(unpriced, "top_products"))] == ["Free", "Paid"]
    assert [r[0] for r in rows(report(unpriced, "bottom_products"))] == ["Paid", "Free"]


def test_missing_amounts_count_as_rows_but_not_in_the_average(spark):
    df = purchases(spark, {"purchase_amount": None}, {"purchase_amount": "4.00"})
    assert rows(report(df, "gender")) == [("Female", 2, 4.0, 4.0)]
    none = purchases(spark, {"purchase_amount": None})
    assert rows(report(none, "gender")) == [("Female", 1, None, None)]


def test_missing_keys_form_a_group(spark):
    df = purchases(spark, {"age_group": None}, {"age_group": None}, {})
    assert rows(report(df, "age_group")) == [(None, 2, 20.0, 10.0), ("Adult", 1, 10.0, 10.0)]


def test_category_shares(spark):
    df = purchases(
        spark,
        {"category": "a", "purchase_amount": "1.00"},
        {"category": "b", "purchase_amount": "2.00"},
        {"category": None, "purchase_amount": None},
    )
    assert rows(report(df, "category")) == [
        (None, None, None, 1, None),
        ("b", 2.0, 2.0, 1, 66.67),
        ("a", 1.0, 1.0, 1, 33.33),
    ]


def test_zero_grand_total_is_an_error(spark):
    df = purchases(spark, {"purchase_amount": "0.00"}, {"category": "a", "purchase_amount": "0.00"})
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        report(df, "category").collect()


def test_empty_input(spark):
    empty = purchases(spark, {}).where("false")
    assert rows(report(empty, "overall")) == [(None, None, None, None, 0, 0)]
    for name in SEGMENTS:
        assert rows(report(empty, name)) == []
    for name in CHARTS:
        assert rows(chart_data(empty, name)) == []
    from_book = build_reports(empty)
    assert rows(from_book["overall"]) == [(None, None, None, None, 0, 0)]
    assert all(rows(from_book[name]) == [] for name in SEGMENTS)


def test_invariants(spark):
    df = mixed(spark)
    total = report(df, "overall").first()
    assert total["total_transactions"] == 400
    assert total["total_customers"] == df.select("customer_id").where("customer_id IS NOT NULL").distinct().count()
    for name in ("category", "discount", "subscription", "age_group", "gender", "frequency", "loyalty", "season", "shipping"):
        found = report(df, name).collect()
        count = "transactions" if "transactions" in found[0].asDict() else "customers"
        assert sum(r[count] for r in found) == 400
        assert sum(r["total_revenue"] or 0 for r in found) == pytest.approx(total["total_revenue"])
    shares = [r["revenue_percentage"] for r in report(df, "category").collect()]
    assert sum(shares) == pytest.approx(100, abs=0.01 * len(shares))


def test_column_order(spark):
    columns = report(mixed(spark), "rating").columns
    assert columns == [
        "item_purchased", "category", "average_rating", "total_revenue", "average_purchase", "transactions",
    ]
    assert report(mixed(spark), "discount").columns == [
        "discount_applied", "transactions", "total_revenue", "average_purchase",
    ]


def test_book_gives_the_same_reports(spark):
    raw = mixed(spark)
    clean = impute_rating(raw)
    for source in (raw, clean):
        book = materialize(report_book(source), "test-book")
        from_book = {**reports_from_book(book), **charts_from_book(book)}
        for name in REPORT_NAMES:
            direct = report(clean, name)
            assert from_book[name].columns == direct.columns
            assert rows(from_book[name]) == rows(direct), name
        for name, segment in CHARTS.items():
            found, direct = rows(from_book[name]), rows(chart_data(clean, name))
            if segment.order_by is None:
                found, direct = sorted(found, key=str), sorted(direct, key=str)
            assert found == direct, name


def test_book_reads_the_purchases_once(spark, tmp_path):
    mixed(spark).write.parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    plan = report_book(stored)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert len(scans) == 1  # also for the number of customers


def test_rating_report_needs_no_imputed_rows(spark):
    raw = mixed(spark)
    assert rows(report(raw, "rating")) == rows(report(impute_rating(raw), "rating"))


def test_only_the_needed_keys_are_grouped(spark):
    raw = mixed(spark)
    every = {tuple(r) for r in report_groups(raw).drop("n_rated", "rating_total").collect()}
    some = report_groups(raw, ("category", "season", "overall"))
    assert {tuple(r) for r in some.collect()} == {r for r in every if r[0] in ("category", "season", "overall")}
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    for unused in ("review_rating", "item_purchased", "age_group", "gender"):
        assert f"{unused}#" not in plan.split("Expand")[0]


def test_rating_of_an_imputed_product(spark):
    df = purchases(
        spark,
        *[{"item_purchased": "Coat", "review_rating": None}] * 10,
        *[{"item_purchased": "Coat", "review_rating": 2.0}] * 10,
        *[{"item_purchased": "Hat", "review_rating": 4.0}] * 30,
    )
    # Median of the category: 4.0.
    book = materialize(report_book(df), "test-book")
    found = {r["item_purchased"]: r["average_rating"] for r in report_from_book(book, "rating").collect()}
    assert found == {"Coat": 3.0, "Hat": 4.0}


def test_exact_sum_of_extreme_amounts(spark):
    amounts = ["9999999999.99", "-9999999999.99", "0.01", "-0.01", "123.45", None, "9999999999.99"]
    df = spark.createDataFrame([(None if a is None else Decimal(a),) for a in amounts], "a decimal(12,2)")
    assert df.agg(exact_sum(df, "a").alias("s")).first()["s"] == Decimal("10000000123.44")
    many = spark.range(1_000_000).select(F.lit("9999999999.99").cast("decimal(12,2)").alias("a"))
    assert many.agg(exact_sum(many, "a").alias("s")).first()["s"] == Decimal("9999999999990000.00")
    wide = df.select(F.col("a").cast("decimal(20,4)"))
    assert wide.agg(exact_sum(wide, "a").alias("s")).first()["s"] == Decimal("10000000123.4400")
    fine = spark.createDataFrame([(Decimal("999999.999999"),), (Decimal("0.000003"),)], "a decimal(12,6)")
    assert fine.agg(exact_sum(fine, "a").alias("s")).first()["s"] == Decimal("1000000.000002")
    finer = spark.createDataFrame([(Decimal("0.123456789012"),), (Decimal("-0.1"),)], "a decimal(12,12)")
    assert finer.agg(exact_sum(finer, "a").alias("s")).first()["s"] == Decimal("0.023456789012")
    whole = spark.createDataFrame([(Decimal(7),), (Decimal(-9),)], "a decimal(9,0)")
    assert whole.agg(exact_sum(whole, "a").alias("s")).first()["s"] == Decimal(-2)


def test_report_options(spark):
    df = mixed(spark)
    assert len(rows(report(df, "rating", limit=3))) == 3
    assert rows(report(df, "rating", limit=3)) == rows(report(df, "rating"))[:3]
    every = report(df, "high_value_locations", min_rows=1, limit=None)
    assert len(rows(every)) == df.select("location").distinct().count()


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="season"):
        report(mixed(spark).drop("season"), "season")
    with pytest.raises(ValueError, match="location"):
        build_reports(mixed(spark).drop("location"))


def test_pipeline_writes_every_report(spark, tmp_path):
    reports = build_reports(mixed(spark).select(*PURCHASE_COLUMNS))
    assert set(reports) == {*REPORT_NAMES, *CHARTS, "executive_summary", "discount_insight", "recommendations", "limitations"}
    write_reports(reports, str(tmp_path / "parquet"))
    some = {name: reports[name] for name in ("category", "chart_top_products")}
    write_reports(some, str(tmp_path / "csv"), "csv")
    for file_format, written in (("parquet", reports), ("csv", some)):
        for name, frame in written.items():
            stored = spark.read.format(file_format).options(header=True).load(str(tmp_path / file_format / name))
            assert stored.columns == frame.columns
            assert stored.count() == frame.count()


def test_amounts_of_other_types_are_summed_exactly(spark):
    """Doubles become decimals before they are added; one that doesn't fit is an error."""
    df = purchases(spark, *({"purchase_amount": "0.10"} for _ in range(10)))
    doubles = df.withColumn("purchase_amount", F.col("purchase_amount").cast("double"))
    assert report(doubles, "overall").first() == report(df, "overall").first()
    assert report(doubles, "overall").first()["total_revenue"] == 1.0
    odd = doubles.withColumn("purchase_amount", F.lit(53.999))
    with pytest.raises(Exception, match="purchase_amount: 53.999"):
        report(odd, "overall").collect()


def test_ratings_beyond_nine_decimals_and_large_ones(spark):
    df = purchases(spark, *({"review_rating": r} for r in [2.12345678949, 2e9] * 10))
    for found in (report(df, "rating"), build_reports(df)["rating"]):
        assert found.first()["average_rating"] == pytest.approx((2.12345678949 + 2e9) / 2, rel=1e-15)
    fine = purchases(spark, *({"review_rating": 2.12345678949} for _ in range(20)))
    assert report(fine, "rating").first()["average_rating"] == 2.12345678949
    gaps = purchases(spark, *({"review_rating": r} for r in [2.12345678949, None] * 10))
    for found in (report(gaps, "rating"), build_reports(gaps)["rating"]):
        assert found.first()["average_rating"] == 2.12345678949
