from __future__ import annotations

import pytest
from fixtures import mixed, purchases

from purchase_insights.operators.report_book import report_book
from purchase_insights.plans.from_book import report_from_book
from purchase_insights.plans.pipeline import build_reports
from purchase_insights.plans.reports import report
from purchase_insights.plans.summary import discount_insight, executive_summary, limitations, recommendations

DISCOUNT_RAISES = (
    "Customers receiving discounts have a higher average purchase amount.",
    "Continue targeted discounts for customer segments where discounts increase spending.",
)
DISCOUNT_DOES_NOT_RAISE = (
    "Customers receiving discounts do not have a higher average purchase amount.",
    "Avoid broad discounts. Use targeted promotions instead, especially for inactive or low-frequency customers.",
)


def by_metric(df):
    return {r["metric"]: r for r in executive_summary(df).collect()}


def test_picks_are_the_first_rows_of_the_reports(spark):
    df = mixed(spark)
    facts = by_metric(df)
    for metric, name, label, value in (
        ("top_category", "category", "category", "total_revenue"),
        ("top_category_share", "category", "category", "revenue_percentage"),
        ("top_product", "top_products", "item_purchased", "total_revenue"),
        ("bottom_product", "bottom_products", "item_purchased", "total_revenue"),
        ("top_age_group", "age_group", "age_group", "total_revenue"),
        ("top_season", "season", "season", "total_revenue"),
        ("top_location", "location", "location", "total_revenue"),
        ("top_average_location", "high_value_locations", "location", "average_purchase"),
        ("top_loyalty_segment", "loyalty", "customer_segment", "total_revenue"),
        ("top_shipping", "shipping", "shipping_type", "average_purchase"),
    ):
        first = report(df, name).first()
        assert (facts[metric]["label"], facts[metric]["value"]) == (first[label], first[value]), metric
    segment = report(df, "customer_segments").first()
    assert facts["top_segment_age_group"]["label"] == segment["age_group"]
    assert facts["top_segment_subscription"]["label"] == segment["subscription_status"]
    assert facts["top_segment_frequency"]["label"] == segment["frequency_of_purchases"]
    assert facts["top_segment_revenue"]["value"] == segment["total_revenue"]
    total = report(df, "overall").first()
    for metric in total.asDict():
        assert facts[metric]["value"] == total[metric]


def test_picks_follow_the_order_of_missing_measures_and_ties(spark):
    df = purchases(
        spark,
        {"season": "Winter"},
        {"season": "Autumn"},
        {"season": "Summer", "purchase_amount": "9.00"},
        {"item_purchased": "Free", "purchase_amount": None, "season": "Summer"},
    )
    facts = by_metric(df)
    assert facts["top_season"]["label"] == "Autumn"
    assert (facts["top_product"]["label"], facts["top_product"]["value"]) == ("Free", None)
    assert facts["bottom_product"]["label"] == "Coat"


def test_display_formats(spark):
    amounts = {"purchase_amount": "1234567.12", "discount_applied": "No"}
    facts = by_metric(purchases(spark, amounts, {**amounts, "customer_id": 2, "category": "b", "purchase_amount": "0.5"}))
    assert facts["total_revenue"]["display"] == "$1,234,567.62"
    assert facts["total_transactions"]["display"] == "2"
    assert facts["average_purchase"]["display"] == "$617283.81"
    assert facts["minimum_purchase"]["display"] == "$0.50"
    assert facts["top_category_share"]["display"] == "100.00%"
    assert facts["top_average_location"]["display"] is None


def test_lines_are_in_report_order(spark):
    found = executive_summary(mixed(spark)).collect()
    assert [r["section"] for r in found] == sorted(r["section"] for r in found)
    assert len(found) == 22
    assert found[0]["section_title"] == "OVERALL BUSINESS PERFORMANCE"


def test_discount_lines_need_both_groups(spark):
    facts = by_metric(purchases(spark, {"discount_applied": "Yes"}))
    assert facts["average_with_discount"]["value"] is None
    facts = by_metric(purchases(spark, {"discount_applied": "Yes"}, {"discount_applied": "No", "purchase_amount": "4"}))
    assert facts["average_with_discount"]["value"] == 10.0
    assert facts["average_without_discount"]["value"] == 4.0


@pytest.mark.parametrize(
    ("without", "texts"),
    [("9.99", DISCOUNT_RAISES), ("10.00", DISCOUNT_DOES_NOT_RAISE), ("10.01", DISCOUNT_DOES_NOT_RAISE)],
)
def test_discount_insight(spark, without, texts):
    df = purchases(spark, {}, {"discount_applied": "No", "purchase_amount": without})
    assert [tuple(r) for r in discount_insight(df).collect()] == [(10.0, float(without), *texts)]


def test_no_insight_for_a_single_group(spark):
    assert discount_insight(purchases(spark, {}, {})).collect() == []
    assert discount_insight(purchases(spark, {"discount_applied": None}, {})).collect() == []


def test_insight_with_an_unpriced_group(spark):
    df = purchases(spark, {}, {"discount_applied": "No", "purchase_amount": None})
    assert [tuple(r) for r in discount_insight(df).collect()] == [(10.0, None, *DISCOUNT_DOES_NOT_RAISE)]


def test_recommendations_quote_the_reports(spark):
    df = mixed(spark)
    found = {r["rec_no"]: r for r in recommendations(df).collect()}
    assert list(found) == list(range(1, 9))
    evidence = {n: (r["evidence_1"], r["evidence_2"], r["evidence_3"]) for n, r in found.items()}
    assert evidence[1][0] == report(df, "category").first()["category"]
    assert evidence[2][0] == report(df, "top_products").first()["item_purchased"]
    assert evidence[3] == tuple(report(df, "customer_segments").first())[:3]
    assert evidence[6][0] == report(df, "location").first()["location"]
    assert evidence[6][1] == report(df, "high_value_locations").first()["location"]
    assert evidence[7][0] == report(df, "season").first()["season"]
    for number in (4, 5, 8):
        assert evidence[number] == (None, None, None)
    assert found[8]["title"] == "PROTECT CUSTOMER RETENTION"
    assert found[8]["actions"][1] == "VIP rewards" and found[6]["actions"] == []
    assert found[5]["lead"].startswith("Do not automatically give discounts to all customers.")
    assert found[7]["lead"] == f"The strongest revenue season is: {evidence[7][0]}. Before this season:"
    assert all(text in found[6]["lead"] for text in evidence[6][:2])


def test_limitations(spark):
    found = limitations(spark).collect()
    assert [r["line_no"] for r in found] == list(range(1, 7))
    assert found[1]["limitation"] == "Profit cannot be calculated."


def test_empty_input_keeps_every_line(spark):
    empty = purchases(spark, {}).where("false")
    found = executive_summary(empty).collect()
    assert len(found) == 22
    counts = {"total_transactions", "total_customers"}
    assert all(r["value"] == (0.0 if r["metric"] in counts else None) for r in found)
    lines = recommendations(empty).collect()
    assert len(lines) == 8
    assert all(r["evidence_1"] is None for r in lines)


def test_built_reports_agree_with_the_single_ones(spark):
    df = mixed(spark)
    built = build_reports(df)
    assert built["executive_summary"].collect() == executive_summary(df).collect()
    assert built["recommendations"].collect() == recommendations(df).collect()
    assert built["discount_insight"].collect() == discount_insight(df).collect()
    assert report_from_book(report_book(df), "overall").first() == report(df, "overall").first()
