"""Executive summary, discount insight and recommendations as tables.

Each is read from one row of facts: the best group of every report it quotes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import zip_longest

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from purchase_insights.functions.formats import count, literal, money, percent, plain_money
from purchase_insights.functions.measures import average_purchase
from purchase_insights.operators.report_book import KEY_COLUMNS, report_book, report_groups
from purchase_insights.plans.reports import MIN_ROWS, report

# Section titles of the executive summary.
SECTION_TITLES = {
    1: "OVERALL BUSINESS PERFORMANCE",
    2: "PRODUCT AND CATEGORY PERFORMANCE",
    3: "CUSTOMER DEMOGRAPHICS",
    4: "SEASONAL AND GEOGRAPHIC PERFORMANCE",
    5: "CUSTOMER LOYALTY",
    6: "SHIPPING OPPORTUNITY",
    7: "DISCOUNT STRATEGY",
}

# What the comparison of average purchases leads to.
DISCOUNT_RAISES = (
    "Customers receiving discounts have a higher average purchase amount.",
    "Continue targeted discounts for customer segments where discounts increase spending.",
)
DISCOUNT_DOES_NOT_RAISE = (
    "Customers receiving discounts do not have a higher average purchase amount.",
    "Avoid broad discounts. Use targeted promotions instead, especially for inactive or low-frequency customers.",
)

# What the recommendations say before their actions; {1} to {3} are the evidence.
LEADS = {
    1: "Focus additional marketing and inventory investment on {1}, the highest revenue category. Potential actions:",
    2: "Increase visibility for {1}, which is currently one of the strongest revenue-generating products."
    " Potential actions:",
    3: "Prioritize the customer segment: Age Group: {1}, Subscription: {2}, Purchase Frequency: {3}."
    " This segment currently generates the highest segment revenue.",
    4: "Encourage customers to purchase more frequently using:",
    5: "Do not automatically give discounts to all customers. Use customer segmentation to target:",
    6: "Increase marketing investment in high-performing locations. The highest revenue location is: {1}."
    " Also investigate locations with high average purchases, such as: {2}."
    " These markets may represent opportunities for premium products and targeted expansion.",
    7: "The strongest revenue season is: {1}. Before this season:",
    8: "Build a loyalty strategy around high-value customers. Potential programs:",
}

# What the data cannot tell, and what follows.
LIMITATIONS = (
    "The dataset does not include product cost.",
    "Profit cannot be calculated.",
    "The dataset does not contain transaction dates.",
    "Revenue growth over time cannot be calculated.",
    "Each customer_id appears once in the current dataset.",
    "Therefore, recommendations focus on increasing customer spending, improving targeting, and identifying"
    " high-value customer and product opportunities.",
)

# Titles and actions of the recommendations.
RECOMMENDATIONS: dict[int, tuple[str, tuple[str, ...]]] = {
    1: (
        "INVEST IN HIGH-PERFORMING CATEGORIES",
        (
            "Increase advertising",
            "Improve product availability",
            "Introduce premium versions",
            "Cross-sell related products",
        ),
    ),
    2: (
        "PROMOTE THE BEST-SELLING PRODUCTS",
        (
            "Feature the product in campaigns",
            "Create complementary product bundles",
            "Use cross-selling recommendations",
        ),
    ),
    3: (
        "TARGET HIGH-VALUE CUSTOMERS",
        ("Create personalized campaigns specifically for this customer group",),
    ),
    4: (
        "INCREASE CUSTOMER PURCHASE FREQUENCY",
        (
            "Personalized product recommendations",
            "Loyalty rewards",
            "Subscription benefits",
            "Reminder campaigns",
            "Limited-time offers",
        ),
    ),
    5: (
        "USE TARGETED DISCOUNTS",
        (
            "Low-frequency customers",
            "New customers",
            "Customers with lower purchase amounts",
            "Customers who may need incentives to return",
        ),
    ),
    6: ("INVEST IN HIGH-POTENTIAL LOCATIONS", ()),
    7: (
        "PREPARE FOR STRONG SALES SEASONS",
        (
            "Increase inventory",
            "Increase marketing campaigns",
            "Prepare product bundles",
            "Improve promotional planning",
        ),
    ),
    8: (
        "PROTECT CUSTOMER RETENTION",
        (
            "Loyalty points",
            "VIP rewards",
            "Exclusive offers",
            "Personalized recommendations",
            "Early access to products",
        ),
    ),
}


@dataclass(frozen=True)
class Pick:
    """The group of a book segment that comes first in its report."""

    segment: str
    measure: str = "revenue"
    ascending: bool = False
    min_rows: int = 0
    key: str | None = None


PICKS: dict[str, Pick] = {
    "category": Pick("category"),
    "top_product": Pick("product"),
    "bottom_product": Pick("product", ascending=True),
    "age_group": Pick("age_group"),
    "buyer": Pick("buyer"),
    "season": Pick("season"),
    "location": Pick("location"),
    "value_location": Pick("location", measure="average", min_rows=MIN_ROWS),
    "loyalty": Pick("loyalty"),
    "shipping": Pick("shipping", measure="average"),
    "discount_yes": Pick("discount", key="Yes"),
    "discount_no": Pick("discount", key="No"),
}


SUMMARY_SEGMENTS = frozenset({"overall", *(pick.segment for pick in PICKS.values())})
RECOMMENDATION_SEGMENTS = frozenset({"category", "product", "buyer", "location", "season"})


def _best(pick: Pick) -> str:
    """SQL aggregate giving the group a pick names, NULL if there is none."""
    eligible = f"segment = {literal(pick.segment)} AND n_rows >= {pick.min_rows}"
    if pick.key is not None:
        eligible += f" AND key_1 = {literal(pick.key)}"
    # Same order as the report: a missing measure counts as the largest, the
    # keys break ties.
    if pick.ascending:
        order = f"{pick.measure} IS NULL, {pick.measure}"
    else:
        order = f"{pick.measure} IS NOT NULL, -{pick.measure}"
    keys = ", ".join(KEY_COLUMNS)
    return (
        f"min_by(struct({keys}, double(revenue) AS revenue, average),"
        f" CASE WHEN {eligible} THEN struct({order}, {keys}) END)"
    )


def _facts(book: DataFrame) -> DataFrame:
    """One row holding the best group of every pick, and the totals.

    Plain aggregates over the small book: every task keeps one group per pick.
    """
    total = "CASE WHEN segment = 'overall' THEN {} END"
    aggregates = {
        **{name: _best(pick) for name, pick in PICKS.items()},
        "total_revenue": f"double(sum({total.format('revenue')}))",
        "average_purchase": f"max({total.format('average')})",
        "minimum_purchase": f"double(min({total.format('lowest')}))",
        "maximum_purchase": f"double(max({total.format('highest')}))",
        "total_transactions": f"coalesce(sum({total.format('n_rows')}), 0)",
    }
    if "n_customers" in book.columns:
        aggregates["total_customers"] = "coalesce(sum(n_customers), 0)"
    measured = book.withColumn("average", average_purchase())
    return measured.agg(*(F.expr(sql).alias(name) for name, sql in aggregates.items()))


def _summary_lines() -> list[tuple[int, str, str, str, str]]:
    """(section, metric, label, value, display) of every line, the last three as SQL."""

    def total(metric: str, text: Callable[[str], str]) -> tuple:
        return 1, metric, "NULL", metric, text(metric)

    def best(section: int, metric: str, pick: str, measure: str = "revenue", text=money) -> tuple:
        return section, metric, f"{pick}.key_1", f"{pick}.{measure}", text(f"{pick}.{measure}")

    def buyer(metric: str, key: str) -> tuple:
        return 3, metric, f"buyer.{key}", "NULL", f"buyer.{key}"

    def discount(metric: str, flag: str, pick: str) -> tuple:
        value = f"CASE WHEN discount_yes IS NOT NULL AND discount_no IS NOT NULL THEN {pick}.average END"
        return 7, metric, literal(flag), value, plain_money(value)

    share = "round(category.revenue * 100.0D / total_revenue, 2)"
    return [
        total("total_revenue", money),
        total("total_transactions", count),
        total("total_customers", count),
        total("average_purchase", plain_money),
        total("minimum_purchase", plain_money),
        total("maximum_purchase", plain_money),
        best(2, "top_category", "category"),
        (2, "top_category_share", "category.key_1", share, percent(share)),
        best(2, "top_product", "top_product"),
        best(2, "bottom_product", "bottom_product"),
        best(3, "top_age_group", "age_group"),
        buyer("top_segment_age_group", "key_1"),
        buyer("top_segment_subscription", "key_2"),
        buyer("top_segment_frequency", "key_3"),
        (3, "top_segment_revenue", "NULL", "buyer.revenue", money("buyer.revenue")),
        best(4, "top_season", "season"),
        best(4, "top_location", "location"),
        best(4, "top_average_location", "value_location", "average", plain_money),
        best(5, "top_loyalty_segment", "loyalty"),
        best(6, "top_shipping", "shipping", "average", plain_money),
        discount("average_with_discount", "Yes", "discount_yes"),
        discount("average_without_discount", "No", "discount_no"),
    ]


def _rows(facts: DataFrame, lines: Iterable[dict[str, str]]) -> DataFrame:
    """One row per line; a line maps column names to SQL over the facts."""
    structs = ("struct(" + ", ".join(f"{sql} AS {name}" for name, sql in line.items()) + ")" for line in lines)
    return facts.selectExpr(f"inline(array({', '.join(structs)}))")


def summary_from_book(book: DataFrame) -> DataFrame:
    """(section, section_title, metric, label, value, display), one row per fact.

    A fact without data has a NULL value; the row itself stays.
    """
    lines = (
        {
            "section": str(section),
            "section_title": literal(SECTION_TITLES[section]),
            "metric": literal(metric),
            "label": f"string({label})",
            "value": f"double({value})",
            "display": display,
        }
        for section, metric, label, value, display in _summary_lines()
    )
    return _rows(_facts(book), lines)


def executive_summary(purchases: DataFrame) -> DataFrame:
    """The summary straight from purchases."""
    return summary_from_book(report_book(purchases, SUMMARY_SEGMENTS))


def _quoting(text: str, evidence: Iterable[str]) -> str:
    """SQL for a text with evidence in place of {1}, {2} and {3}."""
    sql = literal(text)
    for i, column in enumerate(evidence, 1):
        sql = f"replace({sql}, '{{{i}}}', string({column}))"
    return sql


def limitations(spark: SparkSession) -> DataFrame:
    """(line_no, limitation): what the reports cannot tell."""
    lines = ", ".join(f"struct({i} AS line_no, {literal(text)} AS limitation)" for i, text in enumerate(LIMITATIONS, 1))
    return spark.range(1).selectExpr(f"inline(array({lines}))")


def recommendations_from_book(book: DataFrame) -> DataFrame:
    """(rec_no, title, lead, evidence_1, evidence_2, evidence_3, actions).

    ``lead`` quotes the evidence and is NULL without any that it quotes; ``actions``
    is an array, empty where the lead says it all.
    """
    evidence = {
        1: ("category.key_1",),
        2: ("top_product.key_1",),
        3: ("buyer.key_1", "buyer.key_2", "buyer.key_3"),
        6: ("location.key_1", "value_location.key_1"),
        7: ("season.key_1",),
    }
    lines = (
        {
            "rec_no": str(number),
            "title": literal(title),
            "lead": _quoting(LEADS[number], evidence.get(number, ())),
            **{
                f"evidence_{i}": f"string({sql})"
                for i, sql in zip_longest((1, 2, 3), evidence.get(number, ()), fillvalue="NULL")
            },
            "actions": f"cast(array({', '.join(map(literal, actions))}) AS array<string>)",
        }
        for number, (title, actions) in RECOMMENDATIONS.items()
    )
    return _rows(_facts(book), lines)


def recommendations(purchases: DataFrame) -> DataFrame:
    """The recommendations straight from purchases."""
    return recommendations_from_book(report_groups(purchases, RECOMMENDATION_SEGMENTS))


def insight_from_report(discount: DataFrame) -> DataFrame:
    """(avg_with, avg_without, insight, recommendation) from the discount report.

    No row unless there are purchases both with and without a discount.
    """

    def of(flag: str, measure: Column) -> Column:
        return F.max(F.when(F.col("discount_applied") == flag, measure))

    raises = F.col("avg_with") > F.col("avg_without")
    return (
        discount.agg(
            of("Yes", F.col("average_purchase")).alias("avg_with"),
            of("No", F.col("average_purchase")).alias("avg_without"),
            of("Yes", F.lit(1)).alias("_with"),
            of("No", F.lit(1)).alias("_without"),
        )
        .where(F.col("_with").isNotNull() & F.col("_without").isNotNull())
        .select(
            "avg_with",
            "avg_without",
            *(
                F.when(raises, F.lit(yes)).otherwise(F.lit(no)).alias(name)
                for name, yes, no in zip(
                    ("insight", "recommendation"), DISCOUNT_RAISES, DISCOUNT_DOES_NOT_RAISE, strict=True
                )
            ),
        )
    )


def discount_insight(purchases: DataFrame) -> DataFrame:
    return insight_from_report(report(purchases, "discount"))
