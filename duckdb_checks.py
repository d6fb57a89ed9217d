"""DuckDB SQL that computes the expected result of every registered query.

Written against the driver's tables, independently of the library. Averages are
an exact decimal sum over a count, in both engines.
"""

from __future__ import annotations

# Titles, insights and recommendations that the results must have.
SECTION_TITLES = (
    "OVERALL BUSINESS PERFORMANCE",
    "PRODUCT AND CATEGORY PERFORMANCE",
    "CUSTOMER DEMOGRAPHICS",
    "SEASONAL AND GEOGRAPHIC PERFORMANCE",
    "CUSTOMER LOYALTY",
    "SHIPPING OPPORTUNITY",
    "DISCOUNT STRATEGY",
)
INSIGHTS = (
    "Customers receiving discounts have a higher average purchase amount.",
    "Customers receiving discounts do not have a higher average purchase amount.",
)
ADVICE = (
    "Continue targeted discounts for customer segments where discounts increase spending.",
    "Avoid broad discounts. Use targeted promotions instead, especially for inactive or low-frequency customers.",
)
# Title, SQL of the lead, SQL of the evidence, actions.
RECOMMENDATIONS = (
    (
        "INVEST IN HIGH-PERFORMING CATEGORIES",
        "'Focus additional marketing and inventory investment on ' || cat.category || ', the highest revenue category."
        " Potential actions:'",
        ("cat.category",),
        "Increase advertising; Improve product availability; Introduce premium versions; Cross-sell related products",
    ),
    (
        "PROMOTE THE BEST-SELLING PRODUCTS",
        "'Increase visibility for ' || top.item_purchased || ', which is currently one of the strongest"
        " revenue-generating products. Potential actions:'",
        ("top.item_purchased",),
        "Feature the product in campaigns; Create complementary product bundles; Use cross-selling recommendations",
    ),
    (
        "TARGET HIGH-VALUE CUSTOMERS",
        "'Prioritize the customer segment: Age Group: ' || seg.age_group || ', Subscription: '"
        " || seg.subscription_status || ', Purchase Frequency: ' || seg.frequency_of_purchases"
        " || '. This segment currently generates the highest segment revenue.'",
        ("seg.age_group", "seg.subscription_status", "seg.frequency_of_purchases"),
        "Create personalized campaigns specifically for this customer group",
    ),
    (
        "INCREASE CUSTOMER PURCHASE FREQUENCY",
        "'Encourage customers to purchase more frequently using:'",
        (),
        "Personalized product recommendations; Loyalty rewards; Subscription benefits; Reminder campaigns;"
        " Limited-time offers",
    ),
    (
        "USE TARGETED DISCOUNTS",
        "'Do not automatically give discounts to all customers. Use customer segmentation to target:'",
        (),
        "Low-frequency customers; New customers; Customers with lower purchase amounts;"
        " Customers who may need incentives to return",
    ),
    (
        "INVEST IN HIGH-POTENTIAL LOCATIONS",
        "'Increase marketing investment in high-performing locations. The highest revenue location is: ' || loc.location"
        " || '. Also investigate locations with high average purchases, such as: ' || val.location"
        " || '. These markets may represent opportunities for premium products and targeted expansion.'",
        ("loc.location", "val.location"),
        "",
    ),
    (
        "PREPARE FOR STRONG SALES SEASONS",
        "'The strongest revenue season is: ' || sea.season || '. Before this season:'",
        ("sea.season",),
        "Increase inventory; Increase marketing campaigns; Prepare product bundles; Improve promotional planning",
    ),
    (
        "PROTECT CUSTOMER RETENTION",
        "'Build a loyalty strategy around high-value customers. Potential programs:'",
        (),
        "Loyalty points; VIP rewards; Exclusive offers; Personalized recommendations; Early access to products",
    ),
)

RAW = """
raw AS (
SELECT c.c_custkey AS customer_id,
  CAST(15 + c.c_custkey % 58 AS INT) AS age,
  CASE WHEN c.c_custkey % 3 = 0 THEN 'Female' ELSE 'Male' END AS gender,
  p.p_name AS item_purchased, p.p_type AS category,
  CAST(l.l_extendedprice AS DECIMAL(12,2)) AS purchase_amount,
  CASE WHEN l.l_orderkey % 1000 = 0 THEN CONCAT(n.n_name, ' REMOTE') ELSE n.n_name END AS location,
  CASE WHEN EXTRACT(MONTH FROM o.o_orderdate) IN (12,1,2) THEN 'Winter'
       WHEN EXTRACT(MONTH FROM o.o_orderdate) IN (3,4,5) THEN 'Spring'
       WHEN EXTRACT(MONTH FROM o.o_orderdate) IN (6,7,8) THEN 'Summer' ELSE 'Fall' END AS season,
  CASE WHEN l.l_tax = 0 THEN NULL ELSE CAST(1 + l.l_tax * 40
    + CASE p.p_type WHEN 'ECONOMY' THEN 0.0 WHEN 'LARGE' THEN 0.1 WHEN 'MEDIUM' THEN 0.2
                    WHEN 'PROMO' THEN 0.3 WHEN 'SMALL' THEN 0.4 ELSE 0.5 END
    AS DECIMAL(3,1)) END AS review_rating,
  CASE WHEN c.c_acctbal >= 4500 THEN 'Yes' ELSE 'No' END AS subscription_status,
  o.o_orderpriority AS shipping_type,
  CASE WHEN l.l_discount > 0 THEN 'Yes' ELSE 'No' END AS discount_applied,
  CASE WHEN l.l_discount > 0.05 THEN 'Yes' ELSE 'No' END AS promo_code_used,
  CAST(l.l_quantity AS INT) AS previous_purchases,
  CASE c.c_custkey % 8 WHEN 0 THEN 'Weekly' WHEN 1 THEN 'Bi-Weekly' WHEN 2 THEN 'Fortnightly'
    WHEN 3 THEN 'Monthly' WHEN 4 THEN 'Quarterly' WHEN 5 THEN 'Every 3 Months'
    WHEN 6 THEN 'Annually' ELSE 'Daily' END AS frequency_of_purchases
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN part p ON l.l_partkey = p.p_partkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
)"""

_DERIVED_COLUMNS = """
  CASE WHEN age > 17 AND age <= 29 THEN 'Young Adult' WHEN age > 29 AND age <= 44 THEN 'Adult'
       WHEN age > 44 AND age <= 59 THEN 'Middle-aged' WHEN age > 59 AND age <= 70 THEN 'Senior' END AS age_group,
  CASE frequency_of_purchases WHEN 'Weekly' THEN 7 WHEN 'Bi-Weekly' THEN 14 WHEN 'Fortnightly' THEN 14
    WHEN 'Monthly' THEN 30 WHEN 'Quarterly' THEN 90 WHEN 'Every 3 Months' THEN 90 WHEN 'Annually' THEN 365 END
    AS purchase_frequency_days,
  CASE WHEN previous_purchases <= 10 THEN 'New Customer' WHEN previous_purchases <= 30 THEN 'Regular Customer'
       ELSE 'Loyal Customer' END AS customer_segment"""

# Ratings as they are, before any is imputed.
_DERIVED = f"grouped AS (SELECT *,{_DERIVED_COLUMNS} FROM raw)"

PURCHASES = f"""{RAW},
med AS (
SELECT category AS mcat, MEDIAN(CAST(review_rating AS DOUBLE)) AS med FROM raw GROUP BY category
),
purchases AS (
SELECT customer_id, age, gender, item_purchased, category, purchase_amount, location, season,
  CASE WHEN category IS NULL THEN NULL ELSE COALESCE(CAST(review_rating AS DOUBLE), med) END AS review_rating,
  subscription_status, shipping_type, discount_applied, previous_purchases, frequency_of_purchases,{_DERIVED_COLUMNS}
FROM raw LEFT JOIN med ON category = mcat
)"""

_REVENUE = "CAST(SUM(purchase_amount) AS DOUBLE) AS total_revenue"
_MEAN = "CAST(SUM(purchase_amount) AS DOUBLE) / COUNT(purchase_amount)"
_AVERAGE = f"{_MEAN} AS average_purchase"
_RATING = "CAST(SUM(CAST(review_rating AS DECIMAL(18,9))) AS DOUBLE) / COUNT(review_rating) AS average_rating"
_SHARE = (
    "ROUND(CAST(SUM(purchase_amount) AS DOUBLE) * 100.0"
    " / (SELECT CAST(SUM(purchase_amount) AS DOUBLE) FROM purchases), 2) AS revenue_percentage"
)


def _grouped(keys: str, *measures: str, order: str | None = None, having: str = "", limit: int | None = None) -> str:
    sql = f"SELECT {keys}, {', '.join(measures)} FROM purchases GROUP BY {keys} {having}"
    if order:
        sql += f" ORDER BY {order}, " + ", ".join(f"{key.strip()} ASC NULLS FIRST" for key in keys.split(","))
    return sql + (f" LIMIT {limit}" if limit else "")


_ROWS = "COUNT(*) AS transactions"
_CUSTOMERS = "COUNT(*) AS customers"
_REVENUE_DOWN = "SUM(purchase_amount) DESC NULLS FIRST"
_REVENUE_UP = "SUM(purchase_amount) ASC NULLS LAST"
_AVERAGE_DOWN = "average_purchase DESC NULLS FIRST"
_AT_LEAST_20 = "HAVING COUNT(*) >= 20"
_SEGMENT = "age_group, subscription_status, frequency_of_purchases"

REPORTS = {
    "overall": f"SELECT {_REVENUE}, {_AVERAGE}, CAST(MIN(purchase_amount) AS DOUBLE) AS minimum_purchase,"
    " CAST(MAX(purchase_amount) AS DOUBLE) AS maximum_purchase, COUNT(*) AS total_transactions,"
    " COUNT(DISTINCT customer_id) AS total_customers FROM purchases",
    "category": _grouped("category", _REVENUE, _AVERAGE, _ROWS, _SHARE, order=_REVENUE_DOWN),
    "top_products": _grouped("item_purchased, category", _REVENUE, _AVERAGE, _ROWS, order=_REVENUE_DOWN, limit=10),
    "bottom_products": _grouped("item_purchased, category", _REVENUE, _AVERAGE, _ROWS, order=_REVENUE_UP, limit=10),
    "discount": _grouped("discount_applied", _ROWS, _REVENUE, _AVERAGE, order=_AVERAGE_DOWN),
    "subscription": _grouped("subscription_status", _CUSTOMERS, _REVENUE, _AVERAGE, order=_REVENUE_DOWN),
    "age_group": _grouped("age_group", _CUSTOMERS, _REVENUE, _AVERAGE, order=_REVENUE_DOWN),
    "gender": _grouped("gender", _CUSTOMERS, _REVENUE, _AVERAGE, order=_REVENUE_DOWN),
    "frequency": _grouped(
        "frequency_of_purchases, purchase_frequency_days", _CUSTOMERS, _REVENUE, _AVERAGE, order=_REVENUE_DOWN
    ),
    "loyalty": _grouped("customer_segment", _CUSTOMERS, _REVENUE, _AVERAGE, order=_REVENUE_DOWN),
    "season": _grouped("season", _ROWS, _REVENUE, _AVERAGE, order=_REVENUE_DOWN),
    "location": _grouped("location", _CUSTOMERS, _REVENUE, _AVERAGE, order=_REVENUE_DOWN, limit=10),
    "high_value_locations": _grouped(
        "location", _CUSTOMERS, _REVENUE, _AVERAGE, having=_AT_LEAST_20, order=_AVERAGE_DOWN, limit=10
    ),
    "shipping": _grouped("shipping_type", _ROWS, _REVENUE, _AVERAGE, order=_AVERAGE_DOWN),
    "rating": _grouped(
        "item_purchased, category", _RATING, _REVENUE, _AVERAGE, _ROWS,
        having=_AT_LEAST_20, order="average_rating DESC NULLS FIRST",
    ),
    "customer_segments": _grouped(_SEGMENT, _CUSTOMERS, _REVENUE, _AVERAGE, order=_REVENUE_DOWN, limit=10),
}

CHARTS = {
    "chart_revenue_by_category": _grouped("category", _REVENUE, order=_REVENUE_DOWN),
    "chart_top_products": _grouped("item_purchased", _REVENUE, order=_REVENUE_DOWN, limit=10),
    "chart_revenue_by_age_group": _grouped("age_group", _REVENUE, order=_REVENUE_DOWN),
    "chart_discount_effectiveness": _grouped("discount_applied", _AVERAGE),
    "chart_revenue_by_season": _grouped("season", _REVENUE, order=_REVENUE_DOWN),
    "chart_subscription_analysis": _grouped("subscription_status", _AVERAGE),
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _pick(alias: str, report: str) -> str:
    """The first row of a report, NULLs if the report is empty."""
    return f"{alias} AS (SELECT t.* FROM (SELECT 1) one LEFT JOIN (SELECT * FROM ({REPORTS[report]}) LIMIT 1) t ON TRUE)"


_PICKS = {
    "cat": "category",
    "top": "top_products",
    "bot": "bottom_products",
    "age": "age_group",
    "seg": "customer_segments",
    "sea": "season",
    "loc": "location",
    "val": "high_value_locations",
    "loy": "loyalty",
    "shp": "shipping",
}
_PICK_CTES = ",\n".join(_pick(alias, report) for alias, report in _PICKS.items())

_DISCOUNT = f"""
disc AS (
SELECT MAX(CASE WHEN discount_applied = 'Yes' THEN average_purchase END) AS avg_with,
  MAX(CASE WHEN discount_applied = 'No' THEN average_purchase END) AS avg_without,
  COUNT(CASE WHEN discount_applied = 'Yes' THEN 1 END) AS n_with,
  COUNT(CASE WHEN discount_applied = 'No' THEN 1 END) AS n_without
FROM ({REPORTS["discount"]})
)"""


def _summary() -> str:
    def grouped(value: str) -> str:
        return f"'$' || format('{{:,.2f}}', {value})"

    def plain(value: str) -> str:
        return f"'$' || format('{{:.2f}}', {value})"

    def line(section: int, metric: str, label: str, value: str, display: str, source: str) -> str:
        return (
            f"SELECT CAST({section} AS INT) AS section, {_quoted(SECTION_TITLES[section - 1])} AS section_title,"
            f" {_quoted(metric)} AS metric, CAST({label} AS VARCHAR) AS label,"
            f" CAST({value} AS DOUBLE) AS value, {display} AS display FROM {source}"
        )

    lines = [
        line(1, "total_revenue", "NULL", "total_revenue", grouped("total_revenue"), "ov"),
        line(1, "total_transactions", "NULL", "total_transactions", "format('{:,}', total_transactions)", "ov"),
        line(1, "total_customers", "NULL", "total_customers", "format('{:,}', total_customers)", "ov"),
        line(1, "average_purchase", "NULL", "average_purchase", plain("average_purchase"), "ov"),
        line(1, "minimum_purchase", "NULL", "minimum_purchase", plain("minimum_purchase"), "ov"),
        line(1, "maximum_purchase", "NULL", "maximum_purchase", plain("maximum_purchase"), "ov"),
        line(2, "top_category", "category", "total_revenue", grouped("total_revenue"), "cat"),
        line(
            2, "top_category_share", "category", "revenue_percentage", "format('{:.2f}', revenue_percentage) || '%'", "cat"
        ),
        line(2, "top_product", "item_purchased", "total_revenue", grouped("total_revenue"), "top"),
        line(2, "bottom_product", "item_purchased", "total_revenue", grouped("total_revenue"), "bot"),
        line(3, "top_age_group", "age_group", "total_revenue", grouped("total_revenue"), "age"),
        line(3, "top_segment_age_group", "age_group", "NULL", "age_group", "seg"),
        line(3, "top_segment_subscription", "subscription_status", "NULL", "subscription_status", "seg"),
        line(3, "top_segment_frequency", "frequency_of_purchases", "NULL", "frequency_of_purchases", "seg"),
        line(3, "top_segment_revenue", "NULL", "total_revenue", grouped("total_revenue"), "seg"),
        line(4, "top_season", "season", "total_revenue", grouped("total_revenue"), "sea"),
        line(4, "top_location", "location", "total_revenue", grouped("total_revenue"), "loc"),
        line(4, "top_average_location", "location", "average_purchase", plain("average_purchase"), "val"),
        line(5, "top_loyalty_segment", "customer_segment", "total_revenue", grouped("total_revenue"), "loy"),
        line(6, "top_shipping", "shipping_type", "average_purchase", plain("average_purchase"), "shp"),
    ]
    both = "n_with > 0 AND n_without > 0"
    for metric, label, average in (
        ("average_with_discount", "Yes", "avg_with"),
        ("average_without_discount", "No", "avg_without"),
    ):
        value = f"CASE WHEN {both} THEN {average} END"
        lines.append(line(7, metric, _quoted(label), value, plain(value), "disc"))
    body = "\nUNION ALL ".join(lines)
    return f"WITH {PURCHASES},\nov AS ({REPORTS['overall']}),\n{_PICK_CTES},\n{_DISCOUNT}\n{body}"


def _insight() -> str:
    texts = ", ".join(
        f"CASE WHEN avg_with > avg_without THEN {_quoted(yes)} ELSE {_quoted(no)} END AS {name}"
        for name, (yes, no) in (("insight", INSIGHTS), ("recommendation", ADVICE))
    )
    return f"WITH {PURCHASES},\n{_DISCOUNT}\nSELECT avg_with, avg_without, {texts} FROM disc WHERE n_with > 0 AND n_without > 0"


def _recommendations() -> str:
    lines = []
    for number, (title, lead, evidence, actions) in enumerate(RECOMMENDATIONS, 1):
        known = [*evidence, "NULL", "NULL", "NULL"][:3]
        columns = ", ".join(f"CAST({column} AS VARCHAR) AS evidence_{i}" for i, column in enumerate(known, 1))
        lines.append(
            f"SELECT CAST({number} AS INT) AS rec_no, {_quoted(title)} AS title, {lead} AS lead, {columns},"
            f" {_quoted(actions)} AS actions FROM cat, top, seg, loc, val, sea"
        )
    body = "\nUNION ALL ".join(lines)
    return f"WITH {PURCHASES},\n{_PICK_CTES}\n{body}"


def _book() -> str:
    def segment(name: str, *keys: str) -> str:
        texts = [f"CAST({key} AS VARCHAR)" for key in keys] + ["CAST(NULL AS VARCHAR)"] * (3 - len(keys))
        columns = ", ".join(f"{text} AS key_{i}" for i, text in enumerate(texts, 1))
        group = "GROUP BY " + ", ".join(keys) if keys else "HAVING COUNT(*) > 0"
        return (
            f"SELECT '{name}' AS segment, {columns}, COUNT(*) AS n_rows, COUNT(purchase_amount) AS n_priced,"
            " CAST(SUM(purchase_amount) AS DOUBLE) AS revenue, CAST(MIN(purchase_amount) AS DOUBLE) AS lowest,"
            " CAST(MAX(purchase_amount) AS DOUBLE) AS highest, COUNT(review_rating) AS n_rated,"
            " CAST(SUM(review_rating) AS DOUBLE) AS rating_total"
            f" FROM grouped {group}"
        )

    parts = [
        segment("product", "item_purchased", "category"),
        segment("category", "category"),
        segment("item", "item_purchased"),
        segment("rating", "category", "review_rating"),
        segment("buyer", "age_group", "subscription_status", "frequency_of_purchases"),
        segment("age_group", "age_group"),
        segment("subscription", "subscription_status"),
        segment("frequency", "frequency_of_purchases", "purchase_frequency_days"),
        segment("gender", "gender"),
        segment("season", "season"),
        segment("discount", "discount_applied"),
        segment("shipping", "shipping_type"),
        segment("loyalty", "customer_segment"),
        segment("location", "location"),
        segment("overall"),
    ]
    return f"WITH {PURCHASES},\n{_DERIVED}\n" + "\nUNION ALL ".join(parts)


_RAW_COLUMNS = (
    "customer_id, age, gender, item_purchased, category, CAST(purchase_amount AS DOUBLE) AS purchase_amount, location,"
    " season, CAST(review_rating AS DOUBLE) AS review_rating, subscription_status, shipping_type, discount_applied,"
    " promo_code_used, previous_purchases, frequency_of_purchases"
)
_HALF_AGES = "CASE WHEN customer_id % 7 = 0 THEN age + 0.5::DOUBLE ELSE CAST(age AS DOUBLE) END AS age,"
_CLEAN_COLUMNS = (
    "customer_id, age, gender, item_purchased, category, CAST(purchase_amount AS DOUBLE) AS purchase_amount, location,"
    " season, review_rating, subscription_status, shipping_type, discount_applied, previous_purchases,"
    " frequency_of_purchases, age_group, purchase_frequency_days"
)
_WHOLE_AGES = "CAST(age AS DOUBLE) AS age,"
_LINE_BYTES = " + ".join(
    f"COALESCE(strlen(CAST({column} AS VARCHAR)), 0)"
    for column in (
        "customer_id", "age", "gender", "item_purchased", "category", "purchase_amount", "location", "season",
        "review_rating", "subscription_status", "shipping_type", "discount_applied", "previous_purchases",
        "frequency_of_purchases", "age_group", "purchase_frequency_days",
    )
)
_CLEAN = f"WITH {PURCHASES} SELECT {_CLEAN_COLUMNS} FROM purchases"


_TEXT_COLUMNS = (
    "customer_id", "age", "gender", "item_purchased", "category", "purchase_amount", "location", "season",
    "review_rating", "subscription_status", "shipping_type", "discount_applied", "promo_code_used",
    "previous_purchases", "frequency_of_purchases",
)
_TITLES = {"purchase_amount": "Purchase Amount (USD)"}


def _inferred_types() -> str:
    """The narrowest type of all texts of a column, by regular expressions and casts of their own."""
    counts = "CASE WHEN previous_purchases = 10 THEN '1e1' WHEN previous_purchases % 2 = 0 THEN previous_purchases || '.0' ELSE CAST(previous_purchases AS VARCHAR) END"
    texts = ", ".join(
        f"{counts if c == 'previous_purchases' else f'CAST({c} AS VARCHAR)'} AS {c}" for c in _TEXT_COLUMNS
    )
    kinds = "\nUNION ALL ".join(
        f"""SELECT '{_TITLES.get(c, c.replace("_", " ").title())}' AS name,
        CASE WHEN COUNT({c}) = 0 THEN 'string' WHEN bool_and(regexp_full_match({c}, '[+-]?[0-9]+')) THEN 'bigint'
             WHEN COUNT(TRY_CAST({c} AS DOUBLE)) = COUNT({c}) THEN 'double'
             WHEN bool_and(lower({c}) IN ('true', 'false')) THEN 'boolean' ELSE 'string' END AS type,
        COUNT({c}) AS n_values FROM texts"""
        for c in _TEXT_COLUMNS
    )
    return f"WITH {RAW}, texts AS (SELECT {texts} FROM raw)\n{kinds}"


# Records of the faulty file, and what is wrong with them.
_FAULTS = {
    "previous_purchases = 7": "'customer_id: c' || customer_id || ' does not fit bigint'",
    "customer_id % 11 = 0": "'purchase_amount: ' || purchase_amount || '5 does not fit decimal(12,2)'",
    "customer_id % 13 = 0": "'previous_purchases: ' || previous_purchases || ' times does not fit int'",
}


def _checked_load() -> str:
    """The purchases of the records without a fault; medians are of their ratings alone."""
    right = " AND ".join(f"NOT ({fault})" for fault in _FAULTS)
    accepted = RAW.replace("raw AS (", "records AS (", 1) + f",\nraw AS (SELECT * FROM records WHERE {right})"
    columns = _CLEAN_COLUMNS.replace("customer_id, age,", f"customer_id, {_WHOLE_AGES}", 1)
    return f"WITH {PURCHASES.replace(RAW, accepted, 1)} SELECT {columns} FROM purchases"


def _refused_rows() -> str:
    problems = ", ".join(f"CASE WHEN {fault} THEN {text} END" for fault, text in _FAULTS.items())
    return f"WITH {RAW} SELECT CONCAT_WS('; ', {problems}) AS problems FROM raw WHERE {' OR '.join(_FAULTS)}"


def expected() -> dict[str, str]:
    """DuckDB SQL by query name."""
    purchases = {name: f"WITH {PURCHASES}\n{sql}" for name, sql in {**REPORTS, **CHARTS}.items()}
    return {
        # Written as 34.5, 7.0 and 1e1 in the file.
        "csv_scan": f"WITH {RAW} SELECT {_RAW_COLUMNS.replace('age,', _HALF_AGES)} FROM raw",
        "table_scan": _CLEAN,
        "query_scan": f"WITH {PURCHASES} "
        + _grouped("gender, season", _REVENUE, _SHARE, order=_REVENUE_DOWN, having="HAVING COUNT(*) >= 20"),
        "impute_rating": f"WITH {PURCHASES} SELECT customer_id, item_purchased, category, review_rating FROM purchases",
        "age_bins": f"WITH {PURCHASES} SELECT customer_id, age, age_group FROM purchases",
        "frequency_days": f"WITH {PURCHASES} SELECT customer_id, frequency_of_purchases, purchase_frequency_days"
        " FROM purchases",
        "frequency_table": f"WITH {PURCHASES} SELECT customer_id, frequency_of_purchases, purchase_frequency_days"
        " FROM purchases",
        "age_groups_in_order": f"WITH {PURCHASES} SELECT age_group, {_REVENUE}, CAST(CASE age_group"
        " WHEN 'Young Adult' THEN 0 WHEN 'Adult' THEN 1 WHEN 'Middle-aged' THEN 2 WHEN 'Senior' THEN 3 END AS INTEGER)"
        " AS age_rank FROM purchases GROUP BY age_group",
        "clean_purchases": _CLEAN,
        **purchases,
        "report_groups": _book(),
        "executive_summary": _summary(),
        "discount_insight": _insight(),
        "recommendations": _recommendations(),
        "export_customer": _CLEAN,
        # Each line has 15 commas and a line end; none of the texts needs quotes.
        "export_statistics": f"WITH {PURCHASES} SELECT COUNT(*) AS n_rows, CAST(16 AS INT) AS n_columns,"
        f" CAST(SUM(16 + {_LINE_BYTES}) AS BIGINT) AS data_bytes FROM purchases",
        **{f"book_{name}": sql for name, sql in {
            **purchases, "executive_summary": _summary(), "discount_insight": _insight(), "recommendations": _recommendations(),
        }.items()},
        **{f"grown_{name}": purchases[name] for name in ("overall", "category", "rating")},
        "grown_executive_summary": _summary(),
        "inferred_types": _inferred_types(),
        "checked_load": _checked_load(),
        "refused_rows": _refused_rows(),
        "loaded_purchases": _CLEAN.replace("customer_id, age,", f"customer_id, {_WHOLE_AGES}", 1),
    }
