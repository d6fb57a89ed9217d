"""Purchases derived from a TPC-H-like star schema of parquet tables.

The only module that knows those tables; everything else sees purchases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The columns read, with their types: no job to infer them.
TABLES = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_quantity double, l_extendedprice double, l_discount double,"
    " l_tax double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_nationkey int, c_acctbal double",
    "nation": "n_nationkey int, n_name string",
    "part": "p_partkey bigint, p_name string, p_type string",
}

# How a purchase column follows from the tables.
RAW_COLUMNS = {
    "customer_id": "c_custkey",
    "age": "int(15 + c_custkey % 58)",
    "gender": "if(c_custkey % 3 = 0, 'Female', 'Male')",
    "item_purchased": "p_name",
    "category": "p_type",
    "purchase_amount": "cast(l_extendedprice AS decimal(12,2))",
    "location": "if(l_orderkey % 1000 = 0, n_name || ' REMOTE', n_name)",
    "season": "CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'Winter' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'Spring'"
    " WHEN month(o_orderdate) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END",
    "review_rating": "CASE WHEN l_tax <> 0 THEN cast(1 + l_tax * 40 + CASE p_type WHEN 'ECONOMY' THEN 0.0"
    " WHEN 'LARGE' THEN 0.1 WHEN 'MEDIUM' THEN 0.2 WHEN 'PROMO' THEN 0.3 WHEN 'SMALL' THEN 0.4 ELSE 0.5 END"
    " AS decimal(3,1)) END",
    "subscription_status": "if(c_acctbal >= 4500, 'Yes', 'No')",
    "shipping_type": "o_orderpriority",
    "discount_applied": "if(l_discount > 0, 'Yes', 'No')",
    "promo_code_used": "if(l_discount > 0.05, 'Yes', 'No')",
    "previous_purchases": "int(l_quantity)",
    "frequency_of_purchases": "element_at(array('Weekly', 'Bi-Weekly', 'Fortnightly', 'Monthly', 'Quarterly',"
    " 'Every 3 Months', 'Annually', 'Daily'), int(c_custkey % 8 + 1))",
}


def raw_purchases(spark: SparkSession, directory: str) -> DataFrame:
    """One raw purchase record per line item."""
    lines, orders, customers, nations, parts = (
        spark.read.schema(columns).parquet(f"{directory}/{name}.parquet") for name, columns in TABLES.items()
    )
    # Orders meet their customers before the line items do, so the largest table
    # is shuffled once for both. Line items and orders grow together: neither may
    # be broadcast, and adaptive execution splits skewed keys of a merge join.
    # The other joins are left to Spark's size check.
    buyers = orders.join(customers, orders.o_custkey == customers.c_custkey).join(
        nations, customers.c_nationkey == nations.n_nationkey
    )
    purchases = (
        lines.hint("merge")
        .join(buyers, lines.l_orderkey == buyers.o_orderkey)
        .join(parts, lines.l_partkey == parts.p_partkey)
    )
    return purchases.selectExpr(*(f"{expression} AS {name}" for name, expression in RAW_COLUMNS.items()))
