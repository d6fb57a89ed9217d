"""The physical plans keep what makes them scale."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from purchase_insights.operators.cleaning import derive_columns
from purchase_insights.operators import rating, segments
from purchase_insights.operators.report_book import report_book, report_groups
from purchase_insights.plans.charts import CHARTS
from purchase_insights.plans.reports import REPORT_NAMES
from purchase_insights.sources.scratch import materialize
from purchase_insights.sources.star_schema import raw_purchases

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(TABLES).exists(), reason="no test tables")


def executed(df) -> str:
    """The final plan after adaptive execution."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def line_item_scans(plan: str) -> int:
    return len(re.findall(r"FileScan parquet \[l_orderkey", plan))


@pytest.mark.parametrize("name", [*REPORT_NAMES, *CHARTS, "report_groups", "executive_summary", "recommendations"])
def test_built_in_and_distributed(spark, name):
    plan = planned(registry.queries()[name](spark, TABLES))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ObjectHashAggregate"):
        assert operator not in plan
    # Rows are combined before the shuffle.
    assert "partial_" in plan
    # The line items are read once, also for the number of customers; results that need
    # their groups twice, for a total or for medians, read them from a stored table.
    assert line_item_scans(plan) == {"category": 0, "rating": 0}.get(name, 1)
    assert not re.search(r"Window.*\n.*Exchange SinglePartition", plan)


@pytest.mark.parametrize("name", ["category", "rating"])
def test_stored_groups_come_from_one_pass(spark, name, monkeypatch):
    """One scan, one aggregate of the purchases; everything else reads its few rows."""
    stored = []

    def keep(df, name):
        stored.append(df)
        return materialize(df, name)

    monkeypatch.setattr(segments, "materialize", keep)
    monkeypatch.setattr(rating, "materialize", keep)
    found = planned(registry.queries()[name](spark, TABLES))
    assert len(stored) == 1 and line_item_scans(planned(stored[0])) == 1 and line_item_scans(found) == 0
    assert planned(stored[0]).count("SortMergeJoin") == 1


def test_book_reads_the_line_items_once(spark):
    purchases = derive_columns(raw_purchases(spark, TABLES))
    plan = planned(report_book(purchases))
    assert line_item_scans(plan) == 1 and "ObjectHashAggregate" not in plan and "SortAggregate" not in plan


def test_rating_counts_read_the_line_items_once(spark):
    purchases = derive_columns(raw_purchases(spark, TABLES))
    assert line_item_scans(planned(report_groups(purchases, ("product", "rating")))) == 1


@pytest.mark.parametrize("name", ["gender", "season", "loyalty"])
def test_only_needed_columns_are_read(spark, name):
    plan = planned(registry.queries()[name](spark, TABLES))
    read = set(re.findall(r"\b([lopcn]_[a-z]+):", " ".join(re.findall(r"ReadSchema: struct<([^>]*)>", plan))))
    keys = {"l_orderkey", "l_partkey", "o_orderkey", "o_custkey", "c_custkey", "c_nationkey", "n_nationkey", "p_partkey"}
    own = {"gender": set(), "season": {"o_orderdate"}, "loyalty": {"l_quantity"}}[name]
    assert read == keys | {"l_extendedprice"} | own


@pytest.mark.parametrize("name", ["top_products", "bottom_products", "location", "customer_segments", "chart_top_products"])
def test_limits_need_no_full_sort(spark, name):
    plan = planned(registry.queries()[name](spark, TABLES))
    assert "TakeOrderedAndProject" in plan
    assert "rangepartitioning" not in plan


def test_groups_are_filtered_after_aggregation_only(spark):
    plan = planned(registry.queries()["high_value_locations"](spark, TABLES))
    assert re.search(r"Filter \(n_rows#\d+L >= 20\)", plan)


def test_a_hot_order_is_split(spark, tmp_path):
    """A third of the line items in one order: adaptive execution splits its partition."""
    folder = Path(TABLES)
    for name in ("orders", "customer", "nation", "part"):
        (tmp_path / f"{name}.parquet").symlink_to(folder / f"{name}.parquet")
    lines = spark.read.parquet(f"{TABLES}/lineitem.parquet")
    hot = lines.crossJoin(spark.range(4)).drop("id").withColumn("l_orderkey", F.lit(7).cast("bigint"))
    lines.union(hot).repartition(16).write.parquet(str(tmp_path / "lineitem.parquet"))
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        counts = raw_purchases(spark, str(tmp_path)).groupBy("season").count()
        plan = executed(counts)
        assert "skew=true" in plan
        assert sum(r["count"] for r in counts.collect()) == 5 * lines.count()
    finally:
        for key in settings:
            spark.conf.unset(key)
