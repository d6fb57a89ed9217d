"""A book of several loads equals one build from all purchases."""

from __future__ import annotations

import random
from functools import reduce

import pytest
from fixtures import mixed, purchases
from pyspark.sql import functions as F

from purchase_insights.operators.report_book import book_state
from purchase_insights.plans import growing_book
from purchase_insights.plans.pipeline import build_reports
from purchase_insights.plans.reports import report
from purchase_insights.schema import PURCHASE_COLUMNS


def rows(frames):
    return {name: sorted(map(repr, frame.collect())) for name, frame in frames.items()}


def loads(df, n):
    part = F.pmod(F.xxhash64(*df.columns), F.lit(n))
    return [df.where(part == k) for k in range(n)]


def test_loads_equal_one_build(spark, tmp_path):
    df = mixed(spark).select(*PURCHASE_COLUMNS)
    path = str(tmp_path / "book")
    for k, load in enumerate(loads(df, 3)):
        growing_book.add_load(load, path, f"2024/0{k} ä")
    assert rows(growing_book.grown_reports(spark, path)) == rows(build_reports(df))


def test_a_repeated_load_counts_once_and_is_replaced(spark, tmp_path):
    df = mixed(spark).select(*PURCHASE_COLUMNS)
    first, second = loads(df, 2)
    path = str(tmp_path / "book")
    growing_book.add_load(second, path, "a")  # wrong at first
    for load, load_id in ((first, "a"), (second, "b"), (first, "a")):
        growing_book.add_load(load, path, load_id)
    assert rows(growing_book.grown_reports(spark, path)) == rows(build_reports(df))
    with pytest.raises(ValueError, match="id"):
        growing_book.add_load(first, path, "")


def test_compacted_book_grows_on(spark, tmp_path):
    df = mixed(spark).select(*PURCHASE_COLUMNS)
    parts = loads(df, 3)
    for load, name in zip(parts[:2], "ab", strict=True):
        growing_book.add_load(load, str(tmp_path / "old"), name)
    growing_book.compact(spark, str(tmp_path / "old"), str(tmp_path / "new"), "until b")
    growing_book.add_load(parts[2], str(tmp_path / "new"), "c")
    assert rows(growing_book.grown_reports(spark, str(tmp_path / "new"))) == rows(build_reports(df))


def test_customers_of_any_id_count_exactly(spark, tmp_path):
    """Ids beside each other, far apart, negative, missing, in several loads."""
    rng = random.Random(2)
    ids = [None, 0, -1, -64, -65, 63, 64, 2**63 - 1, -(2**63), *range(100, 400), *(rng.randrange(-(2**62), 2**62) for _ in range(300))]
    df = purchases(spark, *({"customer_id": i} for i in ids + ids[:50]))
    assert report(df, "overall").first()["total_customers"] == len(ids) - 1
    assert build_reports(df)["overall"].first()["total_customers"] == len(ids) - 1
    for load_id, load in (("x", df), ("y", df.where("customer_id > 50 OR customer_id IS NULL"))):
        growing_book.add_load(load, str(tmp_path / "book"), load_id)
    assert growing_book.grown_reports(spark, str(tmp_path / "book"))["overall"].first()["total_customers"] == len(ids) - 1


def test_blocks_of_customers(spark):
    """Ids in a row share a row of the state: a 64th of the customers."""
    df = reduce(lambda a, b: a.union(b), [purchases(spark, {}).withColumn("customer_id", F.lit(7 + k).cast("bigint")) for k in range(2)])
    many = df.limit(1).crossJoin(spark.range(6400).select(F.col("id").alias("_id"))).withColumn("customer_id", F.col("_id")).drop("_id")
    assert book_state(many).where("segment = 'customers'").count() == 100


def test_sketched_customers(spark, tmp_path):
    """Three standard errors of 0.8 %, for one table and for the union of two loads that overlap."""
    one = purchases(spark, {})
    many = one.crossJoin(spark.range(50_000).select(F.col("id").alias("_id")))
    many = many.withColumn("customer_id", F.col("_id") * 7919).drop("_id")
    exact, estimate = (report(many, "overall", approximate_customers=on).first() for on in (False, True))
    assert exact["total_customers"] == 50_000 and estimate["total_customers"] != 50_000
    assert estimate["total_customers"] == pytest.approx(50_000, rel=0.024)
    assert exact[:5] == estimate[:5]
    path = str(tmp_path / "book")
    for load_id, load in (("low", many.where("customer_id < 7919 * 30000")), ("high", many.where("customer_id >= 7919 * 20000"))):
        growing_book.add_load(load, path, load_id, approximate_customers=True)
    assert growing_book.states(spark, path).where("segment = 'customers'").count() == 2
    grown = growing_book.grown_reports(spark, path)["overall"].first()["total_customers"]
    assert grown == pytest.approx(50_000, rel=0.024)
    none = report(many.limit(0), "overall", approximate_customers=True).first()
    assert none["total_customers"] == 0 and none["total_transactions"] == 0
    growing_book.add_load(many.limit(5), path, "exact")
    with pytest.raises(Exception, match="sketched"):
        growing_book.grown_book(spark, path)
