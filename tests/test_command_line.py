from __future__ import annotations

import pytest

from purchase_insights.__main__ import main
from purchase_insights.plans.charts import CHARTS
from purchase_insights.plans.reports import REPORT_NAMES
from purchase_insights.schema import PURCHASE_COLUMNS

HEADER = (
    "Customer ID,Age,Gender,Item Purchased,Category,Purchase Amount (USD),Location,Season,Review Rating,"
    "Subscription Status,Shipping Type,Discount Applied,Promo Code Used,Previous Purchases,Frequency of Purchases\n"
)


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    for part in range(3):
        lines = (
            f"{part * 50 + i},{18 + i},{'Male' if i % 2 else 'Female'},Item {i % 4},Category {i % 3},{i}.50,State {i % 5},"
            f"{'Winter' if i % 2 else 'Fall'},{'NA' if i % 6 == 0 else 1 + i % 5},Yes,Express,{'No' if i % 3 else 'Yes'},"
            f"No,{i},Weekly\n"
            for i in range(50)
        )
        (folder / f"part{part}.csv").write_text(HEADER + "".join(lines))
    target = tmp_path_factory.mktemp("loaded") / "purchases"
    main(["load", str(folder), str(target)])
    return str(target)


def test_load(spark, loaded):
    purchases = spark.read.parquet(loaded)
    assert set(PURCHASE_COLUMNS) <= set(purchases.columns)
    assert purchases.count() == 150
    assert purchases.where("review_rating IS NULL").count() == 0
    assert dict(purchases.dtypes)["purchase_amount"] == "decimal(12,2)"


def test_reports(spark, loaded, tmp_path, capsys):
    main(["reports", loaded, str(tmp_path)])
    printed = capsys.readouterr().out
    assert all(name in printed for name in REPORT_NAMES)
    assert "OVERALL BUSINESS PERFORMANCE" in printed
    assert "PROTECT CUSTOMER RETENTION" in printed
    assert spark.read.parquet(str(tmp_path / "overall")).first()["total_transactions"] == 150
    written = {folder.name for folder in tmp_path.iterdir()}
    assert written == {*REPORT_NAMES, *CHARTS, "executive_summary", "discount_insight", "recommendations", "limitations"}


def test_charts_from_a_catalog_table(spark, loaded, tmp_path):
    spark.read.parquet(loaded).createOrReplaceTempView("stored")
    main(["charts", "table:stored", str(tmp_path), "--format", "json"])
    assert {folder.name for folder in tmp_path.iterdir()} == set(CHARTS)
    assert spark.read.json(str(tmp_path / "chart_revenue_by_category")).count() == 3


def test_export(loaded, tmp_path, capsys):
    main(["export", loaded, str(tmp_path / "out")])
    assert capsys.readouterr().out.startswith("150 rows, 16 columns, ")
    with pytest.raises(Exception, match="already exists"):
        main(["export", loaded, str(tmp_path / "out")])
    main(["export", loaded, str(tmp_path / "out"), "--overwrite"])


def test_growing_book(spark, loaded, tmp_path, capsys):
    """Adding a load twice changes nothing; the reports are those of the purchases."""
    book = str(tmp_path / "book")
    for _ in range(2):
        main(["add", loaded, book, "--load-id", "first"])
    main(["reports", f"book:{book}", str(tmp_path / "grown")])
    main(["reports", loaded, str(tmp_path / "built")])
    for name in ("overall", "category", "loyalty"):
        grown, built = (spark.read.parquet(str(tmp_path / kind / name)).collect() for kind in ("grown", "built"))
        assert sorted(map(repr, grown)) == sorted(map(repr, built)) and grown
    assert "STRONG SALES SEASONS" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["add", loaded, book])


def test_load_with_refused_records(spark, tmp_path, capsys):
    right = "1,18,Male,Item,Category,1.50,State,Fall,4,Yes,Express,No,No,3,Weekly\n"
    (tmp_path / "raw.csv").write_text(HEADER + right + right.replace("1.50", "1.505"))
    main(["load", str(tmp_path / "raw.csv"), str(tmp_path / "target"), "--refused", str(tmp_path / "refused")])
    assert capsys.readouterr().out == "1 rows loaded, 1 refused\n"
    assert spark.read.parquet(str(tmp_path / "target")).count() == 1


def test_export_of_a_size(loaded, tmp_path, capsys):
    main(["export", loaded, str(tmp_path / "out"), "--file-bytes", "1000000"])
    assert "16 columns, 1 file(s)" in capsys.readouterr().out
