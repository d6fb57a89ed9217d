from __future__ import annotations

import re
from decimal import Decimal
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from purchase_insights.operators.cleaning import clean_purchases
from purchase_insights.plans.pipeline import load_checked
from purchase_insights.sources import csv_files
from purchase_insights.sources.csv_files import export_csv, read_export, read_purchases_csv

SCHEMA = "id bigint, text string, amount decimal(12,2), rating double"
ROWS = [
    (1, "plain", Decimal("10.00"), 3.5),
    (2, 'say "hi"', Decimal("-0.10"), None),
    (3, "two\nlines", None, 4.0),
    (4, "a,b;c", Decimal("12345678.90"), 2.25),
    (5, "  padded  ", Decimal("0.00"), 1.0),
    (6, None, Decimal("1.00"), 1.0),
    (7, "", Decimal("1.00"), 5.0),
    (8, "Zoë – 東京 \\ #", Decimal("1.00"), 0.1),
    (9, "carriage\rreturn", None, None),
    (None, "tab\there", Decimal("1.00"), 3.0),
]


def exported_bytes(path: Path) -> bytes:
    (part,) = path.glob("*.csv")
    return part.read_bytes()


def test_export_is_what_pandas_writes(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    stats = export_csv(df.coalesce(1), str(tmp_path / "out"))
    frame = pd.DataFrame(ROWS, columns=df.columns).astype({"id": "Int64"})
    expected = frame.to_csv(index=False, na_rep="").encode("utf-8-sig")
    found = exported_bytes(tmp_path / "out")
    assert sorted(found.split(b"\n")) == sorted(expected.split(b"\n"))
    assert found.startswith(b"\xef\xbb\xbfid,text,amount,rating\n")
    assert (stats.rows, stats.columns, stats.files) == (len(ROWS), 4, 1)
    assert stats.size_kb == pytest.approx(len(found) / 1024)


def test_export_reads_back(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    stats = export_csv(df.repartition(3), str(tmp_path / "out"))
    assert stats.rows == len(ROWS)
    assert stats.files == len(list((tmp_path / "out").glob("*.csv")))
    back = read_export(spark, str(tmp_path / "out"), df.schema).collect()
    expected = [(i, t or None, a, r) for i, t, a, r in ROWS]
    assert sorted(map(str, map(tuple, back))) == sorted(map(str, expected))


def test_export_of_an_empty_table_has_a_header(spark, tmp_path):
    stats = export_csv(spark.createDataFrame([], SCHEMA).coalesce(1), str(tmp_path / "out"))
    assert exported_bytes(tmp_path / "out") == b"\xef\xbb\xbfid,text,amount,rating\n"
    assert stats.rows == 0


NUMBERS = [
    1e7, 12345678.9, 0.0001, 0.00012345, 1e-5, 1.5e-7, 3.5, -2.0, 0.0, 1e16, 123456789012345.6, 1e22, -9.99e-300,
    float("inf"), -float("inf"), float("nan"), None,
]


def test_binary_numbers_are_written_as_pandas_does(spark, tmp_path):
    df = spark.createDataFrame([(x,) for x in NUMBERS], "x double").coalesce(1)
    export_csv(df, str(tmp_path / "out"))
    expected = pd.DataFrame({"x": pd.array(NUMBERS, dtype="float64")}).to_csv(index=False, na_rep='""')
    found = exported_bytes(tmp_path / "out").decode("utf-8-sig").replace("\n\n", '\n""\n').replace("\n\n", '\n""\n')
    assert found.split("\n")[:16] == expected.split("\n")[:16]


def test_statistics_of_an_append_are_its_own(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    first = export_csv(df.coalesce(1), str(tmp_path / "out"))
    second = export_csv(df.limit(3).repartition(2), str(tmp_path / "out"), mode="append")
    sizes = [f.stat().st_size for f in (tmp_path / "out").glob("*.csv")]
    assert (first.rows, first.files, second.rows, second.files) == (len(ROWS), 1, 3, 2)
    assert first.size_bytes + second.size_bytes == sum(sizes)


def test_an_export_of_more_than_a_million_rows_is_whole(spark, tmp_path):
    df = spark.range(1_200_000)
    stats = export_csv(df, str(tmp_path / "out"))
    assert stats.rows == 1_200_000
    assert read_export(spark, str(tmp_path / "out"), df.schema).agg(F.sum("id")).first()[0] == 1_200_000 * 1_199_999 // 2


RAW_CSV = '''Customer ID,Age,Category,Item Purchased,Purchase Amount (USD),Review Rating,Frequency of Purchases,Promo Code Used,Color
1,29,Clothing,Blouse,53.10,3.1,Weekly,Yes,red
2,30,Clothing,"Coat, long",64,NA,Fortnightly,No,n/a
3,,Clothing,NULL,,4.0,Every 3 Months,No,"blue ""navy"""
4,71,None,Belt,10.5,2.0,daily,No,
'''


def write(path: Path, text: str, encoding: str = "utf-8") -> str:
    path.write_bytes(text.encode(encoding))
    return str(path)


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig"])
def test_ingest_and_clean(spark, tmp_path, encoding):
    raw = read_purchases_csv(spark, write(tmp_path / "raw.csv", RAW_CSV, encoding))
    assert dict(raw.dtypes)["Purchase Amount (USD)"] == "decimal(12,2)"
    assert dict(raw.dtypes)["Review Rating"] == "double"
    rows = clean_purchases(raw).orderBy("customer_id")
    assert rows.columns == [
        "customer_id", "age", "category", "item_purchased", "purchase_amount", "review_rating",
        "frequency_of_purchases", "color", "age_group", "purchase_frequency_days",
    ]
    assert [tuple(r) for r in rows.collect()] == [
        (1, 29, "Clothing", "Blouse", Decimal("53.10"), 3.1, "Weekly", "red", "Young Adult", 7),
        (2, 30, "Clothing", "Coat, long", Decimal("64.00"), 3.55, "Fortnightly", None, "Adult", 14),
        (3, None, "Clothing", None, None, 4.0, "Every 3 Months", 'blue "navy"', None, 90),
        (4, 71, None, "Belt", Decimal("10.50"), None, "daily", None, None, None),
    ]


def test_types_can_be_overridden(spark, tmp_path):
    path = write(tmp_path / "raw.csv", "Age,Score\n29.5,7\n")
    rows = read_purchases_csv(spark, path, types={"age": "double", "score": "int"}).collect()
    assert [tuple(r) for r in rows] == [(29.5, 7)]


@pytest.mark.parametrize(
    ("column", "text", "value"),
    [
        ("Previous Purchases", "34.0", 34), ("Previous Purchases", "1e1", 10), ("Previous Purchases", " 7 ", 7),
        ("Age", "29.5", 29.5), ("Age", "34.0", 34.0), ("Purchase Amount (USD)", "53.990", Decimal("53.99")),
        ("Purchase Amount (USD)", "1e2", Decimal("100.00")), ("Customer ID", "12345678901.0", 12345678901),
    ],
)
def test_numbers_written_in_other_ways(spark, tmp_path, column, text, value):
    path = write(tmp_path / "raw.csv", f"{column},Color\n{text},red\n")
    assert read_purchases_csv(spark, path).first()[0] == value


@pytest.mark.parametrize(
    ("column", "text"),
    [
        ("Previous Purchases", "34.5"), ("Purchase Amount (USD)", "53.999"), ("Purchase Amount (USD)", "0.004"),
        ("Purchase Amount (USD)", "0.00000000000000000001"), ("Customer ID", "1.25"),
    ],
)
def test_a_value_that_its_type_would_change_is_an_error(spark, tmp_path, column, text):
    path = write(tmp_path / "raw.csv", f"{column},Color\n{text},red\n")
    with pytest.raises(Exception, match=re.escape(f"{column}: {text} does not fit")):
        read_purchases_csv(spark, path).collect()


def test_a_wider_type_keeps_more_decimals(spark, tmp_path):
    path = write(tmp_path / "raw.csv", "Purchase Amount (USD),Color\n53.999,red\n")
    rows = read_purchases_csv(spark, path, types={"purchase_amount_(usd)": "decimal(18,4)"}).collect()
    assert rows[0][0] == Decimal("53.9990")


def test_text_in_a_number_column_is_an_error(spark, tmp_path):
    path = write(tmp_path / "raw.csv", "Age\nold\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_purchases_csv(spark, path).collect()


def test_broken_records_are_an_error_unless_allowed(spark, tmp_path):
    path = write(tmp_path / "raw.csv", "Age,Category,Color\n30,a,red\n31,b\n")
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        read_purchases_csv(spark, path).collect()
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        read_purchases_csv(spark, path).select("Age").collect()
    short = read_purchases_csv(spark, path, mode="PERMISSIVE").orderBy("Age").collect()
    assert [tuple(r) for r in short] == [(30, "a", "red"), (31, "b", None)]


def test_quoted_line_breaks_need_multi_line(spark, tmp_path):
    path = write(tmp_path / "raw.csv", 'Age,Category,Color\n30,"a\nb",red\n')
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        read_purchases_csv(spark, path).collect()
    rows = read_purchases_csv(spark, path, multi_line=True).collect()
    assert [tuple(r) for r in rows] == [(30, "a\nb", "red")]


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig"])
@pytest.mark.parametrize("multi_line", [False, True])
def test_a_folder_of_files(spark, tmp_path, encoding, multi_line):
    for i in range(4):
        write(tmp_path / f"part{i}.csv", f"Age,Category\n{20 + i},c{i}\n", encoding)
    raw = read_purchases_csv(spark, str(tmp_path), multi_line=multi_line)
    assert raw.columns == ["Age", "Category"]
    assert raw.agg(F.sum("Age").alias("s")).first()["s"] == 86


def test_files_must_share_their_header(spark, tmp_path):
    write(tmp_path / "part0.csv", "Age,Category\n20,a\n")
    write(tmp_path / "part1.csv", "Category,Age\nb,30\n")
    with pytest.raises(Exception, match="CSV header does not conform|HEADER"):
        read_purchases_csv(spark, str(tmp_path)).collect()


def write_text(tmp_path, text, name="purchases.csv"):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_inferred_types(spark, tmp_path):
    """Each column gets the narrowest type of all its values, over several files; known ones keep theirs."""
    header = "Customer Id,whole,number,mixed,truth,flag,big,none,odd name`\n"
    write_text(tmp_path, header + "1,7,1.5,1,True,yes,99999999999999999999,NA,+3\n2,-8,2e3,x,FALSE,no,1,,-0\n", "a.csv")
    write_text(tmp_path, header + "3,NA,inf,2.5,NA,true,2,null,12\n", "b.csv")
    text = spark.read.csv(str(tmp_path), header=True)
    kinds = {r["name"]: (r["type"], r["n_values"]) for r in csv_files.column_kinds(text, text.columns).collect()}
    assert kinds == {
        "Customer Id": ("bigint", 3), "whole": ("bigint", 2), "number": ("double", 3), "mixed": ("string", 3),
        "truth": ("boolean", 2), "flag": ("string", 3), "big": ("string", 3), "none": ("string", 0), "odd name`": ("bigint", 3),
    }
    read = csv_files.read_purchases_csv(spark, str(tmp_path), infer_others=True)
    assert dict(read.dtypes) == {name: "bigint" if name == "Customer Id" else kind for name, (kind, _) in kinds.items()}
    rows = sorted(map(tuple, read.select("whole", "number", "truth", "mixed").collect()), key=repr)
    assert rows == [(-8, 2000.0, False, "x"), (7, 1.5, True, "1"), (None, float("inf"), None, "2.5")]
    assert dict(csv_files.read_purchases_csv(spark, str(tmp_path)).dtypes)["whole"] == "string"


def test_checked_load_loses_no_record(spark, tmp_path):
    text = (
        "Customer ID,Age,Category,Review Rating,Purchase Amount (USD),Previous Purchases,Frequency of Purchases,Promo Code Used\n"
        "1,20,a,4.0,10.50,3,Weekly,Yes\n"
        "2,20,a,NA,10.555,3,Weekly,Yes\n"
        "x,old,a,1.0,1e30,3.5,Weekly,Yes\n"
        "3,20,a,2.0\n"
        '4,20,"a, b",,7,1e1,Weekly,Yes\n'
        "5,20,a,2.0,1,1,Weekly,Yes,more\n"
    )
    path, target, refused = write_text(tmp_path, text), str(tmp_path / "target"), str(tmp_path / "refused")
    counts = load_checked(spark, path, target, refused)
    assert (counts.accepted, counts.refused) == (2, 4)
    accepted = spark.read.parquet(target)
    assert sorted((r.customer_id, r.category, r.review_rating, r.previous_purchases) for r in accepted.collect()) == [
        (1, "a", 4.0, 3), (4, "a, b", None, 10),
    ]
    found = {r.record: r.problems for r in spark.read.parquet(refused).collect()}
    assert found["2,20,a,NA,10.555,3,Weekly,Yes"] == ["purchase_amount_(usd): 10.555 does not fit decimal(12,2)"] or found[
        "2,20,a,NA,10.555,3,Weekly,Yes"
    ] == ["Purchase Amount (USD): 10.555 does not fit decimal(12,2)"]
    assert [p.split(":")[0] for p in found["x,old,a,1.0,1e30,3.5,Weekly,Yes"]] == [
        "Customer ID", "Age", "Purchase Amount (USD)", "Previous Purchases",
    ]
    assert found["3,20,a,2.0"] == found["5,20,a,2.0,1,1,Weekly,Yes,more"] == ["record: not 8 fields"]
    assert accepted.count() + len(found) == text.count("\n") - 1


def test_a_number_beyond_all_types_names_its_column(spark, tmp_path):
    path = write_text(tmp_path, "customer_id,purchase_amount\n1,1e30\n")
    with pytest.raises(Exception, match="purchase_amount: 1e30 does not fit"):
        csv_files.read_purchases_csv(spark, path).collect()
