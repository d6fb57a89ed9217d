"""CSV in and out."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from purchase_insights.functions.columns import null_if_missing
from purchase_insights.functions.formats import shortest_number
from purchase_insights.schema import RAW_TYPES, checked_cast, exact_cast
from purchase_insights.sources.scratch import path_exists

BOM = "﻿"


def _kinds(columns: list[str], types: Mapping[str, T.DataType | str] | None) -> dict[str, T.DataType]:
    """The type of each column, by its normalised name; unknown ones are text."""
    known = {**RAW_TYPES, "purchase_amount_(usd)": RAW_TYPES["purchase_amount"], **(types or {})}
    kinds = {name: known.get(_normalised(name), T.StringType()) for name in columns}
    return {name: T.DataType.fromDDL(kind) if isinstance(kind, str) else kind for name, kind in kinds.items()}


def _normalised(name: str) -> str:
    return name.lower().replace(" ", "_")


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _with_inferred(text: DataFrame, types: Mapping[str, T.DataType | str] | None) -> dict[str, T.DataType | str]:
    """``types`` and those that the values of all unknown columns have in common."""
    types = dict(types or {})
    unknown = [name for name in text.columns if _normalised(name) not in {*RAW_TYPES, "purchase_amount_(usd)", *types}]
    return types | {_normalised(name): kind for name, kind in infer_types(text, unknown).items()}


def read_purchases_csv(
    spark: SparkSession,
    path: str | list[str],
    types: Mapping[str, T.DataType | str] | None = None,
    multi_line: bool = False,
    mode: str = "FAILFAST",
    infer_others: bool = False,
) -> DataFrame:
    """Raw purchases from CSV files with a header row.

    Only the header is read up front. Known columns (matched by their normalised header)
    get the types of ``RAW_TYPES``, overridden by ``types``; others stay text, or with
    ``infer_others`` get the type that all their values have (see ``infer_types``), which
    takes a pass over them. Texts that mark a missing value become NULL. Whole numbers may
    be written ``34.0``; a number that its type would change, as ``53.999`` an amount of
    two decimals, is an error that names the column.

    Files are split across tasks unless ``multi_line`` is set, which is needed
    when quoted fields hold line breaks. A record of the wrong length is an
    error; ``mode="PERMISSIVE"`` fills a short one with NULL instead. To find such records,
    whole records are parsed whichever columns are read.
    """
    reader = spark.read.options(
        header=True,
        enforceSchema=False,  # every file must have the header of the first
        multiLine=multi_line,
        mode=mode,
        escape='"',
        columnPruning=False,  # a broken record is an error whichever columns are read
    )
    text = reader.csv(path)
    kinds = _kinds(text.columns, _with_inferred(text, types) if infer_others else types)
    return text.select(
        *(exact_cast(null_if_missing(_quoted(name)), T.StringType(), kind, name).alias(name) for name, kind in kinds.items())
    )


#: Columns of ``read_checked_csv`` beside the purchases: what is wrong with a record, and its text if anything is.
PROBLEMS, RECORD = "_problems", "_record"


def read_checked_csv(
    spark: SparkSession,
    path: str | list[str],
    types: Mapping[str, T.DataType | str] | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """As ``read_purchases_csv``, but nothing in a record is an error.

    ``_problems`` lists a text for each value that does not fit its column, or one for a
    record of the wrong length; ``_record`` then has the record. Such values are NULL.
    """
    names = spark.read.csv(path, header=True, multiLine=multi_line, escape='"').columns
    fields = [T.StructField(name, T.StringType()) for name in (*names, RECORD)]
    text = spark.read.csv(
        path,
        schema=T.StructType(fields),
        header=True,
        enforceSchema=False,
        multiLine=multi_line,
        mode="PERMISSIVE",
        columnNameOfCorruptRecord=RECORD,
        escape='"',
    )
    checked = {
        name: checked_cast(null_if_missing(_quoted(name)), T.StringType(), kind, name)
        for name, kind in _kinds(names, types).items()
    }
    length = F.when(F.col(RECORD).isNotNull(), F.lit(f"record: not {len(names)} fields"))
    found = F.when(length.isNotNull(), F.array(length)).otherwise(
        F.array_compact(F.array(*(problem for _, problem in checked.values())))
    )
    whole = F.to_csv(F.struct(*(_quoted(name).alias(f"c{k}") for k, name in enumerate(names))))
    record = F.when(F.size(found) > 0, F.coalesce(F.col(RECORD), whole))
    return text.select(*(value.alias(name) for name, (value, _) in checked.items()), found.alias(PROBLEMS), record.alias(RECORD))


# What the values of a column are, as bits: merging columns of two parts is an OR.
_WHOLE, _NUMBER, _TRUTH, _TEXT = 1, 2, 4, 8


def _kind_bit(text: Column) -> Column:
    """The bit of one value, NULL for a missing one."""
    value = F.trim(text)
    whole = value.rlike("^[+-]?[0-9]+$")
    number = value.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity)$")
    return (
        F.when(null_if_missing(text).isNull(), None)
        .when(whole & value.try_cast("bigint").isNotNull(), _WHOLE)
        .when(whole, _TEXT)  # more digits than a number keeps
        .when(number, _NUMBER)
        .when(value.isin("true", "false", "True", "False", "TRUE", "FALSE"), _TRUTH)
        .otherwise(_TEXT)
    )


def column_kinds(text: DataFrame, columns: list[str]) -> DataFrame:
    """name, type, n_values: what all values of each text column can be read as, from one pass.

    ``bigint`` if all are whole numbers, ``double`` if all are numbers, ``boolean``, else
    ``string``, as for a column without values. Missing-value marks are of any type.
    """
    kinds = (F.bit_or(_kind_bit(_quoted(name))).alias(f"k{i}") for i, name in enumerate(columns))
    counts = (F.count(null_if_missing(_quoted(name))).alias(f"n{i}") for i, name in enumerate(columns))
    found = text.agg(*kinds, *counts)

    def kind(bits: Column) -> Column:
        number = F.when(bits == _WHOLE, "bigint").when(bits.isin(_NUMBER, _WHOLE | _NUMBER), "double")
        return number.when(bits == _TRUTH, "boolean").otherwise("string")

    rows = (
        F.struct(F.lit(name).alias("name"), kind(F.col(f"k{i}")).alias("type"), F.col(f"n{i}").alias("n_values"))
        for i, name in enumerate(columns)
    )
    return found.select(F.inline(F.array(*rows)))


def infer_types(text: DataFrame, columns: list[str]) -> dict[str, T.DataType]:
    """The type of each of the text columns (see ``column_kinds``)."""
    if not columns:
        return {}
    return {row["name"]: T.DataType.fromDDL(row["type"]) for row in column_kinds(text, columns).collect()}


@dataclass(frozen=True)
class ExportStats:
    rows: int
    columns: int
    files: int
    size_bytes: int

    @property
    def size_kb(self) -> float:
        return self.size_bytes / 1024


def _written_files(spark: SparkSession, path: str) -> tuple[int, int]:
    """Number and total bytes of the CSV files in a folder, if it exists; no file is opened."""
    if not path_exists(spark, path):
        return 0, 0
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path)
    return tuple(files.agg(F.count("length"), F.coalesce(F.sum("length"), F.lit(0))).first())


@contextmanager
def _partition_size(spark: SparkSession, size: int | None) -> Iterator[None]:
    """While it lasts, rebalanced partitions have about so many bytes."""
    settings = {} if size is None else {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(size),
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": str(min(size, 1 << 20)),
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def export_csv(df: DataFrame, path: str, mode: str = "error", file_bytes: int | None = None) -> ExportStats:
    """Write ``df`` as a folder of CSV files for a BI tool.

    Each file has a header and starts with a UTF-8 byte order mark; missing
    values are empty fields, binary numbers are written in the shortest form that
    gives the same number. There is a file per partition of ``df``, in its order. With
    ``file_bytes`` rows are dealt anew, in any order, so that the data of a file take about
    so many bytes in Spark's own format: small partitions are merged, large ones split.
    The statistics are of this write alone.
    """
    before = _written_files(df.sparkSession, path) if mode == "append" else (0, 0)
    binary = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    columns = len(df.columns)
    df = df.select(*(shortest_number(df[c]).alias(c) if c in binary else df[c] for c in df.columns))
    written = Observation("export")
    first, *others = df.columns
    out = df.toDF(BOM + first, *others).observe(written, F.count(F.lit(1)).alias("rows"))
    with _partition_size(df.sparkSession, file_bytes):
        (out.hint("rebalance") if file_bytes else out).write.mode(mode).csv(
            path,
            header=True,
            escape='"',
            nullValue="",
            emptyValue="",
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
            encoding="UTF-8",
        )
    files, size = _written_files(df.sparkSession, path)
    return ExportStats(written.get["rows"], columns, files=files - before[0], size_bytes=size - before[1])


def read_export(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """Read an export back. Empty strings come back as NULL."""
    return spark.read.csv(path, schema=schema, header=True, escape='"', multiLine=multi_line, enforceSchema=True)
