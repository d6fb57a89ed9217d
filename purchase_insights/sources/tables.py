"""Purchases from catalog tables, views and databases."""

from __future__ import annotations

import os
from collections.abc import Mapping
from urllib.parse import parse_qsl, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession

VIEW = "purchases"

# Connection settings.
SSL_MODE = "require"
CONNECT_TIMEOUT_SECONDS = "10"

# Rows that the driver holds at a time; without it a whole range is loaded at once.
FETCH_ROWS = "10000"
UNSUPPORTED_PARAMETER = "channel_binding=require"


def register_view(purchases: DataFrame, name: str = VIEW) -> None:
    """Make the purchases available to ``run_query`` under a view name."""
    purchases.createOrReplaceTempView(name)


def read_table(spark: SparkSession, name: str = VIEW) -> DataFrame:
    """All rows and columns of a catalog table or view."""
    return spark.table(name)


def run_query(spark: SparkSession, query: str) -> DataFrame:
    """Result of a SQL query over tables and views, e.g. ``purchases``."""
    return spark.sql(query.strip().rstrip(";"))


def database_url(environment: Mapping[str, str] | None = None) -> str:
    """``DATABASE_URL`` with the ``postgresql`` scheme and without channel binding."""
    url = (os.environ if environment is None else environment).get("DATABASE_URL")
    if not url:
        raise OSError("DATABASE_URL is not set")
    parts = urlsplit(url)
    scheme = "postgresql" if parts.scheme == "postgres" else parts.scheme
    kept = [parameter for parameter in parts.query.split("&") if parameter != UNSUPPORTED_PARAMETER]
    return parts._replace(scheme=scheme, query="&".join(kept)).geturl()


def jdbc_options(url: str) -> dict[str, str]:
    """Options of Spark's JDBC source for a ``postgresql://user:password@host/db`` URL."""
    parts = urlsplit(url)
    parameters = {"fetchsize": FETCH_ROWS, **dict(parse_qsl(parts.query))}
    parameters.update(sslmode=SSL_MODE, connectTimeout=CONNECT_TIMEOUT_SECONDS)
    address = parts.hostname or ""
    if parts.port:
        address += f":{parts.port}"
    options = {"url": f"jdbc:{parts.scheme}://{address}{parts.path}", "driver": "org.postgresql.Driver", **parameters}
    if parts.username:
        options["user"] = unquote(parts.username)
    if parts.password:
        options["password"] = unquote(parts.password)
    return options


def read_database_table(
    spark: SparkSession,
    options: Mapping[str, str],
    table: str,
    partition_column: str = "customer_id",
    bounds: tuple[int, int] | None = None,
    partitions: int = 8,
) -> DataFrame:
    """A whole database table, read in ``partitions`` parallel ranges.

    ``bounds`` are the smallest and largest value of ``partition_column``; when
    not given they are asked from the database. They only place the cuts: rows
    outside are read as well. A range should fit a task: give large tables more
    ``partitions``, as many as the database allows connections.
    """
    reader = spark.read.format("jdbc").options(**options)
    if bounds is None:
        query = f"SELECT MIN({partition_column}) AS low, MAX({partition_column}) AS high FROM {table}"
        low, high = reader.option("query", query).load().first()
        bounds = (low, high)
    reader = spark.read.format("jdbc").options(**options).option("dbtable", table)
    if bounds[0] is not None:
        reader = reader.options(
            partitionColumn=partition_column,
            lowerBound=str(bounds[0]),
            upperBound=str(bounds[1]),
            numPartitions=str(partitions),
        )
    return reader.load()


def run_database_query(spark: SparkSession, options: Mapping[str, str], query: str) -> DataFrame:
    """Result of a query that the database itself runs."""
    return spark.read.format("jdbc").options(**options).option("query", query.strip().rstrip(";")).load()
