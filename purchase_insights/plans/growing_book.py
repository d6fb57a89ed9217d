"""A report book that grows by loads of purchases.

Each load is stored as the state of its book: a few rows per group, and the customers
as bits. All results of all loads together come from the merged states; purchases of
earlier loads are not read again.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from purchase_insights.operators.report_book import book_of_states, book_state, merge_states
from purchase_insights.plans.pipeline import results_of_book
from purchase_insights.schema import PURCHASE_COLUMNS, conform, require_columns
from purchase_insights.sources.scratch import materialize

#: Columns of a stored state; sums have room for the totals of any number of loads.
STATE = (
    "segment string, key_1 string, key_2 string, key_3 string, n_rows bigint, n_priced bigint, revenue decimal(38,2),"
    " lowest decimal(38,2), highest decimal(38,2), n_rated bigint, rating_total decimal(38,18), customer_bits bigint, customer_sketch binary"
)


def _store(state: DataFrame, path: str, load_id: str) -> None:
    if not load_id:
        raise ValueError("a load needs an id")
    columns = T.StructType.fromDDL(STATE)
    typed = state.select(*(F.col(field.name).cast(field.dataType).alias(field.name) for field in columns))
    typed.write.mode("overwrite").parquet(f"{path.rstrip('/')}/load={quote(load_id, safe='')}")


def add_load(purchases: DataFrame, path: str, load_id: str, approximate_customers: bool = False) -> None:
    """Store the state of a load of purchases in the book at ``path``.

    A load that is there already, by its id, is replaced: one that is added twice, or
    again after a failure, counts once. Other loads are neither read nor written, so
    several can be added at a time. Missing ratings should not be imputed before: those of
    all loads get the median of all. ``approximate_customers`` keeps a sketch of the
    customers, of a fixed size, instead of a bit for each; all loads have to agree.
    """
    _store(book_state(conform(require_columns(purchases, *PURCHASE_COLUMNS)), approximate_customers), path, load_id)


def states(spark: SparkSession, path: str) -> DataFrame:
    """The states of all loads."""
    return spark.read.schema(STATE).option("recursiveFileLookup", "true").parquet(path)


def grown_book(spark: SparkSession, path: str) -> DataFrame:
    """The book of all loads together."""
    return materialize(book_of_states(states(spark, path)), "report-book")


def grown_reports(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All results by name, as ``build_reports`` gives them for the purchases of all loads."""
    return results_of_book(grown_book(spark, path))


def compact(spark: SparkSession, path: str, target: str, load_id: str) -> None:
    """Store the merged state of all loads of a book as one load of another.

    The new book no longer knows the loads by their ids: those must not be added again.
    """
    _store(merge_states(states(spark, path)), target, load_id)
