"""Bounded, repeatable samples for training, folds of the labelled rows, and small things that operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Texts that a Python worker gets at a time.
BATCH_ROWS = 1000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_batches(texts: DataFrame) -> DataFrame:
    """``texts``, whose session hands at most ``BATCH_ROWS`` rows at a time to Python from now on.

    Spark's own 10,000 whole texts would fill a worker's memory; a smaller setting stays.
    The session keeps the setting, as it is read when a result is computed, which is
    after the operator has returned; no result depends on it.
    """
    conf = texts.sparkSession.conf
    now = int(conf.get(_BATCH_SETTING, "0"))
    if now <= 0 or now > BATCH_ROWS:
        conf.set(_BATCH_SETTING, str(BATCH_ROWS))
    return texts


#: Bits of a ``bit_table``: 8 MB, whatever the table it is made from.
FILTER_BITS = 1 << 26


def bit_table(hashes: DataFrame, column: str) -> np.ndarray:
    """``FILTER_BITS`` bits, of which those are set that the 64-bit hashes in ``column`` point to.

    Tells most values apart that are not in a table of any size; see ``in_table``.
    """
    bit = F.col(column).bitwiseAND(FILTER_BITS - 1)
    of_bucket = hashes.groupBy(F.shiftright(bit, 15).alias("bucket")).agg(
        F.bitmap_construct_agg(bit.bitwiseAND((1 << 15) - 1)).alias("bits")
    )
    bits = np.zeros((FILTER_BITS >> 15, 4096), np.uint8)
    for row in of_bucket.toLocalIterator():
        bits[row["bucket"]] = np.frombuffer(row["bits"], np.uint8)
    return bits.ravel()


def in_table(bits: np.ndarray, value: int) -> bool:
    """Whether the bit of a 64-bit hash is set: always for one of the table, seldom for another."""
    bit = value % FILTER_BITS
    return bool(bits[bit >> 3] >> (bit & 7) & 1)


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; NULL without an id: such a row is in no fold, and never learnt from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def sample_ids(ids: DataFrame, size: int) -> DataFrame:
    """At most ``size`` different doc_ids, the same ones however the rows are split."""
    ids = ids.where("doc_id IS NOT NULL")
    others = [F.max(c).alias(c) for c in ids.columns if c != "doc_id"]
    ids = ids.groupBy("doc_id").agg(*others) if others else ids.distinct()
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)


def with_texts(picked: DataFrame, docs: DataFrame) -> DataFrame:
    """``picked`` (a bounded table with doc_id) and the text of each doc_id in ``docs``.

    Of a repeated doc_id one row counts, that of the smallest hash of its text: the result
    has no more rows than ``picked``, however often an id occurs.
    """
    ids = F.broadcast(picked.select("doc_id").distinct())
    rows = docs.select("doc_id", "text").join(ids, "doc_id")
    one = rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return one.join(F.broadcast(picked), "doc_id")


def unused_name(name: str, df: DataFrame) -> str:
    """``name``, with underscores added until no column of ``df`` begins with it."""
    taken = [column.lower() for column in df.columns]
    while any(column.startswith(name) for column in taken):
        name = f"_{name}"
    return name
