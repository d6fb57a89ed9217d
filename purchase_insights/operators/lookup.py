"""Dictionary look-ups where the dictionary is a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purchase_insights.schema import require_columns

# Dictionaries of at most this size are broadcast.
BROADCAST_LIMIT_BYTES = 32 * 1024 * 1024
SALTS = 64


def look_up(
    df: DataFrame, dictionary: DataFrame, key: str, value: str, on: str, broadcast_limit: int = BROADCAST_LIMIT_BYTES
) -> DataFrame:
    """``df`` with the column ``value``: what the dictionary (``key``, ``value``) has for ``on``, else NULL.

    Keys match exactly. A key with several rows is an error, as it would repeat rows of
    ``df``; a NULL key matches nothing. The dictionary is broadcast if its measured size
    allows it. Otherwise both sides are shuffled, each key spread over ``SALTS`` partitions
    by a hash of the row, since one key may hold a large part of ``df``.
    """
    require_columns(df, on)
    entries = dictionary.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(value).alias("_found"))
    repeated = entries.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    first = repeated.orderBy("_key").first()
    if first:
        raise ValueError(f"the dictionary has {first['n']} rows for {first['_key']!r}")
    size = F.octet_length(F.col("_key").cast("string")) + F.coalesce(F.octet_length(F.col("_found").cast("string")), F.lit(0)) + 64
    columns = [name for name in df.columns if name != value]
    if entries.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] <= broadcast_limit:
        joined = df.join(F.broadcast(entries), F.col(on) == F.col("_key"), "left")
    else:
        salts = F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))
        spread = entries.withColumn("_salt_of", F.explode(salts)).hint("merge")
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
        joined = salted.join(spread, (F.col(on) == F.col("_key")) & (F.col("_salt") == F.col("_salt_of")), "left")
    return joined.select(*columns, F.col("_found").alias(value))
