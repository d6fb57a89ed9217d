"""Exact median per group without gathering a group's rows in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from purchase_insights.sources.scratch import materialize

# Values are cut into bands, this many between a number and its double. A scale
# from 1 to 5 has about 2,400 bands; all numbers a double can hold have 4.3 million.
BANDS_PER_DOUBLING = 1024
_SMALLEST_EXPONENT = -1075

# A band with more values than this is cut by its bounds, at most so many times.
ORDERED_AT_ONCE = 4096
CUTS = 1024
MOST_CUTS = 6


def _band(value: Column) -> Column:
    """Number of a value's band; grows with the value."""
    magnitude = F.floor((F.log2(F.abs(value)) - _SMALLEST_EXPONENT) * BANDS_PER_DOUBLING)
    return F.when(value == 0, F.lit(0).cast("bigint")).otherwise(F.signum(value).cast("bigint") * magnitude)


def value_counts(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n) of the rows where neither is NULL or NaN.

    Counts are combined before the shuffle and the shuffle hashes key and value
    together, so a key that holds most of the rows is still spread out.
    """
    known = F.col(key).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    return df.where(known).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))


def _middle(parts: DataFrame, order: str) -> DataFrame:
    """The parts of each (_key, _part) that hold one of the middle ranks, with what lies below.

    ``parts`` has _key, _part, ``order``, _n, _below (values below the whole of _part)
    and the two ranks, a few thousand rows per _part at most.
    """
    upto = Window.partitionBy("_key", "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below = (F.col("_below") + F.sum("_n").over(upto) - F.col("_n")).alias("_below")
    found = parts.select("_key", "_part", order, "_rank_low", "_rank_high", below, "_n")
    holds = (F.col("_below") < F.col("_rank_high")) & (F.col("_below") + F.col("_n") >= F.col("_rank_low"))
    return found.where(holds).drop("_n")


def _narrowed(active: DataFrame) -> DataFrame:
    """Cut every part into ``CUTS`` of equal width and keep those with a middle rank."""
    bounds = active.groupBy("_key", "_part").agg(F.min("_value").alias("_low"), F.max("_value").alias("_high"))
    width = F.col("_high") - F.col("_low")
    place = F.floor((F.col("_value") - F.col("_low")) / width * CUTS)
    cut = active.join(bounds, ["_key", "_part"]).withColumn(
        "_cut", F.when(width > 0, F.least(place, F.lit(CUTS - 1).cast("bigint"))).otherwise(0)
    )
    keys = ["_key", "_part", "_cut", "_below", "_rank_low", "_rank_high"]
    middle = _middle(cut.groupBy(*keys).agg(F.sum("_n").alias("_n")), "_cut")
    kept = cut.drop("_below", "_rank_low", "_rank_high").join(middle, ["_key", "_part", "_cut"])
    # the cuts that are kept, two at most, are the parts of the next level
    part = (F.col("_part") * CUTS + F.col("_cut")).alias("_part")
    first = kept.groupBy("_key").agg(F.min(part).alias("_first"))
    part = F.when(part == F.col("_first"), 0).otherwise(1).cast("bigint").alias("_part")
    return kept.join(first, "_key").select("_key", part, "_value", "_n", "_below", "_rank_low", "_rank_high")


def median_of_counts(counts: DataFrame, key: str, value: str, n: str = "n") -> DataFrame:
    """(key, median) from (key, value, n); the midpoint when the count is even.

    Values are first added up in narrow bands. Only the bands that hold the middle
    ranks (at most two per key) are looked at further: while one of them holds more than
    ``ORDERED_AT_ONCE`` values, it is cut by its own bounds and the parts with the middle
    ranks go on. A band spans less than a thousandth of its numbers, so five cuts tell
    any two doubles apart. No task orders more values than that.
    """
    number = F.col(value).cast("double")
    banded = counts.select(
        F.col(key).alias("_key"), number.alias("_value"), _band(number).alias("_band"), F.col(n).alias("_n")
    )
    in_bands = banded.groupBy("_key", "_band").agg(F.sum("_n").alias("_n")).select(
        "_key",
        F.lit(0).cast("bigint").alias("_part"),
        "_band",
        "_n",
        F.lit(0).cast("bigint").alias("_below"),
        F.expr("(sum(_n) OVER (PARTITION BY _key) + 1) DIV 2").alias("_rank_low"),
        F.expr("(sum(_n) OVER (PARTITION BY _key) + 2) DIV 2").alias("_rank_high"),
    )
    middle = _middle(in_bands, "_band").drop("_part")
    active = banded.join(middle, ["_key", "_band"]).withColumnRenamed("_band", "_part")
    active = materialize(active, "median-bands")
    for _ in range(MOST_CUTS):
        most = active.groupBy("_key", "_part").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if (most or 0) <= ORDERED_AT_ONCE:
            break
        active = materialize(_narrowed(active), "median-bands")
    in_part = Window.partitionBy("_key", "_part").orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = F.col("_below") + F.sum("_n").over(in_part)
    return (
        active.select("_key", "_value", "_n", "_rank_low", "_rank_high", reached.alias("_reached"))
        .where((F.col("_reached") - F.col("_n") < F.col("_rank_high")) & (F.col("_reached") >= F.col("_rank_low")))
        .groupBy(F.col("_key").alias(key))
        .agg(((F.min("_value") + F.max("_value")) / 2).alias("median"))
    )


def grouped_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median) over the rows where neither is NULL or NaN, written out.

    The counts are read twice, so they are written out as well: the rows
    themselves are read once.
    """
    counts = materialize(value_counts(df, key, value), "value-counts")
    return materialize(median_of_counts(counts, key, value), "medians")
