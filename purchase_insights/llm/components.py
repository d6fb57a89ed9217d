"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purchase_insights.sources.scratch import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) for every node ``a`` or ``b`` of ``links``.

    Alternates two steps until nothing changes: every node ties its larger
    neighbours, then its smaller ones, to its smallest neighbour. All tables are of
    links, written to the shared folder each round; minima are combined before the
    shuffle and the joins back are plain ones that Spark splits for a hot node.
    Links of a node to itself and repeated links are allowed, missing ends are not.
    """
    tied = links.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))
    tied = materialize(tied.where("high <> low").distinct(), "links")
    state = _state(tied)
    while state[0]:
        both = tied.select("high", "low").union(tied.select("low", "high")).toDF("node", "other")
        lowest = both.groupBy("node").agg(F.min("other").alias("lowest"))
        lowest = lowest.select("node", F.least("node", "lowest").alias("lowest"))
        larger = both.where("other > node").join(lowest, "node").select(F.col("other").alias("high"), F.col("lowest").alias("low"))
        larger = materialize(larger.distinct(), "links")
        lowest = larger.groupBy("high").agg(F.min("low").alias("lowest"))
        smaller = larger.join(lowest, "high").where("low <> lowest").select(F.col("low").alias("high"), F.col("lowest").alias("low"))
        tied = materialize(smaller.union(lowest).distinct(), "links")
        before, state = state, _state(tied)
        if state == before:
            break
    roots = tied.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return tied.toDF("node", "component").union(roots)


def _state(links: DataFrame) -> tuple:
    """Equal for equal tables of links; the hash is summed in parts that cannot overflow."""
    code = F.xxhash64("high", "low")
    row = links.agg(F.count(F.lit(1)), F.sum(code.bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftrightunsigned(code, 32))).first()
    return tuple(row)
