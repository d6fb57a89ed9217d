"""All report groups from a single pass over the purchases."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from purchase_insights.functions.columns import loyalty_segment
from purchase_insights.functions.measures import base_aggregates, merged_aggregates, rating_aggregates

# The purchases are grouped by these key sets at once. Each is small enough to
# combine well before the shuffle; coarser groups are merged from the result.
PRODUCT_KEYS = ("item_purchased", "category")
RATING_KEYS = ("review_rating", "category")
BUYER_KEYS = ("age_group", "subscription_status", "frequency_of_purchases", "purchase_frequency_days")
PROFILE_KEYS = ("gender", "season", "discount_applied", "shipping_type", "customer_segment")
LOCATION_KEYS = ("location",)
# Customers are told apart by bits: 64 ids in a row share a group, in which each sets its bit.
CUSTOMER_KEYS = ("customer_block",)

# Segment names and keys, by the key set they are merged from.
BOOK_SEGMENTS: dict[tuple[str, ...], dict[str, tuple[str, ...]]] = {
    PRODUCT_KEYS: {
        "product": ("item_purchased", "category"),
        "category": ("category",),
        "item": ("item_purchased",),
    },
    RATING_KEYS: {"rating": ("category", "review_rating")},
    BUYER_KEYS: {
        "buyer": ("age_group", "subscription_status", "frequency_of_purchases"),
        "age_group": ("age_group",),
        "subscription": ("subscription_status",),
        "frequency": ("frequency_of_purchases", "purchase_frequency_days"),
    },
    PROFILE_KEYS: {
        "gender": ("gender",),
        "season": ("season",),
        "discount": ("discount_applied",),
        "shipping": ("shipping_type",),
        "loyalty": ("customer_segment",),
    },
    LOCATION_KEYS: {"location": ("location",), "overall": ()},
    CUSTOMER_KEYS: {"customers": ("customer_block",)},
}

KEY_COLUMNS = ("key_1", "key_2", "key_3")


SEGMENT_NAMES = frozenset(name for segments in BOOK_SEGMENTS.values() for name in segments) - {"customers"}


def _needed(names: Collection[str]) -> dict[tuple[str, ...], dict[str, tuple[str, ...]]]:
    """``BOOK_SEGMENTS`` reduced to the named segments and the keys they use."""
    needed = {}
    for key_set, segments in BOOK_SEGMENTS.items():
        wanted = {name: keys for name, keys in segments.items() if name in names}
        if wanted:
            used = tuple(key for key in key_set if any(key in keys for keys in wanted.values()))
            needed[used or key_set] = wanted
    return needed


def _entries(needed: dict[tuple[str, ...], dict[str, tuple[str, ...]]]) -> str:
    """SQL for the segments a group belongs to, as an array of (segment, keys).

    The first key of a key set tells whether a group is one of that set.
    """

    def entry(segment: str, keys: tuple[str, ...]) -> str:
        texts = [f"string({k})" for k in keys] + ["string(NULL)"] * (len(KEY_COLUMNS) - len(keys))
        columns = ", ".join(f"{text} AS {name}" for text, name in zip(texts, KEY_COLUMNS, strict=True))
        return f"struct('{segment}' AS segment, {columns})"

    cases = (
        f"WHEN _outside_{keys[0]} = 0 THEN array({', '.join(entry(*item) for item in segments.items())})"
        for keys, segments in needed.items()
    )
    return f"CASE {' '.join(cases)} END"


def _groups(purchases: DataFrame, segments: Collection[str]) -> DataFrame:
    """A row per (segment, keys) and group of the key sets, and the names of its measures."""
    needed = _needed(segments)
    prepared = purchases.withColumns(
        {
            "customer_segment": loyalty_segment(F.col("previous_purchases")),
            # NaN is missing, and without a category a rating is not used: see impute_rating.
            "review_rating": F.expr("if(category IS NOT NULL AND NOT isnan(double(review_rating)), review_rating, NULL)"),
        }
    )
    aggregates = base_aggregates(prepared)
    if "rating" in segments:
        prepared = prepared.withColumn("rating", F.col("review_rating"))  # as the other is a key
        aggregates += rating_aggregates("rating")
    if "customers" in segments:
        customer = F.col("customer_id").cast("bigint")
        prepared = prepared.withColumns(
            {
                "customer_block": F.shiftright(customer, 6),
                "_bit": F.expr("shiftleft(1L, int(bigint(customer_id) & 63))"),
            }
        )
        aggregates.append(F.bit_or("_bit").alias("_bits"))
    groups = prepared.groupingSets(list(needed), *dict.fromkeys(k for keys in needed for k in keys)).agg(
        *aggregates, *(F.grouping(keys[0]).alias(f"_outside_{keys[0]}") for keys in needed)
    )
    columns = ["n_rows", "n_priced", "revenue", "lowest", "highest"]
    if "rating" in segments:
        columns += ["n_rated", "rating_total"]
    if "customers" in segments:
        columns.append("if(_outside_customer_block = 0, _bits, NULL) AS customer_bits")
    return groups.selectExpr(f"inline({_entries(needed)})", *columns)


def _merged(df: DataFrame) -> list[Column]:
    """Aggregates that merge groups of the same segment and keys."""
    merged = merged_aggregates()
    if "n_rated" in df.columns:
        merged += [F.sum("n_rated").alias("n_rated"), F.sum("rating_total").alias("rating_total")]
    return merged


def report_groups(purchases: DataFrame, segments: Collection[str] = SEGMENT_NAMES) -> DataFrame:
    """One row per (segment, keys) with the merged measures, from one pass.

    Takes purchases before or after rating imputation. With the segment ``rating``,
    every row has ``n_rated`` and ``rating_total`` of the ratings that are present. With
    the segment ``customers`` the one row of it has their number ``n_customers``.
    """
    groups = _groups(purchases, segments)
    merged = _merged(groups)
    if "customers" not in segments:
        return groups.groupBy("segment", *KEY_COLUMNS).agg(*merged)
    # each block of customers is one group here: their bits add up
    groups = groups.withColumn("key_1", F.when(F.col("segment") != "customers", F.col("key_1")))
    counted = F.sum(F.bit_count("customer_bits").cast("bigint")).alias("n_customers")
    return groups.groupBy("segment", *KEY_COLUMNS).agg(*merged, counted)


def report_book(purchases: DataFrame, segments: Collection[str] = SEGMENT_NAMES) -> DataFrame:
    """``report_groups`` with the number of distinct customers, whatever ``segments`` are.

    They are counted exactly in the same pass: a group per 64 customer ids in a row, not
    one per customer, goes through its shuffle. Ids far apart make a group each.
    """
    return report_groups(purchases, {*segments, "customers"})


#: log2 of the registers of a sketch of customers: 16,384, for a standard error of 0.8 %.
SKETCH_SIZE = 14


def sketch_customers(purchases: DataFrame) -> DataFrame:
    """customer_sketch: one row with a sketch that estimates the number of distinct customers, and can be united."""
    return purchases.agg(F.hll_sketch_agg(F.col("customer_id").cast("bigint"), SKETCH_SIZE).alias("customer_sketch"))


def book_state(purchases: DataFrame, approximate_customers: bool = False) -> DataFrame:
    """What has to be kept of purchases so that books of several loads can be merged.

    One row per (segment, keys) as in ``report_groups``, but customers by block, with the
    bits of those present. With ``approximate_customers`` there is one sketch of them
    instead, of 16 KB at most however many there are.
    """
    segments = SEGMENT_NAMES if approximate_customers else SEGMENT_NAMES | {"customers"}
    state = _merged_by_keys(_groups(purchases, segments))
    if not approximate_customers:
        return state.withColumn("customer_sketch", F.lit(None).cast("binary"))
    sketch = sketch_customers(purchases).withColumn("segment", F.lit("customers"))
    return state.withColumn("customer_bits", F.lit(None).cast("bigint")).unionByName(sketch, allowMissingColumns=True)


def _merged_by_keys(groups: DataFrame) -> DataFrame:
    bits = [F.bit_or("customer_bits").alias("customer_bits")] if "customer_bits" in groups.columns else []
    return groups.groupBy("segment", *KEY_COLUMNS).agg(*_merged(groups), *bits)


def merge_states(states: DataFrame) -> DataFrame:
    """One state of all loads whose states ``states`` holds."""
    merged = _merged_by_keys(states.where("customer_sketch IS NULL"))
    sketched = states.where("customer_sketch IS NOT NULL").groupBy("segment")  # no row without any
    united = sketched.agg(F.hll_union_agg("customer_sketch").alias("customer_sketch"))
    return merged.unionByName(united, allowMissingColumns=True)


def book_of_states(states: DataFrame) -> DataFrame:
    """The book of all loads whose states ``states`` holds; equal to ``report_book`` of their purchases together.

    Customers are either all kept exactly or all sketched; a mixture is an error.
    """
    merged = merge_states(states)
    # exact blocks are added up to one row; that is where a sketch stands
    merged = merged.withColumn("key_1", F.when(F.col("segment") != "customers", F.col("key_1")))
    exact = F.sum(F.bit_count("customer_bits").cast("bigint"))
    estimate = F.max(F.hll_sketch_estimate("customer_sketch"))
    both = exact.isNotNull() & estimate.isNotNull()
    mixture = F.raise_error(F.lit("customers of some loads are exact, of others sketched")).cast("bigint")
    customers = F.when(both, mixture).otherwise(F.coalesce(exact, estimate))
    return merged.groupBy("segment", *KEY_COLUMNS).agg(*_merged(merged), customers.alias("n_customers"))
