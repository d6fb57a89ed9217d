"""Column names and types of a purchase, raw and cleaned."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)

# Types of the columns we know, by normalised name. Other columns of a raw file
# are kept as text.
RAW_TYPES: dict[str, T.DataType] = {
    "customer_id": T.LongType(),
    "age": T.DoubleType(),
    "gender": T.StringType(),
    "item_purchased": T.StringType(),
    "category": T.StringType(),
    "purchase_amount": MONEY,
    "location": T.StringType(),
    "season": T.StringType(),
    "review_rating": T.DoubleType(),
    "subscription_status": T.StringType(),
    "shipping_type": T.StringType(),
    "discount_applied": T.StringType(),
    "promo_code_used": T.StringType(),
    "previous_purchases": T.IntegerType(),
    "frequency_of_purchases": T.StringType(),
}

PURCHASE_COLUMNS: tuple[str, ...] = (
    "customer_id",
    "purchase_amount",
    "category",
    "item_purchased",
    "age_group",
    "gender",
    "location",
    "season",
    "subscription_status",
    "discount_applied",
    "shipping_type",
    "review_rating",
    "previous_purchases",
    "frequency_of_purchases",
    "purchase_frequency_days",
)


# Holds any amount or whole number a text or another decimal may give.
WIDE = T.DecimalType(38, 18)


def checked_cast(value: Column, source: T.DataType, kind: T.DataType, name: str) -> tuple[Column, Column]:
    """``value`` as ``kind``, and a text that names the column where that would change the value (else NULL).

    Texts may write whole numbers as ``34.0`` or ``1e3``. Binary numbers count as the
    decimal that they print as.
    """
    text = isinstance(source, T.StringType)
    if source == kind or isinstance(kind, T.StringType):
        return value.cast(kind), F.lit(None).cast("string")
    exact = isinstance(kind, (T.DecimalType, T.IntegralType))
    if not exact:
        cast = value.try_cast(kind)
        right = cast.isNotNull()
    elif text:
        number = F.trim(value).try_cast(WIDE)
        cast = number.try_cast(kind)
        # plain numbers need no detour through wide decimals
        digits, scale = (kind.precision - kind.scale, kind.scale) if isinstance(kind, T.DecimalType) else (4, 0)
        plain = value.rlike(f"^[0-9]{{1,{digits}}}(\\.[0-9]{{1,{scale}}})?$" if scale else f"^[0-9]{{1,{digits}}}$") if digits else F.lit(False)
        same = (cast.cast(WIDE) == number) & (cast.cast("double") == value.try_cast("double"))
        right = plain | F.coalesce(same, F.lit(False))
        cast = F.when(plain, value.try_cast(kind)).otherwise(cast)
    else:
        cast = value.try_cast(kind)
        right = F.coalesce(cast.try_cast(source) == value, F.lit(False))
    message = F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(f" does not fit {kind.simpleString()}"))
    return F.when(right, cast), F.when(value.isNotNull() & ~right, message)


def exact_cast(value: Column, source: T.DataType, kind: T.DataType, name: str) -> Column:
    """``value`` as ``kind``; an error that names the column where that would change it (see ``checked_cast``)."""
    if source == kind or not isinstance(kind, (T.DecimalType, T.IntegralType)):
        return value.cast(kind)  # Spark's own error tells the value
    cast, problem = checked_cast(value, source, kind, name)
    return F.when(problem.isNotNull(), F.raise_error(problem).cast(kind)).otherwise(cast)


def conform(df: DataFrame, types: Mapping[str, T.DataType] | None = None) -> DataFrame:
    """Amounts, ids and counts of purchases in the types that the reports rely on.

    For tables of any source: amounts of another type become decimals, so that they
    are summed exactly. A value that its type would change is an error; ``types`` gives
    a column a wider one. Conforming columns, and other columns, are left alone.
    """
    known = {name: RAW_TYPES[name] for name in ("customer_id", "purchase_amount", "previous_purchases")} | dict(types or {})

    def conformed(field: T.StructField) -> Column:
        kind, column = known.get(field.name), df[field.name]
        wider = isinstance(kind, T.DecimalType) and isinstance(field.dataType, T.DecimalType)
        wider |= isinstance(kind, T.IntegralType) and isinstance(field.dataType, T.IntegralType)
        if kind is None or wider:
            return column
        return exact_cast(column, field.dataType, kind, field.name).alias(field.name)

    fields = [conformed(field) for field in df.schema]
    return df.select(*fields)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Return ``df``, or raise ``ValueError`` naming the columns it lacks."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"purchases lack the column(s) {', '.join(missing)}")
    return df


def to_result_types(df: DataFrame) -> DataFrame:
    """Cast every decimal to double, the type results are handed out in."""
    decimals = {f.name for f in df.schema if isinstance(f.dataType, T.DecimalType)}
    return df.select(*(df[c].cast("double").alias(c) if c in decimals else df[c] for c in df.columns))
