"""Number formats and literals, mostly as SQL text.

The summary is assembled from SQL text: its many small expressions would each
cost several calls into the JVM as column objects.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def two_decimals(value: str) -> str:
    """``1234.5`` as ``1234.50``, half-even."""
    return f"replace(format_number({value}, 2), ',', '')"


def money(value: str) -> str:
    """``1234.5`` as ``$1,234.50``."""
    return f"'$' || format_number({value}, 2)"


def plain_money(value: str) -> str:
    """``1234.5`` as ``$1234.50``."""
    return f"'$' || {two_decimals(value)}"


def percent(value: str) -> str:
    """``12.5`` as ``12.50%``."""
    return f"{two_decimals(value)} || '%'"


def count(value: str) -> str:
    """``1234`` as ``1,234``."""
    return f"format_number({value}, 0)"


def shortest_number(value: Column) -> Column:
    """A binary number as text: ``12345678.9``, ``0.0001``, ``1e-05``, ``1e+16``; NULL for NaN.

    The digits are the JVM's, which before Java 19 has one too many for a few numbers.
    """
    text = value.cast("string")
    size = F.abs(value.cast("double"))
    plain = F.rtrim(text.try_cast("decimal(38,21)").cast("string"), F.lit("0"))
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    exponent = F.substring_index(text, "E", -1).try_cast("int")
    scientific = F.concat(
        F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", ""),
        F.when(exponent < 0, "e-").otherwise("e+"),
        F.when(F.abs(exponent) < 10, F.lpad(F.abs(exponent).cast("string"), 2, "0")).otherwise(F.abs(exponent).cast("string")),
    )
    return (
        F.when(F.isnan(value), F.lit(None))
        .when(size == float("inf"), F.when(value > 0, "inf").otherwise("-inf"))
        .when(value == 0, text)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(scientific)
    )
