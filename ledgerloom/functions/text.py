"""Text forms of values, as they appear in JSON columns and row hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def number_text(value: Column) -> Column:
    """Shortest text of a double: plain from 1e-4 up to 1e16, else ``1.5e-05``."""
    raw = value.cast("string")
    size = F.abs(value)

    # 17 digits before the point and 21 after hold every double in this range.
    digits = F.regexp_replace(raw.try_cast("decimal(38,21)").cast("string"), "0+$", "")
    plain = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)

    mantissa = F.regexp_replace(F.substring_index(raw, "E", 1), r"\.0$", "")
    power = F.substring_index(raw, "E", -1).try_cast("int")
    power_text = F.concat(
        F.when(power < 0, F.lit("-")).otherwise(F.lit("+")),
        F.when(F.abs(power) < 10, F.lit("0")).otherwise(F.lit("")),
        F.abs(power).cast("string"),
    )

    return (
        F.when(F.isnan(value), F.lit("nan"))
        .when(size == float("inf"), F.when(value > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .when(~raw.contains("E"), raw)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(F.concat(mantissa, F.lit("e"), power_text))
    )


def instant_text(value: Column) -> Column:
    """ISO-8601 text of a UTC instant; microseconds only where there are any."""
    text = F.translate(value.cast("string"), " ", "T")
    full = F.when(F.length(text) == 19, text).otherwise(F.rpad(text, 26, "0"))
    return F.concat(full, F.lit("+00:00"))


def value_text(value: Column | str, kind: T.DataType) -> Column:
    """Text of a value by its type; NULL stays NULL."""
    value = F.col(value) if isinstance(value, str) else value
    if isinstance(kind, T.DoubleType):
        return number_text(value)
    if isinstance(kind, T.TimestampType):
        return instant_text(value)
    return value.cast("string")


def json_quote(text: Column) -> Column:
    """A string as a JSON string literal."""
    boxed = F.to_json(F.array(text))
    return F.substring(boxed, F.lit(2), F.length(boxed) - 2)


def json_list(values: Column) -> Column:
    """An array of strings as a JSON array, ``["a", "b"]``."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, json_quote), ", "), F.lit("]"))


def record_json(schema: T.StructType, columns: list[str]) -> Column:
    """The named columns as one JSON object whose values are all strings.

    NULL becomes the string ``"null"``, so that no field is dropped.
    """
    texts = [
        F.coalesce(value_text(name, schema[name].dataType), F.lit("null")).alias(name)
        for name in columns
    ]
    return F.to_json(F.struct(*texts))
