"""Reading drifting JSON records: typed access to VARIANT fields with the producers' own fallback rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from seslog.functions.text import trim_space

# The keys under which records carry their time, in order of preference.
TIME_KEYS = ("timestamp", "time", "ts", "created", "created_at", "datetime", "date", "event_time", "when", "at")
SECONDS_BELOW = 1e11
MICROS_FROM = 1e15


def field(value: Column, path: str) -> Column:
    """The VARIANT under a dotted path; NULL where it is absent or JSON null."""
    got = F.try_variant_get(value, "$." + path, "variant")
    return F.when(~F.is_variant_null(got), got)


def text_at(value: Column, path: str) -> Column:
    """Text of the value under a path (NULL for absent or JSON null)."""
    return F.try_variant_get(value, "$." + path, "string")


def text_of(value: Column) -> Column:
    """Scalars as text, objects and arrays as their JSON text."""
    return F.try_variant_get(value, "$", "string")


def as_object(value: Column) -> Column:
    """map<string, variant> for a JSON object, else NULL."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def as_array(value: Column) -> Column:
    """array<variant> for a JSON array, else NULL."""
    return F.try_variant_get(value, "$", "array<variant>")


def is_object(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("OBJECT")


def is_array(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("ARRAY")


def kind_of(value: Column) -> Column:
    """string, number, boolean, object or array; NULL for a missing value."""
    name = F.schema_of_variant(value)
    return (
        F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array")
        .when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name == "VOID", None)
        .when(name.isNotNull(), "number")
    )


def scalar_text(value: Column) -> Column:
    """Text of a scalar; NULL for objects and arrays."""
    return F.when(~F.schema_of_variant(value).rlike("^(OBJECT|ARRAY)"), text_of(value))


def string_only(value: Column) -> Column:
    """The value only if it is a JSON string."""
    return F.when(F.schema_of_variant(value) == "STRING", text_of(value))


def nonempty_text(value: Column) -> Column:
    return F.nullif(text_of(value), F.lit(""))


def first_present(value: Column, paths: Sequence[str]) -> Column:
    """First path that holds something other than null (an empty text counts)."""
    return F.coalesce(*[field(value, p) for p in paths])


NUMERIC = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def number(value: Column) -> Column:
    """A JSON value as a number: booleans are 0 or 1, an empty text or JSON null is 0, other texts must be numeric.

    NULL stands both for 'absent' and for 'not a number'. Pass a field with JSON null kept (raw_field).
    """
    text = trim_space(text_of(value))
    return (
        F.when(F.is_variant_null(value), 0.0).when(text == "", 0.0).when(text == "true", 1.0).when(text == "false", 0.0)
        .when(text.rlike(NUMERIC), text.try_cast("double"))
    )


def first_number(value: Column, keys: Sequence[str]) -> Column:
    """First finite, non-negative number under the keys."""
    found = F.array_compact(F.transform(F.array_compact(F.array(*[raw_field(value, k) for k in keys])), number))
    return F.get(F.filter(found, lambda n: n >= 0), 0)


def raw_field(value: Column, path: str) -> Column:
    """The VARIANT under a path, JSON null included."""
    return F.try_variant_get(value, "$." + path, "variant")


def epoch_millis(value: Column) -> Column:
    """Epoch milliseconds of a number given in seconds, milliseconds or microseconds."""
    size = F.abs(value)
    ms = F.when(size < SECONDS_BELOW, value * 1000).when(size >= MICROS_FROM, value / 1000).otherwise(value)
    # Milliseconds are cut towards zero, as a date object does.
    return F.when(F.abs(ms) <= 8.64e15, ms.cast("bigint"))


def millis_of_text(text: Column) -> Column:
    """Epoch milliseconds of a numeric or ISO text."""
    trimmed = trim_space(text)
    numeric = F.when(trimmed.rlike(r"^-?\d+(\.\d+)?$"), trimmed.try_cast("double"))
    return F.when(trimmed == "", None).otherwise(
        F.when(numeric.isNotNull(), epoch_millis(numeric)).otherwise(F.unix_millis(trimmed.try_cast("timestamp")))
    )


def time_millis(record: Column) -> Column:
    """First usable time of a record, its payload and its message, in that order."""
    places = ["", "payload.", "message."]
    texts = F.array(*[F.try_variant_get(record, f"$.{place}{key}", "string") for place in places for key in TIME_KEYS])
    return F.get(F.array_compact(F.transform(F.array_compact(texts), millis_of_text)), 0)
