"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "1970-01-01 00:00:00"


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def seconds_between(a: Column, b: Column) -> Column:
    """Whole elapsed seconds from a to b."""
    return F.timestamp_diff("SECOND", a, b).cast("long")


def add_seconds(ts: Column, seconds: Column | int) -> Column:
    return F.timestamp_add("SECOND", F.lit(seconds) if isinstance(seconds, int) else seconds, ts)


def count_if(condition: Column) -> Column:
    """Rows that fulfil the condition; 0 for no rows."""
    return F.coalesce(F.count_if(condition), F.lit(0)).cast("long")


def reasons(*pairs: tuple[Column, str]) -> Column:
    """Names of the conditions that hold, in the given order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in pairs]))


def blank(text: Column) -> Column:
    return text.isNull() | (F.length(F.trim(text)) == 0)


def safe_number(text: Column) -> Column:
    """Double, or null where the text is no number."""
    return text.try_cast("double")


def bad_number(value: Column) -> Column:
    """Null, NaN or infinite."""
    return value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))


def exact_timestamp(text: Column, shape: str = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Timestamp without zone where shape and round trip both hold, else null."""
    ts = text.try_cast("timestamp_ntz")
    return F.when(text.rlike(shape) & (F.date_format(ts, pattern) == text), ts)


def pattern_timestamp(text: Column, pattern: str = "M/d/yyyy H:mm") -> Column:
    return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")


def content_id(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined with a bar, in lower-case hex."""
    return F.sha2(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256)

