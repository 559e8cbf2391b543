"""Timestamp parsing, bucketing and formatting. Naive times are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyflow.functions.text import strip

# first and last epoch second of the years 1 to 9999
EPOCH_RANGE = (-62135596800, 253402300799)

ISO_SHAPE = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"([T ][0-9]{2}(:[0-9]{2}(:[0-9]{2}([.,][0-9]+)?)?)?(Z|[+-][0-9]{2}(:?[0-9]{2})?)?)?$"
)

COMPACT_PATTERNS = ("yyyyMMdd", "yyyyMMdd'T'HHmm", "yyyyMMdd'T'HHmmss", "yyyyMMdd'T'HHmmssXX")
LOOSE_PATTERNS = ("yyyy-M-d H:m:s", "yyyy-M-d")


def strict_date(text: Column) -> Column:
    """Date of a ``yyyy-MM-dd`` text; NULL for any other text."""
    return F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text.try_cast("date"))


def utc(text: str | None) -> Column:
    """Literal UTC timestamp, or the current time when no text is given."""
    return F.current_timestamp() if text is None else F.lit(text).cast("timestamp")


def lenient(text: Column) -> Column:
    """Timestamp, or NULL where the text is none."""
    return text.try_cast("timestamp")


def stored(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` text of a timestamp."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def midnight(day: Column) -> Column:
    """A date as the UTC timestamp of its midnight."""
    return day.cast("timestamp")


def iso(ts: Column) -> Column:
    """ISO text without zone; a fraction only where there is one."""
    fraction = F.when(F.pmod(F.unix_micros(ts), F.lit(1_000_000)) != 0, F.date_format(ts, ".SSSSSS")).otherwise("")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction)


def iso_utc(ts: Column) -> Column:
    """ISO text with the ``+00:00`` offset."""
    return F.concat(iso(ts), F.lit("+00:00"))


def hour_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:00:00'Z'")


def month_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def minute_label(ts: Column) -> Column:
    return F.date_format(ts, "dd_MM_yyyy_HH_mm")


def parse_iso(text: Column) -> Column:
    """Timestamp of an ISO or loosely written date-time; NULL for anything else.

    ISO week dates count as unparsable.
    """
    extended = F.when(text.rlike(ISO_SHAPE), F.replace(text, F.lit(","), F.lit(".")).try_cast("timestamp"))
    others = [F.try_to_timestamp(text, F.lit(p)) for p in COMPACT_PATTERNS + LOOSE_PATTERNS]
    return F.coalesce(extended, *others)


def from_epoch(seconds: Column) -> Column:
    """Epoch seconds (double) to a timestamp, to the nearest microsecond; NULL outside years 1-9999."""
    usable = F.when(seconds.between(*EPOCH_RANGE), seconds)
    whole = F.floor(usable)
    micros = F.bround((usable - whole) * 1_000_000).cast("bigint")
    return F.timestamp_micros(whole * 1_000_000 + micros)


def from_json_scalar(value: Column, now: Column) -> Column:
    """Event time held in a JSON scalar (VARIANT).

    A number is epoch seconds, a string is ISO-like text; absent, blank and
    unparsable values give ``now``.
    """
    kind = F.schema_of_variant(value)
    seconds = F.when(
        kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(value, "$", "double")
    ).when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double"))
    text = F.when(kind == "STRING", strip(F.try_variant_get(value, "$", "string")))
    return F.coalesce(from_epoch(seconds), parse_iso(text), now)


def page_time(text: Column) -> Column:
    """Event time written as ISO text with or without milliseconds and zone."""
    return F.coalesce(
        text.try_cast("timestamp"),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSX")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssX")),
    )
