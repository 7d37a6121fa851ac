"""Moments from text, and words about guarantees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHAPE = r"^\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d(?::\d\d(?:\.\d{1,6})?)?(?:Z|[+-]\d\d:?\d\d)?)?$"


def moment(text: Column) -> Column:
    """An ISO-8601 moment; without zone it means UTC; null where it is malformed (never the present)."""
    bare = F.regexp_replace(F.trim(text), r"^(\d{4}-\d\d-\d\d[T ]\d\d:\d\d)(Z|[+-]\d\d:?\d\d)?$", "$1:00$2")
    zoned = F.when(bare.rlike(r"(?:Z|[+-]\d\d:?\d\d)$") & bare.rlike("[T ]"), bare).otherwise(F.concat(bare, F.when(bare.rlike("[T ]"), "Z").otherwise("T00:00:00Z")))
    return F.when(bare.rlike(_SHAPE), F.try_to_timestamp(zoned))


def moment_error(text: Column) -> Column:
    """Null for a moment or no text at all, else what is wrong."""
    return F.when(text.isNotNull() & moment(text).isNull(), F.concat(F.lit("malformed moment: "), text))


def is_stale(made_at: Column, now: Column, hours: float = 168.0) -> Column:
    """Strictly older than so many hours."""
    return F.unix_micros(now.cast("timestamp")) - F.unix_micros(made_at.cast("timestamp")) > int(hours * 3_600_000_000)


def guarantee(alpha: Column, delta: Column, calibration: Column) -> Column:
    """The bound in words."""
    shown = F.regexp_replace(F.format_number(alpha, 6), r"\.?0+$", "")
    return F.concat(F.lit("P(unsupported_claim) <= "), shown, F.lit(" with "), F.round((1 - delta) * 100).cast("int").cast("string"), F.lit("% confidence, calibration_id="), calibration)


def trace_id(at: Column, *parts: Column) -> Column:
    """A sortable id: milliseconds and a hash of the parts, both in base 32 digits of fixed width."""
    head = F.lpad(F.conv(F.unix_millis(at.cast("timestamp")).cast("string"), 10, 32), 10, "0")
    tail = F.lpad(F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 15), 16, 32), 12, "0")
    return F.concat(head, tail)
