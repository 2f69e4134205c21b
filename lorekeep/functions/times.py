"""Instants from unevenly written time strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(value: Column) -> Column:
    """Timestamp of an ISO time (``T`` or blank between date and time) or of epoch milliseconds.

    A time without zone means UTC whatever the session's zone is. Null for null, blank and unreadable values.
    """
    text = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    zoned = text.rlike(r"([zZ]|[+-]\d{2}:?\d{2})$") & text.rlike(r"[T ]\d")
    iso = F.regexp_replace(text, r"^(\d{4}-\d{2}-\d{2}) (\d)", "$1T$2")
    iso = F.regexp_replace(iso, r"([+-]\d{2})(\d{2})$", "$1:$2")
    full = F.when(zoned, iso).when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00Z"))).otherwise(F.concat(iso, F.lit("Z")))
    return (
        F.when(text.rlike(r"^-?\d{1,17}$"), F.timestamp_millis(text.try_cast("bigint")))
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), full.try_cast("timestamp"))
    )
