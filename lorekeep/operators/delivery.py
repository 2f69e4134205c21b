"""Exactly one row of each identifier from a feed that delivers at least once.

Rows are ranked inside their identifier and the first is kept. Spark turns ``row_number() = 1`` into a group limit
that runs before the exchange, so of a hot identifier every map task sends one row; no group is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorekeep.functions.times import instant


def normal_id(value: Column) -> Column:
    """Identifier without surrounding white space, in lower case; null if nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", "")), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def keep_first(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row of each ``key``, the first by ``order``; rows with a null key don't come out. Columns stay as they are."""
    rank = unused(df, "rank")
    ranked = df.where(F.col(key).isNotNull()).withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col(rank) == 1).drop(rank)


def _arrival() -> Column:
    return F.coalesce(instant(F.col("lastUpdatedAt")), instant(F.col("createdAt")))


def latest_sessions(sessions: DataFrame) -> DataFrame:
    """One delivery of each session: the latest ``lastUpdatedAt`` (if null or unreadable ``createdAt``), among equals the
    smallest ``delivery_id``; with ``session_id``, which replaces a column of that name.

    Rows whose identifier is null or blank can't be told apart and don't come out; rows without any readable time lose
    against those with one. Of wholly equal rows one stays. Extra columns are kept; an empty table gives an empty one.
    """
    named = sessions.withColumn("session_id", normal_id(F.col("sessionId")))
    return keep_first(named, "session_id", [_arrival().desc_nulls_last(), F.col("delivery_id").asc_nulls_last()])


def surplus_deliveries(sessions: DataFrame) -> DataFrame:
    """``session_id, delivery_id`` of the deliveries that must go: all with an identifier, less those that stay.

    The anti-join is on the delivery's own unique number, so that no session, however often delivered, makes a hot key.
    A delivery number that occurs in several rows of a session is one delivery.
    """
    narrow = sessions.select(normal_id(F.col("sessionId")).alias("session_id"), "delivery_id", _arrival().alias("at")).where("session_id is not null")
    kept = keep_first(narrow, "session_id", [F.col("at").desc_nulls_last(), F.col("delivery_id").asc_nulls_last()]).select("session_id", "delivery_id")
    on = (F.col("a.delivery_id").eqNullSafe(F.col("b.delivery_id"))) & (F.col("a.session_id") == F.col("b.session_id"))
    return narrow.alias("a").join(kept.alias("b"), on, "left_anti").select("session_id", "delivery_id").distinct()


def new_only(batch: DataFrame, stored: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Rows of a new batch whose identifier isn't stored yet, one of each; for feeds where the first delivery counts.

    Null keys don't come out. Only the key column of ``stored`` is read; copies in it don't multiply rows.
    """
    first = keep_first(batch, key, order)
    return first.join(stored.select(F.col(key)), key, "left_anti").select(*batch.columns)


def merge_latest(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """The stored sessions with a new batch taken in: an identifier seen before keeps the later of both deliveries."""
    return latest_sessions(stored.drop("session_id").unionByName(batch.drop("session_id"), allowMissingColumns=True))
