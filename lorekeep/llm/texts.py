"""The text units that the operators on personal data and on secrets work over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _id(column: str):
    return F.nullif(F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", "")), F.lit(""))


def units(sessions: DataFrame | None = None, memories: DataFrame | None = None, tasks: DataFrame | None = None) -> DataFrame:
    """``src, record_id, msg_pos, text``, each unit once however often it was delivered.

    Messages take the session's id (trimmed, lower case) and their position; notes and tasks have position 0. Units
    without an id or with a null or empty text don't come out. If deliveries differ, the greatest text counts.
    """
    parts = []
    if sessions is not None:
        rows = sessions.select(_id("sessionId").alias("record_id"), F.posexplode("conversation").alias("msg_pos", "m"))
        parts.append(rows.select(F.lit("session").alias("src"), "record_id", "msg_pos", F.col("m.content").alias("text")))
    if memories is not None:
        parts.append(memories.select(F.lit("memory").alias("src"), F.col("id").alias("record_id"), F.lit(0).alias("msg_pos"), F.col("body").alias("text")))
    if tasks is not None:
        parts.append(tasks.select(F.lit("task").alias("src"), F.col("task_id").alias("record_id"), F.lit(0).alias("msg_pos"), F.col("prompt").alias("text")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.where("record_id is not null and text is not null and text <> ''")
    return every.groupBy("src", "record_id", "msg_pos").agg(F.max("text").alias("text"))
