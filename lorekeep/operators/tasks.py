"""Tasks and the states they pass through, as new snapshots of their table.

pending, in_progress, failed; what is submitted leaves the table. Each call takes a table of tasks, one row an id, and
returns the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.text import or_else
from lorekeep.operators.delivery import keep_first

DAY = "0000-00-00"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Tasks from files of one JSON object each, ``<id>.task`` if pending, with ``.in_progress`` or ``.failed`` behind it
    otherwise; ``mtime`` is the file's. Other files and those that can't be read don't come out."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("file"), (F.unix_micros("_metadata.file_modification_time") / 1e6).alias("mtime"))
    state = F.when(F.col("file").endswith(".task"), "pending").when(F.col("file").endswith(".task.in_progress"), "in_progress").when(F.col("file").endswith(".task.failed"), "failed")
    # what a failed task has behind its object are remarks on the failure
    body = F.when(state == "failed", F.regexp_replace("value", r"\n# (?:error|failed_at): [^\n]*", "")).otherwise(F.col("value"))
    rows = files.select(F.from_json(body, "task_id string, session_id string, ide string, workspace string, project_key string, created_at string, batch_date string, prompt string").alias("t"), state.alias("status"), "mtime")
    return rows.where("status is not null and t.task_id is not null").select("t.*", "status", "mtime")


def one_of_each(tasks: DataFrame) -> DataFrame:
    """Tasks without repeated ids: of the rows of an id the latest, then the smallest status."""
    return keep_first(tasks, "task_id", [F.col("mtime").desc_nulls_last(), F.col("status").asc_nulls_last()])


def day() -> Column:
    """A task's batch day; tasks without one come before all others."""
    return or_else(F.col("batch_date"), F.lit(DAY))


def added(tasks: DataFrame, new: DataFrame, at: float) -> DataFrame:
    """With new tasks written at ``at``, pending; one whose id is there already replaces it."""
    rest = tasks.join(new.select("task_id"), "task_id", "left_anti").select(*tasks.columns)
    typed = new.select(*(F.col(f.name) if f.name in new.columns and f.name not in ("status", "mtime") else F.lit("pending" if f.name == "status" else at if f.name == "mtime" else None).cast(f.dataType).alias(f.name) for f in tasks.schema))
    return rest.unionByName(typed)


def _moved(tasks: DataFrame, ids: DataFrame, before: str, after: str) -> DataFrame:
    hit = tasks.join(ids.select("task_id").distinct().withColumn("__hit", F.lit(True)), "task_id", "left")
    return hit.withColumn("status", F.when(F.col("__hit") & (F.col("status") == before), after).otherwise(F.col("status"))).select(*tasks.columns)


def next_up(tasks: DataFrame, n: int = 1) -> DataFrame:
    """The ``n`` pending tasks to take next: by batch day, then the time they were written, then the id."""
    return tasks.where("status = 'pending'").orderBy(day(), F.col("mtime").asc_nulls_last(), "task_id").limit(n)


def taken(tasks: DataFrame, n: int = 1) -> DataFrame:
    """With the next ``n`` pending tasks in progress."""
    return _moved(tasks, next_up(tasks, n), "pending", "in_progress")


def submitted(tasks: DataFrame, done: DataFrame) -> DataFrame:
    """Without the tasks in progress that are done."""
    return tasks.join(done.select("task_id", F.lit("in_progress").alias("status")).distinct(), ["task_id", "status"], "left_anti").select(*tasks.columns)


def failed(tasks: DataFrame, ids: DataFrame) -> DataFrame:
    """With the given tasks failed, if they are in progress."""
    return _moved(tasks, ids, "in_progress", "failed")


def reset(tasks: DataFrame) -> DataFrame:
    """With every task in progress pending again."""
    return tasks.withColumn("status", F.when(F.col("status") == "in_progress", "pending").otherwise(F.col("status")))


def cleaned(tasks: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Without the tasks written more than ``days`` days before, whatever their state; those without a time stay."""
    limit = F.unix_timestamp(F.to_timestamp(F.lit(as_of))) - days * 86400
    return tasks.where(F.col("mtime").isNull() | (F.col("mtime") >= limit))
