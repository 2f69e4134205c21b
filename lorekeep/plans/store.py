"""The store as the tools of an assistant use it: each call is one plan over the store's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import notes, recall, sessions

SEARCH_EVENT = "ts string, event string, query string, hits array<string>, id string, path string"


class Store:
    """Notes, feedback events and tasks. Calls that write return the new table and leave storing it to the caller."""

    def __init__(self, memories: DataFrame, events: DataFrame, tasks: DataFrame | None = None):
        self.spark: SparkSession = memories.sparkSession
        self.memories, self.events, self.tasks = memories, events, tasks

    def search(self, query: str, as_of: str, scope: str = "auto", project: str | None = None, k: int = 5) -> DataFrame:
        """The best notes with citation and snippet."""
        from lorekeep.functions.text import snippet

        pool = notes.scopes(recall.one_of_each(self.memories), scope, project)
        best = recall.search(pool, self.events, query, project, as_of, k)
        shown = pool.select("id", "title", notes.citation(pool).alias("citation"), F.left(snippet(query, F.col("body")), F.lit(600)).alias("snippet"))
        return best.join(shown, "id").orderBy(F.desc("score"), "id")

    def logged(self, query: str, hits: DataFrame, at: str) -> DataFrame:
        """The feedback log with this search added; ``hits`` is a result of :meth:`search`, so at most k rows."""
        row = hits.agg(F.sort_array(F.collect_list("id")).alias("hits")).select(F.lit(at).alias("ts"), F.lit("search").alias("event"), F.lit(query).alias("query"), "hits", F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("path"))
        return self.events.unionByName(row)

    def page(self, wanted: str) -> DataFrame:
        """``id, title, text`` of one note, in at most 60 000 bytes."""
        return notes.resolved(recall.one_of_each(self.memories), wanted).select("id", "title", notes.page(F.col("body")).alias("text"))

    def topics(self) -> DataFrame:
        """``scope, id, title`` of all live notes, newest first in each scope."""
        live = recall.one_of_each(self.memories).where("not coalesce(archived, false)")
        own = F.when(F.col("scope") == "project", F.coalesce("project_key", F.lit(""))).otherwise(F.lit("personal"))
        return live.withColumn("scope", own).orderBy("scope", *notes.newest()).select("scope", "id", "title")

    def remember(self, dictated: DataFrame, day: str) -> DataFrame:
        """The notes with dictated ones taken in; protected notes stay as they are."""
        new = notes.remembered(dictated, day)
        typed = new.select(*(F.col(f.name) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.memories.schema))
        return notes.upsert(recall.one_of_each(self.memories), typed)

    def context(self, project: str) -> DataFrame:
        """The summary of one project."""
        return notes.summaries(recall.one_of_each(self.memories).where(F.col("project_key") == project))

    def forget(self, ids: list[str]) -> DataFrame:
        """The notes with those of the given ids archived."""
        return notes.archived(self.memories, self.spark.createDataFrame([(x,) for x in ids], "id string"))

    def waiting(self) -> int:
        """How many tasks wait."""
        return notes.queue(self.tasks).count()

    def next_task(self) -> DataFrame:
        """The first waiting task."""
        return notes.queue(self.tasks).orderBy("day", "created_at", "task_id").limit(1)

    def noise(self, batch: DataFrame) -> DataFrame:
        """Why sessions of a batch aren't worth a note; ``batch`` has ``session_id`` and ``conversation``."""
        return sessions.noise(sessions.messages(batch))
