"""Topics that a model returned, and their way to notes; hooks for a model and an embedder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import note_id, or_else, strip

MOST_TOKENS, MOST_TAGS = 28_000, 6


def kept(topics: DataFrame) -> DataFrame:
    """All but those that say not to keep them; a missing flag keeps."""
    return topics.where(~F.col("should_keep").eqNullSafe(F.lit(False)))


def fits(prompt: Column) -> Column:
    """Whether a prompt is within the budget, at four characters a token."""
    return F.floor(F.length(prompt) / 4) <= MOST_TOKENS


def unfenced(text: Column) -> Column:
    """A model's answer without the fence around it, from ``topics:`` on if that stands further down."""
    bare = F.regexp_replace(F.regexp_replace(strip(text), r"^```[^\n]*\n", ""), r"\n\s*```[^\n]*$", "")
    at = F.instr(bare, F.lit("topics:"))
    return F.when(at > 1, F.substring(bare, at, F.length(bare))).otherwise(bare)


def to_notes(topics: DataFrame, day: str) -> DataFrame:
    """Notes of topics: unknown scopes are personal, so are project topics without a key; unknown values are medium; six
    tags at most."""
    name = or_else(strip(F.col("title")), F.lit("untitled"))
    project = (F.col("scope") == "project") & (F.coalesce("project_key", F.lit("")) != "")
    return topics.select(
        note_id(name, F.lit(day)).alias("id"), F.when(project, "project").otherwise("personal").alias("scope"), name.alias("title"),
        or_else(F.col("body"), F.concat(F.lit("# "), name, F.lit("\n"))).alias("body"), F.when(project, F.col("project_key")).alias("project_key"), F.lit("auto").alias("source"),
        F.when(F.col("value").isin("high", "medium", "low"), F.col("value")).otherwise("medium").alias("value"), F.lit(day).alias("created"), F.lit(day).alias("updated"),
        F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, MOST_TAGS).alias("tags"),
    )


def apply_model(rows: DataFrame, column: str, model: Callable[[list[str]], list[str]], out: str = "answer") -> DataFrame:
    """Adds a model's answers, asked a batch at a time; a null text isn't asked, a failing batch gives nulls."""
    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            known = s.dropna()
            try:
                answers = pd.Series(model(known.tolist()), index=known.index, dtype=object)
            except Exception:
                answers = pd.Series(dtype=object)
            yield answers.reindex(s.index)

    return rows.withColumn(out, ask(F.col(column)))


def embed(rows: DataFrame, column: str, model: Callable[[list[str]], list[list[float]]], stored: DataFrame | None = None) -> DataFrame:
    """``digest, vector`` for the distinct texts, those already ``stored`` (same columns) not embedded again."""
    texts = rows.where(F.col(column).isNotNull()).select(F.sha2(column, 256).alias("digest"), F.col(column).alias("text")).dropDuplicates(["digest"])
    missing = texts.join(stored.select("digest"), "digest", "left_anti") if stored is not None else texts

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(model(s.tolist()), index=s.index)

    fresh = missing.select("digest", run("text").alias("vector"))
    return fresh if stored is None else stored.select("digest", "vector").unionByName(fresh)
