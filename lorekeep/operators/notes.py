"""The note store: lists, conflicts, supersession, archiving, upserts, summaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType
from pyspark.sql.window import Window

from lorekeep.functions.text import or_else, strip, words
from lorekeep.operators.partners import lists, partners, taken
from lorekeep.session import numbered, written

PROTECTED = ("manual", "edited")
TAGS, TITLE = 2, 0.40


def listed(notes: DataFrame, scope: str | None = None, project: str | None = None, since: str | None = None, value: str | None = None, archived: bool = False) -> DataFrame:
    """Notes by the given filters; those left out don't filter. Newest first when sorted by :func:`newest`."""
    out = notes if archived else notes.where("not coalesce(archived, false)")
    for column, want in (("scope", scope), ("project_key", project), ("value", value)):
        out = out.where(F.col(column) == want) if want else out
    return out.where(F.col("created") >= since) if since else out


def newest() -> list[Column]:
    return [or_else(F.col("updated"), F.col("created")).desc_nulls_last(), F.col("id")]


def stats(notes: DataFrame) -> DataFrame:
    """``dimension, key, n`` by scope, source and value in one pass."""
    grouped = notes.groupingSets([["scope"], ["source"], ["value"]], "scope", "source", "value").agg(F.count("*").alias("n"), F.grouping("scope").alias("a"), F.grouping("source").alias("b"))
    name = F.when(F.col("a") == 0, "scope").when(F.col("b") == 0, "source").otherwise("value")
    return grouped.select(name.alias("dimension"), F.coalesce("scope", "source", "value").alias("key"), "n")


def flags(notes: DataFrame) -> DataFrame:
    """``dimension, key, n``: how many notes carry a mark of a conflict and how many one of being superseded."""
    n = lambda c: F.count(F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, 1))
    sums = notes.agg(n("potential_conflicts").alias("conflicts"), n("potentially_superseded_by").alias("superseded"))
    return sums.select(F.explode(F.array(*(F.struct(F.lit("flag").alias("dimension"), F.lit(c).alias("key"), F.col(c).alias("n")) for c in ("conflicts", "superseded")))).alias("x")).select("x.*")


def spans(notes: DataFrame) -> DataFrame:
    """``project_key, span``: from the first to the last day of creation of a project's live notes; unknown without any."""
    own = notes.where("scope = 'project' and not coalesce(archived, false)").groupBy("project_key").agg(F.min(F.nullif("created", F.lit(""))).alias("a"), F.max(F.nullif("created", F.lit(""))).alias("b"))
    return own.select("project_key", F.coalesce(F.concat("a", F.lit(" ~ "), "b"), F.lit("unknown")).alias("span"))


def near_empty(notes: DataFrame, least: int = 5) -> bool:
    """Whether a store has fewer live notes than ``least``; no more than so many rows are looked for."""
    return notes.where("not coalesce(archived, false)").select("id").limit(least).count() < least


def stale(notes: DataFrame, overviews: DataFrame) -> DataFrame:
    """``project_key`` of the projects whose overview has to be made again: none is there, or a live note was written after
    it; overviews (``project_key, compiled_at`` in seconds, ``edited``) that people edited stay as they are."""
    last = notes.where("scope = 'project' and not coalesce(archived, false) and project_key is not null").groupBy("project_key").agg(F.max("file_mtime").alias("last"))
    joined = last.join(overviews.select("project_key", "compiled_at", "edited"), "project_key", "left")
    return joined.where(~F.coalesce("edited", F.lit(False)) & (F.col("compiled_at").isNull() | (F.col("last") > F.col("compiled_at")))).select("project_key")


def contexts(notes: DataFrame, overviews: DataFrame, size: int = 4096) -> DataFrame:
    """``project_key, summary``: a project's overview (``project_key, text``) if it has one that isn't blank, else the lines of
    its notes as in :func:`summaries`, in at most ``size`` characters."""
    body = strip(F.col("text"))
    text = F.concat(F.lit("# "), F.col("project_key"), F.lit("\n\n"), body)
    own = overviews.where(body != "").select("project_key", F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size - 20)), F.lit("\n\n... (truncated)"))).otherwise(text).alias("summary"))
    rest = notes.join(own.select("project_key"), "project_key", "left_anti").select(*notes.columns)
    return own.unionByName(summaries(rest, size=size))


def _kept() -> list[Column]:
    """What of a note tells whom it meets: ``scope, p, tags, w``."""
    tags = F.array_sort(F.array_distinct(F.transform(F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t.isNotNull()), F.lower)))
    project = F.when(F.col("scope") == "project", F.coalesce("project_key", F.lit(""))).otherwise(F.lit(""))
    return [F.col("scope"), project.alias("p"), tags.alias("tags"), words(F.col("title")).alias("w")]


def _live(notes: DataFrame, *more: Column) -> DataFrame:
    """``id, scope, p, tags, w`` of live notes, written, since they are read more than once."""
    live = notes.where("not coalesce(archived, false) and id is not null").dropDuplicates(["id"])
    return written(live.select("id", *_kept(), *more), "notes")


def conflicts(notes: DataFrame) -> DataFrame:
    """``id, other`` of live notes of one scope and project that share two tags or have titles alike.

    Exact without comparing all notes of a project: two shared tags, or a title likeness of 0.4 or more, both need a
    shared word. For tags, the pairs of a note's tags are looked up; for titles, its rarest words, as many as a likeness of
    0.4 can't do without. Notes are moved, never pairs.
    """

    def give(t: pa.Table, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([taken(t, "id", np.repeat(x, n)), taken(t, "id", y)], names=["id", "other"])

    kind = notes.schema["id"].dataType.simpleString()
    return partners(_live(notes), f"id {kind}, other {kind}", give)


def superseded(notes: DataFrame) -> DataFrame:
    """``id, superseded_by``: for each note the later ones (by creation, then id) it is in conflict with, in order."""

    def later(t: pa.Table):
        c = pc.rank(t["c"].combine_chunks(), tiebreaker="dense").to_numpy()
        return lambda x, y: y[(c[y] > c[x]) | ((c[y] == c[x]) & (y > x))]

    def give(t: pa.Table, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([taken(t, "id", x[n > 0]), lists(t, n[n > 0], y)], names=["id", "superseded_by"])

    kind = notes.schema["id"].dataType.simpleString()
    return partners(_live(notes, F.coalesce("created", F.lit("")).alias("c")), f"id {kind}, superseded_by array<{kind}>", give, later)


def marked(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The store with new notes taken in and both ways marked: a new note's ``potential_conflicts`` are the live stored notes
    it is in conflict with, in order, and each of those gets the new ids behind its own ``potentially_superseded_by``.
    Only pairs of a new and a stored note count; an id in both is the new one."""
    old = stored.join(incoming.select("id"), "id", "left_anti").select(*stored.columns)
    both = old.withColumn("__new", F.lit(False)).unionByName(incoming.select(*stored.columns).withColumn("__new", F.lit(True)))
    kind = both.schema["id"].dataType
    # all rows of an id, and what one of the live ones meets by; rows go with their note, so that lists are never moved
    live = F.col("id").isNotNull() & ~F.coalesce("archived", F.lit(False))
    one = both.groupBy("id").agg(F.first("__new").alias("fresh"), F.collect_list(F.struct(*both.columns)).alias("rows"), F.first(F.when(live, F.struct(*_kept())), ignorenulls=True).alias("by"))
    one = written(one.select("id", "fresh", "rows", "by.*"), "notes")

    def across(t: pa.Table):
        fresh = t["fresh"].to_numpy()
        return lambda x, y: y[fresh[y] != fresh[x]]

    def give(t: pa.Table, x: np.ndarray, n: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([taken(t, "rows", x), lists(t, n, y)], names=["rows", "__others"])

    result = StructType([one.schema["rows"], StructField("__others", ArrayType(kind))])
    found = partners(one, result, give, across, own=("rows",)).unionByName(one.where("scope is null").select("rows", F.lit(None).cast(ArrayType(kind)).alias("__others")))
    out = found.select("__others", F.explode("rows").alias("__r")).select("__r.*", "__others")
    none = F.array().cast("array<string>")
    out = out.withColumn("potential_conflicts", F.when(F.col("__new"), F.coalesce("__others", none)).otherwise(F.col("potential_conflicts")))
    out = out.withColumn("potentially_superseded_by", F.when(~F.col("__new") & (F.size("__others") > 0), F.array_union(F.coalesce("potentially_superseded_by", none), F.col("__others"))).otherwise(F.col("potentially_superseded_by")))
    return out.select(*stored.columns)


def inactive(notes: DataFrame, events: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """``id, age`` of automatic notes at least ``days`` old that no recent event names; an unreadable date is no age."""
    from lorekeep.operators.recall import recent

    window = recent(events, as_of, days)
    active = window.select(F.explode("hits").alias("id")).unionByName(window.select("id")).where("id is not null").distinct()
    age = F.datediff(F.to_date(F.lit(as_of[:10])), F.col("created").try_cast("date"))
    old = notes.where("not coalesce(archived, false)").where(F.col("source").isin("auto", "bootstrap") & (age >= days)).select("id", age.alias("age")).distinct()
    return old.join(active, "id", "left_anti")


def source_now(notes: DataFrame) -> Column:
    """``edited`` for automatic notes whose file is more than 5 seconds younger than their last own writing."""
    written = F.col("_mtime_at_write")
    return F.when(F.col("source").isin("auto", "bootstrap") & (written > 0) & ~F.isnan(written) & (F.col("file_mtime") > written + 5), "edited").otherwise(F.col("source"))


def upsert(stored: DataFrame, incoming: DataFrame, day: str | None = None) -> DataFrame:
    """The store after writing ``incoming`` (one row an id): protected notes stay as they are, others are replaced, new
    ones added. With a ``day``, what is written is updated on it, and created on the day it was first. The result is a new
    snapshot of the store."""
    if day:
        born = stored.select("id", F.col("created").alias("__born"))
        incoming = incoming.join(born, "id", "left").withColumn("created", F.coalesce("__born", F.nullif("created", F.lit("")), F.lit(day))).withColumn("updated", F.lit(day)).drop("__born")
    kept = stored.where(F.col("source").isin(*PROTECTED))
    fresh = incoming.join(kept.select("id"), "id", "left_anti")
    rest = stored.where(~F.coalesce(F.col("source").isin(*PROTECTED), F.lit(False))).join(incoming.select("id"), "id", "left_anti")
    return kept.unionByName(rest).unionByName(fresh.select(*stored.columns))


def citation(notes: DataFrame) -> Column:
    """Where a note is from: tool, day, the first characters of the session."""
    o = F.col("origin")
    day = F.substring(F.coalesce(*(F.nullif(x, F.lit("")) for x in (o["distilled_at"], o["remembered_at"], F.col("created")))), 1, 10)
    sid = F.when(F.coalesce(o["session_id"], F.lit("")) != "", F.concat(F.lit("session "), F.left(o["session_id"], F.lit(6)), F.lit("..")))
    return F.concat_ws(" · ", F.nullif(o["ide"], F.lit("")), day, sid)


def summary_line(notes: DataFrame) -> Column:
    """One line for a note: its title and a short description."""
    lines = F.transform(F.split(F.coalesce("body", F.lit("")), r"\R"), strip)
    first = F.left(F.get(F.filter(lines, lambda x: (x != "") & ~x.startswith("#")), 0), F.lit(100))
    desc = or_else(strip(F.coalesce(F.try_element_at("extra", F.lit("summary")), F.lit(""))), first)
    short = F.when(F.length(desc) > 100, F.concat(F.left(desc, F.lit(97)), F.lit("..."))).otherwise(desc)
    head = F.concat(F.lit("- **"), F.left(or_else(F.col("title"), F.col("id")), F.lit(60)), F.lit("**"))
    return F.when(F.coalesce(short, F.lit("")) == "", head).otherwise(F.concat(head, F.lit(" — "), short))


def buckets(notes: DataFrame, most: int = 10, most_protected: int | None = None) -> DataFrame:
    """``project_key, bucket, rank, line`` of what a project's summary shows: all protected notes (or the first
    ``most_protected``), and of the others the ``most`` newest of high and of medium value."""
    protected = F.col("source").isin(*PROTECTED)
    bucket = F.when(protected, 0).when(F.col("value") == "high", 1).when(F.col("value") == "medium", 2)
    own = notes.where("scope = 'project' and not coalesce(archived, false)").withColumn("bucket", bucket).where("bucket is not null")

    def first(rows: DataFrame, n: int) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("project_key", "bucket").orderBy(*newest()))).where(F.col("rank") <= n)

    kept = own.where("bucket = 0")
    kept = numbered(kept, "project_key", newest(), "rank") if most_protected is None else first(kept, most_protected)
    return kept.unionByName(first(own.where("bucket > 0"), most)).select("project_key", "bucket", "rank", summary_line(notes).alias("line"))


def summaries(notes: DataFrame, most: int = 10, size: int = 4096) -> DataFrame:
    """``project_key, summary`` in at most ``size`` characters; longer ones are cut and say so. Lines beyond the size
    can't show, so what is gathered of a project is bounded."""
    shown = buckets(notes, most, size // 8)  # no line has fewer than 8 characters with its line end
    order = Window.partitionBy("project_key").orderBy("bucket", "rank")
    near = shown.withColumn("before", F.coalesce(F.sum(F.length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") <= size)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "rank", "line"))), lambda s: s["line"]), "\n")
    body = near.groupBy("project_key").agg(text.alias("t"))
    return body.select("project_key", F.when(F.length("t") > size, F.concat(F.left("t", F.lit(size - 20)), F.lit("\n\n... (truncated)"))).otherwise(F.col("t")).alias("summary"))


def compile_entries(notes: DataFrame) -> DataFrame:
    """``project_key, i, n, entry``: the numbered entries of a project's overview, by value, then age."""
    rank = F.when(F.col("value") == "high", 0).when(F.col("value") == "low", 2).otherwise(1)
    own = notes.where("scope = 'project' and not coalesce(archived, false)")
    counts = own.groupBy(F.col("project_key").alias("__p")).agg(F.count("*").alias("n"))
    rows = numbered(own, "project_key", [rank, or_else(F.col("updated"), F.col("created")), F.col("id")], "i").join(counts, F.col("project_key").eqNullSafe(F.col("__p"))).drop("__p")
    tag = F.when(F.col("source").isin(*PROTECTED), F.concat(F.lit(" [source="), F.col("source"), F.lit("]"))).otherwise(F.lit(""))
    head = F.concat(F.lit("--- entry "), F.col("i").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" (id="), F.col("id"), F.lit(", value="), F.coalesce("value", F.lit("")), tag, F.lit(") ---\n"))
    return rows.select("project_key", "i", "n", F.concat(head, strip(F.coalesce("body", F.lit(""))), F.lit("\n")).alias("entry"))


def with_block(text: Column, block: Column, start: str, end: str) -> Column:
    """A file's text with the marked block replaced, or added behind a blank line; null gives the block alone."""
    marked = F.concat(F.lit(start + "\n"), block, F.lit("\n" + end))
    a = F.instr(text, F.lit(start))
    tail = F.substring(text, a, F.length(text))
    z = F.instr(tail, F.lit(end))
    swapped = F.concat(F.left(text, (a - 1).cast("int")), marked, F.substring(tail, z + len(end), F.length(text)))
    gap = F.when(text.endswith("\n\n"), F.lit("")).when(text.endswith("\n"), F.lit("\n")).otherwise(F.lit("\n\n"))
    return F.when(text.isNull(), F.concat(marked, F.lit("\n"))).when((a > 0) & (z > 0), swapped).when(a > 0, text).otherwise(F.concat(text, gap, marked, F.lit("\n")))


def queue(tasks: DataFrame) -> DataFrame:
    """Waiting tasks, each once, with their place in the queue: by batch day (empty ones first), then creation."""
    one = tasks.where("status = 'pending' and task_id is not null").dropDuplicates(["task_id"])
    return one.select("task_id", or_else(F.col("batch_date"), F.lit("0000-00-00")).alias("day"), F.coalesce("created_at", F.lit("")).alias("created_at"))


def scopes(notes: DataFrame, mode: str = "auto", project: str | None = None) -> DataFrame:
    """The notes a search looks at: ``all`` takes every scope, ``auto`` too if there is a project, else the personal ones,
    ``current_project`` the project's own and none without one, ``personal`` and ``general`` only the personal ones; an
    unknown mode is ``auto``."""
    own = F.col("scope") != "project"
    if mode in ("personal", "general"):
        return notes.where(own)
    if mode == "current_project":
        return notes.where((F.col("project_key") == project) & ~own) if project else notes.where("false")
    return notes if mode == "all" or project else notes.where(own)


def resolved(notes: DataFrame, wanted: str) -> DataFrame:
    """The one note a word stands for: with that id, personal ones before projects' and archived ones last; else the newest
    whose id or title holds it in any case."""
    low = wanted.lower()
    near = F.lower("id").contains(low) | F.lower(F.coalesce("title", F.lit(""))).contains(low)
    root = F.when(F.coalesce("archived", F.lit(False)), 2).when(F.col("scope") == "project", 1).otherwise(0)
    return notes.where(near | (F.col("id") == wanted)).orderBy(F.when(F.col("id") == wanted, root).otherwise(3), *newest()).limit(1)


def remembered(texts: DataFrame, day: str) -> DataFrame:
    """Notes that people dictate (``body, scope, project_key, tags``, and ``value`` if there is one): redacted, without blanks at
    both ends. A first line that begins with ``#`` is the title, else its first 30 characters are, put in front as a heading.
    Unknown values are medium, a project scope without a key is personal; blank texts don't come out."""
    from lorekeep.functions.cleaning import redacted
    from lorekeep.functions.text import note_id

    body, _ = redacted(F.col("body"))
    line = F.get(F.split("body", r"\R", 2), 0)
    held = texts.withColumn("body", strip(body)).where("body <> ''").withColumn("__headed", line.startswith("#"))
    name = F.when(F.col("__headed"), strip(F.regexp_replace(line, r"^#+", ""))).otherwise(or_else(strip(F.left(line, F.lit(30))), F.lit("memory")))
    project = (F.col("scope") == "project") & (F.coalesce("project_key", F.lit("")) != "")
    value = F.when(F.col("value").isin("high", "medium", "low"), F.col("value")).otherwise("medium") if "value" in texts.columns else F.lit("medium")
    return held.withColumn("__name", name).select(
        note_id(F.col("__name"), F.lit(day)).alias("id"), F.when(project, "project").otherwise("personal").alias("scope"), F.when(project, F.col("project_key")).alias("project_key"), F.col("__name").alias("title"),
        F.when(F.col("__headed"), F.col("body")).otherwise(F.concat(F.lit("# "), "__name", F.lit("\n\n"), "body")).alias("body"), F.lit("manual").alias("source"), value.alias("value"),
        F.lit(day).alias("created"), F.lit(day).alias("updated"), F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, 6).alias("tags"),
    )


def archived(notes: DataFrame, ids: DataFrame, state: bool = True) -> DataFrame:
    """The store with the notes of ``ids`` archived, or restored; all rows come out."""
    marked = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    return notes.join(marked, "id", "left").withColumn("archived", F.when(F.col("__hit"), F.lit(state)).otherwise(F.col("archived"))).select(*notes.columns)


def pending(sessions: DataFrame, done: DataFrame, key: str = "session_id") -> DataFrame:
    """Sessions not yet worked on."""
    return sessions.join(done.select(key).distinct(), key, "left_anti").select(*sessions.columns)


def page(text: Column, most: int = 60_000) -> Column:
    """At most ``most`` bytes of a text, cut between characters."""
    raw = F.left(text, F.lit(most)).cast("binary")
    cuts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.substring(raw, F.lit(1), F.lit(most) - i).cast("string"))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.get(F.filter(cuts, F.is_valid_utf8), 0))
