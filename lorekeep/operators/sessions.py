"""Sessions and their messages: statistics, noise, pairing, truncation, time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorekeep.functions import cleaning
from lorekeep.functions.text import or_else, strip
from lorekeep.functions.times import instant

#: Fixed values of the noise rules.
LEAST_USER_CHARS, LEAST_TEXT_RATIO, REPEATS, REPEAT_CHARS = 10, 0.10, 3, 20
MARKERS = ("<tool_use>", "</tool_use>", "<function_call", "<tool_call", "tool_calls:")
REFUSALS = (
    r"(?i)\b(I cannot|I can't|I'm sorry|I am sorry|I'm unable|I am unable)\b",
    r"(?iU)\b(无法回答|无法满足|不便回答|抱歉.{0,5}(无法|不能|不便))",
    r"(?i)\b(refuse|cannot help|cannot assist)\b",
)
MANY_CHARS, BUDGET = 80_000, 15_000
#: Positions of one session that are put in order by one task.
BLOCK = 4096


def messages(sessions: DataFrame, key: str = "session_id") -> DataFrame:
    """``key, pos, role, content``, one row a message; null conversations give none, null contents are empty."""
    return sessions.select(key, F.posexplode("conversation").alias("pos", "m")).select(key, "pos", F.col("m.role").alias("role"), F.coalesce("m.content", F.lit("")).alias("content"))


def batch_stats(sessions: DataFrame, ides: list[str]) -> DataFrame:
    """``ide, sessions, characters, map_reduce`` of a batch, with a row of zeros for every enabled ide without sessions."""
    chars = F.aggregate(F.coalesce("conversation", F.array().cast(sessions.schema["conversation"].dataType)), F.lit(0).cast("bigint"), lambda s, m: s + F.length(F.coalesce(m["content"], F.lit(""))))
    sums = sessions.select("ide", chars.alias("c")).groupBy("ide").agg(F.count("*").alias("sessions"), F.sum("c").alias("characters"))
    enabled = sessions.sparkSession.createDataFrame([(x,) for x in ides], "ide string")
    return enabled.join(sums, "ide", "full").select("ide", F.coalesce("sessions", F.lit(0)).alias("sessions"), F.coalesce("characters", F.lit(0)).alias("characters"), (F.coalesce("characters", F.lit(0)) > MANY_CHARS).alias("map_reduce"))


def workspace_positions(sessions: DataFrame, key: str, least: int = 0) -> DataFrame:
    """``workspace, sessions, first_at, last_at``; sessions without a workspace are together under one name."""
    at = instant(F.col("createdAt"))
    return sessions.groupBy(or_else(F.col("workspace"), F.lit("unknown")).alias("workspace")).agg(F.count(key).alias("sessions"), F.min(at).alias("first_at"), F.max(at).alias("last_at")).where(F.col("sessions") >= least)


def without_tools(text: Column) -> Column:
    """A text without the blocks and marks of tool calls."""
    out = text
    for tag in ("tool_use", "tool_call", "function_call"):
        out = F.regexp_replace(out, rf"(?s)<{tag}[^>]*>.*?</{tag}>", "")
    for mark in MARKERS:
        out = F.replace(out, F.lit(mark), F.lit(""))
    return strip(F.regexp_replace(out, r"(?is)```(?:json|xml)\s*\n\s*[\"']?tool_calls[\"']?\s*[:=].*?```", ""))


def noise(rows: DataFrame, key: str = "session_id") -> DataFrame:
    """``key, reason`` of the sessions that hold no insight, by the first rule that holds; null for the others.

    ``rows`` are messages. Counts of equal texts are summed first, by digest, so that a long session is no single group.
    """
    user, asst = F.col("role") == "user", F.col("role") == "assistant"
    bare = without_tools(F.col("content"))
    sums = rows.groupBy(key).agg(
        F.count(F.when(user, 1)).alias("u"), F.count(F.when(asst, 1)).alias("a"),
        F.sum(F.when(user, F.length("content")).otherwise(0)).alias("uc"),
        F.sum(F.when(asst, F.length("content")).otherwise(0)).alias("ac"), F.sum(F.when(asst, F.length(bare)).otherwise(0)).alias("tc"),
        F.max_by(F.greatest(*(F.col("content").rlike(p) for p in REFUSALS)), F.when(asst, F.col("pos"))).alias("refused"),
    )
    own = strip(F.col("content"))
    most = rows.where(user & (F.length(own) >= REPEAT_CHARS)).groupBy(key, F.sha2(own, 256).alias("h")).agg(F.count("*").alias("n")).groupBy(key).agg(F.max("n").alias("most"))
    ratio = F.when(F.col("ac") == 0, 0.0).otherwise(F.col("tc") / F.col("ac"))
    reason = (
        F.when((F.col("u") == 0) | (F.col("a") == 0), "no-real-interaction")
        .when(F.col("uc") < LEAST_USER_CHARS, "user-input-too-short")
        .when(ratio < LEAST_TEXT_RATIO, "all-tool-calls-no-thinking")
        .when(F.coalesce("most", F.lit(0)) >= REPEATS, "repeated-stuck-pattern")
        .when(F.col("refused") & (F.col("u") == F.col("a")), "refused-no-followup")
    )
    return sums.join(most, key, "left").select(key, reason.alias("reason"))


def previous(rows: DataFrame, columns: dict[str, str], key: str = "session_id") -> DataFrame:
    """Adds, under new names, columns of the message before in the same session.

    Sessions are worked on in blocks of ``BLOCK`` positions; only the last row of each block is looked at across them.
    """
    blocked = rows.withColumn("__b", F.floor(F.col("pos") / BLOCK))
    inside = Window.partitionBy(key, "__b").orderBy("pos")
    local = blocked.withColumns({new: F.lag(old).over(inside) for old, new in columns.items()} | {"__first": F.row_number().over(inside) == 1})
    ends = blocked.groupBy(key, "__b").agg(*(F.max_by(old, "pos").alias(new) for old, new in columns.items()))
    across = Window.partitionBy(key).orderBy("__b")
    ends = ends.select(F.col(key).alias("__k"), F.col("__b").alias("__c"), *(F.lag(new).over(across).alias(f"__{new}") for new in columns.values()))
    joined = local.join(ends, (F.col(key) == F.col("__k")) & (F.col("__b") == F.col("__c")), "left")
    return joined.select(*rows.columns, *(F.when(F.col("__first"), F.col(f"__{new}")).otherwise(F.col(new)).alias(new) for new in columns.values()))


def pairs(rows: DataFrame, key: str = "session_id") -> DataFrame:
    """Cleaned messages of core interactions: a user message stays if it is core, the assistant's directly behind it with
    it, any other if it is longer than 100 characters. Empty messages go first."""
    cleaned = rows.withColumn("content", cleaning.clean(F.col("content"))).where("content <> ''")
    core = cleaned.withColumn("core", (F.col("role") == "user") & cleaning.is_core(F.col("content")))
    core = previous(core, {"role": "before", "core": "led"}, key)
    keep = F.when(F.col("role") == "user", F.col("core")).when((F.col("role") == "assistant") & (F.col("before") == "user"), F.col("led")).otherwise(F.length("content") > 100)
    return core.where(keep).select(key, "pos", "role", "content")


def truncate(rows: DataFrame, budget: int = BUDGET, key: str = "session_id") -> DataFrame:
    """The most telling messages of each session within a budget of characters; the one that overflows is cut if more
    than 200 characters are left. First and last messages count most.

    No message is empty, so at most ``budget + 1`` of a session can matter: that limit holds before rows are gathered.
    """
    ends = rows.groupBy(key).agg(F.min("pos").alias("__lo"), F.max("pos").alias("__hi"))
    scored = rows.where("content <> ''").join(ends, key).withColumn("weight", cleaning.importance(F.col("content")) + F.when(F.col("pos").isin(F.col("__lo"), F.col("__hi")), 100).otherwise(0))
    by_weight = Window.partitionBy(key).orderBy(F.desc("weight"), "pos")
    near = scored.select(key, "pos", "role", "content", "weight").withColumn("__n", F.row_number().over(by_weight)).where(F.col("__n") <= budget + 1)
    summed = near.withColumn("sum", F.sum(F.length("content")).over(by_weight.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.col("sum") - F.length("content"))
    cut = (F.col("before") <= budget) & (F.col("sum") > budget) & (budget - F.col("before") > 200)
    text = F.when(cut, F.concat(F.left("content", (budget - F.col("before")).cast("int")), F.lit("...[已截断]"))).otherwise(F.col("content"))
    return summed.where((F.col("sum") <= budget) | cut).select(key, "pos", "role", text.alias("content"))


def touched(sessions: DataFrame, start: str, end: str) -> DataFrame:
    """Sessions created or last updated in the closed window; an update time that is null counts as the creation."""
    a, b = instant(F.col("createdAt")), F.coalesce(instant(F.col("lastUpdatedAt")), instant(F.col("createdAt")))
    lo, hi = F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end))
    return sessions.where(a.between(lo, hi) | b.between(lo, hi))


def overlapping(sessions: DataFrame, start: str, end: str) -> DataFrame:
    """Sessions whose span from creation to last update meets the closed window."""
    a, b = instant(F.col("createdAt")), F.coalesce(instant(F.col("lastUpdatedAt")), instant(F.col("createdAt")))
    return sessions.where((F.least(a, b) <= F.to_timestamp(F.lit(end))) & (F.greatest(a, b) >= F.to_timestamp(F.lit(start))))


def per_day(sessions: DataFrame, start: str, end: str) -> DataFrame:
    """``day, sessions`` for every day of the range, days without sessions too."""
    days = sessions.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    counted = sessions.groupBy(F.to_date(instant(F.col("createdAt"))).alias("day")).agg(F.count("*").alias("n"))
    return days.join(counted, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("sessions"))


def display_name(sessions: DataFrame) -> Column:
    """The name in at most 80 characters, else one made from the identifier."""
    return F.coalesce(F.left(or_else(F.col("name"), F.lit(None)), F.lit(80)), F.concat(F.lit("会话 "), F.left("sessionId", F.lit(8))))


def prompt(rows: DataFrame, key: str = "session_id", part: int = 2000) -> DataFrame:
    """``key, part, prompt``: numbered messages, redacted, in order, ``part`` messages a row so that none grows unbounded."""
    text, _ = cleaning.redacted(F.col("content"))
    line = F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("] "), F.coalesce("role", F.lit("unknown")), F.lit(": "), text)
    grouped = rows.groupBy(key, F.floor(F.col("pos") / part).alias("part")).agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("x"))
    return grouped.select(key, "part", F.array_join(F.transform("x", lambda s: s["line"]), "\n\n").alias("prompt"))
