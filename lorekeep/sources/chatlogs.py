"""Chat logs of several tools as sessions of one schema.

Files are read by Spark's own sources, one scan a tool; every broken line or value is left out by itself.
"""

from __future__ import annotations

import sqlite3
import warnings
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lorekeep.functions.text import or_else, strip, url_text
from lorekeep.functions.times import instant

SESSION = "ide string, sessionId string, name string, createdAt string, lastUpdatedAt string, status string, workspace string, messageCount int, conversation array<struct<role:string,content:string>>"
_LINE = "struct<type:string,timestamp:string,isMeta:boolean,isSidechain:boolean,message:struct<role:string,content:string>>"
_BLOCKS = "array<struct<type:string,text:string>>"


def _between(at: Column, start: str, end: str) -> Column:
    return at.between(F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end)))


def jsonl_sessions(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Sessions of ``project/session.jsonl`` files; see :func:`sessions_of_lines`. Folders named ``subagents`` are skipped."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return sessions_of_lines(lines.where(~F.col("file").contains("/subagents/")).withColumn("n", F.monotonically_increasing_id()), start, end)


def sessions_of_lines(lines: DataFrame, start: str, end: str) -> DataFrame:
    """Sessions of log lines (``value, file, block, n``) whose span of entries meets the window.

    A session's times are those of all its entries. Meta and side entries, and user entries whose content isn't a JSON
    string, are no messages; of an assistant's block list the text blocks count. What counts is the type of the JSON value: a
    text that begins with a bracket is a text. Messages keep the order of the lines, whatever parts a file is read in.
    """
    e = F.from_json("value", _LINE)
    listed = F.from_json("value", "struct<message:struct<content:array<string>>>")["message"]["content"]
    rows = lines.withColumn("e", e).where("e is not null").select("file", "block", "n", "e", listed.isNotNull().alias("is_list"), F.get_json_object("value", "$.message.content").alias("raw"))
    spans = rows.groupBy("file").agg(F.min(instant(F.col("e.timestamp"))).alias("first"), F.max(instant(F.col("e.timestamp"))).alias("last"))
    is_list = F.col("is_list")
    blocks = F.from_json("raw", _BLOCKS)
    joined = strip(F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & (F.coalesce(b["text"], F.lit("")) != "")), lambda b: b["text"]), "\n"))
    side = F.coalesce("e.isSidechain", F.lit(False))
    user = (F.col("e.type") == "user") & ~side & ~F.coalesce("e.isMeta", F.lit(False)) & ~is_list
    asst = (F.col("e.type") == "assistant") & ~side
    content = F.when(user, F.col("raw")).when(asst, F.when(is_list, joined).otherwise(strip(F.col("raw"))))
    messages = rows.select("file", "block", "n", F.col("e.type").alias("role"), content.alias("content")).where("content rlike '(?U)\\\\S'")
    packed = messages.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", "n", "role", "content"))).alias("m"))
    out = packed.join(spans, "file").where((F.col("first") <= F.to_timestamp(F.lit(end))) & (F.col("last") >= F.to_timestamp(F.lit(start))))
    names = F.filter("m", lambda x: x["role"] == "user")
    folder = F.element_at(F.split("file", "/"), -2)
    return out.select(
        F.lit("claude-code").alias("ide"), F.regexp_extract("file", r"([^/]+)\.jsonl$", 1).alias("sessionId"),
        F.coalesce(strip(F.left(F.get(names, 0)["content"], F.lit(60))), F.lit("session")).alias("name"),
        F.date_format("first", "yyyy-MM-dd'T'HH:mm:ss").alias("createdAt"), F.date_format("last", "yyyy-MM-dd'T'HH:mm:ss").alias("lastUpdatedAt"),
        F.lit("completed").alias("status"), F.when(folder.startswith("-"), F.translate(folder, "-", "/")).otherwise(folder).alias("workspace"),
        F.size("m").alias("messageCount"), F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("conversation"),
    )


def indexed_sessions(spark: SparkSession, index: str, data: str, start: str, end: str) -> DataFrame:
    """Sessions of an index file and one data file a message; see :func:`sessions_of_entries`."""
    entries = spark.read.option("wholetext", "true").text(index).select(F.explode(F.from_json("value", "struct<entries:map<string,struct<lastAccess:bigint,fileName:string>>>")["entries"]).alias("key", "meta"))
    files = spark.read.option("wholetext", "true").text(data).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), "value")
    return sessions_of_entries(entries.select("key", "meta.lastAccess", "meta.fileName"), files, start, end)


def sessions_of_entries(entries: DataFrame, files: DataFrame, start: str, end: str) -> DataFrame:
    """Sessions of index entries (``key, lastAccess, fileName``) and files (``file, value``); the window filters messages,
    before they are grouped. The files' value is JSON inside JSON, its content URL-encoded. Roles are in the key's suffix."""
    role = F.when(F.col("key").endswith("-user"), "user").when(F.col("key").endswith("-bot"), "assistant")
    seen = F.timestamp_millis("lastAccess")
    wanted = entries.select(role.alias("role"), seen.alias("seen"), F.col("fileName").alias("file")).where("role is not null and file <> ''").where(_between(F.col("seen"), start, end))
    inner = F.from_json(F.from_json("value", "struct<value:string>")["value"], "struct<content:string,storeSessionId:string,id:bigint>")
    files = files.select("file", inner.alias("d"))
    rows = wanted.join(files, "file").select("role", "seen", F.coalesce("d.storeSessionId", F.lit("unknown")).alias("sid"), F.coalesce("d.id", F.lit(0)).alias("id"), url_text(F.col("d.content")).alias("content")).where("content <> ''")
    packed = rows.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("id", "role", "content"))).alias("m"), F.max("seen").alias("last"))
    at = F.date_format("last", "yyyy-MM-dd'T'HH:mm:ss")
    names = F.filter("m", lambda x: x["role"] == "user")
    return packed.select(
        F.lit("aone-copilot").alias("ide"), F.col("sid").alias("sessionId"), F.coalesce(strip(F.left(F.get(names, 0)["content"], F.lit(60))), F.lit("session")).alias("name"),
        at.alias("createdAt"), at.alias("lastUpdatedAt"), F.lit("completed").alias("status"), F.lit("").alias("workspace"), F.size("m").alias("messageCount"),
        F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("conversation"),
    )


def contained(needles: DataFrame, needle: str, hay: DataFrame, text: str, gram: int = 8) -> DataFrame:
    """Rows of both tables whose needle stands anywhere in the text, without comparing all with all.

    Needles are joined by their first ``gram`` characters to the texts' runs of so many, shorter ones by their whole length,
    and then looked for in full. Texts are to be short (keys); empty and null needles match nothing.
    """
    sized = needles.where(F.length(needle) > 0).withColumn("__size", F.least(F.length(needle), F.lit(gram))).withColumn("__gram", F.left(F.col(needle), F.lit(gram)))
    sizes = [r[0] for r in sized.select("__size").distinct().collect()]  # at most ``gram`` rows

    def grams(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(F.col(text), i, F.lit(n)))

    runs = F.array_distinct(F.flatten(F.array(*map(grams, sizes)))) if sizes else F.array().cast("array<string>")
    return sized.join(hay.withColumn("__gram", F.explode(runs)), "__gram").where(F.col(text).contains(F.col(needle))).drop("__gram", "__size")


def agent_messages(kv: DataFrame) -> DataFrame:
    """``session_id, key, role, content`` of agent rows whose key holds a conversation's id anywhere.

    Of a key in several rows the latest counts; only user and assistant rows with a text do.
    """
    latest = kv.groupBy("key").agg(F.max_by("value", "snapshot_at").alias("value"))
    ids = latest.where("key like 'composerData:%' and value is not null").select(F.expr("substring(key, 14)").alias("session_id"))
    blob = F.from_json("value", "struct<role:string,text:string,content:string>")
    agents = latest.where("key like 'agentKv:blob:%'").select("key", F.expr("substring(key, 14)").alias("rest"), blob.alias("b"))
    text = or_else(F.col("b.text"), F.col("b.content"))
    return contained(ids, "session_id", agents, "rest").select("session_id", "key", F.col("b.role").alias("role"), text.alias("content")).where("role in ('user', 'assistant') and content <> ''")


def fuzzy_contents(kv: DataFrame) -> DataFrame:
    """``session_id, bubble_id, key`` for listed messages without a row of their own: the first key of a content row, in
    order, that holds the message's id anywhere."""
    keys = kv.where("key is not null").groupBy("key").agg(F.max_by("value", "snapshot_at").alias("value"))
    listed = F.from_json("value", "struct<fullConversationHeadersOnly:array<struct<bubbleId:string>>>")["fullConversationHeadersOnly"]
    heads = keys.where("key like 'composerData:%'").select(F.expr("substring(key, 14)").alias("session_id"), F.explode(F.array_distinct(F.transform(listed, lambda h: h["bubbleId"]))).alias("bubble_id")).where("bubble_id <> ''")
    own = keys.where("key like 'bubbleId:%' and value is not null").select("key")
    missing = heads.withColumn("key", F.concat(F.lit("bubbleId:"), "session_id", F.lit(":"), "bubble_id")).join(own, "key", "left_anti").drop("key")
    contents = keys.where("key like 'composer.content.%' and value is not null").select("key", F.expr("substring(key, 18)").alias("rest"))
    met = contained(missing.select("bubble_id").distinct(), "bubble_id", contents, "rest").groupBy("bubble_id").agg(F.min("key").alias("key"))
    return missing.join(met, "bubble_id").select("session_id", "bubble_id", "key")


def workspace_of(path: Column) -> Column:
    """The first four parts of a file's path; empty for a shorter one."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 3, F.array_join(F.slice(parts, 1, 4), "/")).otherwise(F.lit(""))


def union(*sources: DataFrame) -> DataFrame:
    """Sessions of several tools in one table; columns a source lacks are null."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def collected(wanted: list[str], readers: dict[str, Callable[[], DataFrame]]) -> DataFrame | None:
    """The sessions of the wanted tools in one table, by the reader of each; a tool without one is warned of. None if no
    reader is left."""
    unknown = [w for w in wanted if w not in readers]
    if unknown:
        warnings.warn(f"no reader for {', '.join(unknown)}", stacklevel=2)
    made = [readers[w]() for w in wanted if w in readers]
    return union(*made) if made else None


class _Range(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


class KvReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["path"].split(",")
        self.table = options.get("table", "cursorDiskKV")
        self.prefix = options.get("prefix", "")
        self.step = int(options.get("rows", "50000"))

    def _open(self, path: str) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{path}?mode=ro", uri=True)

    def partitions(self) -> list[_Range]:
        out = []
        for path in self.paths:
            with self._open(path) as con:
                top = con.execute(f'SELECT max(rowid) FROM "{self.table}"').fetchone()[0] or 0
            out += [_Range(path, a, min(a + self.step, top + 1)) for a in range(0, top + 1, self.step)]
        return out

    def read(self, part: _Range) -> Iterator[tuple]:
        with self._open(part.path) as con:
            query = f'SELECT key, value FROM "{self.table}" WHERE rowid >= ? AND rowid < ? AND substr(key, 1, ?) = ?'
            for key, value in con.execute(query, (part.low, part.high, len(self.prefix), self.prefix)):
                yield key, value.decode("utf-8", "replace") if isinstance(value, bytes) else value


class KvSource(DataSource):
    """``spark.read.format("kvfile").option("prefix", "composerData:").load(path)``: key-value tables of SQLite files.

    Read-only, in ranges of row numbers; options ``table``, ``prefix`` and ``rows`` (of a range).
    """

    @classmethod
    def name(cls) -> str:
        return "kvfile"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])

    def reader(self, schema: T.StructType) -> KvReader:
        return KvReader(self.options)


def write_batches(sessions: DataFrame, path: str) -> None:
    """Sessions as JSON by day; days that are written again replace their old files, other days stay."""
    sessions.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_date").json(path)


def read_batches(spark: SparkSession, path: str, days: list[str] | None = None, ides: list[str] | None = None) -> DataFrame:
    """Sessions of the given days and tools; days without a folder add nothing."""
    out = spark.read.schema(SESSION + ", batch_date string").json(path)
    out = out.where(F.col("batch_date").isin(days)) if days else out
    return out.where(F.col("ide").isin(ides)) if ides else out


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Feedback events from JSON lines; broken lines are left out."""
    schema = "ts string, event string, query string, hits array<string>, id string, path string, _corrupt_record string"
    rows = spark.read.schema(schema).json(path)
    return rows.where("_corrupt_record is null and event is not null").drop("_corrupt_record")


def append_events(events: DataFrame, path: str) -> None:
    """Events added as JSON lines by day."""
    events.withColumn("date", F.date_format(instant(F.col("ts")), "yyyy-MM-dd")).write.mode("append").partitionBy("date").json(path)
