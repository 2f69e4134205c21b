"""Registered queries of sources, sinks, streams, tasks and the store's upkeep, each over its whole tables, with their SQL."""

from __future__ import annotations

import os
import sqlite3
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import config, text
from lorekeep.functions.times import instant
from lorekeep.operators import bm25, delivery, notes, recall, tasks, topics
from lorekeep.plans.core_queries import _AGED, _CONFLICTS, _COUNTS, _KEYED, _LATEST, _MSG, _NOTE, _PROJECT, _TITLE, _WORDS, AS_OF, NOTE_QUERY, SQL, _documents, _latest, _messages, _recent, _stripped, query
from lorekeep.session import numbered, shared_dir, table, written
from lorekeep.sources import chatlogs, markdown
from lorekeep.streaming import feedback

_SPOKEN = "regexp_matches(content, '[^\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]')"


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder of the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.one_of_each(table(spark, sf_dir, "memories"))


# --- sources and sinks ------------------------------------------------------------------------------------------------


@query(
    "log_sessions",
    _MSG + f""", s AS (SELECT session_id, pos, role, CASE WHEN role = 'user' THEN content ELSE {_stripped('content')} END AS content FROM m WHERE role IN ('user', 'assistant') AND {_SPOKEN}),
w AS (SELECT session_id, min(pos % 24) AS a, max(pos % 24) AS b FROM m GROUP BY 1)
SELECT session_id, count(*) AS messages, md5(string_agg(role || ':' || content, e'\\n' ORDER BY pos)) AS digest,
 '2026-03-01T' || lpad(CAST(any_value(a) AS VARCHAR), 2, '0') || ':00:00' AS first_at, '2026-03-01T' || lpad(CAST(any_value(b) AS VARCHAR), 2, '0') || ':00:00' AS last_at
FROM s JOIN w USING (session_id) GROUP BY session_id""",
)
def log_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions written as log lines, every other assistant message as a list of blocks, and read again."""
    m = _messages(spark, sf_dir)
    blocks = F.to_json(F.array(F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text")), F.struct(F.lit("text").alias("type"), F.col("content").alias("text"))))
    quoted = F.regexp_replace(F.to_json(F.struct(F.col("content").alias("c"))), r'^\{"c":|\}$', "")
    content = F.when((F.col("role") == "assistant") & (F.col("pos") % 2 == 1), blocks).otherwise(quoted)
    at = F.concat(F.lit("2026-03-01T"), F.lpad((F.col("pos") % 24).cast("string"), 2, "0"), F.lit(":00:00Z"))
    line = F.concat(F.lit('{"type":'), F.coalesce(F.concat(F.lit('"'), "role", F.lit('"')), F.lit("null")), F.lit(',"timestamp":"'), at, F.lit('","message":{"content":'), content, F.lit("}}"))
    lines = m.select(line.alias("value"), F.concat(F.lit("app/"), "session_id", F.lit(".jsonl")).alias("file"), F.lit(0).cast("bigint").alias("block"), F.col("pos").cast("bigint").alias("n"))
    read = chatlogs.sessions_of_lines(lines, "1970-01-01", "2100-01-01")
    said = F.array_join(F.transform("conversation", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "\n")
    return read.select(F.col("sessionId").alias("session_id"), F.col("messageCount").cast("bigint").alias("messages"), F.md5(said).alias("digest"), F.col("createdAt").alias("first_at"), F.col("lastUpdatedAt").alias("last_at"))


@query(
    "indexed_logs",
    _MSG + """, s AS (SELECT * FROM m WHERE role IN ('user', 'assistant') AND content <> '' AND pos % 24 BETWEEN 3 AND 20)
SELECT session_id, count(*) AS messages, md5(string_agg(role || ':' || content, e'\\n' ORDER BY pos)) AS digest, '2026-03-01T' || lpad(CAST(max(pos % 24) AS VARCHAR), 2, '0') || ':00:00' AS last_at FROM s GROUP BY session_id""",
)
def indexed_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as entries of an index and a data file each, read again within a window."""
    m = _messages(spark, sf_dir).where("role is not null")
    name = F.concat_ws("-", "session_id", F.col("pos").cast("string"))
    ms = F.unix_millis(F.to_timestamp(F.lit("2026-03-01 00:00:00"))) + (F.col("pos") % 24) * 3_600_000
    suffix = F.when(F.col("role") == "user", "-user").when(F.col("role") == "assistant", "-bot").otherwise("-none")
    coded = F.replace(F.url_encode("content"), F.lit("+"), F.lit("%20"))
    inner = F.to_json(F.struct(coded.alias("content"), F.col("session_id").alias("storeSessionId"), F.col("pos").cast("bigint").alias("id")))
    rows = written(m.select(F.concat(name, suffix).alias("key"), ms.alias("lastAccess"), F.concat(name, F.lit(".json")).alias("fileName"), F.to_json(F.struct(inner.alias("value"))).alias("value")), "entries")
    read = chatlogs.sessions_of_entries(rows.select("key", "lastAccess", "fileName"), rows.select(F.col("fileName").alias("file"), "value"), "2026-03-01 03:00:00", "2026-03-01 20:00:00")
    said = F.array_join(F.transform("conversation", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "\n")
    return read.select(F.col("sessionId").alias("session_id"), F.col("messageCount").cast("bigint").alias("messages"), F.md5(said).alias("digest"), F.col("lastUpdatedAt").alias("last_at"))


@query("batch_roundtrip", _LATEST + " SELECT s.sessionId, k.ide, k.batch_date, k.n_messages, k.name FROM k JOIN sessions s ON s.delivery_id = k.delivery_id WHERE k.ide IN ('cursor', 'qoder') AND k.batch_date >= '2026-02-01'")
def batch_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept sessions written by day, one tool's days written anew, and days of two tools read."""
    path = _folder(spark, "batches")
    fields = [f.strip().split(" ", 1)[0] for f in chatlogs.SESSION.split(", ")]
    kept = _latest(spark, sf_dir).select("ide", "sessionId", "name", "createdAt", "lastUpdatedAt", "status", "workspace", "messageCount", "conversation", "batch_date")
    assert set(fields) <= {*kept.columns}
    chatlogs.write_batches(kept.withColumn("name", F.lit("old")), path)
    chatlogs.write_batches(kept, path)
    read = chatlogs.read_batches(spark, path, None, ["cursor", "qoder"]).where("batch_date >= '2026-02-01'")
    return read.select("sessionId", "ide", F.col("batch_date").cast("string").alias("batch_date"), F.coalesce(F.size(F.coalesce("conversation", F.array().cast("array<struct<role:string,content:string>>"))), F.lit(0)).cast("bigint").alias("n_messages"), "name")


@query("kv_file_scan", "SELECT key, md5(value) AS digest FROM cursor_disk_kv WHERE key LIKE 'composerData:%'")
def kv_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key-value rows written to SQLite files, one a task, and scanned by prefix. The shared folder has to be a mounted one."""
    folder = _mounted(spark, "kv")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        path = f"{folder}/{uuid.uuid4().hex}.db"
        with sqlite3.connect(path) as con:
            con.execute("CREATE TABLE cursorDiskKV (key TEXT, value BLOB)")
            for b in batches:
                con.executemany("INSERT INTO cursorDiskKV VALUES (?, ?)", zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        con.close()
        yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

    paths = written(table(spark, sf_dir, "cursor_disk_kv").select("key", "value").mapInArrow(write, "path string"), "kv-files")
    spark.dataSource.register(chatlogs.KvSource)
    names = sorted(r[0] for r in paths.collect())  # one a task
    rows = spark.read.format("kvfile").option("prefix", "composerData:").load(",".join(names))
    return rows.select("key", F.md5("value").alias("digest"))


def _files(rows: DataFrame, folder: str) -> None:
    """Rows of ``name, text`` written as a file each below a mounted folder."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                path = f"{folder}/{name}"
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(f"{path}.part-{uuid.uuid4().hex}", "w", encoding="utf-8", newline="") as f:
                    f.write(content)
                os.replace(f.name, path)  # a task that runs again writes the same
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    rows.select("name", "text").mapInArrow(write, "n bigint").agg(F.sum("n")).collect()


def _mounted(spark: SparkSession, name: str) -> str:
    return _folder(spark, name).removeprefix("file://").removeprefix("file:")


@query("note_files", f"SELECT id, scope, value, source, title, len(tags) AS n_tags, CAST(row_number() OVER (PARTITION BY scope ORDER BY id) AS INT) AS place FROM (SELECT id, scope, value, source, coalesce(trim(regexp_extract(coalesce(body, ''), '(?m)^[ \\t]*#+[ \\t]*([^#\\s][^\\n\\r]*)$', 1)), '') AS title, coalesce(tags, []) AS tags FROM ({_NOTE}) WHERE scope IS NOT NULL)")
def note_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All notes as markdown files, compiled overviews among them that don't count, scanned again in the order of their paths."""
    folder = _mounted(spark, "notes")
    own = _notes(spark, sf_dir)
    texts = markdown.as_texts(own.where("scope is not null"))
    scope = own.select("id", "scope")
    named = texts.join(scope, "id").select("id", "scope", "text")
    made = named.select(F.concat_ws("/", "scope", F.concat("id", F.lit(".md"))).alias("name"), "text")
    _files(made.unionByName(named.where("scope = 'project'").select(F.concat(F.lit("project/_compiled/"), "id", F.lit(".md")).alias("name"), "text")), folder)
    rows = markdown.read_notes(spark, f"file://{folder}").select("id", "scope", "value", "source", "title", F.size("tags").cast("bigint").alias("n_tags"), "file_path")
    return numbered(rows, "scope", [F.col("file_path")], "place").drop("file_path")


@query("task_files", "SELECT task_id, status, coalesce(nullif(batch_date, ''), '0000-00-00') AS day, md5(prompt) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY mtime DESC NULLS LAST, status NULLS LAST) AS one_n FROM tasks WHERE task_id IS NOT NULL) WHERE one_n = 1 AND status IN ('pending', 'in_progress', 'failed')")
def task_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tasks as files whose suffix tells their state, unreadable ones among them, scanned again."""
    folder = _mounted(spark, "tasks")
    own = tasks.one_of_each(table(spark, sf_dir, "tasks")).where("status in ('pending', 'in_progress', 'failed')")
    body = F.to_json(F.struct("task_id", "batch_date", "created_at", "prompt"))
    suffix = F.concat(F.lit(".task"), F.when(F.col("status") == "pending", "").otherwise(F.concat(F.lit("."), "status")))
    rows = own.select(F.concat("task_id", suffix).alias("name"), body.alias("text"))
    _files(rows.unionByName(spark.createDataFrame([("x.task", "{broken"), ("y.tmp", "{}")], "name string, text string")), folder)
    return tasks.read_files(spark, f"file://{folder}").select("task_id", "status", tasks.day().alias("day"), F.md5("prompt").alias("digest"))


_EVENTS = "SELECT ts, event, query, coalesce(len(list_filter(hits, x -> x IS NOT NULL)), 0) AS n_hits, id, path FROM recall_events WHERE event IS NOT NULL"


@query("event_log", _EVENTS.replace("x -> x IS NOT NULL", "lambda x: x IS NOT NULL"))
def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feedback events appended to a log by day, in two goes, and read again."""
    path, rows = _folder(spark, "events"), table(spark, sf_dir, "recall_events")
    chatlogs.append_events(rows.where("event = 'search'"), path)
    chatlogs.append_events(rows.where("event <> 'search'"), path)
    hits = F.filter("hits", lambda x: x.isNotNull())
    return chatlogs.read_events(spark, path).select("ts", "event", "query", F.coalesce(F.size(hits), F.lit(0)).cast("bigint").alias("n_hits"), "id", "path")


@query("workspace_names", _LATEST + " SELECT session_id, CASE WHEN len(string_split(workspace, '/')) > 3 THEN array_to_string(string_split(workspace, '/')[1:4], '/') ELSE '' END AS workspace FROM k")
def workspace_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, sf_dir).select("session_id", chatlogs.workspace_of(F.col("workspace")).alias("workspace"))


@query(
    "fuzzy_bubbles",
    """WITH l AS (SELECT key, arg_max(value, snapshot_at) AS value FROM cursor_disk_kv WHERE key IS NOT NULL GROUP BY key),
h AS (SELECT DISTINCT substring(key, 14) AS session_id, unnest(from_json(json_extract(value, '$.fullConversationHeadersOnly'), '[{"bubbleId":"VARCHAR"}]')).bubbleId AS bubble_id FROM l WHERE key LIKE 'composerData:%' AND json_valid(value) AND json_type(json_extract(CASE WHEN json_valid(value) THEN value END, '$.fullConversationHeadersOnly')) = 'ARRAY'),
m AS (SELECT * FROM h WHERE bubble_id <> '' AND 'bubbleId:' || session_id || ':' || bubble_id NOT IN (SELECT key FROM l WHERE value IS NOT NULL))
SELECT session_id, bubble_id, min(c.key) AS key FROM m JOIN (SELECT key FROM l WHERE key LIKE 'composer.content.%' AND value IS NOT NULL) c ON contains(substring(c.key, 18), m.bubble_id) GROUP BY 1, 2""",
)
def fuzzy_bubbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chatlogs.fuzzy_contents(table(spark, sf_dir, "cursor_disk_kv"))


# --- streams ----------------------------------------------------------------------------------------------------------


@query(
    "recalls_stream",
    f"""WITH e AS (SELECT * FROM ({_recent(100_000)}) WHERE seen_at IS NOT NULL)
SELECT CAST(date_trunc('day', seen_at) AS TIMESTAMP) AS day, id, CAST(sum(w) AS BIGINT) AS recalls FROM (
 SELECT seen_at, unnest(hits) AS id, 1 AS w FROM e WHERE event = 'search' UNION ALL SELECT seen_at, id, 2 FROM e WHERE event = 'read') WHERE id <> '' GROUP BY 1, 2""",
)
def recalls_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files, counted by day; all of them in one batch, so none is late."""
    source, out, cp = (_folder(spark, x) for x in ("in", "out", "cp"))
    table(spark, sf_dir, "recall_events").write.json(source)
    stream = feedback.recalls(feedback.event_stream(spark, source, files=1_000_000))
    stream.writeStream.outputMode("complete").foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(out)).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "id", "recalls")


@query("latest_stream", SQL["p5_sessions"].replace(", status, batch_date, n_messages", ", batch_date"))
def latest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deliveries as a stream of files, merged batch by batch into the store of the latest ones."""
    source, store, cp = (_folder(spark, x) for x in ("in", "store", "cp"))
    rows = table(spark, sf_dir, "sessions").select("delivery_id", "batch_date", "sessionId", "createdAt", "lastUpdatedAt")
    rows.repartitionByRange(3, "batch_date").write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    feedback.keep_latest(stream, store, cp).awaitTermination()
    return feedback.current(spark, store).select("session_id", "delivery_id", "batch_date")


@query("once_stream", _KEYED + "SELECT DISTINCT session_id FROM r WHERE coalesce(u, c) IS NOT NULL")
def once_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sessions come through a stream that lets each pass once."""
    source, out, cp = (_folder(spark, x) for x in ("in", "out", "cp"))
    rows = table(spark, sf_dir, "sessions").select("delivery_id", "sessionId", F.coalesce(instant(F.col("lastUpdatedAt")), instant(F.col("createdAt"))).alias("at")).where("at is not null")
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1_000_000).parquet(source)
    feedback.once(stream).select("session_id").writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("session_id string").parquet(out)


# --- tasks ------------------------------------------------------------------------------------------------------------

_ONE_TASK = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY mtime DESC NULLS LAST, status NULLS LAST) AS one_n FROM tasks WHERE task_id IS NOT NULL) WHERE one_n = 1"""


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.one_of_each(table(spark, sf_dir, "tasks"))


@query(
    "task_states",
    f"""WITH t AS ({_ONE_TASK}), n AS (SELECT task_id FROM t WHERE status = 'pending' ORDER BY coalesce(nullif(batch_date, ''), '0000-00-00'), mtime NULLS LAST, task_id LIMIT 20),
a AS (SELECT task_id, CASE WHEN task_id IN (SELECT task_id FROM n) THEN 'in_progress' ELSE status END AS status, mtime FROM t),
b AS (SELECT * FROM a WHERE NOT (coalesce(status, '') = 'in_progress' AND task_id LIKE '%7')),
c AS (SELECT task_id, CASE WHEN status = 'in_progress' AND task_id LIKE '%3' THEN 'failed' ELSE status END AS status, mtime FROM b),
d AS (SELECT task_id, CASE WHEN status = 'in_progress' THEN 'pending' ELSE status END AS status, mtime FROM c)
SELECT task_id, status FROM d WHERE mtime IS NULL OR mtime >= epoch(TIMESTAMP '2026-03-01')""",
)
def task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty tasks taken, some submitted, some failed, the rest reset, old ones cleaned up."""
    now = tasks.taken(_tasks(spark, sf_dir), 20)
    now = tasks.submitted(now, now.where("task_id like '%7'"))
    now = tasks.reset(tasks.failed(now, now.where("task_id like '%3'")))
    return tasks.cleaned(now, "2026-03-08 00:00:00", 7).select("task_id", "status")


@query(
    "task_order",
    f"""WITH t AS ({_ONE_TASK}) SELECT task_id, status, CAST(row_number() OVER (PARTITION BY status ORDER BY coalesce(nullif(batch_date, ''), '0000-00-00'), coalesce(created_at, ''), task_id) AS INT) AS listed,
 CAST(row_number() OVER (PARTITION BY status ORDER BY coalesce(nullif(batch_date, ''), '0000-00-00'), mtime NULLS LAST, task_id) AS INT) AS taken FROM t""",
)
def task_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every task's place in the list of its state and in the order in which tasks are taken."""
    rows = _tasks(spark, sf_dir).select("task_id", "status", "mtime", tasks.day().alias("day"), F.coalesce("created_at", F.lit("")).alias("made"))
    listed = numbered(rows, "status", [F.col("day"), F.col("made"), F.col("task_id")], "listed").select("task_id", "status", "listed")
    taken = numbered(rows, "status", [F.col("day"), F.col("mtime").asc_nulls_last(), F.col("task_id")], "taken").select("task_id", "taken")
    return listed.join(taken, "task_id")


@query("tasks_added", f"WITH t AS ({_ONE_TASK}) SELECT task_id, status FROM t WHERE status <> 'failed' OR status IS NULL UNION ALL SELECT task_id, 'pending' FROM t WHERE status = 'failed' UNION ALL SELECT task_id || '-again', 'pending' FROM t WHERE status = 'failed'")
def tasks_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed tasks written again, and once more under new ids."""
    own = _tasks(spark, sf_dir)
    bad = own.where("status = 'failed'")
    return tasks.added(own, bad.unionByName(bad.withColumn("task_id", F.concat("task_id", F.lit("-again")))), 1.8e9).select("task_id", "status")


# --- search and notes -------------------------------------------------------------------------------------------------


@query(
    "grep_recall",
    f"""WITH c AS ({_COUNTS}), n AS (SELECT m.*, c.recalls, CASE WHEN scope = 'project' THEN coalesce(project_key, '') ELSE 'personal' END AS own, CAST((length(lower(body)) - length(replace(lower(body), 'cache', ''))) / 5 AS INT) AS hits,
  {_WORDS.format(_TITLE)} AS tw FROM ({_NOTE}) m LEFT JOIN c ON c.id = m.id WHERE NOT coalesce(archived, false) AND contains(lower(body), 'cache')),
s AS (SELECT id, own AS scope, round(hits * CASE value WHEN 'high' THEN 1.5 WHEN 'low' THEN 0.5 ELSE 1.0 END * CASE source WHEN 'manual' THEN 1.3 WHEN 'edited' THEN 1.2 ELSE 1.0 END
  * CASE WHEN len(potentially_superseded_by) > 0 THEN 0.6 ELSE 1.0 END * CASE WHEN own <> 'personal' AND own <> '{_PROJECT}' THEN 0.7 ELSE 1.0 END * {_AGED}, 2) AS score
 FROM n WHERE own IN ('personal', '{_PROJECT}') OR len(list_intersect(list_distinct(list_transform(coalesce(tags, []), lambda t: lower(t))), ['cache'])) >= 2 OR (len(tw) > 0 AND len(list_intersect(tw, ['cache'])) / (len(tw) + 1 - len(list_intersect(tw, ['cache']))) > 0.30))
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY scope ORDER BY score DESC, id) <= 200""",
)
def grep_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.fallback(table(spark, sf_dir, "memories"), table(spark, sf_dir, "recall_events"), "cache", _PROJECT, AS_OF).select("id", "scope", "score")


@query("whole_file_recall")
def whole_file_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores over notes as whole files, heads included; no SQL, since a head is YAML."""
    live = recall.live_notes(table(spark, sf_dir, "memories"))
    files = markdown.as_texts(live.drop("own")).join(live.select("id", "own"), "id")
    scored = bm25.scores(files, NOTE_QUERY, "own", "id", "text")
    return bm25.candidates(scored).select("scope", "key", F.round("bm25", 4).alias("bm25"), "rank")


@query("top_reads", f"SELECT id, count(*) AS n FROM ({_recent(90)}) WHERE event = 'read' AND id <> '' GROUP BY id ORDER BY n DESC, id LIMIT 10")
def top_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.top_reads(table(spark, sf_dir, "recall_events"), AS_OF, 90)


_LINES = "string_split_regex(coalesce(text, ''), '\\r\\n|[\\n\\x0b\\f\\r\\x{85}\\x{2028}\\x{2029}]')"


@query("head_snippets", f"WITH l AS (SELECT doc_id, {_LINES} AS l FROM documents) SELECT doc_id, md5(array_to_string(list_slice(list_filter(l, lambda x: {_stripped('x')} <> ''), 1, 6), e'\\n')) AS digest, CAST(greatest(coalesce(list_position(list_transform(l, lambda x: {_stripped('x')} <> ''), true), 0), 1) AS INT) AS line FROM l")
def head_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = text.head(F.col("text"), 6)
    return _documents(spark, sf_dir).select("doc_id", head.alias("h")).select("doc_id", F.md5("h.snippet").alias("digest"), "h.line")


@query("date_spans", f"SELECT project_key, coalesce(min(nullif(created, '')) || ' ~ ' || max(nullif(created, '')), 'unknown') AS span FROM ({_NOTE}) WHERE scope = 'project' AND NOT coalesce(archived, false) GROUP BY project_key")
def date_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.spans(_notes(spark, sf_dir))


@query("near_empty", "SELECT 'memories' AS store, (SELECT count(*) FROM memories WHERE NOT coalesce(archived, false)) < 5 AS near_empty UNION ALL SELECT 'one', true")
def near_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "memories")
    one = rows.where("not coalesce(archived, false)").limit(1)
    return spark.createDataFrame([("memories", notes.near_empty(rows)), ("one", notes.near_empty(one))], "store string, near_empty boolean")


_CUT = "created >= '2026-04-01'"


@query(
    "incremental_marks",
    _CONFLICTS + f""", f AS (SELECT id, coalesce({_CUT}, false) AS fresh, potential_conflicts AS pc, potentially_superseded_by AS sb FROM ({_NOTE})),
e AS (SELECT c.id, c.other, a.fresh FROM c JOIN f a ON a.id = c.id JOIN f b ON b.id = c.other WHERE a.fresh <> b.fresh),
g AS (SELECT id, list_sort(list(other)) AS others FROM e GROUP BY id)
SELECT f.id, CASE WHEN fresh THEN coalesce(array_to_string(g.others, ' '), '') ELSE coalesce(array_to_string(pc, ' '), '') END AS potential_conflicts,
 CASE WHEN NOT fresh AND g.others IS NOT NULL THEN array_to_string(list_concat(coalesce(list_distinct_in_order, []), list_filter(g.others, lambda x: NOT list_contains(coalesce(sb, []), x))), ' ') ELSE coalesce(array_to_string(sb, ' '), '') END AS superseded_by
FROM (SELECT *, sb AS list_distinct_in_order FROM f) f LEFT JOIN g ON g.id = f.id""",
)
def incremental_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes of the last months taken into a store of the older ones."""
    read = _notes(spark, sf_dir).select("id", "scope", "project_key", "title", "tags", "created", "archived", "potential_conflicts", "potentially_superseded_by")
    own = written(read.withColumn("fresh", F.coalesce(F.expr(_CUT), F.lit(False))), "store")
    out = notes.marked(own.where("not fresh").drop("fresh"), own.where("fresh").drop("fresh"))
    joined = lambda c: F.coalesce(F.array_join(c, " "), F.lit(""))
    return out.select("id", joined("potential_conflicts").alias("potential_conflicts"), joined("potentially_superseded_by").alias("superseded_by"))


_OVERVIEWS = f"""SELECT project_key, quantile_disc(file_mtime, 0.5) AS compiled_at, length(project_key) % 5 = 0 AS edited, CASE WHEN length(project_key) % 3 = 0 THEN '  ' ELSE repeat(project_key || ' overview. ', 40 * (length(project_key) % 7)) END AS text
 FROM ({_NOTE}) WHERE scope = 'project' AND project_key IS NOT NULL AND file_mtime IS NOT NULL AND length(project_key) % 4 > 0 GROUP BY project_key"""


def _overviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overviews made up from the notes: some projects have none, some were edited, some are blank or long."""
    n = F.length("project_key")
    rows = _notes(spark, sf_dir).where("scope = 'project' and project_key is not null and file_mtime is not null").where(n % 4 > 0)
    each = rows.groupBy("project_key").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY file_mtime)").alias("compiled_at"))
    body = F.when(n % 3 == 0, "  ").otherwise(F.expr("repeat(concat(project_key, ' overview. '), 40 * (length(project_key) % 7))"))
    return each.select("project_key", "compiled_at", (n % 5 == 0).alias("edited"), body.alias("text"))


@query(
    "stale_projects",
    f"""WITH o AS ({_OVERVIEWS}), l AS (SELECT project_key, max(file_mtime) AS last FROM ({_NOTE}) WHERE scope = 'project' AND NOT coalesce(archived, false) AND project_key IS NOT NULL GROUP BY project_key)
SELECT project_key FROM l LEFT JOIN o USING (project_key) WHERE NOT coalesce(edited, false) AND (compiled_at IS NULL OR last > compiled_at)""",
)
def stale_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.stale(_notes(spark, sf_dir), _overviews(spark, sf_dir))


@query(
    "project_contexts",
    SQL["project_summaries"].replace("WITH n AS", f"WITH o AS ({_OVERVIEWS}), n AS", 1).replace("SELECT project_key, CASE WHEN length(t) > 4096", "SELECT project_key, md5(CASE WHEN length(t) > 4096").replace("ELSE t END AS summary FROM t", f"ELSE t END) AS digest FROM t WHERE project_key NOT IN (SELECT project_key FROM o WHERE {_stripped('text')} <> '')")
    + f" UNION ALL SELECT project_key, md5(CASE WHEN length(x) > 4096 THEN left(x, 4076) || e'\\n\\n... (truncated)' ELSE x END) FROM (SELECT project_key, '# ' || project_key || e'\\n\\n' || {_stripped('text')} AS x FROM o WHERE {_stripped('text')} <> '')",
)
def project_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.contexts(_notes(spark, sf_dir), _overviews(spark, sf_dir)).select("project_key", F.md5("summary").alias("digest"))


@query("dated_upsert", f"WITH n AS ({_NOTE}) SELECT id, source, CASE WHEN source IN ('manual', 'edited') OR value <> 'high' OR value IS NULL THEN updated ELSE '2026-07-01' END AS updated, CASE WHEN source IN ('manual', 'edited') OR value <> 'high' OR value IS NULL THEN created ELSE coalesce(created, '2026-07-01') END AS created FROM n UNION ALL SELECT id || '-new', source, '2026-07-01', coalesce(nullif(created, ''), '2026-07-01') FROM n WHERE value = 'low'")
def dated_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _notes(spark, sf_dir).select("id", "source", "value", "created", "updated")
    new = own.where("value = 'high'").withColumn("created", F.lit(None).cast("string")).unionByName(own.where("value = 'low'").withColumn("id", F.concat("id", F.lit("-new"))))
    return notes.upsert(own, new, "2026-07-01").select("id", "source", "created", "updated")


@query("session_order", _LATEST + ", s AS (SELECT k.ide, k.session_id, k.createdAt FROM k) SELECT session_id, CAST(row_number() OVER (PARTITION BY ide ORDER BY createdAt NULLS FIRST, session_id) AS INT) AS place FROM s")
def session_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's place among those of its tool, by the text of its creation time."""
    rows = _latest(spark, sf_dir).select("ide", "session_id", "createdAt")
    return numbered(rows, "ide", [F.col("createdAt").asc_nulls_first(), F.col("session_id")], "place").select("session_id", "place")


# --- models, texts, settings ------------------------------------------------------------------------------------------


def _sizes(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), float(t.count("a"))] for t in texts]


@query("vector_cache", f"SELECT DISTINCT sha256(body) AS digest, CAST(length(body) AS FLOAT) AS chars, CAST(length(body) - length(replace(body, 'a', '')) AS FLOAT) AS letters FROM ({_NOTE}) WHERE body IS NOT NULL")
def vector_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all notes, those of project notes made first and kept; the model counts letters."""
    own = _notes(spark, sf_dir).select("scope", "body")
    stored = written(topics.embed(own.where("scope = 'project'"), "body", _sizes), "vectors")
    return topics.embed(own, "body", _sizes, stored).select("digest", F.col("vector")[0].alias("chars"), F.col("vector")[1].alias("letters"))


@query("model_answers", "SELECT task_id, CASE WHEN prompt IS NULL THEN NULL WHEN length(prompt) // 4 <= 28000 THEN CAST(length(prompt) AS VARCHAR) END AS answer, coalesce(length(prompt) // 4 <= 28000, true) AS fits FROM (SELECT task_id, any_value(prompt) AS prompt FROM tasks WHERE task_id IS NOT NULL GROUP BY task_id)")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts within the budget answered by a model that counts characters."""
    rows = table(spark, sf_dir, "tasks").where("task_id is not null").groupBy("task_id").agg(F.any_value("prompt").alias("prompt"))
    fits = F.coalesce(topics.fits(F.col("prompt")), F.lit(True))
    asked = rows.select("task_id", F.when(fits, F.col("prompt")).alias("prompt"), fits.alias("fits"))
    return topics.apply_model(asked, "prompt", lambda batch: [str(len(t)) for t in batch]).select("task_id", "answer", "fits")


@query("unfenced_answers", f"SELECT id, 'topics:' || e'\\n- ' || coalesce(title, '') || e'\\n  x' AS answer FROM ({_NOTE})")
def unfenced_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _notes(spark, sf_dir)
    said = F.concat(F.lit("\n```yaml\nHere you are.\ntopics:\n- "), F.coalesce("title", F.lit("")), F.lit("\n  x\n```\n"))
    return own.select("id", topics.unfenced(said).alias("answer"))


_TEMPLATE = "[{ide}] {workspace}: {session_id} in {project_key}"


@query("rendered_prompts", _LATEST + " SELECT session_id, '[' || coalesce(nullif(ide, ''), '?') || '] ' || coalesce(nullif(workspace, ''), '(unknown)') || ': ' || session_id || ' in null' AS prompt FROM k")
def rendered_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {"workspace": text.or_else(F.col("workspace"), F.lit("(unknown)")), "ide": text.or_else(F.col("ide"), F.lit("?")), "session_id": F.col("session_id"), "project_key": F.lit("null")}
    return _latest(spark, sf_dir).select("session_id", text.rendered(_TEMPLATE, values).alias("prompt"))


@query("contained_paths", f"SELECT id, way, CASE way WHEN 'plain' THEN file_path IS NOT NULL WHEN 'dots' THEN file_path IS NOT NULL ELSE false END AS inside FROM ({_NOTE}), (SELECT unnest(['plain', 'dots', 'out', 'prefix']) AS way)")
def contained_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files below a root, by paths that wind, climb out of it, or only begin alike."""
    own = _notes(spark, sf_dir)
    ways = {"plain": "/root/m/", "dots": "/root/./x/../m//", "out": "/root/m/../../", "prefix": "/root/mm/"}
    name = F.regexp_replace("file_path", r"^/+", "")
    each = own.select("id", F.explode(F.array(*(F.struct(F.lit(k).alias("way"), F.concat(F.lit(v), name).alias("path")) for k, v in ways.items()))).alias("x"))
    return each.select("id", "x.way", text.inside(F.col("x.path"), "/root/m").alias("inside"))


@query("han_slugs", f"SELECT id, left(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_stripped('lower(title)')}, '[^A-Za-z0-9_\\x{{4e00}}-\\x{{9fff}}\\s\\-]', '', 'g'), '\\s+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g'), 50) AS slug FROM ({_NOTE})")
def han_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _notes(spark, sf_dir).select("id", text.han_slug(F.col("title")).alias("slug"))


@query("layered_settings", f"WITH s AS (SELECT CASE source WHEN 'manual' THEN 2 WHEN 'edited' THEN 1 ELSE 0 END AS layer, coalesce(project_key, '') AS key, value FROM ({_NOTE})) SELECT key, value FROM s WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY layer DESC, value) = 1")
def layered_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings in rows, here the notes' values by project, people's own before all others."""
    own = _notes(spark, sf_dir)
    layer = F.when(F.col("source") == "manual", 2).when(F.col("source") == "edited", 1).otherwise(0)
    return config.settings(own.select(layer.alias("layer"), F.coalesce("project_key", F.lit("")).alias("key"), "value"))


@query(
    "scope_modes",
    f"""WITH n AS ({_NOTE}), c AS (SELECT count(*) AS every, count(*) FILTER (scope <> 'project') AS own, count(*) FILTER (scope = 'project' AND project_key = '{_PROJECT}') AS one FROM n)
SELECT unnest(['auto', 'auto', 'all', 'all', 'current_project', 'current_project', 'personal', 'personal', 'general', 'general', 'odd', 'odd']) AS mode, unnest([true, false, true, false, true, false, true, false, true, false, true, false]) AS known,
 unnest([every, own, every, every, one, 0, own, own, own, own, every, own]) AS n FROM c""",
)
def scope_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many notes each mode looks at, with a project and without one."""
    own = written(_notes(spark, sf_dir).select("id", "scope", "project_key"), "scopes")
    out = None
    for mode in ("auto", "all", "current_project", "personal", "general", "odd"):
        for project in (_PROJECT, None):
            one = notes.scopes(own, mode, project).agg(F.count("*").alias("n")).select(F.lit(mode).alias("mode"), F.lit(project is not None).alias("known"), "n")
            out = one if out is None else out.unionByName(one)
    return out


@query("p5_new", _KEYED + "SELECT session_id, delivery_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY delivery_id) AS first FROM r WHERE batch_date >= '2026-04-01') WHERE first = 1 AND session_id NOT IN (SELECT session_id FROM r WHERE batch_date < '2026-04-01' OR batch_date IS NULL)")
def p5_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions that the batches from April on bring for the first time; the first delivery of each counts."""
    rows = table(spark, sf_dir, "sessions").withColumn("session_id", delivery.normal_id(F.col("sessionId"))).select("session_id", "delivery_id", "batch_date")
    late = F.coalesce(F.col("batch_date") >= "2026-04-01", F.lit(False))
    return delivery.new_only(rows.where(late), rows.where(~late), "session_id", [F.col("delivery_id")]).select("session_id", "delivery_id")
