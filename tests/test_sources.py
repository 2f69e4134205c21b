import json
import sqlite3

import pytest

from lorekeep.sources import chatlogs, markdown
from lorekeep.streaming import feedback


def test_sqlite_rows(spark, tmp_path):
    path = tmp_path / "kv.db"
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE cursorDiskKV (key TEXT, value BLOB)")
        con.executemany("INSERT INTO cursorDiskKV VALUES (?, ?)", [(f"composerData:{i}", b"{}") for i in range(250)] + [("other", None)])
    spark.dataSource.register(chatlogs.KvSource)
    df = spark.read.format("kvfile").option("prefix", "composerData:").option("rows", "100").load(str(path))
    assert df.count() == 250 and df.rdd.getNumPartitions() == 3
    assert spark.read.format("kvfile").load(str(path)).where("value is null").count() == 1


def test_jsonl_sessions(spark, tmp_path):
    own = tmp_path / "-home-me-app"
    (own / "subagents").mkdir(parents=True)
    lines = [
        {"type": "summary", "timestamp": "2026-01-01T00:00:00Z"},
        {"type": "user", "timestamp": "2026-01-02T00:00:00Z", "message": {"role": "user", "content": "first question"}},
        {"type": "user", "isMeta": True, "message": {"content": "meta"}},
        {"type": "user", "message": {"content": [{"type": "tool_result"}]}},
        {"type": "assistant", "timestamp": "2026-01-03T00:00:00Z", "message": {"content": [{"type": "text", "text": "an"}, {"type": "tool_use"}, {"type": "text", "text": "swer"}]}},
        {"type": "assistant", "isSidechain": True, "message": {"content": "side"}},
    ]
    text = "\n".join(map(json.dumps, lines)) + "\n{broken\n"
    (own / "s1.jsonl").write_text(text)
    (own / "subagents" / "s2.jsonl").write_text(text)
    got = chatlogs.jsonl_sessions(spark, str(tmp_path), "2026-01-02 12:00:00", "2026-01-02 13:00:00").collect()
    assert len(got) == 1
    r = got[0]
    assert (r["sessionId"], r["workspace"], r["createdAt"], r["name"]) == ("s1", "/home/me/app", "2026-01-01T00:00:00", "first question")
    assert [(m["role"], m["content"]) for m in r["conversation"]] == [("user", "first question"), ("assistant", "an\nswer")]
    assert chatlogs.jsonl_sessions(spark, str(tmp_path), "2027-01-01", "2027-01-02").count() == 0


def test_texts_that_begin_with_a_bracket(spark, tmp_path):
    own = tmp_path / "app"
    own.mkdir()
    say = lambda role, content: {"type": role, "timestamp": "2026-01-02T00:00:00Z", "message": {"role": role, "content": content}}
    lines = [say("user", "[Image] fix this bug please"), say("assistant", "[done] see above"), say("user", "[]"), say("user", []), say("user", [{"type": "text", "text": "no"}]), say("assistant", [{"type": "text", "text": "[x]"}]), say("user", '[{"type": "text", "text": "quoted"}]')]
    (own / "s.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = chatlogs.jsonl_sessions(spark, str(tmp_path), "2026-01-01", "2026-01-03").first()
    assert [(m["role"], m["content"]) for m in got["conversation"]] == [("user", "[Image] fix this bug please"), ("assistant", "[done] see above"), ("user", "[]"), ("assistant", "[x]"), ("user", '[{"type": "text", "text": "quoted"}]')]


def test_only_tools_with_a_reader(spark):
    one = spark.createDataFrame([("a",)], "ide string")
    with pytest.warns(UserWarning, match="vim"):
        got = chatlogs.collected(["cursor", "vim"], {"cursor": lambda: one, "qoder": lambda: one})
    assert got.count() == 1
    with pytest.warns(UserWarning):
        assert chatlogs.collected(["vim"], {}) is None


def test_needles_in_texts(spark):
    needles = ["a", "abc", "12345678", "12345678-tail", "", None, "zz"]
    texts = ["xabcx", "12345678-tail-0", "12345678", "b", None, ""]
    left = spark.createDataFrame([(n,) for n in needles], "needle string")
    right = spark.createDataFrame([(t,) for t in texts], "hay string")
    got = {(r["needle"], r["hay"]) for r in chatlogs.contained(left, "needle", right, "hay").collect()}
    assert got == {(n, t) for n in needles for t in texts if n and t and n in t}


def test_indexed_sessions(spark, tmp_path):
    (tmp_path / "data").mkdir()
    entries = {}
    for i, (suffix, content) in enumerate([("-user", "hi%20there+x"), ("-bot", "ok"), ("-none", "no")]):
        (tmp_path / "data" / f"{i}.json").write_text(json.dumps({"value": json.dumps({"content": content, "storeSessionId": "s", "id": i})}))
        entries[f"k{i}{suffix}"] = {"lastAccess": 1767225600000 + i, "fileName": f"{i}.json"}
    (tmp_path / "index.json").write_text(json.dumps({"entries": entries}))
    got = chatlogs.indexed_sessions(spark, str(tmp_path / "index.json"), str(tmp_path / "data"), "2025-12-31", "2026-01-02").collect()
    assert [[tuple(m) for m in r["conversation"]] for r in got] == [[("user", "hi there+x"), ("assistant", "ok")]]


def test_batches_replace_days(spark, tmp_path):
    path = str(tmp_path / "b")
    schema = chatlogs.SESSION + ", batch_date string"
    row = lambda day, name: ("cursor", name, None, None, None, None, None, 1, [("user", "x")], day)
    chatlogs.write_batches(spark.createDataFrame([row("2026-01-01", "a"), row("2026-01-02", "b")], schema), path)
    chatlogs.write_batches(spark.createDataFrame([row("2026-01-02", "c")], schema), path)
    assert sorted(r["sessionId"] for r in chatlogs.read_batches(spark, path).collect()) == ["a", "c"]
    assert chatlogs.read_batches(spark, path, ["2026-01-01"], ["cursor"]).count() == 1


def test_markdown_notes(spark, tmp_path):
    row = {"id": "1e5", "scope": "project", "project_key": "h/a", "source": "auto", "value": "high", "created": "2026-01-01", "updated": None, "tags": ["a: b", "null", "1"], "origin": {"ide": "x", "session_id": "s\\\"q", "workspace": None, "msg_range": [0, 3], "distilled_at": None, "remembered_at": None}, "potential_conflicts": [], "potentially_superseded_by": ["o"], "archived": True, "extra": {"note": "yes: no"}, "_mtime_at_write": 5.25, "body": "# T\n\ntext\n"}
    text = markdown.text_of(row)
    back = markdown.note(text)
    assert markdown.text_of(back) == text
    for k in ("id", "tags", "origin", "archived", "body", "_mtime_at_write", "potentially_superseded_by"):
        assert back[k] == row[k], k
    assert back["extra"] == {"note": "yes: no"} and back["title"] == "T"
    assert markdown.split("---\r\nid: x\r\n---\r\n") == ({}, "---\r\nid: x\r\n---\r\n")
    assert markdown.note("no head") is None and markdown.note("---\nid: a\n---\n") is None and markdown.note("---\n: [\n---\nx") is None
    (tmp_path / "_compiled").mkdir()
    (tmp_path / "a.md").write_text(text)
    (tmp_path / "_compiled" / "overview.md").write_text(text)
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe")
    got = markdown.read_notes(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0]["origin"]["msg_range"] == [0, 3] and got[0]["file_mtime"] > 0


def test_event_log(spark, tmp_path):
    path = str(tmp_path / "log")
    schema = "ts string, event string, query string, hits array<string>, id string, path string"
    events = [("2026-01-01T10:00:00", "search", "q", ["a", "b"], None, None), ("2026-01-01T11:00:00", "read", None, None, "a", None)]
    chatlogs.append_events(spark.createDataFrame(events, schema), path)
    (tmp_path / "log" / "date=2026-01-01" / "x.json").write_text('{"ts": "2026-01-05T00:00:00", "event": "search", "hits": ["z"]}\n{broken\n')
    assert chatlogs.read_events(spark, path).count() == 3
    stream = feedback.recalls(feedback.event_stream(spark, path + "/*"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("recalls").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    assert {(r["id"], r["recalls"]) for r in spark.table("recalls").collect()} == {("a", 3), ("b", 1), ("z", 1)}


def test_streamed_deliveries(spark, tmp_path):
    schema = "delivery_id bigint, sessionId string, createdAt string, lastUpdatedAt string"
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    for n, data in enumerate([[(1, "a", "2026-01-01", "2026-01-02")], [(2, "A", "2026-01-01", "2026-01-03"), (3, "b", None, None)]]):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").json(source)
        feedback.keep_latest(spark.readStream.schema(schema).json(source), store, str(tmp_path / "cp")).awaitTermination(120)
        got = {r["session_id"]: r["delivery_id"] for r in feedback.current(spark, store).collect()}
    assert got == {"a": 2, "b": 3}


def test_a_damaged_store_fails_and_a_lost_batch_is_ignored(spark, tmp_path):
    import shutil

    schema = "delivery_id bigint, sessionId string, createdAt string, lastUpdatedAt string"
    source, store, cp = str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "cp")
    assert feedback.current(spark, store) is None

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
        feedback.keep_latest(spark.readStream.schema(schema).json(source), store, cp).awaitTermination(120)

    feed([(i, f"s{i}", "2026-01-01", None) for i in range(20)])
    (tmp_path / "store" / "pointers" / "7").mkdir()  # of a batch that was lost before it ended
    assert feedback.current(spark, store).count() == 20
    shutil.rmtree(tmp_path / "store" / "batch-0")
    with pytest.raises(Exception, match="(?i)path|exist"):
        feed([(100, "s3", "2026-01-02", None)])
