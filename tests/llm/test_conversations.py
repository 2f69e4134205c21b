import json
import random
from datetime import datetime

from pyspark.sql import functions as F

from lorekeep.llm import conversations as C

KV = "key string, value string, snapshot_at timestamp"
T0, T1 = datetime(2026, 1, 1), datetime(2026, 1, 2)


def composer(sid, headers=None, mapped=None):
    return (f"composerData:{sid}", json.dumps({"conversationMap": mapped or {}, "fullConversationHeadersOnly": headers or []}), T0)


def bubble(sid, b, text, kind=None, at=T0):
    return (f"bubbleId:{sid}:{b}", json.dumps({"text": text} | ({"type": kind} if kind else {})), at)


def run(spark, rows):
    return sorted(tuple(r) for r in C.rebuild(spark.createDataFrame(rows, KV)).collect())


def test_kahn_against_brute_force():
    random.seed(1)
    for _ in range(300):
        n = random.randint(0, 7)
        ids = list(range(n))
        parents = [random.sample(ids, random.randint(0, min(2, n))) for _ in ids]
        times = [random.choice([None, 1, 2, 3]) for _ in ids]
        done, left = C.kahn_order(ids, parents, times)
        assert sorted(done + left) == ids
        placed = set()
        for i in done:
            assert set(parents[i]) <= placed
            free = [j for j in ids if j not in placed and set(parents[j]) <= placed]
            assert i == min(free, key=lambda j: (times[j] is None, times[j] or 0, j))
            placed.add(i)
        assert not any(set(parents[j]) <= placed for j in left)


def test_repeated_nodes_count_once():
    assert C.list_order(["a", "b", "a", "c", "b"]) == [(0, 0), (1, 1), (3, 2)]
    assert C.list_order(None) == [] and C.list_order([]) == []


def test_headers_types_and_fallbacks(spark):
    rows = [
        composer("s", [{"bubbleId": "u", "type": "1"}, {"bubbleId": "blank", "type": 1}, {"bubbleId": "a", "serverBubbleId": "x"}, {"bubbleId": "u", "type": 1}, {"bubbleId": "u2", "type": 1}, {"bubbleId": "a2", "type": 2}]),
        bubble("s", "u", "old", 1),
        bubble("s", "u", "new", 1, T1),
        bubble("s", "blank", " \n　"),
        bubble("s", "a", "answer", 2),
        ("bubbleId:s:u2", '{"text": "cut', T0),
        ("composer.content.u2", json.dumps({"content": "second"}), T0),
        bubble("s", "a2", "end"),
        (None, "x", T0),
        ("bubbleId:s:nobody", None, T0),
    ]
    want = [("s", 0, "u", "user"), ("s", 1, "a", "assistant"), ("s", 2, "u2", "user"), ("s", 3, "a2", "assistant")]
    assert run(spark, rows) == want
    assert run(spark, rows[:-4]) == []  # u2 has no readable row left... and a2 none at all
    parts = C.conversation_parts(spark.createDataFrame(rows, KV), size=3).orderBy("part").collect()
    assert [[m["content"] for m in p["conversation"]] for p in parts] == [["new", "answer", "second"], ["end"]]


def test_map_wins_and_keeps_its_order(spark):
    mapped = {"z": {"type": 1, "text": "q"}, "b": {"type": 2, "text": None}, "a": {"type": 2, "text": "r"}}
    assert run(spark, [composer("m", [{"bubbleId": "gone", "type": 1}], mapped)]) == [("m", 0, "z", "user"), ("m", 1, "a", "assistant")]


def test_broken_conversations_go(spark):
    two = {"u": {"type": 1, "text": "q"}, "a": {"type": 2, "text": "r"}}
    rows = [
        composer("starts", None, {"a": {"type": 2, "text": "r"}, **two}),
        composer("twice", None, {"u": {"type": 1, "text": "q"}, "v": {"type": 1, "text": "q"}, "a": {"type": 2, "text": "r"}}),
        composer("open", None, {**two, "v": {"type": 1, "text": "q"}}),
        composer("empty"),
        ("composerData:cut", composer("cut", None, two)[1][:-3], T0),
        ("composerData:list", "[]", T0),
        ("composerData:null", None, T1),
        composer("null", None, two),
        composer("good", None, two),
    ]
    assert {r[0] for r in run(spark, rows)} == {"good"}
    assert run(spark, []) == []


def test_one_conversation_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 7)
    n = 500
    heads = [{"bubbleId": f"b{i}", "type": 1 + i % 2} for i in range(n)]
    rows = [composer("h", heads)] + [bubble("h", f"b{i}", "" if 10 <= i < 60 else f"t{i}") for i in range(n)]
    got = run(spark, rows)
    assert [r[1] for r in got] == list(range(n - 50)) and got[10][2] == "b60"
    rows[-1] = bubble("h", f"b{n - 1}", None)
    assert run(spark, rows) == []


def test_order_of_rows_with_parents(spark):
    data = [("c", "a", None, 5), ("c", "b", "a", 4), ("c", "d", "b", 9), ("c", "e", "b", 8), ("c", "x", "y", 1), ("c", "y", "x", 1), ("c", "z", "x", 1), ("c", "lost", "gone", 7), ("d", "a", "a2", 1), ("c", None, "a", 1), ("c", "a", None, 6)]
    df = spark.createDataFrame(data, "conv string, id string, parent string, ts int")
    got = {(r["conv"], r["id"]): (r["pos"], r["cyclic"]) for r in C.order_replies(df, "conv", "id", "parent", "ts").collect()}
    order = [k[1] for k, v in sorted(got.items(), key=lambda x: (x[1][0] is None, x[1][0])) if k[0] == "c" and v[0] is not None]
    assert order == ["a", "lost", "b", "e", "d"]
    assert all(got[("c", k)] == (None, True) for k in "xyz") and got[("d", "a")] == (0, False)
    chain = spark.range(300).select(F.lit("k").alias("conv"), F.col("id").cast("string").alias("id"), (F.col("id") - 1).cast("string").alias("parent"), F.lit(None).cast("int").alias("ts"))
    assert all(r["pos"] == int(r["id"]) for r in C.order_replies(chain, "conv", "id", "parent", "ts").collect())


def test_clashing_columns(spark):
    rows = [composer("good", None, {"u": {"type": 1, "text": "q"}, "a": {"type": 2, "text": "r"}}), composer("good", None, {"u": {"type": 1, "text": "q"}, "a": {"type": 2, "text": "r"}})]
    df = spark.createDataFrame(rows, KV)
    more = df.withColumns({c: F.lit(1) for c in ("v", "b", "m", "o", "at", "pos", "block", "session_id", "type", "role", "text", "ckey")})
    assert sorted(tuple(r) for r in C.rebuild(more).collect()) == run(spark, rows) != []


def test_snapshots_fork_the_graph(spark):
    from datetime import datetime

    heads = lambda *ids: json.dumps({"fullConversationHeadersOnly": [{"bubbleId": i} for i in ids]})
    at = lambda d: datetime(2026, 1, d)
    rows = [("composerData:s", heads("a", "b", "c", "c2"), at(1)), ("composerData:s", heads("a", "b", None, "d", "a", "e"), at(2)), ("composerData:s", "{broken", at(3)), ("composerData:s", None, at(4))]
    rows += [("composerData:t", json.dumps({"conversationMap": {"y": {}, "x": {}}}), None), ("bubbleId:s:a", "{}", at(1)), (None, "{}", at(1))]
    graph = C.reply_graph(spark.createDataFrame(rows, KV))
    assert {(r["session_id"], r["bubble_id"]): r["parent"] for r in graph.collect()} == {("s", "a"): None, ("s", "b"): "a", ("s", "c"): "b", ("s", "c2"): "c", ("s", "d"): "b", ("s", "e"): "d", ("t", "y"): None, ("t", "x"): "y"}
    order = C.order_replies(graph, "session_id", "bubble_id", "parent", "seen_at").orderBy("session_id", "pos").collect()
    assert [r["bubble_id"] for r in order] == ["a", "b", "c", "d", "c2", "e", "y", "x"] and not any(r["cyclic"] for r in order)
    loop = graph.where("session_id = 't'").unionByName(spark.createDataFrame([("t", "y2", "z2", None), ("t", "z2", "y2", None), ("t", "w", "z2", None)], graph.schema))
    got = {r["bubble_id"]: (r["pos"], r["cyclic"]) for r in C.order_replies(loop, "session_id", "bubble_id", "parent", "seen_at").collect()}
    assert got == {"y": (0, False), "x": (1, False), "y2": (None, True), "z2": (None, True), "w": (None, True)}
    assert C.order_replies(graph.limit(0), "session_id", "bubble_id", "parent", "seen_at").count() == 0
