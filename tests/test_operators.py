import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import cleaning
from lorekeep.operators import bm25, delivery, notes, recall, sessions, topics

DELIVERY = "delivery_id bigint, sessionId string, createdAt string, lastUpdatedAt string, session_id string, conversation array<struct<role:string,content:string>>"


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_delivery_keeps_the_latest(spark):
    data = [
        (1, "A ", "2026-01-01T00:00:00", "2026-01-02T00:00:00", "x", None),
        (2, "a\n", "2026-01-01T00:00:00", "2026-01-02T08:00:00+08:00", "x", None),  # the same instant, larger number
        (3, "a", "2026-01-01T00:00:00", "bad", "x", None),
        (4, " ", None, None, "x", None),
        (5, None, None, None, "x", None),
        (6, "b", "2026-01-03T00:00:00", None, "x", None),
        (7, "b", "1767398400000", "2026-01-01T00:00:00", "x", None),
        (8, "c", None, None, "x", None),
        (8, "c", None, None, "x", None),
    ]
    df = spark.createDataFrame(data, DELIVERY).drop("session_id")
    assert sorted(rows(delivery.surplus_deliveries(df))) == [("a", 2), ("a", 3), ("b", 7)]
    kept = delivery.latest_sessions(df)
    assert sorted((r["session_id"], r["delivery_id"]) for r in kept.collect()) == [("a", 1), ("b", 6), ("c", 8)]


def test_delivery_of_nothing(spark):
    none = spark.createDataFrame([], DELIVERY).drop("session_id")
    assert rows(delivery.surplus_deliveries(none)) == [] and rows(delivery.latest_sessions(none)) == []


def test_delivery_hot_session_and_extra_columns(spark):
    df = spark.range(30_000).select(F.col("id").alias("delivery_id"), F.when(F.col("id") < 20_000, "hot").otherwise(F.col("id").cast("string")).alias("sessionId"), F.lit("2026-01-01").alias("createdAt"), F.lit(None).cast("string").alias("lastUpdatedAt"), F.lit(1).alias("rank"), F.lit("y").alias("at"), F.lit("z").alias("session_id"))
    assert delivery.surplus_deliveries(df).count() == 19_999
    kept = delivery.latest_sessions(df)
    assert kept.columns == df.columns and kept.where("session_id = 'hot'").select("delivery_id", "rank", "at").first()[:] == (0, 1, "y")


def test_new_batches(spark):
    stored = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    batch = spark.createDataFrame([("b", 5), ("c", 4), ("c", 3), (None, 9)], "k string, v int")
    assert rows(delivery.new_only(batch, stored, "k", [F.col("v")])) == [("c", 3)]
    old = spark.createDataFrame([(1, "a", "2026-01-01", None, None)], "delivery_id bigint, sessionId string, createdAt string, lastUpdatedAt string, extra string")
    new = spark.createDataFrame([(2, "A", "2026-01-01", "2026-01-05", None), (3, "z", None, None, None)], old.schema)
    merged = delivery.merge_latest(delivery.latest_sessions(old), new)
    assert sorted((r["session_id"], r["delivery_id"]) for r in merged.collect()) == [("a", 2), ("z", 3)]


def test_bm25_against_the_formula(spark):
    random.seed(3)
    docs = [(i, "s" if i % 3 else None, " ".join(random.choice("red blue green pool cache".split()) for _ in range(random.randint(0, 9))) or None) for i in range(40)]
    got = {(s, k): v for s, k, v in rows(bm25.scores(spark.createDataFrame(docs, "k int, s string, t string"), "pool pool cache x", "s", "k", "t"))}
    assert len(got) == 40
    for scope in ("s", ""):
        own = {k: (t or "").split() for k, s, t in docs if (s or "") == scope}
        n, avg = len(own), sum(map(len, own.values())) / len(own)
        df = {w: sum(w in t for t in own.values()) for w in {w for t in own.values() for w in t}}
        idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
        mean = sum(idf.values()) / len(idf)
        idf = {w: v if v >= 0 else 0.25 * mean for w, v in idf.items()}
        for k, t in own.items():
            want = sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in ("pool", "pool", "cache"))
            assert got[(scope, k)] == pytest.approx(want, abs=1e-9)


def test_bm25_cap_comes_before_the_zero_drop(spark):
    df = spark.createDataFrame([("s", i, -1.0 if i < 3 else 0.0) for i in range(10)], "scope string, key int, bm25 double")
    assert rows(bm25.candidates(df, 7)) == []
    assert bm25.candidates(df, 8).first()["shift"] == 2.0
    assert rows(bm25.scores(df.select("scope", "key", F.lit("x").alias("t")), "  ", "scope", "key", "t")) == []


@pytest.mark.parametrize("cap", [3, 300])
def test_index_equals_the_scan(spark, tmp_path, cap):
    random.seed(9)
    docs = [(i, random.choice(["s", "t", None]), " ".join(random.choice("red blue green pool cache 连接池".split()) for _ in range(random.randint(0, 6))) or None) for i in range(60)]
    df = spark.createDataFrame(docs, "k int, s string, t string")
    index = bm25.Index.build(df, "s", "k", "t", str(tmp_path / "i"))
    for query in ("pool", "red red blue", "连接池 green", "none", " "):
        want = [(*r[:2], round(r[2], 9), round(r[3], 9), r[4]) for r in rows(bm25.candidates(bm25.scores(df, query, "s", "k", "t"), cap))]
        got = [(*r[:2], round(r[2], 9), round(r[3], 9), r[4]) for r in rows(index.candidates(query, cap))]
        assert sorted(got) == sorted(want), query


@pytest.mark.parametrize(
    ("source", "age", "recalls", "floor", "want"),
    [("manual", 365, None, 0.5, 1.0), ("edited", 1000, None, 0.5, 1.0), ("auto", 0, 0, 0.5, 1.0), ("auto", 90, 0, 0.0, 0.5), ("auto", 1000, 0, 0.5, 0.5), ("auto", 60, 20, 0.5, 0.945), ("auto", 60, 0, 0.5, 0.63), ("manual", 365, 1, 0.5, 1.0)],
)
def test_decay(spark, source, age, recalls, floor, want):
    at = datetime(2026, 7, 1).timestamp() - age * 86400
    got = spark.range(1).select(recall.decay(F.lit(source), F.lit(at), F.lit(None).cast("double"), F.lit(recalls).cast("int"), "2026-07-01 00:00:00", floor=floor)).first()[0]
    assert got == pytest.approx(want, abs=0.01)


EVENT = "ts string, event string, query string, hits array<string>, id string, path string"


def test_recall_counts(spark):
    e = [("2026-06-30T00:00:00", "search", "q", ["a", "b"], None, None), ("bad", "search", "q", ["a", "c", ""], None, None), ("2026-06-30T00:00:00", "read", None, None, "x", None), ("2026-01-01T00:00:00", "read", None, None, "x", None), (None, "read", None, None, None, None)]
    df = spark.createDataFrame(e, EVENT)
    assert dict(rows(recall.recall_counts(df, "2026-07-01 00:00:00"))) == {"a": 2, "b": 1, "c": 1, "x": 2}
    assert rows(recall.recall_counts(df.limit(0), "2026-07-01 00:00:00")) == []


MESSAGE = "session_id string, pos int, role string, content string"


def test_pairs_against_a_loop(spark):
    random.seed(5)
    pool = [("user", "fix the error"), ("user", "ok"), ("assistant", "a"), ("assistant", "b" * 120), ("tool", "c" * 120), ("tool", "c"), ("user", " ")]
    data = [(f"s{s}", i, *random.choice(pool)) for s in range(200) for i in range(random.randint(1, 8))]

    def loop(conv):
        conv, out, i = [m for m in conv if m[3].strip()], [], 0
        while i < len(conv):
            answered = i + 1 < len(conv) and conv[i + 1][2] == "assistant"
            if conv[i][2] == "user":
                keep = conv[i][3].strip() == "fix the error"
                out += conv[i : i + 1 + answered] if keep else []
                i += 1 + answered
            else:
                out += [conv[i]] if len(conv[i][3]) > 100 else []
                i += 1
        return out

    want = sorted(m[:2] for s in range(200) for m in loop([d for d in data if d[0] == f"s{s}"]))
    assert sorted(r[:2] for r in rows(sessions.pairs(spark.createDataFrame(data, MESSAGE)))) == want


def test_truncate_against_a_loop(spark):
    random.seed(6)
    data = [(f"s{s}", i, "user", random.choice(["error ", "cache lock ", "z "]) + "y" * random.choice([10, 300, 700])) for s in range(100) for i in range(random.randint(1, 7))]

    def loop(conv, budget=1000):
        score = lambda i, m: sum(k in m[3] for k in cleaning.KEYWORDS) + (100 if i in (0, len(conv) - 1) else 0)
        out, used = [], 0
        for i, m in sorted(enumerate(conv), key=lambda x: -score(*x)):
            if used + len(m[3]) > budget:
                if budget - used > 200:
                    out.append((*m[:3], m[3][: budget - used] + "...[已截断]"))
                break
            out.append(m)
            used += len(m[3])
        return out

    want = sorted(m for s in range(100) for m in loop([d for d in data if d[0] == f"s{s}"]))
    assert sorted(rows(sessions.truncate(spark.createDataFrame(data, MESSAGE), 1000))) == want


def test_noise_rules(spark):
    same = "this very message is pasted again"
    data = {
        "none": [("user", "hello there, only me")],
        "short": [("user", "hi"), ("assistant", "hello")],
        "tools": [("user", "please run the tool"), ("assistant", "<tool_use>" + "x" * 200 + "</tool_use>")],
        "stuck": [("user", same), ("assistant", "a"), ("user", same + " "), ("assistant", "b"), ("user", same)],
        "refused": [("user", "do something bad"), ("assistant", "I'm sorry, no")],
        "good": [("user", "explain the cache"), ("assistant", "it stores rows")],
    }
    df = spark.createDataFrame([(k, i, r, c) for k, v in data.items() for i, (r, c) in enumerate(v)], MESSAGE)
    assert dict(rows(sessions.noise(df))) == {"none": "no-real-interaction", "short": "user-input-too-short", "tools": "all-tool-calls-no-thinking", "stuck": "repeated-stuck-pattern", "refused": "refused-no-followup", "good": None}


NOTE = "id string, scope string, project_key string, title string, tags array<string>, archived boolean, created string, source string, value string"


def test_conflicts(spark):
    data = [
        ("old", "personal", None, "Redis script", ["redis", "EVALSHA", "noscript"], False, "2026-01-01", "auto", "high"),
        ("new", "personal", None, "other words", ["redis", "evalsha", "noscript"], None, "2026-02-01", "auto", "high"),
        ("title", "project", "p", "fix the lock order", None, False, "2026-01-01", "auto", "low"),
        ("alike", "project", "p", "fix the lock now", None, False, "2026-01-02", "auto", "low"),
        ("far", "project", "q", "fix the lock now", None, False, "2026-01-02", "auto", "low"),
        ("gone", "project", "p", "fix the lock now", None, True, "2026-01-02", "auto", "low"),
    ]
    df = spark.createDataFrame(data, NOTE)
    assert sorted(rows(notes.conflicts(df))) == [("alike", "title"), ("new", "old"), ("old", "new"), ("title", "alike")]
    assert sorted(rows(notes.superseded(df))) == [("old", ["new"]), ("title", ["alike"])]
    assert rows(notes.conflicts(df.limit(0))) == []


def test_upsert_protects(spark):
    stored = spark.createDataFrame([("a", "manual", 1), ("b", "auto", 1), ("c", None, 1)], "id string, source string, v int")
    new = spark.createDataFrame([("a", "auto", 2), ("b", "auto", 2), ("d", "auto", 2)], stored.schema)
    assert sorted(rows(notes.upsert(stored, new)), key=str) == [("a", "manual", 1), ("b", "auto", 2), ("c", None, 1), ("d", "auto", 2)]


def test_marked_block(spark):
    def run(x, block="b\\1$"):
        return spark.range(1).select(notes.with_block(F.lit(x).cast("string"), F.lit(block), "<s>", "<e>")).first()[0]

    assert run(None) == "<s>\nb\\1$\n<e>\n"
    assert run("mine") == "mine\n\n<s>\nb\\1$\n<e>\n"
    assert run("mine\n") == "mine\n\n<s>\nb\\1$\n<e>\n"
    assert run("x\n<s>\nold\n<e>\ny") == "x\n<s>\nb\\1$\n<e>\ny"


def test_topics(spark):
    df = spark.createDataFrame([("t", "project", None, "x", ["a"] * 9, "b", None), (" ", None, None, None, None, None, False)], "title string, scope string, project_key string, value string, tags array<string>, body string, should_keep boolean")
    got = topics.to_notes(topics.kept(df), "2026-01-01").collect()
    assert len(got) == 1 and got[0]["scope"] == "personal" and got[0]["value"] == "medium" and len(got[0]["tags"]) == 6
    fenced = spark.range(1).select(topics.unfenced(F.lit("```yaml\nsay\ntopics:\n- a\n```"))).first()[0]
    assert fenced == "topics:\n- a"


def test_hooks(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",)], "t string")
    assert [r[1] for r in rows(topics.apply_model(df, "t", lambda x: [v.upper() for v in x]))] == ["A", None, "A"]

    def broken(x):
        raise RuntimeError("down")

    assert [r[1] for r in rows(topics.apply_model(df, "t", broken))] == [None] * 3
    first = topics.embed(df, "t", lambda x: [[1.0, 2.0]] * len(x))
    assert first.count() == 1
    assert topics.embed(df, "t", broken, first).count() == 1


def test_fusion_of_equal_scores(spark):
    df = spark.createDataFrame([(1, 2.0, 0.5), (2, 2.0, None)], "k int, b double, c double")
    assert {r["k"]: round(r["final_score"], 6) for r in recall.fuse(df, "b", "c").collect()} == {1: 0.35, 2: 0.0}
