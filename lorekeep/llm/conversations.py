"""Conversations rebuilt from message rows of a key-value store.

Every conversation row lists its messages, each following the one before: a reply graph. It is ordered with Kahn's
algorithm, inside the row that holds it (ids only, no texts). Message texts are joined by key afterwards and stay
distributed: the positions of a conversation are worked on in blocks, so a conversation of any length never is one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lorekeep.session import cut, numbered

#: Positions of one conversation that are put in order by one task.
BLOCK = 4096
#: Messages in one row of :func:`conversation_parts`.
PART = 1000

_ENTRY = "struct<type:string,text:string>"
_HEADER = "struct<bubbleId:string,type:string>"
_COMPOSER = f"struct<conversationMap:map<string,{_ENTRY}>,fullConversationHeadersOnly:array<{_HEADER}>>"
_ORDERED = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("pos", T.IntegerType())]))


def kahn_order(ids: Sequence, parents: Sequence[Iterable], times: Sequence) -> tuple[list[int], list[int]]:
    """Indices in topological order, and those left over, which lie on or behind a cycle.

    ``parents`` holds for each node the ids it answers; parents that aren't nodes count as absent, a node that occurs
    again counts at its first place only. Among nodes that are free at once the earlier time goes first (nodes without
    a time after those with one), then the place in the list.
    """
    first: dict = {}
    for i, x in enumerate(ids):
        first.setdefault(x, i)
    nodes = sorted(first.values())
    waits = dict.fromkeys(nodes, 0)
    answers: dict[int, list[int]] = {i: [] for i in nodes}
    for i in nodes:
        for p in set(parents[i] or ()):
            j = first.get(p)
            if j is not None:
                answers[j].append(i)
                waits[i] += 1
    rank = {i: (times[i] is None, times[i] if times[i] is not None else 0, i) for i in nodes}
    free = [(rank[i], i) for i in nodes if not waits[i]]
    heapq.heapify(free)
    done: list[int] = []
    while free:
        _, i = heapq.heappop(free)
        done.append(i)
        for j in answers[i]:
            waits[j] -= 1
            if not waits[j]:
                heapq.heappush(free, (rank[j], j))
    return done, [i for i in nodes if waits[i]]


def list_order(ids: Sequence) -> list[tuple[int, int]]:
    """``(place in the list, position)`` of the messages of one list, where each first occurrence answers the one before."""
    if ids is None:
        return []
    parents, last, seen = [], None, set()
    for x in ids:
        parents.append(() if x in seen or last is None else (last,))
        if x not in seen:
            seen.add(x)
            last = x
    done, _ = kahn_order(ids, parents, range(len(ids)))
    return [(at, pos) for pos, at in enumerate(done)]


def order_replies(df: DataFrame, conversation: str, message: str, parent: str, time: str) -> DataFrame:
    """Positions for message rows that name the message they answer: ``conversation, message, pos, cyclic``.

    For stores whose rows carry a parent. Kahn's algorithm on a forest, spread over tasks: what is free after the same number
    of steps makes a level, levels come from joins (pointer doubling: the number of rounds is the logarithm of the longest
    chain), and messages left over lie on a cycle or behind one. Within a level the earlier time, then the message id goes
    first. No conversation is gathered; positions are counted over sorted ranges. A message without parent, or whose parent
    has no row, starts a thread; messages left over get a null ``pos`` and ``cyclic`` true. Null message ids don't come
    out; of repeated message ids the earliest row counts.
    """
    w = Window.partitionBy("c", "m").orderBy(F.col("t").asc_nulls_last(), F.col("p").asc_nulls_last())
    nodes = df.select(F.col(conversation).alias("c"), F.col(message).alias("m"), F.col(parent).alias("p"), F.col(time).alias("t")).where("m is not null").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    # the rounds work on digests of conversation and message, together 128 bits
    nodes = cut(nodes.select("c", "m", "t", F.xxhash64("c").alias("ch"), F.xxhash64("m").alias("mh"), F.when(F.col("p").isNotNull(), F.xxhash64("p")).alias("ph")))
    ids = nodes.select("ch", "mh", "ph")
    known = ids.select("ch", F.col("mh").alias("ph"), F.lit(True).alias("known"))
    rounds = ids.groupBy("ch").agg(F.length(F.bin(F.count("*"))).alias("rounds"))  # enough for a chain of all its messages
    step = cut(ids.join(known, ["ch", "ph"], "left").join(rounds, "ch").select("ch", "mh", F.when(F.col("known"), F.col("ph")).alias("up"), F.when(F.col("known"), 1).otherwise(0).alias("depth"), "rounds"))
    parts = []
    for k in range(step.agg(F.max("rounds")).first()[0] or 0):
        parts.append(step.where(F.col("rounds") <= k))  # nothing of these conversations moves any more
        live = step.where(F.col("rounds") > k)
        far = live.select("ch", F.col("mh").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"))
        rest = live.where("up is not null").join(far, ["ch", "up"], "left").select("ch", "mh", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), "rounds")
        step = cut(live.where("up is null").unionByName(rest))
    for part in parts:
        step = step.unionByName(part)
    placed = nodes.select("c", "m", "t", "ch", "mh").join(step.select("ch", "mh", "up", "depth"), ["ch", "mh"])
    free = numbered(placed.where("up is null").select("c", "m", "t", "depth"), "c", [F.col("depth"), F.col("t").asc_nulls_last(), F.col("m")], "pos")
    left = placed.where("up is not null").select("c", "m", F.lit(None).cast("int").alias("pos"), F.lit(True).alias("cyclic"))
    out = free.select("c", "m", (F.col("pos") - 1).alias("pos"), F.lit(False).alias("cyclic")).unionByName(left)
    return out.select(F.col("c").alias(conversation), F.col("m").alias(message), "pos", "cyclic")


def reply_graph(kv: DataFrame) -> DataFrame:
    """``session_id, bubble_id, parent, seen_at`` of every message that any snapshot of a conversation lists.

    A message answers the one before it in the latest snapshot that lists it; messages that a later snapshot no longer
    lists stay where they were, so the graph forks there. ``seen_at`` is the time of the first snapshot with the message.
    Unreadable rows, entries without an id and repeated entries add nothing.
    """
    rows = kv.where(F.col("key").startswith("composerData:")).where(_is_object(F.col("value"))).select(F.expr("substring(key, length('composerData:') + 1)").alias("session_id"), "snapshot_at", F.from_json("value", _COMPOSER).alias("c"))
    ids = F.when(F.size("c.conversationMap") > 0, F.map_keys("c.conversationMap")).otherwise(F.transform("c.fullConversationHeadersOnly", lambda h: h["bubbleId"]))
    once = rows.select("session_id", "snapshot_at", F.array_distinct(F.filter(ids, lambda x: x.isNotNull())).alias("ids"))
    pairs = F.transform("ids", lambda x, i: F.struct(x.alias("id"), F.when(i > 0, F.get("ids", i - 1)).alias("up")))
    each = once.select("session_id", "snapshot_at", F.explode(pairs).alias("x"))
    best = F.max(F.struct(F.col("snapshot_at").alias("t"), F.col("x.up").alias("up")))
    return each.groupBy("session_id", F.col("x.id").alias("bubble_id")).agg(best.alias("b"), F.min("snapshot_at").alias("seen_at")).select("session_id", "bubble_id", F.col("b.up").alias("parent"), "seen_at")


@F.pandas_udf(_ORDERED)
def _listed(ids: pd.Series) -> pd.Series:
    return ids.map(lambda x: [{"at": a, "pos": p} for a, p in list_order(x)])


def _is_object(value: Column) -> Column:
    return F.get_json_object(value, "$").isNotNull() & value.rlike(r"^\s*\{")


def _latest(kv: DataFrame, payload: Column) -> DataFrame:
    """``key`` and the payload of its row with the latest snapshot; rows without a time are the oldest."""
    best = F.max(F.struct(F.col("snapshot_at").alias("t"), payload.alias("v")))
    return kv.groupBy("key").agg(best.alias("b")).select("key", F.col("b.v").alias("v"))


def _messages(kv: DataFrame, texts: bool) -> DataFrame:
    """``session_id, at, bubble_id, type, readable, blank[, text]`` of every listed message, in Kahn's order."""
    kv = kv.select("key", "value", "snapshot_at")
    composers = _latest(kv.where(F.col("key").startswith("composerData:")), F.col("value"))
    parsed = composers.where(_is_object(F.col("v"))).select(F.substring_index("key", ":", -1).alias("last"), F.expr("substring(key, length('composerData:') + 1)").alias("session_id"), F.from_json("v", _COMPOSER).alias("c"))
    entries = F.map_entries("c.conversationMap")
    mapped = F.size("c.conversationMap") > 0
    listed = F.when(mapped, F.transform(entries, lambda e: F.struct(e["key"].alias("id"), e["value"]["type"].alias("type"), e["value"]["text"].alias("text"), F.lit(True).alias("own")))).otherwise(
        F.transform(F.filter("c.fullConversationHeadersOnly", lambda h: h["bubbleId"].isNotNull()), lambda h: F.struct(h["bubbleId"].alias("id"), h["type"].alias("type"), F.lit(None).cast("string").alias("text"), F.lit(False).alias("own")))
    )
    lists = parsed.select("session_id", listed.alias("m")).where(F.size("m") > 0)
    ordered = lists.select("session_id", "m", F.explode(_listed(F.col("m.id"))).alias("o"))
    rows = ordered.select("session_id", F.col("o.pos").alias("at"), F.element_at("m", F.col("o.at") + 1).alias("m"))
    rows = rows.select("session_id", "at", F.col("m.id").alias("bubble_id"), F.col("m.type").alias("type"), F.col("m.text").alias("own_text"), F.col("m.own").alias("own"))

    body = F.from_json("value", _ENTRY)
    content = F.from_json("value", "struct<text:string,content:string>")

    def facts(text: Column, kind: Column) -> Column:
        fields = [_is_object(F.col("value")).alias("ok"), kind.alias("type"), _blank(text).alias("blank")]
        return F.struct(*fields, *([text.alias("text")] if texts else []))

    bubbles = _latest(kv.where(F.col("key").startswith("bubbleId:")), facts(body["text"], body["type"])).select("key", F.col("v").alias("b"))
    contents = _latest(kv.where(F.col("key").startswith("composer.content.")), facts(F.coalesce(content["text"], content["content"]), F.lit(None).cast("string"))).where("v.ok").select(F.col("key").alias("ckey"), F.col("v").alias("d"))

    # rows that need no partner get keys of their own, not null, which would bring them all to one task
    none = F.concat(F.lit("-:"), "session_id", F.lit(":"), F.col("at").cast("string"))
    keyed = rows.withColumn("key", F.when(~F.col("own"), F.concat(F.lit("bubbleId:"), "session_id", F.lit(":"), "bubble_id")).otherwise(none))
    found = keyed.join(bubbles, "key", "left")
    good = F.coalesce(F.col("b.ok"), F.lit(False))
    found = found.withColumn("ckey", F.when(~F.col("own") & ~good, F.concat(F.lit("composer.content."), "bubble_id")).otherwise(none)).join(contents, "ckey", "left")
    text = lambda n: F.when(good, F.col(f"b.{n}")).otherwise(F.col(f"d.{n}"))
    return found.select(
        "session_id", "at", "bubble_id",
        F.coalesce("type", F.when(good, F.col("b.type"))).alias("type"),
        (F.col("own") | good | F.col("d").isNotNull()).alias("readable"),
        F.when(F.col("own"), _blank(F.col("own_text"))).otherwise(text("blank")).alias("blank"),
        *([F.when(F.col("own"), F.col("own_text")).otherwise(text("text")).alias("content")] if texts else []),
    )


def _blank(text: Column) -> Column:
    return ~F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def rebuild(kv: DataFrame, texts: bool = False) -> DataFrame:
    """``session_id, pos, bubble_id, role`` (and ``content``) of every message of the kept conversations.

    Dropped are conversations with a message of which no readable row exists, with nothing left after blank messages
    went, with an assistant message first, and with a user message that no assistant message follows directly. Null
    keys, unreadable or null values and repeated keys are handled as in TESTDATA.md; a value that isn't a JSON object
    is unreadable; list entries without an id are none; an empty table gives no rows.
    """
    block = F.floor(F.col("at") / BLOCK)
    every = cut(_messages(kv, texts).withColumn("block", block))
    bad = every.where(~F.col("readable")).select("session_id").distinct()
    kept = every.where(F.col("readable") & ~F.col("blank")).withColumn("role", F.when(F.trim("type") == "1", "user").otherwise("assistant"))
    inside = Window.partitionBy("session_id", "block").orderBy("at")
    local = kept.withColumn("rn", F.row_number().over(inside)).withColumn("next", F.lead("role").over(inside))
    lone = F.col("role") == "user"
    sums = local.groupBy("session_id", "block").agg(
        F.count("*").alias("n"), F.min_by("role", "at").alias("first"), F.max_by("role", "at").alias("last"),
        F.max(F.when(lone & (F.col("next") == "user"), 1).otherwise(0)).alias("wrong"),
    )
    across = Window.partitionBy("session_id").orderBy("block")
    whole = Window.partitionBy("session_id")
    after = F.lead("first").over(across)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = sums.withColumn("wrong", F.greatest("wrong", F.when((F.col("last") == "user") & ~F.coalesce(after == "assistant", F.lit(False)), 1).otherwise(0)))
    sums = sums.withColumn("wrong", F.max("wrong").over(whole)).withColumn("start", F.first("first").over(across))
    fine = sums.where("wrong = 0 and start = 'user'").select("session_id", "block", "before").join(bad, "session_id", "left_anti")
    out = local.join(fine, ["session_id", "block"])
    return out.select("session_id", (F.col("before") + F.col("rn") - 1).cast("int").alias("pos"), "bubble_id", "role", *(["content"] if texts else []))


def conversation_parts(kv: DataFrame, size: int = PART) -> DataFrame:
    """``session_id, part, conversation``: the kept conversations as arrays of ``role, content``, ``size`` messages a row.

    A conversation of more messages takes several rows, numbered from 0, so that no row grows without bound.
    """
    rows = rebuild(kv, texts=True).withColumn("part", F.floor(F.col("pos") / size).cast("int"))
    packed = rows.groupBy("session_id", "part").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "content"))).alias("m"))
    return packed.select("session_id", "part", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("conversation"))
