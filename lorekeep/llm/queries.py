"""Registered queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm import conversations, mixing, near_duplicates, personal, secrets, stuffing, texts, tokens
from lorekeep.session import table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_P2 = """
WITH l AS (SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY snapshot_at DESC NULLS LAST) AS n FROM cursor_disk_kv WHERE key IS NOT NULL) WHERE n = 1),
o AS (SELECT key, CAST(value AS JSON) AS j FROM l WHERE json_valid(value) AND json_type(CASE WHEN json_valid(value) THEN value END) = 'OBJECT'),
c AS (SELECT substring(key, 14) AS sid, j FROM o WHERE key LIKE 'composerData:%'),
mk AS (SELECT sid, j, unnest(json_keys(j, '$.conversationMap')) AS id, generate_subscripts(json_keys(j, '$.conversationMap'), 1) AS i FROM c WHERE len(json_keys(j, '$.conversationMap')) > 0),
mm AS (SELECT sid, i, id, json_extract_string(j, '$.conversationMap."' || id || '".type') AS type, json_extract_string(j, '$.conversationMap."' || id || '".text') AS text, true AS ok FROM mk),
hh AS (SELECT sid, unnest(h).bubbleId AS id, unnest(h).type AS type, generate_subscripts(h, 1) AS i
  FROM (SELECT sid, from_json(json_extract(j, '$.fullConversationHeadersOnly'), '[{"bubbleId":"VARCHAR","type":"VARCHAR"}]') AS h FROM c WHERE coalesce(len(json_keys(j, '$.conversationMap')), 0) = 0)),
h1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sid, id ORDER BY i) AS n FROM hh WHERE id IS NOT NULL) WHERE n = 1),
hm AS (SELECT h1.sid, h1.i, h1.id, coalesce(h1.type, json_extract_string(b.j, '$.type')) AS type,
  CASE WHEN b.key IS NOT NULL THEN json_extract_string(b.j, '$.text') ELSE coalesce(json_extract_string(d.j, '$.text'), json_extract_string(d.j, '$.content')) END AS text, b.key IS NOT NULL OR d.key IS NOT NULL AS ok
  FROM h1 LEFT JOIN o b ON b.key = 'bubbleId:' || h1.sid || ':' || h1.id LEFT JOIN o d ON d.key = 'composer.content.' || h1.id),
a AS (SELECT sid, i, id, type, text, ok FROM mm UNION ALL SELECT * FROM hm),
k AS (SELECT sid, id, CASE WHEN type = '1' THEN 'user' ELSE 'assistant' END AS role, row_number() OVER (PARTITION BY sid ORDER BY i) - 1 AS pos FROM a
  WHERE regexp_matches(text, '[^\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]')),
n AS (SELECT *, lead(role) OVER (PARTITION BY sid ORDER BY pos) AS next FROM k),
bad AS (SELECT sid FROM a WHERE NOT ok UNION SELECT sid FROM n WHERE (pos = 0 AND role <> 'user') OR (role = 'user' AND next IS DISTINCT FROM 'assistant'))
SELECT sid AS session_id, CAST(pos AS INT) AS pos, id AS bubble_id, role FROM n WHERE sid NOT IN (SELECT sid FROM bad)"""

_ORDER = """
WITH RECURSIVE c AS (SELECT row_number() OVER () AS r, substring(key, 14) AS sid, snapshot_at AS seen, CAST(value AS JSON) AS j FROM cursor_disk_kv
  WHERE key LIKE 'composerData:%' AND json_valid(value) AND json_type(CASE WHEN json_valid(value) THEN value END) = 'OBJECT'),
a AS (SELECT r, sid, seen, unnest(json_keys(j, '$.conversationMap')) AS id, generate_subscripts(json_keys(j, '$.conversationMap'), 1) AS i FROM c WHERE len(json_keys(j, '$.conversationMap')) > 0
  UNION ALL SELECT r, sid, seen, unnest(h).bubbleId, generate_subscripts(h, 1) FROM (SELECT r, sid, seen, from_json(json_extract(j, '$.fullConversationHeadersOnly'), '[{"bubbleId":"VARCHAR"}]') AS h FROM c WHERE coalesce(len(json_keys(j, '$.conversationMap')), 0) = 0)),
f AS (SELECT r, sid, seen, id, min(i) AS i FROM a WHERE id IS NOT NULL GROUP BY r, sid, seen, id),
p AS (SELECT sid, id, seen, lag(id) OVER (PARTITION BY r ORDER BY i) AS up FROM f),
n AS (SELECT sid, id, up, t FROM (SELECT *, min(seen) OVER (PARTITION BY sid, id) AS t, row_number() OVER (PARTITION BY sid, id ORDER BY seen DESC NULLS LAST, up DESC NULLS LAST) AS k FROM p) WHERE k = 1),
d AS (SELECT sid, id, t, 0 AS depth FROM n WHERE up IS NULL UNION ALL SELECT n.sid, n.id, n.t, d.depth + 1 FROM d JOIN n ON n.sid = d.sid AND n.up = d.id)
SELECT n.sid AS session_id, n.id AS bubble_id, d.id IS NULL AS cyclic, CASE WHEN d.id IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY n.sid, d.id IS NULL ORDER BY d.depth, d.t NULLS LAST, n.id) - 1 AS INT) END AS pos
FROM n LEFT JOIN d ON d.sid = n.sid AND d.id = n.id"""

_P3 = """
WITH t AS (SELECT id, lower(concat_ws(e'\\n', coalesce(any_value(title), ''), coalesce(any_value(body), ''), coalesce(array_to_string(any_value(tags), e'\\n'), ''))) AS x FROM memories WHERE id IS NOT NULL GROUP BY id),
w AS (SELECT id, unnest(list_distinct(list_concat(regexp_extract_all(x, '[a-z0-9_]+'), flatten(list_transform(regexp_extract_all(x, '[\\x{4e00}-\\x{9fff}]+'),
  lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substring(r, i, 2)) END))))) AS word FROM t),
n AS (SELECT id, count(*) AS n FROM w GROUP BY id),
m AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS common FROM w a JOIN w b ON a.word = b.word AND a.id < b.id GROUP BY 1, 2)
SELECT id_a, id_b FROM m JOIN n p ON p.id = id_a JOIN n q ON q.id = id_b WHERE common * 10 >= (p.n + q.n - common) * 7"""

_GROUPS = _P3[: _P3.rindex("SELECT")] + """, k AS (SELECT id, md5(string_agg(word, ' ' ORDER BY word)) AS key FROM w GROUP BY id),
c AS (SELECT id, min(id) OVER (PARTITION BY key) AS class_id FROM k),
l AS (SELECT id_a, id_b FROM m JOIN n p ON p.id = id_a JOIN n q ON q.id = id_b WHERE common * 10 >= (p.n + q.n - common) * 7),
e AS (SELECT a.class_id AS x, b.class_id AS y FROM l JOIN c a ON a.id = id_a JOIN c b ON b.id = id_b WHERE a.class_id <> b.class_id),
f AS (SELECT x, count(DISTINCT y) AS links FROM (SELECT x, y FROM e UNION ALL SELECT y, x FROM e) GROUP BY x)
SELECT c.id, class_id, coalesce(links, 0) AS links FROM c LEFT JOIN f ON f.x = class_id"""


@query("p2_found", _P2)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.rebuild(table(spark, sf_dir, "cursor_disk_kv"))


@query("p2_conversations")
def p2_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.conversation_parts(table(spark, sf_dir, "cursor_disk_kv"))


@query("p2_order", _ORDER)
def p2_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message that any snapshot lists, branches that later ones gave up among them, in the order of the reply graph."""
    return conversations.order_replies(conversations.reply_graph(table(spark, sf_dir, "cursor_disk_kv")), "session_id", "bubble_id", "parent", "seen_at")


@query("p6_ids")
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_column(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.stuffed_pages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "page_labels"))


@query("p8_scores")
def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = stuffing.fit(documents, table(spark, sf_dir, "page_labels"))
    if model is None:
        raise ValueError("the labels lack pages of one kind")
    return stuffing.page_scores(documents, model)


@query("p3_found", _P3)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.similar_notes(table(spark, sf_dir, "memories"))


@query("p3_groups", _GROUPS)
def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.note_groups(table(spark, sf_dir, "memories"))


@query("p7_mix")
def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


@query("p7_ids")
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.unpacked(p7_mix(spark, sf_dir), tokens.width())


@query("p7_shares")
def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def _secret_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(texts.units(table(spark, sf_dir, "sessions"), table(spark, sf_dir, "memories"), table(spark, sf_dir, "tasks")), "units")


@query("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(_secret_units(spark, sf_dir))


@query("p4_redacted")
def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.redact(_secret_units(spark, sf_dir))


def _personal_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(texts.units(table(spark, sf_dir, "sessions"), table(spark, sf_dir, "memories")), "units")


@query("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.items(_personal_units(spark, sf_dir), table(spark, sf_dir, "name_list"))
    return found.select("src", "record_id", "msg_pos", "pii_type", "nth")


@query("p1_redacted")
def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.redact(_personal_units(spark, sf_dir), table(spark, sf_dir, "name_list"))
