"""Registered queries of the core, each over its whole tables, with the equivalent SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.functions import cleaning, text
from lorekeep.operators import bm25, delivery, notes, recall, sessions, topics
from lorekeep.session import shared_dir, table, written
from lorekeep.sources import chatlogs, markdown

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_KEYED = """
WITH t AS (
  SELECT delivery_id, lower(regexp_replace(sessionId, '^\\s+|\\s+$', '', 'g')) AS session_id,
         CASE WHEN regexp_matches(lastUpdatedAt, '^[0-9]+$') THEN epoch_ms(CAST(lastUpdatedAt AS BIGINT))
              WHEN regexp_matches(lastUpdatedAt, '([zZ]|[+-][0-9]{2}:?[0-9]{2})$') AND regexp_matches(lastUpdatedAt, '[T ][0-9]')
                THEN CAST(CAST(lastUpdatedAt AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS TIMESTAMP)
              ELSE CAST(lastUpdatedAt AS TIMESTAMP) END AS u,
         CASE WHEN regexp_matches(createdAt, '^[0-9]+$') THEN epoch_ms(CAST(createdAt AS BIGINT))
              WHEN regexp_matches(createdAt, '([zZ]|[+-][0-9]{2}:?[0-9]{2})$') AND regexp_matches(createdAt, '[T ][0-9]')
                THEN CAST(CAST(createdAt AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS TIMESTAMP)
              ELSE CAST(createdAt AS TIMESTAMP) END AS c,
         status, batch_date, coalesce(len(conversation), 0) AS n_messages, ide, name, workspace, createdAt, lastUpdatedAt, conversation
  FROM sessions),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY coalesce(u, c) DESC NULLS LAST, delivery_id) AS rn
      FROM t WHERE session_id <> '')
"""


@query("p5_found", _KEYED + "SELECT session_id, delivery_id FROM r WHERE rn > 1")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.surplus_deliveries(table(spark, sf_dir, "sessions"))


@query("p5_sessions", _KEYED + "SELECT session_id, delivery_id, status, batch_date, n_messages FROM r WHERE rn = 1")
def p5_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of each session; ``n_messages`` stands for the conversation so that the rows can be compared by hash."""
    kept = delivery.latest_sessions(table(spark, sf_dir, "sessions"))
    return kept.selectExpr("session_id", "delivery_id", "status", "batch_date", "cast(if(conversation is null, 0, size(conversation)) as bigint) as n_messages")


# --- search -----------------------------------------------------------------------------------------------------------

SEARCH = "timeout of the connection pool 连接池 缓存"
AS_OF = "2026-07-01 00:00:00"
_STOP = ", ".join(f"'{x}'" for x in text.STOP_PAIRS)
_TOKENS = f"""
list_concat(regexp_extract_all(lower(coalesce({{0}}, '')), '[A-Za-z0-9_\\-]+'),
  flatten(list_transform(regexp_extract_all(lower(coalesce({{0}}, '')), '[\\x{{{{4e00}}}}-\\x{{{{9fff}}}}]+'),
    lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_concat(
      list_filter(list_transform(range(1, length(r)), lambda i: substring(r, i, 2)), lambda p: p NOT IN ({_STOP})), [right(r, 1)]) END)))"""
_DOCS = "SELECT doc_id, coalesce(source, '') AS scope, " + _TOKENS.format("text") + " AS t FROM documents"
_NOTE = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file_mtime DESC NULLS LAST, body DESC NULLS LAST) AS one_n
  FROM memories WHERE id IS NOT NULL) WHERE one_n = 1"""


def _bm25(base: str, q: str) -> str:
    """SQL of the scores of ``base`` (doc_id, scope, t) for a query."""
    return f"""
WITH base AS ({base}),
q AS (SELECT unnest({_TOKENS.format("'" + q + "'")}) AS term),
dl AS (SELECT scope, count(*) AS n, avg(len(t)) AS avgdl FROM base GROUP BY scope),
df AS (SELECT scope, term, count(*) AS df FROM (SELECT scope, unnest(list_distinct(t)) AS term FROM base) GROUP BY scope, term),
idf AS (SELECT scope, term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df JOIN dl USING (scope)),
mean AS (SELECT scope, avg(idf) AS mean FROM idf GROUP BY scope),
tf AS (SELECT b.doc_id, b.scope, q.term, len(list_filter(b.t, lambda x: x = q.term)) AS f, len(b.t) AS len FROM base b, q),
s AS (SELECT tf.scope, tf.doc_id AS key, sum(CASE WHEN f = 0 THEN 0 ELSE
        (CASE WHEN i.idf < 0 THEN 0.25 * m.mean ELSE i.idf END) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * tf.len / dl.avgdl)) END) AS bm25
      FROM tf JOIN dl USING (scope) LEFT JOIN idf i ON i.scope = tf.scope AND i.term = tf.term LEFT JOIN mean m ON m.scope = tf.scope GROUP BY tf.scope, tf.doc_id)"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("bm25_scores", _bm25(_DOCS, SEARCH) + " SELECT scope, key, round(bm25, 4) AS bm25 FROM s")
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.scores(_documents(spark, sf_dir), SEARCH, "source", "doc_id", "text").withColumn("bm25", F.round("bm25", 4) + 0.0)


@query(
    "bm25_topk",
    _bm25(_DOCS, SEARCH) + """,
r AS (SELECT *, CASE WHEN min(bm25) OVER (PARTITION BY scope) < 0 THEN 1 - min(bm25) OVER (PARTITION BY scope) ELSE 0 END AS shift,
             row_number() OVER (PARTITION BY scope ORDER BY round(bm25, 9) DESC, key) AS rank FROM s)
SELECT scope, key, round(bm25, 4) AS bm25, round(shift, 4) AS shift, rank FROM r WHERE rank <= 300 AND abs(bm25) >= 1e-9 AND rank <= 5""",
)
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = bm25.scores(_documents(spark, sf_dir), SEARCH, "source", "doc_id", "text")
    return bm25.candidates(scored).where("rank <= 5").select("scope", "key", F.round("bm25", 4).alias("bm25"), (F.round("shift", 4) + 0.0).alias("shift"), F.col("rank").cast("bigint").alias("rank"))


@query("bm25_index", SQL["bm25_topk"].replace(" AND rank <= 5", ""))
def bm25_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates from an index built for this call; a store keeps its own."""
    index = bm25.Index.build(_documents(spark, sf_dir), "source", "doc_id", "text", f"{shared_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}")
    return index.candidates(SEARCH).select("scope", "key", F.round("bm25", 4).alias("bm25"), (F.round("shift", 4) + 0.0).alias("shift"), F.col("rank").cast("bigint").alias("rank"))


@query(
    "search_tokens",
    "SELECT doc_id, unnest(list_distinct(" + _TOKENS.format("text") + ")) AS term FROM documents",
)
def search_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("term"))


_AT = """CASE WHEN regexp_matches({0}, '^[0-9]+$') THEN epoch_ms(TRY_CAST({0} AS BIGINT))
 WHEN regexp_matches({0}, '([zZ]|[+-][0-9]{{2}}:?[0-9]{{2}})$') AND regexp_matches({0}, '[T ][0-9]') THEN TRY_CAST({0} AS TIMESTAMPTZ) AT TIME ZONE 'UTC'
 ELSE TRY_CAST({0} AS TIMESTAMP) END"""


def _recent(days: int) -> str:
    return f"SELECT * FROM (SELECT *, {_AT.format('ts')} AS seen_at FROM recall_events) WHERE seen_at IS NULL OR seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL {days} DAY"


_COUNTS = f"""SELECT id, sum(w) AS recalls FROM (
  SELECT unnest(hits) AS id, 1 AS w FROM ({_recent(30)}) WHERE event = 'search'
  UNION ALL SELECT id, 2 FROM ({_recent(30)}) WHERE event = 'read') WHERE id <> '' GROUP BY id"""


@query("recall_counts", f"SELECT id, CAST(recalls AS BIGINT) AS recalls FROM ({_COUNTS})")
def recall_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.recall_counts(table(spark, sf_dir, "recall_events"), AS_OF)


@query(
    "recall_stats",
    f"""WITH e AS ({_recent(90)})
SELECT count(*) FILTER (event = 'search') AS n_search, count(*) FILTER (event = 'read') AS n_read, count(*) FILTER (event = 'adopt') AS n_adopt,
 (SELECT count(DISTINCT id) FROM (SELECT unnest(hits) AS id FROM e WHERE event = 'search' UNION ALL SELECT id FROM e WHERE event IN ('read', 'adopt')) WHERE id <> '') AS n_active,
 CASE WHEN count(*) FILTER (event = 'search') > 0 THEN count(*) FILTER (event = 'read') / count(*) FILTER (event = 'search') ELSE 0.0 END AS adoption_rate FROM e""",
)
def recall_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.recall_stats(table(spark, sf_dir, "recall_events"), AS_OF, 90)


@query("top_hits", f"SELECT id, count(*) AS n FROM (SELECT unnest(hits) AS id FROM ({_recent(90)}) WHERE event = 'search') WHERE id <> '' GROUP BY id ORDER BY n DESC, id LIMIT 10")
def top_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.top_hits(table(spark, sf_dir, "recall_events"), AS_OF, 90)


_AGED = f"""CASE WHEN source IN ('manual', 'edited') THEN 1.0 WHEN coalesce(CASE WHEN _mtime_at_write > 0 AND NOT isnan(_mtime_at_write) THEN _mtime_at_write END, file_mtime) IS NULL THEN 1.0
 ELSE greatest(0.5, pow(0.5, greatest((epoch(TIMESTAMP '{AS_OF}') - coalesce(CASE WHEN _mtime_at_write > 0 AND NOT isnan(_mtime_at_write) THEN _mtime_at_write END, file_mtime)) / 86400.0, 0) / 90.0)
   * least(1.5, 1 + coalesce(recalls, 0) * 0.1)) END"""


@query("decay_weights", f"WITH c AS ({_COUNTS}), n AS ({_NOTE}) SELECT n.id, round({_AGED}, 6) AS decay FROM n LEFT JOIN c USING (id)")
def decay_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = recall.one_of_each(table(spark, sf_dir, "memories")).join(recall.recall_counts(table(spark, sf_dir, "recall_events"), AS_OF), "id", "left")
    aged = recall.decay(F.col("source"), F.col("_mtime_at_write"), F.col("file_mtime"), F.col("recalls"), AS_OF)
    return notes.select("id", F.round(aged, 6).alias("decay"))


_PROJECT = "git.brindle.example/core/ledger-hub"
_OWN = f"SELECT id AS doc_id, CASE WHEN scope = 'project' THEN coalesce(project_key, '') ELSE 'personal' END AS scope, {_TOKENS.format('body')} AS t FROM ({_NOTE}) WHERE NOT coalesce(archived, false)"
_WORDS = "list_distinct(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+'))"
_TITLE = "trim(regexp_extract(coalesce(body, ''), '(?m)^[ \\t]*#[ \\t]+(\\S[^\\n\\r]*)$', 1))"
NOTE_QUERY = "redis cache timeout retry"


@query(
    "weighted_recall",
    _bm25(_OWN, NOTE_QUERY) + f""",
r AS (SELECT *, CASE WHEN min(bm25) OVER (PARTITION BY scope) < 0 THEN 1 - min(bm25) OVER (PARTITION BY scope) ELSE 0 END AS shift,
             row_number() OVER (PARTITION BY scope ORDER BY round(bm25, 9) DESC, key) AS rank FROM s),
c AS ({_COUNTS}),
n AS (SELECT r.bm25, r.shift, r.scope AS own, m.*, c.recalls, r.scope <> 'personal' AND r.scope <> '{_PROJECT}' AS other, {_WORDS.format(_TITLE)} AS tw, {_WORDS.format("'" + NOTE_QUERY + "'")} AS qw
      FROM r JOIN ({_NOTE}) m ON m.id = r.key LEFT JOIN c ON c.id = m.id WHERE rank <= 300 AND abs(bm25) >= 1e-9)
SELECT id, own AS scope, round(bm25, 3) AS bm25, round({_AGED}, 3) AS decay,
 round((bm25 + shift) * CASE value WHEN 'high' THEN 1.5 WHEN 'low' THEN 0.5 ELSE 1.0 END * CASE source WHEN 'manual' THEN 1.3 WHEN 'edited' THEN 1.2 ELSE 1.0 END
  * CASE WHEN len(potentially_superseded_by) > 0 THEN 0.6 ELSE 1.0 END * CASE WHEN other THEN 0.7 ELSE 1.0 END * {_AGED}, 3) AS score
FROM n WHERE NOT other OR len(list_intersect(list_distinct(list_transform(coalesce(tags, []), lambda t: lower(t))), ['redis', 'cache', 'timeout', 'retry'])) >= 2
 OR (len(tw) > 0 AND len(list_intersect(tw, qw)) / (len(tw) + len(qw) - len(list_intersect(tw, qw))) > 0.30)
ORDER BY score DESC, id LIMIT 20""",
)
def weighted_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.search(table(spark, sf_dir, "memories"), table(spark, sf_dir, "recall_events"), NOTE_QUERY, _PROJECT, AS_OF, 20)


@query("grep_hits", "SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'retries', ''))) / 7 AS INT) AS hits FROM documents WHERE contains(lower(text), 'retries')")
def grep_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.line_hits(_documents(spark, sf_dir), "retries", "doc_id", "text")


@query(
    "snippet_lines",
    """WITH l AS (SELECT doc_id, generate_subscripts(string_split_regex(text, '\\r\\n|[\\n\\x0b\\f\\r\\x{85}\\x{2028}\\x{2029}]'), 1) AS i,
 lower(unnest(string_split_regex(text, '\\r\\n|[\\n\\x0b\\f\\r\\x{85}\\x{2028}\\x{2029}]'))) AS line FROM documents WHERE text IS NOT NULL),
c AS (SELECT *, contains(line, 'connection pool') AS whole, CAST(contains(line, 'connection') AS INT) + CAST(contains(line, 'pool') AS INT) AS n FROM l)
SELECT doc_id, CAST(coalesce(min(i) FILTER (whole), arg_min(i, i - 1000000 * n) FILTER (n > 0 AND n = mx)) AS BIGINT) AS line
FROM (SELECT *, max(n) OVER (PARTITION BY doc_id) AS mx FROM c) GROUP BY doc_id HAVING max(n) > 0""",
)
def snippet_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).where("text is not null").select("doc_id", text.snippet_line("connection pool", F.col("text")).alias("line")).where("line is not null")


_QUERIES = "SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 20 = 0"


@query("cosine_topk", f"WITH q AS ({_QUERIES}), s AS (SELECT query_id, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), e), 4) AS cosine FROM embeddings, q) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) <= 20")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest rows of every row whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings")
    return recall.nearest(rows, rows.where("vec_id % 20 = 0"), "vec_id", "embedding", 20)


@query(
    "fused_rerank",
    _bm25(_DOCS, SEARCH) + f""",
qe AS ({_QUERIES}),
top AS (SELECT key, bm25 FROM s WHERE abs(bm25) >= 1e-9 ORDER BY round(bm25, 9) DESC, key LIMIT 50),
j AS (SELECT query_id, key, bm25, coalesce(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), e), 0) AS cosine FROM top LEFT JOIN embeddings v ON v.vec_id = top.key, qe),
f AS (SELECT query_id, key, round(0.3 * (bm25 - min(bm25) OVER ()) / (CASE WHEN max(bm25) OVER () = min(bm25) OVER () THEN 1 ELSE max(bm25) OVER () - min(bm25) OVER () END) + 0.7 * cosine, 4) AS final_score FROM j)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, key) AS INT) AS rank FROM f""",
)
def fused_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 candidates of the search, ranked anew against every row whose id is divisible by 20."""
    scored = bm25.scores(_documents(spark, sf_dir), SEARCH, "source", "doc_id", "text").where("abs(bm25) >= 1e-9")
    vectors = table(spark, sf_dir, "embeddings")
    top = scored.orderBy(F.round("bm25", 9).desc(), "key").limit(50)
    top = written(top.join(vectors, top["key"] == vectors["vec_id"], "left").select("key", "bm25", "embedding"), "candidates")
    return recall.rerank(top, vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked")))


# --- sessions ---------------------------------------------------------------------------------------------------------

_LATEST = _KEYED + ", k AS (SELECT * FROM r WHERE rn = 1)"
_MSG = _LATEST + """, m AS (SELECT session_id, pos, role, coalesce(content, '') AS content FROM (
  SELECT session_id, unnest(range(len(conversation))) AS pos, unnest(conversation).role AS role, unnest(conversation).content AS content FROM k WHERE len(conversation) > 0))"""
_SP = "[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{0b}]"


def _stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{_SP}+|{_SP}+$', '', 'g')"


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.latest_sessions(table(spark, sf_dir, "sessions"))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.messages(_latest(spark, sf_dir))


IDES = ["aone-copilot", "claude-code", "cursor", "qoder", "vscode"]


@query(
    "batch_stats",
    _LATEST + """, s AS (SELECT ide, count(*) AS sessions, sum(coalesce(list_sum(list_transform(conversation, lambda m: length(coalesce(m.content, '')))), 0)) AS characters FROM k GROUP BY ide)
SELECT ide, coalesce(sessions, 0) AS sessions, CAST(coalesce(characters, 0) AS BIGINT) AS characters, coalesce(characters, 0) > 80000 AS map_reduce
FROM (SELECT unnest(['aone-copilot', 'claude-code', 'cursor', 'qoder', 'vscode']) AS ide) FULL JOIN s USING (ide)""",
)
def batch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.batch_stats(_latest(spark, sf_dir), IDES)


@query("workspace_sessions", _LATEST + " SELECT coalesce(nullif(workspace, ''), 'unknown') AS workspace, count(*) AS sessions, min(c) AS first_at, max(c) AS last_at FROM k GROUP BY 1")
def workspace_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sessions.workspace_positions(_latest(spark, sf_dir), "session_id")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_at", "last_at")})


def _untooled(x: str) -> str:
    for tag in ("tool_use", "tool_call", "function_call"):
        x = f"regexp_replace({x}, '(?s)<{tag}[^>]*>.*?</{tag}>', '', 'g')"
    for mark in sessions.MARKERS:
        x = f"replace({x}, '{mark}', '')"
    return _stripped(f"regexp_replace({x}, '(?is)```(?:json|xml)\\s*\\n\\s*[\"'']?tool_calls[\"'']?\\s*[:=].*?```', '', 'g')")


_NOISE = _MSG + f""", a AS (SELECT session_id, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS a,
  coalesce(sum(length(content)) FILTER (role = 'user'), 0) AS uc, coalesce(sum(length(content)) FILTER (role = 'assistant'), 0) AS ac,
  coalesce(sum(length({_untooled('content')})) FILTER (role = 'assistant'), 0) AS tc,
  arg_max(regexp_matches(content, '(?i)\\b(I cannot|I can''t|I''m sorry|I am sorry|I''m unable|I am unable|refuse|cannot help|cannot assist)\\b')
    OR regexp_matches(content, '(?:^|[^\\p{{L}}\\p{{N}}_])(无法回答|无法满足|不便回答|抱歉.{{0,5}}(无法|不能|不便))'), pos) FILTER (role = 'assistant') AS refused
  FROM m GROUP BY session_id),
d AS (SELECT session_id, max(n) AS most FROM (SELECT session_id, {_stripped('content')} AS t, count(*) AS n FROM m WHERE role = 'user' GROUP BY 1, 2) WHERE length(t) >= 20 GROUP BY session_id),
n AS (SELECT a.session_id, CASE WHEN u = 0 OR a = 0 THEN 'no-real-interaction' WHEN uc < 10 THEN 'user-input-too-short'
  WHEN (CASE WHEN ac = 0 THEN 0 ELSE tc / ac END) < 0.10 THEN 'all-tool-calls-no-thinking' WHEN coalesce(most, 0) >= 3 THEN 'repeated-stuck-pattern'
  WHEN refused AND u = a THEN 'refused-no-followup' END AS reason FROM a LEFT JOIN d USING (session_id))"""


@query("noise_reasons", _NOISE + " SELECT * FROM n")
def noise_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.noise(_messages(spark, sf_dir))


@query("noise_histogram", _NOISE + " SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM n GROUP BY 1")
def noise_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise_reasons(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def _cleaned(x: str, least: int) -> str:
    """RE2 has no repeats of more than 1000, so the SQL is for a smaller bound only."""
    for pattern, note in cleaning._noise(least):
        x = f"regexp_replace({x}, '{pattern}', '{note}', 'g')"
    return _stripped(f"regexp_replace({x}, '\\n{{3,}}', e'\\n\\n', 'g')")


@query("clean_messages", _MSG + f" SELECT session_id, CAST(pos AS INT) AS pos, md5({_cleaned('content', 60)}) AS digest FROM m")
def clean_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a bound of 60 characters, so that short blocks are cut too; see ``pair_filter`` for the usual one."""
    return _messages(spark, sf_dir).select("session_id", "pos", F.md5(cleaning.clean(F.col("content"), 60)).alias("digest"))


_KW = ", ".join("'" + k + "'" for k in cleaning.KEYWORDS)
_PAIRS = _MSG + f""", c AS (SELECT session_id, pos, role, {_cleaned('content', 1000).replace('{1000,}', '{1000}[\\s\\S]{1000}[\\s\\S]{1000}[\\s\\S]{1000}[\\s\\S]{1000,}')} AS content FROM m),
e AS (SELECT *, role = 'user' AND {_stripped('content')} <> '' AND NOT regexp_matches({_stripped('content')}, '{cleaning.TRIVIAL.replace("(?iu)", "(?i)")}')
   AND (length({_stripped('content')}) >= 50 OR list_bool_or(list_transform([{_KW}], lambda k: contains({_stripped('content')}, k)))) AS core FROM c WHERE content <> ''),
f AS (SELECT *, lag(role) OVER w AS before, lag(core) OVER w AS led FROM e WINDOW w AS (PARTITION BY session_id ORDER BY pos)),
p AS (SELECT session_id, pos, role, content FROM f WHERE CASE WHEN role = 'user' THEN core WHEN role = 'assistant' AND before = 'user' THEN led ELSE length(content) > 100 END)"""


@query("pair_filter", _PAIRS + " SELECT session_id, CAST(pos AS INT) AS pos, role, md5(content) AS digest FROM p")
def pair_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.pairs(_messages(spark, sf_dir)).select("session_id", "pos", "role", F.md5("content").alias("digest"))


@query(
    "budget_truncate",
    _PAIRS + f""", g AS (SELECT *, list_sum(list_transform([{_KW}], lambda k: CAST(contains(content, k) AS INT)))
  + CASE WHEN pos = min(pos) OVER (PARTITION BY session_id) OR pos = max(pos) OVER (PARTITION BY session_id) THEN 100 ELSE 0 END AS weight FROM p),
h AS (SELECT *, sum(length(content)) OVER (PARTITION BY session_id ORDER BY weight DESC, pos ROWS UNBOUNDED PRECEDING) AS total FROM g),
i AS (SELECT *, total - length(content) AS before FROM h)
SELECT session_id, CAST(pos AS INT) AS pos, role, md5(CASE WHEN total <= 1000 THEN content ELSE left(content, CAST(1000 - before AS INT)) || '...[已截断]' END) AS digest
FROM i WHERE total <= 1000 OR (before <= 1000 AND 1000 - before > 200)""",
)
def budget_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a budget of 1000 characters: hardly any session here reaches the usual one."""
    return sessions.truncate(sessions.pairs(_messages(spark, sf_dir)), 1000).select("session_id", "pos", "role", F.md5("content").alias("digest"))


def _redacted_sql(x: str) -> tuple[str, dict[str, str]]:
    counts = {}
    for kind, pattern, keep in cleaning.SECRETS:
        p = pattern.replace("'", "''")
        counts[kind] = f"len(regexp_extract_all({x}, '{p}'))"
        x = f"regexp_replace({x}, '{p}', '{chr(92) + '1' if keep else ''}<REDACTED:{kind}>', 'g')"
    return x, counts


_RED, _REDC = _redacted_sql("content")


@query("redact_messages", _MSG + f" SELECT session_id, CAST(pos AS INT) AS pos, md5({_RED}) AS digest FROM m")
def redact_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = cleaning.redacted(F.col("content"))
    return _messages(spark, sf_dir).select("session_id", "pos", F.md5(out).alias("digest"))


@query("redact_counts", _MSG + " SELECT " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {k}" for k, c in _REDC.items()) + " FROM m")
def redact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, counts = cleaning.redacted(F.col("content"))
    return _messages(spark, sf_dir).agg(*(F.sum(c).alias(k) for k, c in counts.items()))


_FROM, _TO = "2026-02-01 00:00:00", "2026-02-28 23:59:59"


@query("two_point_window", _LATEST + f" SELECT session_id FROM k WHERE c BETWEEN '{_FROM}' AND '{_TO}' OR coalesce(u, c) BETWEEN '{_FROM}' AND '{_TO}'")
def two_point_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.touched(_latest(spark, sf_dir), _FROM, _TO).select("session_id")


@query("overlap_window", _LATEST + f" SELECT session_id FROM k WHERE least(c, coalesce(u, c)) <= '{_TO}' AND greatest(c, coalesce(u, c)) >= '{_FROM}'")
def overlap_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.overlapping(_latest(spark, sf_dir), _FROM, _TO).select("session_id")


@query(
    "sessions_per_day",
    _LATEST + " SELECT CAST(d AS DATE) AS day, count(k.session_id) AS sessions FROM range(TIMESTAMP '2026-01-01', TIMESTAMP '2026-07-01', INTERVAL 1 DAY) t(d) LEFT JOIN k ON CAST(k.c AS DATE) = CAST(d AS DATE) GROUP BY 1",
)
def sessions_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.per_day(_latest(spark, sf_dir), "2026-01-01", "2026-06-30")


@query("session_names", _LATEST + " SELECT k.session_id, coalesce(left(nullif(k.name, ''), 80), '会话 ' || left(s.sessionId, 8)) AS name FROM k JOIN sessions s ON s.delivery_id = k.delivery_id")
def session_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = _latest(spark, sf_dir)
    return latest.select("session_id", sessions.display_name(latest).alias("name"))


@query(
    "session_prompts",
    _MSG + f" SELECT session_id, CAST(pos // 2000 AS BIGINT) AS part, md5(string_agg('[' || pos || '] ' || coalesce(role, 'unknown') || ': ' || {_RED}, e'\\n\\n' ORDER BY pos)) AS digest FROM m GROUP BY 1, 2",
)
def session_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.prompt(_messages(spark, sf_dir)).select("session_id", "part", F.md5("prompt").alias("digest"))


# --- notes ------------------------------------------------------------------------------------------------------------


@query("note_list", f"SELECT id, scope, value, source FROM ({_NOTE}) WHERE NOT coalesce(archived, false) AND scope = 'project' AND value = 'high' AND created >= '2026-03-01'")
def note_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = recall.one_of_each(table(spark, sf_dir, "memories"))
    return notes.listed(own, scope="project", value="high", since="2026-03-01").select("id", "scope", "value", "source")


@query(
    "note_stats",
    f"""WITH n AS ({_NOTE}) SELECT 'scope' AS dimension, scope AS key, count(*) AS n FROM n GROUP BY scope
UNION ALL SELECT 'source', source, count(*) FROM n GROUP BY source UNION ALL SELECT 'value', value, count(*) FROM n GROUP BY value
UNION ALL SELECT 'flag', 'conflicts', count(*) FROM n WHERE len(potential_conflicts) > 0 UNION ALL SELECT 'flag', 'superseded', count(*) FROM n WHERE len(potentially_superseded_by) > 0""",
)
def note_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = recall.one_of_each(table(spark, sf_dir, "memories"))
    return notes.stats(own).unionByName(notes.flags(own))


_CONFLICTS = f"""WITH n AS (SELECT id, scope, CASE WHEN scope = 'project' THEN coalesce(project_key, '') ELSE '' END AS p, created,
  list_distinct(list_transform(coalesce(tags, []), lambda t: lower(t))) AS g, {_WORDS.format("coalesce(title, '')")} AS w FROM ({_NOTE}) WHERE NOT coalesce(archived, false)),
c AS (SELECT a.id, b.id AS other, coalesce(a.created, '') AS c, coalesce(b.created, '') AS oc FROM n a JOIN n b ON a.scope = b.scope AND a.p = b.p AND a.id <> b.id
  WHERE len(list_intersect(a.g, b.g)) >= 2
   OR (len(a.w) > 0 AND len(b.w) > 0 AND len(list_intersect(a.w, b.w)) * 5 >= (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) * 2))"""


@query("note_conflicts", _CONFLICTS + " SELECT id, other FROM c")
def note_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.conflicts(recall.one_of_each(table(spark, sf_dir, "memories")))


@query("superseded_by", _CONFLICTS + " SELECT id, array_to_string(list_sort(list(other)), ' ') AS superseded_by FROM c WHERE oc > c OR (oc = c AND other > id) GROUP BY id")
def superseded_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.superseded(recall.one_of_each(table(spark, sf_dir, "memories"))).select("id", F.array_join("superseded_by", " ").alias("superseded_by"))


@query(
    "inactive_notes",
    f"""WITH e AS ({_recent(90)}), a AS (SELECT unnest(hits) AS id FROM e UNION SELECT id FROM e WHERE id IS NOT NULL)
SELECT id, CAST(date_diff('day', TRY_CAST(created AS DATE), DATE '2026-07-01') AS INT) AS age FROM ({_NOTE}) n
WHERE NOT coalesce(archived, false) AND source IN ('auto', 'bootstrap') AND date_diff('day', TRY_CAST(created AS DATE), DATE '2026-07-01') >= 90 AND id NOT IN (SELECT id FROM a WHERE id IS NOT NULL)""",
)
def inactive_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.inactive(recall.one_of_each(table(spark, sf_dir, "memories")), table(spark, sf_dir, "recall_events"), AS_OF)


@query("source_upgrade", f"SELECT id, CASE WHEN source IN ('auto', 'bootstrap') AND _mtime_at_write > 0 AND NOT isnan(_mtime_at_write) AND file_mtime > _mtime_at_write + 5 THEN 'edited' ELSE source END AS source FROM ({_NOTE})")
def source_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = recall.one_of_each(table(spark, sf_dir, "memories"))
    return own.select("id", notes.source_now(own).alias("source"))


@query("citations", f"""SELECT id, concat_ws(' · ', nullif(origin.ide, ''), substring(coalesce(nullif(origin.distilled_at, ''), nullif(origin.remembered_at, ''), nullif(created, '')), 1, 10),
 CASE WHEN coalesce(origin.session_id, '') <> '' THEN 'session ' || left(origin.session_id, 6) || '..' END) AS citation FROM ({_NOTE})""")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = recall.one_of_each(table(spark, sf_dir, "memories"))
    return own.select("id", notes.citation(own).alias("citation"))


_BUCKETS = f"""WITH n AS (SELECT *, CASE WHEN source IN ('manual', 'edited') THEN 0 WHEN value = 'high' THEN 1 WHEN value = 'medium' THEN 2 END AS bucket FROM ({_NOTE}) WHERE scope = 'project' AND NOT coalesce(archived, false)),
b AS (SELECT *, row_number() OVER (PARTITION BY project_key, bucket ORDER BY coalesce(nullif(updated, ''), created) DESC NULLS LAST, id) AS rank FROM n WHERE bucket IS NOT NULL),
d AS (SELECT *, coalesce(nullif({_stripped("coalesce(extra['summary'], '')")}, ''), left(list_filter(list_transform(string_split_regex(coalesce(body, ''), '\\r\\n|[\\n\\x0b\\f\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: {_stripped('x')}), lambda x: x <> '' AND NOT starts_with(x, '#'))[1], 100)) AS descr FROM b WHERE bucket = 0 OR rank <= 10),
l AS (SELECT project_key, bucket, rank, '- **' || left(coalesce(nullif(title, ''), id), 60) || '**' || CASE WHEN coalesce(descr, '') = '' THEN '' ELSE ' — ' || CASE WHEN length(descr) > 100 THEN left(descr, 97) || '...' ELSE descr END END AS line FROM d)"""


@query("project_lines", _BUCKETS + " SELECT project_key, CAST(bucket AS INT) AS bucket, CAST(rank AS INT) AS rank, line FROM l")
def project_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.buckets(recall.one_of_each(table(spark, sf_dir, "memories")))


@query("project_summaries", _BUCKETS + r""", t AS (SELECT project_key, string_agg(line, e'\n' ORDER BY bucket, rank) AS t FROM l GROUP BY project_key)
SELECT project_key, CASE WHEN length(t) > 4096 THEN left(t, 4076) || e'\n\n... (truncated)' ELSE t END AS summary FROM t""")
def project_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.summaries(recall.one_of_each(table(spark, sf_dir, "memories")))


@query(
    "compile_entries",
    f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY project_key ORDER BY CASE value WHEN 'high' THEN 0 WHEN 'low' THEN 2 ELSE 1 END, coalesce(nullif(updated, ''), created) NULLS FIRST, id) AS i, count(*) OVER (PARTITION BY project_key) AS n
 FROM ({_NOTE}) WHERE scope = 'project' AND NOT coalesce(archived, false))
SELECT project_key, CAST(i AS INT) AS i, n, md5('--- entry ' || i || '/' || n || ' (id=' || id || ', value=' || coalesce(value, '') || CASE WHEN source IN ('manual', 'edited') THEN ' [source=' || source || ']' ELSE '' END || e') ---\\n' || {_stripped("coalesce(body, '')")} || e'\\n') AS digest FROM n""",
)
def compile_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.compile_entries(recall.one_of_each(table(spark, sf_dir, "memories"))).select("project_key", "i", "n", F.md5("entry").alias("digest"))


@query("note_titles", f"SELECT id, {_TITLE} AS h1, trim(regexp_extract(coalesce(body, ''), '(?m)^[ \\t]*#+[ \\t]+(\\S[^\\n\\r]*)$', 1)) AS heading FROM ({_NOTE})")
def note_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = recall.one_of_each(table(spark, sf_dir, "memories"))
    return own.select("id", text.title(F.col("body")).alias("h1"), text.title(F.col("body"), any_depth=True).alias("heading"))


@query("note_slugs", f"SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace({_stripped('lower(title)')}, '[^A-Za-z0-9_\\s\\-]', '', 'g'), '\\s+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM ({_NOTE})")
def note_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.one_of_each(table(spark, sf_dir, "memories")).select("id", text.slug(F.col("title")).alias("slug"))


_INCOMING = f"SELECT id, 'auto' AS source, 'low' AS value, 'new ' || title AS title FROM ({_NOTE}) WHERE value = 'high' UNION ALL SELECT id || '-copy', 'auto', value, title FROM ({_NOTE}) WHERE value = 'low'"


@query(
    "protected_upsert",
    f"""WITH n AS (SELECT id, source, value, title FROM ({_NOTE})), i AS ({_INCOMING})
SELECT * FROM n WHERE source IN ('manual', 'edited') OR id NOT IN (SELECT id FROM i)
UNION ALL SELECT * FROM i WHERE id NOT IN (SELECT id FROM n WHERE source IN ('manual', 'edited'))""",
)
def protected_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = recall.one_of_each(table(spark, sf_dir, "memories")).select("id", "source", "value", "title")
    new = own.where("value = 'high'").selectExpr("id", "'auto' as source", "'low' as value", "concat('new ', title) as title")
    added = own.where("value = 'low'").selectExpr("concat(id, '-copy') as id", "'auto' as source", "value", "title")
    return notes.upsert(own, new.unionByName(added))


@query("task_queue", "SELECT task_id, coalesce(nullif(batch_date, ''), '0000-00-00') AS day, coalesce(any_value(created_at), '') AS created_at FROM tasks WHERE status = 'pending' AND task_id IS NOT NULL GROUP BY ALL")
def task_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.queue(table(spark, sf_dir, "tasks"))


_REMOTES = {"scp": "git@{0}:{1}.git", "https": "https://me:pw@{0}/{1}.git", "ssh": "ssh://git@{0}:2222/{1}", "git": "git://{0}/{1}.git/"}


@query(
    "remote_keys",
    """SELECT project_key, notation, CASE WHEN notation = 'git' THEN NULL ELSE lower(split_part(project_key, '/', 1)) || substring(project_key, length(split_part(project_key, '/', 1)) + 1) END AS key,
 regexp_replace(replace(project_key, '/', '_'), '[^A-Za-z0-9._\\-]', '_', 'g') AS directory FROM (SELECT DISTINCT project_key FROM memories WHERE project_key LIKE '%/%'), (SELECT unnest(['scp', 'https', 'ssh', 'git']) AS notation)""".replace("CASE WHEN notation = 'git' THEN NULL ELSE ", "").replace(" END AS key", " AS key"),
)
def remote_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every project key written as a remote in each notation and brought back."""
    own = table(spark, sf_dir, "memories").where("project_key like '%/%'").select("project_key").distinct()
    host, path = F.upper(F.substring_index("project_key", "/", 1)), F.expr("substring(project_key, instr(project_key, '/') + 1)")
    forms = F.array(*(F.struct(F.lit(k).alias("notation"), text.rendered(v, {"0": host, "1": path}).alias("url")) for k, v in _REMOTES.items()))
    return own.select("project_key", F.explode(forms).alias("r")).select("project_key", "r.notation", text.remote_key(F.col("r.url")).alias("key"), text.directory(F.col("project_key")).alias("directory"))


# --- sources and texts ------------------------------------------------------------------------------------------------


@query(
    "agent_messages",
    """WITH l AS (SELECT key, arg_max(value, snapshot_at) AS value FROM cursor_disk_kv GROUP BY key),
c AS (SELECT substring(key, 14) AS session_id FROM l WHERE key LIKE 'composerData:%' AND value IS NOT NULL),
a AS (SELECT key, TRY_CAST(value AS JSON) AS j FROM l WHERE key LIKE 'agentKv:blob:%')
SELECT session_id, key, j ->> '$.role' AS role, coalesce(nullif(j ->> '$.text', ''), j ->> '$.content') AS content
FROM a JOIN c ON contains(substring(a.key, 14), c.session_id)
WHERE j ->> '$.role' IN ('user', 'assistant') AND coalesce(nullif(j ->> '$.text', ''), j ->> '$.content') <> ''""",
)
def agent_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chatlogs.agent_messages(table(spark, sf_dir, "cursor_disk_kv"))


@query("kv_kinds", "SELECT CASE WHEN starts_with(key, 'composer.content.') THEN 'composer.content' ELSE split_part(key, ':', 1) END AS kind, count(*) AS n, count(DISTINCT key) AS keys FROM cursor_disk_kv GROUP BY 1")
def kv_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows by the kind of their key: what stands before the first colon, or the one prefix that no colon follows."""
    once = table(spark, sf_dir, "cursor_disk_kv").groupBy("key").agg(F.count("*").alias("n"))
    kind = F.when(F.col("key").startswith("composer.content."), "composer.content").otherwise(F.substring_index("key", ":", 1))
    return once.groupBy(kind.alias("kind")).agg(F.sum("n").alias("n"), F.count("*").alias("keys"))


_BACK = ("scope", "value", "source", "tags", "origin", "body")


@query("frontmatter_roundtrip", f"SELECT id, {', '.join(f'true AS same_{c}' for c in _BACK)} FROM ({_NOTE})")
def frontmatter_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes written as files' texts and read again: ``id`` and whether its fields came back."""
    own = recall.one_of_each(table(spark, sf_dir, "memories"))
    back = markdown.from_texts(markdown.as_texts(own)).select("id", F.struct("scope", "value", "source", "tags", "origin", "body").alias("b"))
    fields = [F.nullif(c, F.lit("")).alias(c) for c in ("scope", "value", "source")]
    mine = own.select("id", F.struct(*fields, F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "origin", F.ltrim(F.coalesce("body", F.lit("")), F.lit("\n")).alias("body")).alias("a"))
    return mine.join(back, "id").select("id", *((F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))).alias(f"same_{c}") for c in _BACK))


@query("marked_blocks", f"""SELECT doc_id, md5(CASE WHEN text IS NULL THEN e'<!-- a -->\\nlist\\n<!-- z -->\\n' ELSE text || CASE WHEN ends_with(text, e'\\n\\n') THEN '' WHEN ends_with(text, e'\\n') THEN e'\\n' ELSE e'\\n\\n' END || e'<!-- a -->\\nlist\\n<!-- z -->\\n' END) AS digest FROM documents""")
def marked_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block added to each text, then replaced by another of the same marks."""
    once = notes.with_block(F.col("text"), F.lit("old list"), "<!-- a -->", "<!-- z -->")
    return _documents(spark, sf_dir).select("doc_id", F.md5(notes.with_block(once, F.lit("list"), "<!-- a -->", "<!-- z -->")).alias("digest"))


@query("url_texts", "SELECT doc_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL")
def url_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts percent-encoded and decoded again."""
    coded = F.replace(F.url_encode("text"), F.lit("+"), F.lit("%20"))
    return _documents(spark, sf_dir).where("text is not null").select("doc_id", F.md5(text.url_text(coded)).alias("digest"))


@query(
    "topic_notes",
    f"""SELECT 'personal' AS scope, title, NULL AS project_key, CASE WHEN value IN ('high', 'low') THEN value ELSE 'medium' END AS value, array_to_string(list_slice(coalesce(tags, []), 1, 6), ' ') AS tags
FROM ({_NOTE}) WHERE scope <> 'project' AND value IS DISTINCT FROM 'low' UNION ALL SELECT CASE WHEN project_key IS NULL THEN 'personal' ELSE 'project' END, title, project_key, CASE WHEN value IN ('high', 'low') THEN value ELSE 'medium' END, array_to_string(list_slice(coalesce(tags, []), 1, 6), ' ') FROM ({_NOTE}) WHERE scope = 'project' AND value IS DISTINCT FROM 'low'""",
)
def topic_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = recall.one_of_each(table(spark, sf_dir, "memories")).withColumn("should_keep", F.when(F.col("value") == "low", False).when(F.col("value") == "high", True))
    made = topics.to_notes(topics.kept(own), "2026-07-01")
    return made.select("scope", "title", "project_key", "value", F.array_join("tags", " ").alias("tags"))


@query("best_of_each", "SELECT source, max(n_chars) AS n_chars, arg_min(doc_id, struct_pack(a := -n_chars, b := doc_id)) AS doc_id FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL GROUP BY source")
def best_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.best_of(_documents(spark, sf_dir).where("source is not null and n_chars is not null").select("doc_id", "source", "n_chars"), "source", "n_chars")


# --- what tools ask of the store --------------------------------------------------------------------------------------


@query("scope_notes", f"SELECT id FROM ({_NOTE}) WHERE scope = 'project' AND project_key = '{_PROJECT}'")
def scope_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.scopes(recall.one_of_each(table(spark, sf_dir, "memories")), "current_project", _PROJECT).select("id")


@query("resolved_note", f"SELECT id, title FROM ({_NOTE}) WHERE contains(lower(id), 'decision') OR contains(lower(coalesce(title, '')), 'decision') ORDER BY coalesce(nullif(updated, ''), created) DESC NULLS LAST, id LIMIT 1")
def resolved_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.resolved(recall.one_of_each(table(spark, sf_dir, "memories")), "Decision").select("id", "title")


@query("pending_sessions", _LATEST + f" SELECT session_id FROM k WHERE session_id NOT IN (SELECT origin.session_id FROM ({_NOTE}) WHERE origin.session_id IS NOT NULL)")
def pending_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that no note comes from."""
    done = table(spark, sf_dir, "memories").select(F.col("origin.session_id").alias("session_id")).where("session_id is not null")
    return notes.pending(_latest(spark, sf_dir), done).select("session_id")


@query("archived_notes", f"SELECT id, coalesce(archived, false) OR value = 'low' AS archived FROM ({_NOTE})")
def archived_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = recall.one_of_each(table(spark, sf_dir, "memories"))
    return notes.archived(own, own.where("value = 'low'")).select("id", F.coalesce("archived", F.lit(False)).alias("archived"))


_SAID = f"SELECT task_id, {_stripped(_redacted_sql('prompt')[0])} AS body, project_key FROM (SELECT task_id, any_value(prompt) AS prompt, any_value(nullif(project_key, 'null')) AS project_key FROM tasks WHERE task_id IS NOT NULL GROUP BY task_id)"


@query(
    "remembered_notes",
    f"""WITH b AS (SELECT *, string_split_regex(body, '\\r\\n|[\\n\\x0b\\f\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]')[1] AS line FROM ({_SAID}) WHERE body <> ''),
t AS (SELECT *, CASE WHEN starts_with(line, '#') THEN {_stripped("regexp_replace(line, '^#+', '')")} ELSE coalesce(nullif({_stripped('left(line, 30)')}, ''), 'memory') END AS title FROM b)
SELECT CASE WHEN coalesce(project_key, '') <> '' THEN 'project' ELSE 'personal' END AS scope, nullif(project_key, '') AS project_key, title, md5(CASE WHEN starts_with(line, '#') THEN body ELSE '# ' || title || e'\\n\\n' || body END) AS digest FROM t""",
)
def remembered_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task prompts taken as dictated notes."""
    prompts = table(spark, sf_dir, "tasks").where("task_id is not null").groupBy("task_id").agg(F.any_value("prompt").alias("body"), F.any_value(F.nullif("project_key", F.lit("null"))).alias("project_key"))
    made = notes.remembered(prompts.withColumns({"scope": F.lit("project"), "tags": F.lit(None).cast("array<string>")}), "2026-07-01")
    return made.select("scope", "project_key", "title", F.md5("body").alias("digest"))


_CUT = ", ".join(f"try(decode(encode(text)[1:{60_000 - i}]))" for i in range(4))


@query("pages", f"SELECT doc_id, length(t) AS chars, octet_length(encode(t)) AS bytes, md5(t) AS digest FROM (SELECT doc_id, CASE WHEN octet_length(encode(text)) <= 60000 THEN text ELSE coalesce({_CUT}) END AS t FROM documents)")
def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a page, long ones cut."""
    out = _documents(spark, sf_dir).select("doc_id", notes.page(F.col("text")).alias("t"))
    return out.select("doc_id", F.length("t").cast("bigint").alias("chars"), F.octet_length("t").cast("bigint").alias("bytes"), F.md5("t").alias("digest"))
