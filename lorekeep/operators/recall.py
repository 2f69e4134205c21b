"""Feedback counts, decay, weighted recall and vector fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorekeep.functions.text import jaccard, title, words
from lorekeep.functions.times import instant
from lorekeep.operators import bm25
from lorekeep.session import written

# Weights, half-life in days, floor, and the boost of recalls within so many days.
VALUE_WEIGHT = {"high": 1.5, "medium": 1.0, "low": 0.5}
SOURCE_WEIGHT = {"manual": 1.3, "edited": 1.2, "auto": 1.0, "bootstrap": 1.0}
HALF_LIFE, FLOOR, BOOST, BOOST_CAP, BOOST_DAYS = 90.0, 0.5, 0.1, 1.5, 30
SUPERSEDED, CROSS = 0.6, 0.7
#: Most candidates that are ranked anew for each query.
MOST_CANDIDATES = 5_000


def recent(events: DataFrame, as_of: str, days: int) -> DataFrame:
    """Events of the last ``days`` days; those with an unreadable time stay."""
    at = instant(F.col("ts"))
    return events.where(at.isNull() | (at >= F.to_timestamp(F.lit(as_of)) - F.make_interval(days=F.lit(days))))


def recall_counts(events: DataFrame, as_of: str, days: int = BOOST_DAYS) -> DataFrame:
    """``id, recalls``: 1 for each search that hit a note, 2 for each time it was read; null and empty ids don't count."""
    window = recent(events, as_of, days)
    hits = window.where("event = 'search'").select(F.explode("hits").alias("id"), F.lit(1).alias("w"))
    reads = window.where("event = 'read'").select("id", F.lit(2).alias("w"))
    return hits.unionByName(reads).where("id is not null and id <> ''").groupBy("id").agg(F.sum("w").alias("recalls"))


def recall_stats(events: DataFrame, as_of: str, days: int) -> DataFrame:
    """One row: searches, reads, adoptions, the share of reads to searches, and the number of different active notes."""
    window = recent(events, as_of, days)
    n = lambda e: F.count(F.when(F.col("event") == e, 1))
    active = window.where("event = 'search'").select(F.explode("hits").alias("id")).unionByName(window.where("event in ('read', 'adopt')").select("id")).where("id is not null and id <> ''").distinct()
    sums = window.agg(n("search").alias("n_search"), n("read").alias("n_read"), n("adopt").alias("n_adopt"))
    both = sums.withColumn("__one", F.lit(1)).join(active.agg(F.count("*").alias("n_active")).withColumn("__one", F.lit(1)), "__one").drop("__one")
    return both.withColumn("adoption_rate", F.when(F.col("n_search") > 0, F.col("n_read") / F.col("n_search")).otherwise(0.0))


def top_hits(events: DataFrame, as_of: str, days: int, k: int = 10) -> DataFrame:
    """``id, n`` of the notes found most often."""
    hits = recent(events, as_of, days).where("event = 'search'").select(F.explode("hits").alias("id")).where("id is not null and id <> ''")
    return hits.groupBy("id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(k)


def decay(source: Column, written_at: Column, mtime: Column, recalls: Column, as_of: str, half_life: float = HALF_LIFE, floor: float = FLOOR) -> Column:
    """Weight of a note's age; recalls slow it down. Notes people wrote or edited keep 1."""
    now = F.unix_micros(F.to_timestamp(F.lit(as_of))) / 1e6
    at = F.when(written_at > 0, F.nanvl(written_at, mtime)).otherwise(mtime)
    age = F.greatest((now - at) / 86400.0, F.lit(0.0))
    boost = F.least(F.lit(BOOST_CAP), 1.0 + F.coalesce(recalls, F.lit(0)) * BOOST)
    aged = F.greatest(F.lit(floor), F.pow(F.lit(0.5), age / half_life) * boost)
    return F.when(source.isin("manual", "edited") | F.lit(half_life <= 0) | at.isNull(), 1.0).otherwise(aged)


def one_of_each(notes: DataFrame) -> DataFrame:
    """Notes without repeated ids: of the rows of an id the latest written, then the greatest body."""
    w = Window.partitionBy("id").orderBy(F.col("file_mtime").desc_nulls_last(), F.col("body").desc_nulls_last())
    return notes.where("id is not null").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def _weight(column: Column, table: dict[str, float]) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(column == k, v) if out is None else out.when(column == k, v)
    return out.otherwise(1.0)


def cross_match(query: str, tags: Column, name: Column) -> Column:
    """Whether a note of another project is close to the query: two tags among its words, or a title like it."""
    q = F.array_distinct(F.regexp_extract_all(F.lit(query.lower()), F.lit(r"[a-zA-Z0-9_\-]+"), F.lit(0)))
    low = F.array_distinct(F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.lower))
    return (F.size(F.array_intersect(low, q)) >= 2) | (jaccard(words(name), words(F.lit(query))) > 0.30)


def live_notes(notes: DataFrame) -> DataFrame:
    """Notes to search, each once, with ``own``, the scope whose corpus they are in, ``h1``, their title, and ``outdated``."""
    live = one_of_each(notes).where("not coalesce(archived, false)").withColumn("h1", title(F.col("body")))
    live = live.withColumn("outdated", F.size(F.coalesce("potentially_superseded_by", F.array().cast("array<string>"))) > 0)
    return live.withColumn("own", F.when(F.col("scope") == "project", F.coalesce("project_key", F.lit(""))).otherwise(F.lit("personal")))


#: What a search needs of a note beside its text; an index for :func:`search` keeps these columns and ``own``.
KEPT = ["tags", "h1", "source", "value", "_mtime_at_write", "file_mtime", "outdated"]


def note_index(notes: DataFrame, path: str) -> bm25.Index:
    """An index of :func:`live_notes` for :func:`search`."""
    return bm25.Index.build(live_notes(notes), "own", "id", "body", path, ["own", *KEPT])


def search(notes: DataFrame, events: DataFrame, query: str, project: str | None, as_of: str, k: int = 5, index: bm25.Index | None = None, counts: DataFrame | None = None) -> DataFrame:
    """``id, scope, bm25, decay, score`` of the best notes for a query, by a :func:`note_index` if there is one, and with
    ``counts``, a result of :func:`recall_counts` that a store keeps for a while, instead of counting the events again.

    Personal notes and each project are scopes of their own; notes of other projects count only if close to the query,
    and less. Every note's own weight, source, supersession and decay scale its score.
    """
    if index:  # the index has what the weights need; the notes aren't read
        hits, live = index.candidates(query), index.kept().withColumnRenamed("key", "id")
    else:
        live = written(live_notes(notes).select("id", "own", *KEPT, "body"), "live")
        hits, live = bm25.candidates(bm25.scores(live, query, "own", "id", "body")), live.drop("body")
    counts = recall_counts(events, as_of) if counts is None else counts
    joined = hits.withColumnRenamed("key", "id").join(live, "id").join(counts, "id", "left")
    cross = (F.col("own") != "personal") & (F.col("own") != F.lit(project)) if project else F.lit(False)
    joined = joined.where(~cross | cross_match(query, F.col("tags"), F.col("h1")))
    aged = decay(F.col("source"), F.col("_mtime_at_write"), F.col("file_mtime"), F.col("recalls"), as_of)
    old = F.when(F.col("outdated"), SUPERSEDED).otherwise(1.0)
    score = (F.col("bm25") + F.col("shift")) * _weight(F.col("value"), VALUE_WEIGHT) * _weight(F.col("source"), SOURCE_WEIGHT) * old * F.when(cross, CROSS).otherwise(1.0) * aged
    out = joined.select("id", F.col("own").alias("scope"), F.round("bm25", 3).alias("bm25"), F.round(aged, 3).alias("decay"), F.round(score, 3).alias("score"))
    return out.orderBy(F.desc("score"), "id").limit(k)


def fallback(notes: DataFrame, events: DataFrame, query: str, project: str | None, as_of: str, cap: int = 200) -> DataFrame:
    """``id, scope, line, score`` of the notes that hold the query word for word, for stores without an index: hits by line,
    weighted as in :func:`search`, rounded to 2 places, at most ``cap`` of a scope, the best first."""
    live = live_notes(notes)
    lines = F.split(F.lower(F.coalesce("body", F.lit(""))), r"\R")
    q = query.lower()
    n = F.transform(lines, lambda x: ((F.length(x) - F.length(F.replace(x, F.lit(q), F.lit("")))) / max(len(q), 1)).cast("int"))
    held = live.withColumn("__n", n).withColumn("__hits", F.aggregate("__n", F.lit(0), lambda a, b: a + b)).where(F.col("__hits") > 0 if q else F.lit(False))
    cross = (F.col("own") != "personal") & (F.col("own") != F.lit(project)) if project else F.lit(False)
    joined = held.where(~cross | cross_match(query, F.col("tags"), title(F.col("body")))).join(recall_counts(events, as_of), "id", "left")
    aged = decay(F.col("source"), F.col("_mtime_at_write"), F.col("file_mtime"), F.col("recalls"), as_of)
    old = F.when(F.size(F.coalesce("potentially_superseded_by", F.array().cast("array<string>"))) > 0, SUPERSEDED).otherwise(1.0)
    score = F.col("__hits") * _weight(F.col("value"), VALUE_WEIGHT) * _weight(F.col("source"), SOURCE_WEIGHT) * old * F.when(cross, CROSS).otherwise(1.0) * aged
    out = joined.select("id", F.col("own").alias("scope"), F.array_position(F.transform("__n", lambda x: x > 0), True).alias("line"), F.round(score, 2).alias("score"))
    rank = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("score"), "id"))
    return out.withColumn("__r", rank).where(F.col("__r") <= cap).drop("__r")


def top_reads(events: DataFrame, as_of: str, days: int, k: int = 10) -> DataFrame:
    """``id, n`` of the notes read most often."""
    reads = recent(events, as_of, days).where("event = 'read' and id <> ''")
    return reads.groupBy("id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(k)


def best_of(rows: DataFrame, key: str, score: str) -> DataFrame:
    """The row with the best score of each key, the first of equals by all other columns."""
    rest = [c for c in rows.columns if c not in (key, score)]
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), *rest))).where("__n = 1").drop("__n")


def line_hits(docs: DataFrame, query: str, key: str, text: str) -> DataFrame:
    """``key, hits``: how often the query stands in a text, whatever its case; texts without any don't come out, and for an
    empty query none."""
    if not query:
        return docs.select(F.col(key), F.lit(0).alias("hits")).where("false")
    low, q = F.lower(F.coalesce(F.col(text), F.lit(""))), query.lower()
    n = ((F.length(low) - F.length(F.replace(low, F.lit(q), F.lit("")))) / len(q)).cast("int")
    return docs.select(F.col(key), n.alias("hits")).where("hits > 0")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def _blocks(rows: DataFrame, key: str, vector: str, most: int) -> DataFrame:
    """``dim, ids, unit``: rows of one width in blocks of ``most``, their vectors scaled to length 1; rows without a whole
    vector have no cosine and don't come out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            widths = pc.list_value_length(b.column(1))
            out = []
            for dim in pc.unique(widths).to_pylist():
                own = b.filter(pc.equal(widths, dim))
                for at in range(0, own.num_rows, most):
                    part = own.slice(at, most)
                    x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, dim)
                    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
                    unit = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
                    out.append((dim, part.column(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), unit.tobytes()))
            kinds = (pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=["dim", "ids", "unit"])

    whole = rows.select(F.col(key).cast("bigint").alias("key"), F.col(vector).alias("v")).where(F.col("key").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    return whole.mapInArrow(run, "dim int, ids binary, unit binary")


def nearest(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """``query_id, <key>, cosine`` of the ``k`` rows nearest to each query, itself among them if it is a row; cosines of 4
    places, the smaller id first among equal ones. Every query meets every row, block against block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}  # of the query blocks of this task
        for b in batches:
            for dim, asked, a, width, ids, u in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if dim != width:
                    continue
                x = np.frombuffer(a).reshape(-1, dim) @ np.frombuffer(u).reshape(-1, dim).T
                score = np.copysign(np.floor(np.abs(x) * 10_000 + 0.5), x).astype(np.int64)
                at = np.broadcast_to(np.frombuffer(ids, np.int64), score.shape)
                if asked in best:
                    score, at = np.hstack([best[asked][0], score]), np.hstack([best[asked][1], at])
                order = np.lexsort((at, -score), axis=1)[:, :k]
                best[asked] = (np.take_along_axis(score, order, 1), np.take_along_axis(at, order, 1))
        for asked, (score, at) in best.items():
            q = np.repeat(np.frombuffer(asked, np.int64), score.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(at.ravel()), pa.array(score.ravel())], names=["query_id", "key", "score"])

    left = written(_blocks(queries, key, vector, 256), "queries").select("dim", F.col("ids").alias("asked"), F.col("unit").alias("a"))
    right = written(_blocks(rows, key, vector, 2048), "rows").withColumnRenamed("dim", "width")
    met = left.crossJoin(right).mapInArrow(run, "query_id bigint, key bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("key").alias(key), (F.col("score") / 10_000).alias("cosine"))


def fuse(rows: DataFrame, bm25_column: str, cosine_column: str, weight: float = 0.3) -> DataFrame:
    """Adds ``final_score``: the min-max scaled BM25 score and the cosine, weighted. The two ends are one row that comes
    to the driver first, so no window runs over all rows; a null cosine counts as 0."""
    low, high = rows.agg(F.min(bm25_column), F.max(bm25_column)).first()
    span = 1.0 if low == high or low is None else high - low
    scaled = (F.col(bm25_column) - F.lit(low).cast("double")) / span
    return rows.withColumn("final_score", weight * scaled + (1 - weight) * F.coalesce(F.col(cosine_column), F.lit(0.0)))


def rerank(top: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, key, final_score, rank``: a few candidates (``key, bm25, embedding``), at most some thousands, by their fused
    score for every query (``query_id, asked``). The candidates go to every task; queries stay where they are."""
    rows = top.limit(MOST_CANDIDATES + 1).collect()
    if len(rows) > MOST_CANDIDATES:
        raise ValueError(f"more than {MOST_CANDIDATES} candidates")
    keys = [r["key"] for r in rows]
    scores = np.array([r["bm25"] for r in rows], np.float64)
    span = (scores.max() - scores.min() or 1.0) if len(rows) else 1.0
    scaled = 0.3 * (scores - scores.min()) / span if len(rows) else scores
    vectors = [None if r["embedding"] is None else np.array(r["embedding"], np.float64) for r in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                out = np.zeros((b.num_rows, len(keys)))
                for i, v in enumerate(b.column(1).to_pylist()):
                    x = np.array(v if v is not None else [], np.float64)
                    for j, y in enumerate(vectors):
                        if y is not None and len(x) == len(y):
                            norm = np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())
                            out[i, j] = (x * y).sum() / norm if norm else 0.0
                score = np.floor(np.abs(scaled + 0.7 * out) * 10_000 + 0.5) / 10_000 * np.sign(scaled + 0.7 * out) + 0.0
                rank = np.argsort(np.lexsort((np.broadcast_to(np.arange(len(keys)), score.shape), -score), axis=1), axis=1) + 1
                ids = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), len(keys))))
                yield pa.RecordBatch.from_arrays([ids, pa.array(keys * b.num_rows, pa.int64()), pa.array(score.ravel()), pa.array(rank.ravel().astype(np.int32))], names=["query_id", "key", "final_score", "rank"])

    if sorted(keys) != keys:
        order = np.argsort(np.array(keys), kind="stable")
        keys, scaled, vectors = [keys[i] for i in order], scaled[order], [vectors[i] for i in order]
    return queries.select(F.col("query_id").cast("bigint").alias("query_id"), "asked").mapInArrow(run, "query_id bigint, key bigint, final_score double, rank int")
