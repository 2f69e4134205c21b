"""Queries that take all rows where others of their kind take some."""

import hashlib
import math
import random

from lorekeep.operators import recall
from lorekeep.plans import core_queries


def test_pages_takes_every_document(spark, tmp_path):
    texts = [None, "", "short", "a" * 60_000, "a" * 60_001, *("a" * i + "长😀" * 20_000 for i in range(7))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    cut = [None if t is None else t.encode()[:60_000].decode(errors="ignore") for t in texts]
    want = {(i, *((None,) * 3 if t is None else (len(t), len(t.encode()), hashlib.md5(t.encode()).hexdigest()))) for i, t in enumerate(cut)}
    assert {tuple(r) for r in core_queries.QUERIES["pages"](spark, str(tmp_path)).select("doc_id", "chars", "bytes", "digest").collect()} == want


def test_nearest_answers_every_query(spark):
    rng = random.Random(5)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(8)]) for i in range(5000)] + [(5000, [0.0] * 8), (5001, None), (5020, [1.0, None] * 4), (5040, [1.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id bigint, e array<float>").repartition(3)
    got = {}
    for r in recall.nearest(df, df.where("vec_id % 20 = 0"), "vec_id", "e", 5).collect():
        got.setdefault(r["query_id"], []).append((-r["cosine"], r["vec_id"]))
    assert set(got) == {*range(0, 5001, 20), 5040} and got[5040] == [(-1.0, 5040)]

    def cosine(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        c = sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0
        return math.copysign(math.floor(abs(c) * 10_000 + 0.5), c) / 10_000

    for q in (0, 1000, 4980, 5000):
        assert sorted(got[q]) == sorted((-cosine(rows[q][1], v), i) for i, v in rows[:5001])[:5]


def test_every_kind_of_key_is_counted(spark, tmp_path):
    keys = ["composer.content.a", "composer.content.a", "composer.content.b:c", "bubbleId:s:1", "composerData:s"]
    spark.createDataFrame([(k,) for k in keys], "key string").write.parquet(f"{tmp_path}/cursor_disk_kv.parquet")
    got = {tuple(r) for r in core_queries.QUERIES["kv_kinds"](spark, str(tmp_path)).select("kind", "n", "keys").collect()}
    assert got == {("composer.content", 3, 2), ("bubbleId", 1, 1), ("composerData", 1, 1)}
