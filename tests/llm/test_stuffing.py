import random

import pytest
from pyspark.sql import functions as F

from lorekeep.llm import stuffing as S

DOC = "doc_id bigint, text string"


def page(rng, stuffed):
    noun = lambda: rng.choice("cache pool index lock queue router parser driver window token stream table".split())
    if stuffed:
        kind = rng.randrange(3)
        if kind == 0:
            return " ".join(f"{rng.choice('best cheap free top online'.split())} {noun()}" for _ in range(80))
        if kind == 1:
            return "\n".join(f"https://{noun()}-{noun()}.example/{noun()}/{rng.randint(1, 999)}" for _ in range(30))
        return ", ".join(f"{noun()} {noun()}" for _ in range(60))
    return " ".join(f"The {noun()} is slow because the {noun()} of a {noun()} waits for it, and we have to look at the {noun()} first." for _ in range(rng.randint(3, 9)))


@pytest.fixture(scope="module")
def data():
    rng = random.Random(7)
    return [(i, page(rng, i % 4 == 0), int(i % 4 == 0)) for i in range(400)]


def test_held_out_pages(spark, data):
    docs = spark.createDataFrame([d[:2] for d in data] + [(1000, None), (1001, ""), (1002, "buy"), (1003, "\x00\x01 \x07")], DOC).withColumn("n_tokens", F.lit("clash"))
    labels = spark.createDataFrame([(d[0], d[2]) for d in data[:200]] + [(data[0][0], 1), (None, 1), (5, None), (9999, 1)], "doc_id bigint, is_spam int")
    found = {r[0] for r in S.stuffed_pages(docs, labels).collect()}
    want = {d[0] for d in data[200:] if d[2]}
    assert {i for i in found if i >= 200} == want


def test_labels_of_one_kind_or_none(spark, data):
    docs = spark.createDataFrame([d[:2] for d in data[:40]], DOC)
    for rows in ([], [(1, 0)], [(0, 1)]):
        assert S.stuffed_pages(docs, spark.createDataFrame(rows, "doc_id bigint, is_spam int")).count() == 0


def test_scores_of_every_row(spark, data):
    docs = spark.createDataFrame([d[:2] for d in data[:80]] + [(3, None), (3, "x" * 200_000), (None, "a b c")], DOC)
    model = S.fit(docs, spark.createDataFrame([(d[0], d[2]) for d in data[:80]], "doc_id bigint, is_spam int"))
    rows = S.page_scores(docs, model).collect()
    assert len(rows) == 83 and all(r["perplexity"] > 0 for r in rows)
    judged = [r for r in rows if r["n_tokens"] >= S.LEAST_TOKENS and r["doc_id"] is not None and r["doc_id"] < 80 and r["n_tokens"] < 10_000]
    assert all(r["flagged"] == (r["doc_id"] % 4 == 0) for r in judged)
    assert min(r["perplexity"] for r in judged if r["flagged"]) > max(r["perplexity"] for r in judged if not r["flagged"])


def test_bounds_of_low_and_high_scores():
    import numpy as np

    score = np.array([0.1, 0.2, 0.3, 0.35, 1.0, 1.1, 1.2, 1.3, 1.3, 3.0, 3.5])
    stuffed = np.array([1, 1, 1, 1, 0, 0, 0, 0, 0, 1, 1])
    low, high = S.bounds(score, stuffed)
    assert 0.35 < low < 1.0 and 1.3 < high < 3.0
    low, high = S.bounds(np.array([1.0, 2.0, 2.0, 3.0]), np.array([0, 0, 1, 1]))
    assert low == -np.inf and 2.0 < high < 3.0
    low, high = S.bounds(np.array([3.0, 1.0, 0.5]), np.array([0, 1, 1]))  # two low pages aren't evidence enough
    assert low == -np.inf and high >= 3.0


def test_repeats_within_the_window():
    import numpy as np

    def levels(text):
        shape, hashed, doc, wordy = S._pieces([text, text])
        out = S._repeats(shape, hashed, doc, wordy)
        return out[doc == 0]

    assert levels("a b c d").max() == 0
    assert levels("a b a c").tolist() == [0, 0, 1, 0]
    assert levels("a b " * 40).max() == 4
    far = " ".join(f"w{i}x" for i in range(S.WINDOW + 5))
    assert levels(f"a b {far} a b").max() == 0
    assert np.all(S._repeats(*S._pieces(["a b", "a b"]))[[0, 1]] == 0)


def test_bound_of_the_labelled_rows(spark, data):
    docs = spark.createDataFrame([d[:2] for d in data], DOC)
    labels = spark.createDataFrame([(d[0], d[2]) for d in data], "doc_id bigint, is_spam int")
    assert sorted(r[1] for r in S.labelled_pages(docs, labels, 7).collect()) == [0] * 7 + [1] * 7


def test_clashing_columns(spark, data):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([d[:2] for d in data[:80]], DOC)
    labels = spark.createDataFrame([(d[0], d[2]) for d in data[:80]], "doc_id bigint, is_spam int")
    more = docs.withColumns({c: F.lit(0) for c in ("is_spam", "n", "h", "flagged", "perplexity")})
    wide = labels.withColumns({c: F.lit("x") for c in ("text", "__n", "n")})
    assert sorted(r[0] for r in S.stuffed_pages(more, wide).collect()) == sorted(r[0] for r in S.stuffed_pages(docs, labels).collect())


def test_all_labelled_rows_count(spark):
    docs = spark.range(20_500).selectExpr("id as doc_id", "'t' as text")
    labels = docs.selectExpr("doc_id", "cast(doc_id < 100 as int) as is_spam")
    assert S.labelled_pages(docs, labels).count() == 20_500


def test_bounds_in_the_tasks(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    for case in range(4):
        y = rng.random(150) < (0.3, 0.7, 0.02, 0.98)[case]
        score = np.round(rng.normal(2, 0.4, 150) + y * rng.choice([-1.5, 1.5] if case % 2 else [0, 2], 150), 2 - case % 2)
        df = spark.createDataFrame(list(zip(y.astype(int).tolist(), score.tolist(), strict=True)), "y int, score double")
        assert S.bounds_of(df.repartition(5)) == pytest.approx(S.bounds(score, y), abs=0)
    assert S.bounds_of(df.where("y = 1")) is None and S.bounds_of(df.limit(0)) is None
