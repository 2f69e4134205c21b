import random
import re
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from lorekeep.llm import near_duplicates as N

NOTE = "id string, title string, body string, tags array<string>"


def words(title, body, tags):
    x = "\n".join([title or "", body or "", *[t for t in tags or [] if t]]).lower()
    out = set(re.findall("[a-z0-9_]+", x))
    for run in re.findall("[一-鿿]+", x):
        out |= {run} if len(run) == 1 else {run[i : i + 2] for i in range(len(run) - 1)}
    return out


def brute(rows):
    sets = {r[0]: words(*r[1:]) for r in rows if r[0] is not None}
    pairs = ((a, b, len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a, b in combinations(sorted(sets), 2))
    return {(a, b) for a, b, i, u in pairs if u and 10 * i >= 7 * u}


def test_against_brute_force(spark):
    random.seed(2)
    rows = []
    for g in range(25):
        size = random.choice([1, 2, 3, 5, 8, 20, 60, 150])
        base = [f"w{random.randint(0, 400)}" for _ in range(size)]
        for k in range(random.randint(1, 6)):
            mine = [w for w in base if random.random() > 0.12 * (k > 0)] + [f"n{random.randint(0, 10**6)}" for _ in range(random.randint(0, size // 5))]
            random.shuffle(mine)
            rows.append((f"{g}-{k}", "标题 一" if k % 2 else None, " ".join(mine), [None, f"T{g}"] if k % 3 else None))
    rows += [rows[0], ("e1", None, None, None), ("e2", "", " !", []), (None, "x", "y", None)]
    got = [tuple(r) for r in N.similar_notes(spark.createDataFrame(rows, NOTE)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    groups = {r["id"]: r for r in N.note_groups(spark.createDataFrame(rows, NOTE)).collect()}
    assert set(groups) == {r[0] for r in rows if r[0] is not None and words(*r[1:])}


def test_exactly_at_the_threshold(spark):
    ten = [f"a{i}" for i in range(10)]
    rows = [("x", None, " ".join(ten), None), ("y", None, " ".join(ten[:7]), None), ("z", None, " ".join(ten[:6]), None)]
    assert {tuple(r) for r in N.similar_notes(spark.createDataFrame(rows, NOTE)).collect()} == {("x", "y"), ("y", "z")}


def test_empty_and_extra_columns(spark):
    assert N.similar_notes(spark.createDataFrame([], NOTE)).count() == 0
    df = spark.createDataFrame([("a", "x y", None, None), ("b", "y x", None, None)], NOTE).withColumn("class", F.lit(1)).withColumn("tokens", F.lit("t"))
    assert [tuple(r) for r in N.similar_notes(df).collect()] == [("a", "b")]


def test_hot_block_is_split(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT", 5)
    rows = [(f"{i:03d}", None, f"same words in all notes here {i}", None) for i in range(60)]
    assert {tuple(r) for r in N.similar_notes(spark.createDataFrame(rows, NOTE)).collect()} == brute(rows)


def test_copies_of_one_note_are_split(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT", 5)
    rows = [(f"{i:03d}", None, f"the same note {'again' if i < 40 else i % 5}", None) for i in range(60)]
    got = [tuple(r) for r in N.similar_notes(spark.createDataFrame(rows, NOTE)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_full_buckets_split_nothing(spark):
    """Buckets that many ordinary blocks share aren't taken for frequent blocks; results never depend on the counts."""
    rng = random.Random(5)
    base = [[f"w{rng.randint(0, 5000)}" for _ in range(60)] for _ in range(40)]
    rows = [(f"{i}", None, " ".join(base[i % 40][: 60 - i % 7] + [f"x{i}"]), None) for i in range(120)]
    classes, _ = N.note_classes(spark.createDataFrame(rows, NOTE))
    frequency, bands = N._frequencies(classes)
    assert frequency.sum() > 0
    want = {tuple(r) for r in N.similar_classes(classes).collect()}
    rows = lambda f: sum(N._probes(classes, f, True, t).count() for t in N._tiers(bands))
    met = lambda f: {tuple(r) for t in N._tiers(bands) for r in N._met(classes, f, t).collect()}
    ordinary = rows(frequency)
    full = np.full(N.BUCKETS, 50_000, np.int32)  # as with very many notes: more than HOT in every bucket
    assert rows(full) == ordinary and want <= met(full)
    heavy = np.full(N.BUCKETS, 3, np.int32)
    heavy[::3] = 4 * N.HOT
    assert rows(heavy) > ordinary and want <= met(heavy)


def test_large_sets_have_wider_sketches(spark, monkeypatch):
    rng = random.Random(9)
    rows = []
    for g in range(6):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range((300, 700, 1500)[g % 3])]
        rows += [(f"{g}-{k}", None, " ".join(w for w in base if rng.random() > 0.05 * k), None) for k in range(4)]
    rows += [(f"s{i}", None, f"a few words {i % 3}", None) for i in range(9)]
    want = brute(rows)
    assert {tuple(r) for r in N.similar_notes(spark.createDataFrame(rows, NOTE)).collect()} == want
    classes, _ = N.note_classes(spark.createDataFrame(rows, NOTE))
    assert [t[2] for t in N._tiers(N._frequencies(classes)[1])] == [4, 16, 64]
    monkeypatch.setattr(N, "LARGE", 2)
    monkeypatch.setattr(N, "PAIRS", 7)
    assert {tuple(r) for r in N.similar_notes(spark.createDataFrame(rows, NOTE)).collect()} == want


def test_pairs_of_a_key_in_several_batches(spark):
    """A key whose rows come in several Arrow batches meets all of its other side."""
    rows = [(f"{i:04d}", None, f"same words in all notes here {i % 700}", None) for i in range(900)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {tuple(r) for r in N.similar_notes(spark.createDataFrame(rows, NOTE)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(rows)


def test_sketch_is_a_lower_bound():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200))).astype(np.int64) * 7919 for _ in range(400)]
    flat, sizes = np.concatenate(sets), np.array([len(x) for x in sets])
    bits = N._sketches(flat, sizes, 4)
    sig, owner, place = N._cells(flat, sizes, np.full(400, 3))
    for i in range(0, 400, 2):
        d = len(np.setxor1d(sets[i], sets[i + 1]))
        assert sum(int(v).bit_count() for v in (bits[i] ^ bits[i + 1]).view(np.uint64)) <= d
        a, b = sig[owner == i], sig[owner == i + 1]
        assert len(a) == len(b) == N._blocks_of(3) and (a != b).sum() <= d
        alone, _, _ = N._cells(sets[i], sizes[i : i + 1], np.array([3]))
        assert (alone == a).all() and (place[owner == i] == np.arange(len(a))).all()


def test_bands_meet():
    for n in range(1, 3000):
        k = N._band(n)
        assert (10 / 7) ** k <= n * (1 + 1e-9) and n < (10 / 7) ** (k + 1) * (1 + 1e-9)
        assert N._band(-(-7 * n // 10)) >= k - 1
        assert N._blocks_of(k) > (2 * (10 / 7) ** (k + 2) - 2) * 3 / 17
