import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lorekeep.operators import notes, partners

NOTE = "id string, scope string, project_key string, title string, tags array<string>, created string, archived boolean, potential_conflicts array<string>, potentially_superseded_by array<string>"


@pytest.fixture(scope="module")
def data():
    rng = random.Random(3)
    some = lambda of, most: [rng.choice(of) for _ in range(rng.randint(0, most))]
    rows = []
    for i in range(400):
        title = " ".join(some("a b c d e f g h i j k l m n".split(), 9))
        scope, project = rng.choice([("personal", "p"), ("project", "p"), ("project", "q"), ("project", None), (None, "p")])
        tags = rng.choice([None, [], [None, "a"], some("A a B c d e f g h i j k".split(), 5)])
        rows.append((f"n{i}", scope, project, rng.choice([title, None]), tags, rng.choice(["2026-01-01", "2026-02-01", None]), rng.choice([None, False, False, True]), some(["x", "n1"], 2), some(["x", "n2"], 2)))
    return rows


def met(rows):
    """Brute force: pairs of ids in conflict, both ways."""
    live = []
    for r in rows:
        if not r[6] and r[1] is not None and r[0] is not None:
            live.append((r[0], (r[1], (r[2] or "") if r[1] == "project" else ""), {t.lower() for t in r[4] or [] if t is not None}, set(re.findall(r"\w+", (r[3] or "").lower()))))
    alike = lambda a, b: bool(a and b) and len(a & b) * 5 >= len(a | b) * 2
    return {(a[0], b[0]) for a in live for b in live if a[0] != b[0] and a[1] == b[1] and (len(a[2] & b[2]) >= 2 or alike(a[3], b[3]))}


@pytest.mark.parametrize("share", [4096, 7])
def test_conflicts_as_by_brute_force(spark, data, monkeypatch, share):
    monkeypatch.setattr(partners, "SHARE", share)
    got = [tuple(r) for r in notes.conflicts(spark.createDataFrame(data, NOTE)).collect()]
    assert len(got) == len(set(got)) and set(got) == met(data) and len(got) > 200


@pytest.mark.parametrize("share", [4096, 7])
def test_later_partners_in_order(spark, data, monkeypatch, share):
    monkeypatch.setattr(partners, "SHARE", share)
    made = {r[0]: r[5] or "" for r in data}
    want = {}
    for a, b in sorted(met(data)):
        if (made[b], b) > (made[a], a):
            want.setdefault(a, []).append(b)
    got = notes.superseded(spark.createDataFrame(data, NOTE)).collect()
    assert len(got) == len(want) and {r["id"]: r["superseded_by"] for r in got} == want


def test_marks_as_by_brute_force(spark, data):
    wide = NOTE + ", extra map<string,string>"
    data = [(*r, {"k": r[0]}) for r in data] + [(None, "personal", None, "a b", ["a", "b"], None, False, None, ["z"], None)]
    old, new = data[:250] + data[-1:], data[240:-1]
    names = {r[0] for r in new}
    pairs = {(a, b) for a, b in met(data) if (a in names) != (b in names)}
    want = []
    for r in [*[r for r in old if r[0] not in names], *new]:
        others = sorted(b for a, b in pairs if a == r[0])
        if r[0] in names:
            r = (*r[:7], others, *r[8:])
        elif others:
            r = (*r[:8], list(dict.fromkeys([*(r[8] or []), *others])), *r[9:])
        want.append(r)
    df = notes.marked(spark.createDataFrame(old, wide), spark.createDataFrame(new, wide))
    assert not exchanged_behind(df)
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, want))


def exchanged_behind(df):
    """Whether anything is exchanged or joined once partners are found."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return bool(re.search("Exchange|Join", plan[: plan.index("MapInArrow")]))


def test_pairs_are_never_exchanged(spark, data):
    df = spark.createDataFrame(data, NOTE)
    assert not exchanged_behind(notes.conflicts(df))
    assert not exchanged_behind(notes.superseded(df))


def test_groups_stay_whole():
    batch = lambda g, share: pa.RecordBatch.from_arrays([pa.array(np.array(g, np.int64)), pa.array(np.array(share, np.int32))], names=["g", "share"])
    big = partners.ROWS
    batches = [batch([], []), batch([0] * big, [0] * big), batch([0, 0, 1], [0, 0, 0]), batch([1] * big, [0] * big), batch([1, 1], [1, 1])]
    out = [sorted(set(zip(t["g"].to_pylist(), t["share"].to_pylist(), strict=True))) for t in partners._whole(iter(batches))]
    assert out == [[(0, 0)], [(1, 0)], [(1, 1)]]
