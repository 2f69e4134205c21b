import numpy as np

from lorekeep.llm import mixing as M
from lorekeep.llm.tokens import encoder
from lorekeep.session import written

DOC = "doc_id bigint, text string, source string"


def test_plan_meets_targets_and_caps():
    got = {s.source: s for s in M.plan([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.2, 2), ("none", 0.1, 3), ("zero", 0.0, 3), ("null", None, None)], {"a": 1000, "b": 100, "c": 20, "zero": 50}, 1)}
    assert got["c"].slots == 40 and got["b"].slots == 400 and got["a"].slots == 680
    assert got["none"].slots == got["zero"].slots == got["null"].slots == 0
    exact = {s.source: s.slots for s in M.plan([("a", 0.75, 5), ("b", 0.25, 5)], {"a": 500, "b": 500}, 1)}
    assert exact == {"a": 750, "b": 250}
    assert M.plan([], {}) == []


def test_draws_are_multinomial_and_repeatable():
    weights = np.array([600.0, 300.0, 100.0, 0.0])
    draws = np.stack([M.shard_draw(weights, k, 1000, 3) for k in range(400)])
    assert (draws.sum(axis=1) == 1000).all() and (draws[:, 3] == 0).all()
    assert (M.shard_draw(weights, 7, 1000, 3) == draws[7]).all()
    p = weights / 1000
    assert np.allclose(draws.mean(axis=0), 1000 * p, atol=3)
    assert np.allclose(draws.var(axis=0)[:3], (1000 * p * (1 - p))[:3], rtol=0.3)  # a multinomial's spread


def test_draws_are_settled_to_the_plan():
    planned, drawn = np.array([500, 300, 200, 0]), np.array([520, 260, 190, 30])
    settled = M.Settled(planned, drawn)
    held = [settled.numbers(s, np.arange(drawn[s])) for s in range(4)]
    got = sorted((int(s), int(q)) for a, b in held for s, q in zip(a, b, strict=True))
    assert got == [(s, q) for s in range(4) for q in range(planned[s])]
    kept, number = held[0]
    moved = np.flatnonzero(kept != 0)
    assert len(moved) == 20 and np.diff(moved).max() <= 27  # evenly spread
    assert (np.diff(number[kept == 0]) == 1).all()


def test_slots_of_many_ranges(spark):
    shares = M.plan([("a", 0.6, 3), ("b", 0.4, 3)], {"a": 40_000, "b": 9_000}, 10)
    rows = M.slots(spark, shares, 16, 1).collect()
    assert len({r["shard"] for r in rows}) > 2 * M.RANGE
    for s in shares:
        own = [(r["pass"], r["block"]) for r in rows if r["source"] == s.source]
        assert len(own) == len(set(own)) == s.slots
    sizes = np.bincount([r["shard"] for r in rows])
    assert (sizes[:-1] == 16).all()
    own = np.bincount([r["shard"] for r in rows if r["source"] == "b"], minlength=len(sizes))
    assert len(set(own[:-1].tolist())) > 5  # drawn, not even


def test_permutation():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        x = M.permuted(np.arange(n), n, 5)
        assert sorted(x) == list(range(n))
    assert (M.permuted(np.arange(1000), 1000, 5) != M.permuted(np.arange(1000), 1000, 6)).any()


def corpus(spark):
    rows = [(i, f"text number {i} " * (i % 9), "big") for i in range(200)] + [(1000 + i, "small words here", "small") for i in range(5)]
    rows += [(2000, "x", None), (2001, "x", "unlisted"), (2002, None, "big"), (2003, "", "small"), (None, "x", "big")]
    targets = [("big", 0.5, 1), ("small", 0.5, 3), ("small", 0.5, 3), ("absent", 0.1, 2), (None, 0.1, 1)]
    return rows, spark.createDataFrame(rows, DOC), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_blocks_hold_every_token_in_order(spark):
    rows, docs, targets = corpus(spark)
    blocks = M.packed_blocks(written(M.encoded(docs, ["big", "small", "absent"])), 16).orderBy("source", "block").collect()
    enc = encoder()
    for source in ("big", "small"):
        want = [t for i, x, s in rows if s == source and i is not None and x for t in enc.encode(x)]
        own = [b for b in blocks if b["source"] == source]
        assert [b["block"] for b in own] == list(range(len(own)))
        assert [int(t) for b in own for t in np.frombuffer(b["tokens"], "<u2")] == want
        assert all(b["n_tokens"] == 16 for b in own[:-1])


def test_mix_and_shares(spark):
    _, docs, targets = corpus(spark)
    rows = M.mix(docs, targets, 16, 32).collect()
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
    for source, most in (("big", 1), ("small", 3)):
        own = [(r["pass"], r["block"]) for r in rows if r["source"] == source]
        assert len(set(own)) == len(own) and max(p for p, _ in own) < most
        full = {b for _, b in own}
        for p in range(max(p for p, _ in own)):  # a pass is complete before the next begins
            assert {b for q, b in own if q == p} == full
    told = {r["source"]: r for r in M.shares(docs, targets, 16, 32).collect()}
    for source in ("big", "small", "absent"):
        assert told[source]["mixed_tokens"] == sum(r["n_tokens"] for r in rows if r["source"] == source)
    assert abs(sum(r["actual_share"] for r in told.values()) - 1) < 1e-9
    ids = M.unpacked(M.mix(docs, targets, 16, 32)).where("source = 'small' and block = 0").first()["tokens"]
    assert ids[: len(encoder().encode("small words here"))] == encoder().encode("small words here")


def test_ids_of_four_bytes(spark, monkeypatch):
    _, docs, targets = corpus(spark)
    narrow = M.unpacked(M.mix(docs, targets, 16, 32)).collect()
    monkeypatch.setattr(M, "width", lambda *a: 4)
    assert sorted(map(str, M.unpacked(M.mix(docs, targets, 16, 32), 4).collect())) == sorted(map(str, narrow))


def test_nothing_to_mix(spark):
    _, docs, targets = corpus(spark)
    assert M.mix(docs.limit(0), targets).count() == 0
    assert M.mix(docs, targets.limit(0)).count() == 0


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    _, docs, targets = corpus(spark)
    names = ["rid", "n", "tokens", "start", "block", "pass", "shard", "slot", "part"]
    more = docs.withColumns({c: F.lit("x") for c in names})
    wide = targets.withColumns({c: F.lit("x") for c in names})
    same = lambda d, t: sorted(map(str, M.mix(d, t, 16, 32).collect()))
    assert same(more, wide) == same(docs, targets)
