"""Near-duplicate notes: an exact parity-sketch join at a Jaccard threshold.

Each token flips one bit of a sketch, so the Hamming distance of two sketches never exceeds the symmetric difference of
the token sets, and Jaccard at least t means a symmetric difference of at most (1 - t) / (1 + t) * (|A| + |B|). Sets
are put in size bands by powers of 1 / t; sets that can match lie in the same or in neighbouring bands. Per band pair
the sketch is cut in n blocks, more than the largest allowed difference d: two matching sets disagree in at most d
blocks, so of any order of the blocks common to all sets the first d + 1 of both share one (the pigeonhole). The rarest
blocks come first. Rows of a block are brought together sorted, and the pairs that meet in it are held against the distance
bound there, many at once; what is left is verified. A block that very many sets share is split into squares of bounded
size, so no task sees more of it than another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.session import written

THRESHOLD = (7, 10)
#: Words of the sketch held against the bound where sets meet, by the largest set they serve: so many bits tell two sets
#: apart only as long as the difference allowed stays well below half of them.
WIDTHS = ((310, 4), (1300, 16), (1 << 62, 64))
#: Blocks of a band pair for each difference allowed in it.
BLOCKS = 1.0
#: Hash buckets of the block frequencies that order the blocks; what reaches the driver is one number a bucket. A bucket also
#: counts what else falls in it, on average the same everywhere: that much is taken off before a block is called frequent.
BUCKETS = 1 << 20
_CHUNK = 1 << 16
#: Bytes of token sets that are worked on at once.
SLICE = 1 << 20
#: A block value met by more sets than this is split into squares of so many.
HOT = 4000
#: Pairs that are tested at once, and from how many on a block is tested by itself.
PAIRS, LARGE = 1 << 16, 1 << 10


def token_set(*texts: Column) -> Column:
    """Sorted distinct 64-bit hashes of the words: runs of ``[a-z0-9_]`` and neighbouring pairs of Chinese characters."""
    text = F.lower(F.concat_ws("\n", *texts))
    han = "[\\x{4e00}-\\x{9fff}]"
    words = F.concat(
        F.regexp_extract_all(text, F.lit("[a-z0-9_]+"), F.lit(0)),
        F.regexp_extract_all(text, F.lit(f"(?=({han}{han}))"), F.lit(1)),
        F.regexp_extract_all(text, F.lit(f"(?<!{han}){han}(?!{han})"), F.lit(0)),
    )
    return F.array_sort(F.transform(F.array_distinct(words), lambda w: F.xxhash64(w)))


def _band(n: int) -> int:
    """The largest k with (1/t)^k <= n."""
    p, q = THRESHOLD
    k = int(math.log(n) / math.log(q / p))
    while (q / p) ** (k + 1) <= n * (1 + 1e-12):
        k += 1
    while (q / p) ** k > n * (1 + 1e-12):
        k -= 1
    return k


def _blocks_of(channel: int) -> int:
    """Blocks for pairs of a set in band ``channel`` with one in the same or the next band."""
    p, q = THRESHOLD
    largest = (q / p) ** (channel + 2)
    return math.ceil(BLOCKS * (2 * largest * (q - p) / (q + p))) + 2


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _cells(flat: np.ndarray, sizes: np.ndarray, channels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The blocks of many sets at once: a 64-bit value of each block, its set, and its place among the set's blocks."""
    kinds, at = np.unique(channels, return_inverse=True)
    n = np.array([_blocks_of(int(c)) for c in kinds], np.int64)[at]
    first = np.concatenate(([0], np.cumsum(n)[:-1])).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    h = flat.view(np.uint64)
    cell = first[row] + (h % n[row].astype(np.uint64)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    sorted_cells = cell[order]
    starts = np.flatnonzero(np.r_[True, sorted_cells[1:] != sorted_cells[:-1]])
    value = np.zeros(int(n.sum()), np.uint64)
    value[sorted_cells[starts]] = np.bitwise_xor.reduceat(_mix(h)[order], starts)
    owner = np.repeat(np.arange(len(sizes)), n)
    place = np.arange(len(value)) - first[owner]
    salt = np.array([(int(c) + 64) * 0xD1B54A32D192ED03 % (1 << 64) for c in kinds], np.uint64)[at]
    return _mix(value + (place + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt[owner]), owner, place


def _sketches(flat: np.ndarray, sizes: np.ndarray, words: int) -> np.ndarray:
    """A parity sketch of each set, ``words`` numbers a row."""
    wide = 64 * words
    bit = (_mix(flat.view(np.uint64) + np.uint64(7)) % np.uint64(wide)).astype(np.int64)
    odd = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * wide + bit, minlength=len(sizes) * wide) & 1
    return (odd.reshape(len(sizes), words, 64).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64).view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Some sets at a time: classes, token hashes end to end, sizes, bands."""
    for whole in batches:
        step = max(1, whole.num_rows * SLICE // max(whole.nbytes, 1))
        for at in range(0, whole.num_rows, step):
            batch = whole.slice(at, step)
            sizes = np.diff(batch.column(1).offsets.to_numpy()).astype(np.int64)
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            some = sizes > 0
            if some.any():
                kinds, where = np.unique(sizes[some], return_inverse=True)
                yield batch.column(0).to_numpy(zero_copy_only=False)[some], flat, sizes[some], np.array([_band(int(x)) for x in kinds])[where]


def _frequencies(classes: DataFrame) -> tuple[np.ndarray, list[int]]:
    """How many blocks of all sets fall in each bucket, and the bands that sets are in. Tasks send their counts in chunks."""
    chunks = -(-BUCKETS // _CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, bands = np.zeros(chunks * _CHUNK, np.int64), set()
        for _, flat, sizes, band in _sets(batches):
            bands |= {int(b) for b in np.unique(band)}
            for channels in (band, band - 1):
                total[:BUCKETS] += np.bincount((_cells(flat, sizes, channels)[0] & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        if bands:
            at = [i for i in range(chunks) if total[i * _CHUNK : (i + 1) * _CHUNK].any()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([total[i * _CHUNK : (i + 1) * _CHUNK].tobytes() for i in at], pa.binary()), pa.array([sorted(bands)] * len(at), pa.list_(pa.int32()))], names=["chunk", "n", "bands"])

    def add(table: pa.Table) -> pa.Table:
        n = sum(np.frombuffer(x, np.int64) for x in table.column("n").to_pylist())
        bands = sorted({b for x in table.column("bands").to_pylist() for b in x})
        return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()], pa.int32()), "n": pa.array([n.tobytes()], pa.binary()), "bands": pa.array([bands], pa.list_(pa.int32()))})

    schema = "chunk int, n binary, bands array<int>"
    rows = classes.select("class", "tokens").mapInArrow(run, schema).groupBy("chunk").applyInArrow(add, schema).collect()
    out = np.zeros(chunks * _CHUNK, np.int64)
    for r in rows:
        out[r["chunk"] * _CHUNK : (r["chunk"] + 1) * _CHUNK] = np.frombuffer(r["n"], np.int64)
    return np.minimum(out[:BUCKETS], np.iinfo(np.int32).max).astype(np.int32), sorted({b for r in rows for b in r["bands"]})


def _tiers(bands: list[int]) -> list[tuple[int, int, int]]:
    """``low, high, words``: the channels, from ``low`` to below ``high``, whose largest sets a width of sketch serves; only
    those that occur."""
    p, q = THRESHOLD
    channels, out, low = sorted({c for b in bands for c in (b, b - 1)}), [], -(1 << 30)
    for most, words in WIDTHS:
        high = next((c for c in range(max(low, -2), 1 << 10) if (q / p) ** (c + 2) > most), 1 << 30) if most < 1 << 62 else 1 << 30
        if any(low <= c < high for c in channels):
            out.append((low, high, words))
        low = high
    return out


def _probes(classes: DataFrame, frequency: np.ndarray, right: bool, tier: tuple[int, int, int]) -> DataFrame:
    """``k, class, meta, s0..`` of the d + 1 rarest blocks of every set: on the left side for the pairs in which it is in the
    lower band (or both are in one), on the right for those and those in which it is in the upper one; of the channels of a
    tier. ``k`` is the block's value, its lowest bit the side; ``meta`` is the set's size, the block's place, and whether it is
    there for the upper band. Of a frequent block the rows go to one row (column) of a square of parts, by their class.
    """
    p, q = THRESHOLD
    low, high, words = tier
    noise = float(frequency.mean())
    noise += 4 * noise**0.5
    names = ["k", "class", "meta", *(f"s{i}" for i in range(words))]
    schema = ", ".join(f"{n} bigint" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, flat, sizes, band in _sets(batches):
            for upper in (False, True) if right else (False,):
                channels = band - 1 if upper else band
                own = (channels >= low) & (channels < high)
                if not own.any():
                    continue
                mine, sub, kind = sizes[own], flat[np.repeat(own, sizes)], ids[own]
                bits = _sketches(sub, mine, words)
                # a partner that is larger has at most size * q / p tokens; in the upper band a set is the larger one itself
                d = 2 * mine * (q - p) // (q + p) if upper else mine * (p + q) * (q - p) // (p * (q + p))
                sig, owner, place = _cells(sub, mine, channels[own])
                n = frequency[(sig & np.uint64(BUCKETS - 1)).astype(np.int64)]
                order = np.lexsort((sig, n, owner))
                chosen = place <= d[owner]  # owners keep their places: the sorted cells of a set fill the same stretch
                pick = order[chosen]
                of, key, rank = owner[pick], sig[pick], place[chosen]
                parts = np.maximum(1, np.ceil((n[pick] - noise) / HOT)).astype(np.int64)
                if (parts > 1).any():
                    at = np.repeat(np.arange(len(parts)), parts)
                    across = (np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)).astype(np.uint64)
                    of, key, rank, parts = of[at], key[at], rank[at], parts[at].astype(np.uint64)
                    along = _mix(kind[of].view(np.uint64) + np.uint64(11)) % parts
                    row, column = (across, along) if right else (along, across)
                    key = np.where(parts > 1, _mix(key + _mix(row * parts + column + np.uint64(3))), key)
                k = (key & ~np.uint64(1)) | np.uint64(right)
                meta = mine[of] << 32 | rank << 1 | int(upper)
                columns = [k.view(np.int64), kind[of], meta, *bits[of].T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x, np.int64), pa.int64()) for x in columns], names=names)

    return classes.select("class", "tokens").mapInArrow(run, schema)


def _columns(columns: list[np.ndarray]) -> dict:
    """Rows of a batch as the tests need them: with t = p / q, two sets of sizes x and y may differ in (q - p) / (p + q) of
    x + y at most, and a block at place ``pos`` of one of them is among their first if ``need`` is at most ``give`` of the
    other."""
    p, q = THRESHOLD
    key, kind, meta = columns[:3]
    size, pos = (meta >> 32).astype(np.int32), (meta >> 1 & 0x7FFFFFFF).astype(np.int32)
    return {
        "k": key | 1, "right": (key & 1).astype(bool), "class": kind, "upper": (meta & 1).astype(bool), "bits": [x.view(np.uint64) for x in columns[3:]],
        "give": size * (q - p), "need": pos * (p + q) - size * (q - p), "size": size, "least": -(-size * p // q),
    }


def _near(rows: dict, i, j) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of rows ``i`` and ``j`` (two arrays alike, or a slice of each for all their pairs) those that may reach
    the threshold."""
    p, q = THRESHOLD
    whole = isinstance(i, slice)
    left, right = ((lambda x: x[i][:, None]), (lambda x: x[j][None, :])) if whole else ((lambda x: x[i]), (lambda x: x[j]))
    give = left(rows["give"]) + right(rows["give"])
    good = left(rows["need"]) <= right(rows["give"])
    good &= right(rows["need"]) <= left(rows["give"])
    good &= left(rows["least"]) <= right(rows["size"])
    good &= right(rows["least"]) <= left(rows["size"])
    good &= right(rows["upper"]) | (left(rows["class"]) < right(rows["class"]))
    bits, most = rows["bits"], (give // (p + q)).astype(np.int16 if len(rows["bits"]) < 64 else np.int32)
    apart = np.bitwise_count(left(bits[0]) ^ right(bits[0])).astype(most.dtype)
    apart += np.bitwise_count(left(bits[1]) ^ right(bits[1]))
    good &= apart <= most
    at = np.flatnonzero(good)
    a, b = (at // good.shape[1] + i.start, at % good.shape[1] + j.start) if whole else (i[at], j[at])
    apart, most = apart.reshape(-1)[at], most.reshape(-1)[at]
    for x in bits[2:]:
        apart = apart + np.bitwise_count(x[a] ^ x[b])
    near = apart <= most
    return a[near], b[near]


def _pairs(rows: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The near pairs of sorted rows: within each key, every row of the left side with every one of the right."""
    key, right = rows["k"], rows["right"]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    ends = np.r_[starts[1:], len(key)]
    lefts = np.add.reduceat((~right).astype(np.int64), starts)
    rights = ends - starts - lefts
    some = (lefts > 0) & (rights > 0)
    starts, lefts, rights = starts[some], lefts[some], rights[some]
    large = lefts * rights > LARGE
    for a, m, n in zip(starts[large].tolist(), lefts[large].tolist(), rights[large].tolist(), strict=True):
        rest = max(1, PAIRS // min(m, 256))
        for x in range(a, a + m, 256):
            for b in range(a + m, a + m + n, rest):
                yield _near(rows, slice(x, min(x + 256, a + m)), slice(b, min(b + rest, a + m + n)))
    starts, lefts, rights = starts[~large], lefts[~large], rights[~large]
    ends = np.cumsum(lefts * rights)
    for first in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
        t = np.arange(first, min(first + PAIRS, int(ends[-1])))
        g = np.searchsorted(ends, t, side="right")
        t -= (ends - lefts * rights)[g]
        yield _near(rows, starts[g] + t // rights[g], starts[g] + lefts[g] + t % rights[g])


def _met(classes: DataFrame, frequency: np.ndarray, tier: tuple[int, int, int]) -> DataFrame:
    """``a, b`` of the pairs that share one of their rarest blocks and stay within the bound as far as their sketches tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # rows of the left side of the last key so far
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None and held[0][0] | 1 == columns[0][0] | 1:
                columns = [np.concatenate([x, y]) for x, y in zip(held, columns, strict=True)]
            rows = _columns(columns)
            for i, j in _pairs(rows):
                if len(i):
                    a, b = rows["class"][i], rows["class"][j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
            last = columns[0] == (columns[0][-1] & ~np.int64(1))
            held = [x[last] for x in columns] if last.any() else None

    both = _probes(classes, frequency, False, tier).unionByName(_probes(classes, frequency, True, tier))
    # one number is the whole key, and its lowest bit puts the left side first
    return both.repartition(F.col("k").bitwiseOR(F.lit(1))).sortWithinPartitions("k").mapInArrow(run, "a bigint, b bigint")


def similar_classes(classes: DataFrame) -> DataFrame:
    """``a, b`` (a < b) of all pairs of different token sets that reach the threshold; ``classes`` has ``class, tokens``."""
    p, q = THRESHOLD
    frequency, bands = _frequencies(classes)
    met = classes.select(F.col("class").alias("a"), F.col("class").alias("b")).where("false")
    for tier in _tiers(bands):
        met = met.unionByName(_met(classes, frequency, tier))
    tokens = classes.select("class", "tokens")
    both = met.distinct().join(tokens.select(F.col("class").alias("a"), F.col("tokens").alias("ta")), "a").join(tokens.select(F.col("class").alias("b"), F.col("tokens").alias("tb")), "b")
    common = F.size(F.array_intersect("ta", "tb"))
    return both.where(common * q >= (F.size("ta") + F.size("tb") - common) * p).select("a", "b")


def note_classes(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of notes with equal token sets (``class, tokens``) and the members (``class, id``); each id once.

    Notes with a null id and notes without any word don't take part. If rows of one id differ, the first in the order of
    title, body and tags counts.
    """
    fields = [F.coalesce(F.col("title"), F.lit("")), F.coalesce(F.col("body"), F.lit("")), F.coalesce(F.concat_ws("\n", "tags"), F.lit(""))]
    texts = notes.where("id is not null").select("id", F.concat_ws("\n", *fields).alias("text"))
    # written before anything else looks at the tokens: the expressions would be evaluated anew for every use
    sets = written(texts.groupBy("id").agg(F.min("text").alias("text")).select("id", token_set(F.col("text")).alias("tokens")), "notes")
    one = sets.where(F.size("tokens") > 0).withColumn("class", F.expr("xxhash64(tokens, 17)"))
    return one.groupBy("class").agg(F.first("tokens").alias("tokens")), one.select("class", "id")


def similar_notes(notes: DataFrame) -> DataFrame:
    """``id_a, id_b`` (id_a < id_b) of all pairs of ids whose token sets reach the threshold, equal sets included."""
    classes, members = note_classes(notes)
    classes = written(classes, "classes")
    links = similar_classes(classes)
    x, y = members.select(F.col("class").alias("a"), F.col("id").alias("x")), members.select(F.col("class").alias("b"), F.col("id").alias("y"))
    across = links.join(x, "a").join(y, "b").select("x", "y")
    # of a class of very many copies each part of the one side meets all of the other in a task of its own
    counts = members.groupBy("class").agg(F.ceil(F.count("*") / HOT).cast("int").alias("parts"), F.count("*").alias("n")).where("n > 1").drop("n")
    sized = members.join(counts, "class")
    one = sized.select("class", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.col("id").alias("x"))
    other = sized.select("class", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("id").alias("y"))
    equal = one.join(other, ["class", "part"]).where("x < y").select("x", "y")
    return across.unionByName(equal).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def note_groups(notes: DataFrame) -> DataFrame:
    """``id, class_id, links``: one row of each id, its class of equal notes, named by the smallest id in it, and the number of
    other classes it is near."""
    classes, members = note_classes(notes)
    links = similar_classes(written(classes, "classes"))
    ends = links.select(F.col("a").alias("class")).unionByName(links.select(F.col("b").alias("class")))
    counted = ends.groupBy("class").agg(F.count("*").alias("links"))
    named = members.groupBy("class").agg(F.min("id").alias("class_id")).join(counted, "class", "left")
    return members.join(named, "class").select("id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))
