"""A mix of sources at target weights, in fixed-length blocks of tokens.

The token stream of each source is packed into blocks. Each output shard draws by a multinomial how many of its slots a
source fills; every shard has its own seed, so any task can draw for any shard and no list of shards exists anywhere. A
source's slots are numbered through all shards. The draws' totals stray from the plan by about the root of the number of
slots; so many slots of the sources that drew too many, spread evenly, go to those that drew too few, and the actual shares
and the caps are met exactly to the block. Number q stands for pass ``q // n`` over the source's n blocks and, in that pass,
for the block that a pseudorandom permutation of the indices puts there. Blocks are joined to slots by index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorekeep.llm.tokens import VOCABULARIES, VOCABULARY, encoder, share, width
from lorekeep.session import written

#: Tokens of a block.
BLOCK = 512
#: Slots of an output shard.
SHARD = 4096
#: Shards that one row of work draws for.
RANGE = 32
#: Most sources that a table of targets may name: the plan is made on the driver.
MOST_SOURCES = 10_000
SEED = 20


@dataclass(frozen=True)
class Share:
    source: str
    target: float
    repeats: int
    tokens: int
    blocks: int
    slots: int


def plan(targets: list[tuple[str, float, int]], tokens: dict[str, int], block: int = BLOCK) -> list[Share]:
    """How many slots each source fills.

    The mix is as large as all sources together. A source whose target would take more passes than ``max_repeats``
    gives all it may, and the rest is shared out among the others by their targets. Sources without tokens, and
    targets or repeats that are null or not positive, give nothing.
    """
    rows = [(s, max(w or 0.0, 0.0), max(r or 0, 0), tokens.get(s, 0)) for s, w, r in sorted(targets)]
    blocks = {s: math.ceil(n / block) for s, _, _, n in rows}
    slots = dict.fromkeys(blocks, 0)
    free = [(s, w, r * blocks[s]) for s, w, r, _ in rows if w > 0 and r * blocks[s] > 0]
    left = sum(blocks[s] for s, w, r, _ in rows if w > 0 and r > 0)
    while free and left > 0:
        weight = sum(w for _, w, _ in free)
        full = [x for x in free if left * x[1] / weight >= x[2]]
        if not full:
            ideal = {s: left * w / weight for s, w, _ in free}
            got = {s: int(v) for s, v in ideal.items()}
            for s in sorted(ideal, key=lambda s: (got[s] - ideal[s], s))[: left - sum(got.values())]:
                got[s] += 1
            slots |= got
            break
        for s, _, most in full:
            slots[s] = most
            left -= most
        free = [x for x in free if x not in full]
    return [Share(s, w, r, n, blocks[s], slots[s]) for s, w, r, n in rows]


def shard_draw(weights: np.ndarray, shard: int, size: int, seed: int = SEED) -> np.ndarray:
    """How many of the ``size`` slots of a shard each source fills: a multinomial draw of the shard's own generator."""
    return np.random.default_rng((seed, shard)).multinomial(size, weights / weights.sum()).astype(np.int64)


@dataclass(frozen=True)
class Settled:
    """Slots as drawn brought to the plan: of the sources that drew too many, evenly spread numbers go to the others."""

    planned: np.ndarray
    drawn: np.ndarray

    def numbers(self, source: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The source and the number in it that a source's drawn slots ``q`` stand for in the end."""
        over = np.maximum(self.drawn - self.planned, 0)
        x, all_ = int(over[source]), max(int(self.drawn[source]), 1)
        before = q * x // all_
        out, number = np.full(len(q), source, np.int64), q - before
        moved = (q + 1) * x // all_ > before
        if moved.any():
            short = np.maximum(self.planned - self.drawn, 0)
            ends = np.cumsum(short)
            j = int(over[:source].sum()) + before[moved]
            to = np.searchsorted(ends, j, side="right")
            out[moved] = to
            number[moved] = self.drawn[to] + j - (ends - short)[to]
        return out, number


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Images of indices under a pseudorandom permutation of 0..n-1: a Feistel network, walked until it lands inside."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> np.uint64(half), x & mask
        for r in range(4):
            f = (b + np.uint64((key * 4 + r + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            a, b = b, a ^ ((f >> np.uint64(29)) & mask)
        return (a << np.uint64(half)) | b

    x = once(index.astype(np.uint64))
    while (out := x >= np.uint64(n)).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


def encoded(documents: DataFrame, sources: list[str], name: str = VOCABULARY, folder: str = VOCABULARIES) -> DataFrame:
    """``source, doc_id, n, tokens, rid`` of the listed sources' documents (at most ``MOST_SOURCES``); tokens little-endian,
    :func:`width` bytes each; ``rid`` numbers the rows and is fixed once the table is written.

    Null, empty texts and documents with a null id or with a source that is null or not listed don't come out.
    """
    spark = documents.sparkSession
    bytes_ = width(name, folder)
    share(spark, name, folder)
    listed = spark.createDataFrame([(s,) for s in sources], "source string")
    picked = documents.where("doc_id is not null and source is not null and text is not null").select("source", "doc_id", "text")
    picked = picked.join(F.broadcast(listed), "source", "left_semi").where("text <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name, folder).encode
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                packed = [np.asarray(encode(t), f"<u{bytes_}").tobytes() for t in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) // bytes_ for x in packed], pa.int32()), pa.array(packed, pa.binary())], names=["source", "doc_id", "n", "tokens"])

    return picked.mapInArrow(run, "source string, doc_id bigint, n int, tokens binary").withColumn("rid", F.monotonically_increasing_id())


def _starts(docs: DataFrame) -> DataFrame:
    """``rid, start``: where each document begins in the token stream of its source, in the order of the ids.

    Ranges of the sorted rows are summed for themselves, each by one task, and then their few sums one after the other:
    a source of any size, and ids however sparse, never make one task long.
    """
    narrow = docs.select("source", "doc_id", "rid", "n").repartitionByRange("source", "doc_id", "rid").sortWithinPartitions("source", "doc_id", "rid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, total = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            at = []
            for source, n in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if source != last:
                    last, total = source, 0
                at.append(total)
                total += n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * len(at), pa.int32()), batch.column(2), batch.column(3), pa.array(at, pa.int64())], names=["source", "part", "rid", "n", "at"])

    local = written(narrow.mapInArrow(run, "source string, part int, rid bigint, n int, at bigint"), "offsets")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = local.groupBy("source", "part").agg(F.sum("n").alias("sum")).select("source", "part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    return local.join(base, ["source", "part"]).select("rid", (F.col("base") + F.col("at")).alias("start"))


def packed_blocks(docs: DataFrame, block: int = BLOCK, bytes_: int = 2) -> DataFrame:
    """``source, block, n_tokens, tokens``: each source's documents in order of their ids, end to end, cut into blocks.

    ``docs`` is a written table of :func:`encoded`, ``bytes_`` the bytes of a token. The last block of a source is shorter. Rows of one id lie one behind
    the other.
    """
    placed = docs.select("rid", "source", "n", "tokens").join(_starts(docs), "rid").where("n > 0")
    first = F.floor(F.col("start") / block)
    pieces = placed.withColumn("block", F.explode(F.sequence(first, F.floor((F.col("start") + F.col("n") - 1) / block))))
    lo = F.greatest(F.col("block") * block - F.col("start"), F.lit(0))
    hi = F.least((F.col("block") + 1) * block - F.col("start"), F.col("n"))
    pieces = pieces.select("source", "block", F.greatest(F.col("start"), F.col("block") * block).alias("from"), F.substring("tokens", (lo * bytes_ + 1).cast("int"), ((hi - lo) * bytes_).cast("int")).alias("piece"))
    joined = pieces.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("from", "piece"))).alias("p"))
    tokens = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["piece"]))
    return joined.select("source", "block", tokens.alias("tokens")).withColumn("n_tokens", (F.length("tokens") / bytes_).cast("int"))


def slots(spark: SparkSession, shares: list[Share], shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """``shard, slot, source, pass, block`` of the whole mix.

    Two passes over ranges of shards, both drawn in tasks: the first sums each range's draws, the second draws the same
    again and numbers the slots from the sums of the ranges before. The driver holds a few numbers a source.
    """
    names, blocks = [s.source for s in shares], [max(s.blocks, 1) for s in shares]
    planned = np.array([s.slots for s in shares], np.int64)
    total = int(planned.sum())
    shards = -(-total // shard)
    out = "shard bigint, slot int, source string, pass int, block bigint"
    if not total:
        return spark.createDataFrame([], out)
    weights = planned.astype(np.float64)
    ranges = -(-shards // RANGE)
    parts = int(min(ranges, max(spark.sparkContext.defaultParallelism * 2, ranges // 64)))

    def draws(r: int) -> Iterator[tuple[int, np.ndarray]]:
        for k in range(r * RANGE, min((r + 1) * RANGE, shards)):
            yield k, shard_draw(weights, k, min(shard, total - k * shard), seed)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.column(0).to_pylist():
                n = sum(d for _, d in draws(r))
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), r), pa.int64()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["r", "s", "n"])

    drawn = written(spark.range(0, ranges, 1, parts).mapInArrow(sums, "r bigint, s int, n bigint"), "draws")
    sizes = np.zeros(len(shares), np.int64)
    for row in drawn.groupBy("s").agg(F.sum("n").alias("n")).collect():  # one row a source
        sizes[row["s"]] = row["n"]
    settled = Settled(planned, sizes)
    before = Window.partitionBy("s").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    base = drawn.select("r", "s", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    work = base.groupBy("r").agg(F.collect_list(F.struct("s", "base")).alias("bases"))  # at most one entry a source

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, bases in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                first = np.zeros(len(names), np.int64)
                for b in bases:
                    first[b["s"]] = b["base"]
                for k, draw in draws(r):
                    held = [settled.numbers(int(s), np.arange(first[s], first[s] + draw[s])) for s in np.flatnonzero(draw)]
                    first += draw
                    source, number = (np.concatenate(x) for x in zip(*held, strict=True))
                    n = np.array(blocks, np.int64)[source]
                    turn, index = number // n, number % n
                    for s, t in np.unique(np.stack([source, turn]), axis=1).T.tolist():
                        own = (source == s) & (turn == t)
                        index[own] = permuted(index[own], blocks[s], (seed * 1_000_003 + s) * 4096 + t)
                    slot = permuted(np.arange(len(source), dtype=np.int64), len(source), seed * 7_919 + k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(source), k), pa.int64()), pa.array(slot, pa.int32()), pa.array([names[s] for s in source.tolist()], pa.string()), pa.array(turn, pa.int32()), pa.array(index, pa.int64())], names=["shard", "slot", "source", "pass", "block"])

    return work.mapInArrow(run, out)


def _targets(targets: DataFrame) -> list[tuple[str, float, int]]:
    rows = targets.where("source is not null").groupBy("source").agg(F.max("target_share"), F.max("max_repeats")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    return [tuple(r) for r in rows]


def _planned(docs: DataFrame, targets: list[tuple[str, float, int]], block: int) -> list[Share]:
    sizes = docs.groupBy("source").agg(F.sum("n").alias("n")).collect()  # one row a listed source
    return plan(targets, {r["source"]: r["n"] for r in sizes}, block)


def mix(documents: DataFrame, targets: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED, name: str = VOCABULARY, folder: str = VOCABULARIES) -> DataFrame:
    """``shard, slot, source, pass, block, n_tokens, tokens`` of the whole mix; see :func:`unpacked` for the ids.

    Documents whose source is null or not listed stay out, as do null and empty texts. An empty table gives no rows.
    """
    listed = _targets(targets)
    docs = written(encoded(documents, [t[0] for t in listed], name, folder), "encoded")
    chosen = slots(documents.sparkSession, _planned(docs, listed, block), shard, seed)
    # both sides grow with the data, whatever the planner makes of the slots' size
    return chosen.hint("merge").join(packed_blocks(docs, block, width(name, folder)), ["source", "block"]).select("shard", "slot", "source", "pass", "block", "n_tokens", "tokens")


def shares(documents: DataFrame, targets: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED, name: str = VOCABULARY, folder: str = VOCABULARIES) -> DataFrame:
    """``source, target_share, max_repeats, tokens, blocks, slots, mixed_tokens, actual_share, passes`` of each target."""
    spark = documents.sparkSession
    listed = _targets(targets)
    docs = written(encoded(documents, [t[0] for t in listed], name, folder).select("source", "n"), "sizes")
    planned = _planned(docs, listed, block)
    rows = [(s.source, s.target, s.repeats, s.tokens, s.blocks, s.slots, s.tokens % block or (block if s.tokens else 0)) for s in planned]
    frame = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, tokens bigint, blocks bigint, slots bigint, rest bigint")
    drawn = slots(spark, planned, shard, seed).join(F.broadcast(frame.select("source", "blocks", "rest")), "source")
    n = F.when(F.col("block") == F.col("blocks") - 1, F.col("rest")).otherwise(block)
    sums = drawn.groupBy("source").agg(F.sum(n).alias("mixed_tokens"), (F.max("pass") + 1).alias("passes"))
    out = frame.join(sums, "source", "left").na.fill(0, ["mixed_tokens", "passes"])
    return out.select("source", "target_share", "max_repeats", "tokens", "blocks", "slots", "mixed_tokens", (F.col("mixed_tokens") / F.sum("mixed_tokens").over(Window.partitionBy())).alias("actual_share"), "passes")


def unpacked(rows: DataFrame, bytes_: int = 2) -> DataFrame:
    """The rows of :func:`mix` with ``tokens`` as ``array<int>``; ``bytes_`` is the vocabulary's :func:`width`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("tokens")
            ids = [np.frombuffer(x, f"<u{bytes_}").astype(np.int32) for x in batch.column(at).to_pylist()]
            yield batch.set_column(at, "tokens", pa.array(ids, pa.list_(pa.int32())))

    fields = ", ".join(f"`{f.name}` {'array<int>' if f.name == 'tokens' else f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, fields)
