"""Notes that meet: for each note the others of its group that share two tags or have titles alike.

The pairs are quadratic in the notes of one vocabulary, so they are never exchanged, sorted or written in between: notes
are, and each task lists the partners of its share of a group from the whole group, both ways of a pair apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lorekeep.session import written

#: Notes of a group that one task lists the partners of, unless the group is larger than so many times the shares.
SHARE = 4096
MOST_SHARES = 32
#: Rows of small groups that are worked on at once, and partners given out at once.
ROWS = 1 << 14
PARTNERS = 1 << 16


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of one or more whole groups; rows come sorted by ``g`` and ``share``."""
    held, rows, last = [], 0, None
    for b in batches:
        if not b.num_rows:
            continue
        g, share = (b.column(c).to_numpy(zero_copy_only=False) for c in ("g", "share"))
        begins = np.flatnonzero(np.r_[last is not None and (g[0], share[0]) != last, (g[1:] != g[:-1]) | (share[1:] != share[:-1])])
        last = (g[-1], share[-1])
        if len(begins) and rows + begins[-1] >= ROWS:
            yield pa.Table.from_batches([*held, b.slice(0, begins[-1])]).combine_chunks()
            held, rows, b = [], 0, b.slice(begins[-1])
        held.append(b)
        rows += b.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of lists: each value's row and number, and the rows' lengths."""
    lists = lists.combine_chunks()
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.list_flatten(lists).dictionary_encode()
    return np.repeat(np.arange(len(n)), n), values.indices.to_numpy(zero_copy_only=False).astype(np.int64), n


class _Postings:
    """The rows that hold a key; entries are asked for by row."""

    def __init__(self, row: np.ndarray, key: np.ndarray, rows: int):
        order = np.argsort(row, kind="stable")
        _, at, n = np.unique(key[order], return_inverse=True, return_counts=True)
        self.members = row[order][np.argsort(at, kind="stable")]
        ends = np.cumsum(n)
        self.starts, self.ends = (ends - n)[at], ends[at]
        self.of = np.searchsorted(row[order], np.arange(rows + 1))

    def met(self, row: int) -> list[np.ndarray]:
        e = slice(self.of[row], self.of[row + 1])
        return [self.members[a:b] for a, b in zip(self.starts[e].tolist(), self.ends[e].tolist(), strict=True)]


def _partners(t: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Of each own row its number and those of its partners, in order."""
    g, share = t["g"].to_numpy(), t["share"].to_numpy()
    group = np.cumsum(np.r_[False, (g[1:] != g[:-1]) | (share[1:] != share[:-1])])

    row, tag, n_tags = _flat(t["tags"])
    order = np.lexsort((tag, row))
    row, tag, many = row[order], tag[order], int(tag.max(initial=0)) + 1
    rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, int(n_tags.max(initial=0))):
        i = np.flatnonzero(row[d:] == row[:-d])
        rows.append(row[i])
        keys.append((group[row[i]] * many + tag[i]) * many + tag[i + d])
    tagged = _Postings(np.concatenate(rows), np.concatenate(keys), len(g))

    row, word, n = _flat(t["w"])
    begin = np.cumsum(n) - n
    key = group[row] * (int(word.max(initial=0)) + 1) + word
    _, at, df = np.unique(key, return_inverse=True, return_counts=True)
    order = np.lexsort((at, df[at], row))
    # alike at 0.4 means at least ceil(0.4 * n) words in common, so one of the n - ceil(0.4 * n) + 1 rarest
    rare = order[np.arange(len(row)) - begin[row] < (n - (2 * n + 4) // 5 + 1)[row]]
    titled = _Postings(row[rare], at[rare], len(g))
    own = np.zeros(int(word.max(initial=0)) + 1, np.int32)
    first = np.searchsorted(group, np.arange(group[-1] + 2)).tolist()
    there = np.zeros(len(g), bool)

    def distinct(found: list[np.ndarray], k: int) -> np.ndarray:
        """In order, of rows of the group ``k``."""
        a, b = first[k], first[k + 1]
        y = np.concatenate(found) if found else np.zeros(0, np.int64)
        if len(y) * 16 < b - a:
            y = np.sort(y)
            return y[np.r_[True, y[1:] != y[:-1]]] if len(y) else y
        there[y] = True
        out = np.flatnonzero(there[a:b]) + a
        there[out] = False
        return out

    for x in np.flatnonzero(t["own"].to_numpy()).tolist():
        found = tagged.met(x)
        if n[x]:
            y = distinct(titled.met(x), group[x])
            y = y[(n[y] * 5 >= n[x] * 2) & (n[x] * 5 >= n[y] * 2)]
            ends = np.cumsum(n[y])
            theirs = word[np.arange(ends[-1]) + np.repeat(begin[y] - ends + n[y], n[y])]
            mine = word[begin[x] : begin[x] + n[x]]
            own[mine] = 1
            common = np.add.reduceat(own[theirs], ends - n[y])
            own[mine] = 0
            found.append(y[common * 5 >= (n[x] + n[y] - common) * 2])
        y = distinct(found, group[x])
        yield x, y[y != x]


def partners(notes: DataFrame, result: str | StructType, give: Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch], among: Callable[[pa.Table], Callable[[int, np.ndarray], np.ndarray]] | None = None, own: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the schema ``result``, made by ``give`` of a table of notes, numbers of rows in it, how many partners each of
    them has, and the partners' numbers. Partners come in the order of their ids.

    ``notes`` has a row for each ``id``, with ``scope`` (those without one meet none and are left out), ``p``, ``tags`` and
    ``w`` without repeats or nulls, and what ``give`` and ``among`` read; columns ``own`` are only there in rows they are
    asked for. It is read more than once, so it should be written. ``among`` makes of a table what keeps some of a row's partners.
    """
    n = F.count("*")
    groups = notes.where("scope is not null").groupBy("scope", "p").agg(n.alias("__n"), F.least(F.ceil(n / SHARE), F.lit(MOST_SHARES)).cast("int").alias("__shares"))
    groups = written(groups.withColumn("g", F.monotonically_increasing_id()), "groups")
    shares = groups.agg(F.sum("__shares")).first()[0] or 1
    mine = F.pmod(F.xxhash64("id"), F.col("__shares")).cast("int")
    rows = notes.join(groups, ["scope", "p"]).withColumn("__mine", mine).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("__shares") - 1))).withColumn("own", F.col("share") == F.col("__mine"))
    rows = rows.withColumns({c: F.when(F.col("own"), F.col(c)) for c in own}).drop("scope", "p", "__n", "__shares", "__mine")
    # a number, so that shares of much work aren't put together for their few bytes
    tasks = min(shares, 4 * int(notes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(tasks, "g", "share").sortWithinPartitions("g", "share", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches):
            kept = among(t) if among else None
            xs, ys, size = [], [], 0
            for x, y in _partners(t):
                xs.append(x)
                ys.append(kept(x, y) if kept else y)
                size += len(ys[-1]) + 1
                if size >= PARTNERS:
                    yield give(t, np.array(xs), np.array([len(y) for y in ys]), np.concatenate(ys))
                    xs, ys, size = [], [], 0
            if xs:
                yield give(t, np.array(xs), np.array([len(y) for y in ys]), np.concatenate(ys))

    return rows.mapInArrow(run, result)


def taken(t: pa.Table, column: str, at: np.ndarray) -> pa.Array:
    """Rows of a column as one array."""
    return t[column].combine_chunks().take(pa.array(at, pa.int64()))


def lists(t: pa.Table, n: np.ndarray, at: np.ndarray) -> pa.Array:
    """The ids of partners as a list for each row."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), taken(t, "id", at))
