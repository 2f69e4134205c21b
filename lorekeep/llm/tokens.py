"""Byte-level BPE of whole columns with the vocabulary of a public tokenizer.

A text is cut into words by the tokenizer's own pattern. Each word's merges run on one contiguous array of part
boundaries with the rank of every adjacent pair: the minimum is searched, its boundary deleted, the neighbouring ranks
refreshed. Words repeat, so a worker keeps the ids of those it has met (in a table of bounded size).
"""

from __future__ import annotations

import base64
import heapq
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

#: Folder of the public vocabulary files; a parameter of every function below.
VOCABULARIES = os.environ.get("LOREKEEP_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
#: Fixed value: the word pattern that belongs to the vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the pattern's \s has it; between a character that isn't and one that is, words always end.
_SPACE = "\t-\r\x20\x85\xa0  -     　"
_CHUNK = f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+"
#: Words of up to so many bytes are merged by scanning the array, longer ones with a heap (same result).
SHORT = 128
#: Words and chunks that a worker remembers.
REMEMBERED = 400_000
#: Ids after which the texts encoded so far are handed on, and texts taken from Arrow at once.
SLICE, TEXTS = 1 << 18, 64
_NONE = 1 << 30


def _scan(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    cuts = list(range(len(word) + 1))
    pair = [ranks.get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while pair:
        low = min(pair)
        if low == _NONE:
            break
        i = pair.index(low)
        del cuts[i + 1], pair[i]
        if i < len(pair):
            pair[i] = ranks.get(word[cuts[i] : cuts[i + 2]], _NONE)
        if i:
            pair[i - 1] = ranks.get(word[cuts[i - 1] : cuts[i + 1]], _NONE)
    return [ranks[word[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]


def _heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(word)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    todo = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(todo)
    while todo:
        _, i, end = heapq.heappop(todo)
        j = after[i] if alive[i] else n
        if j >= n or after[j] != end:
            continue
        alive[j] = False
        after[i] = end
        if end < n:
            before[end] = i
            if (r := ranks.get(word[i : after[end]])) is not None:
                heapq.heappush(todo, (r, i, after[end]))
        if (h := before[i]) >= 0 and (r := ranks.get(word[h:end])) is not None:
            heapq.heappush(todo, (r, h, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word. Of equally low ranks the leftmost pair is merged first."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    return _scan(word, ranks) if len(word) <= SHORT else _heap(word, ranks)


class Encoder:
    """Encodes texts as ordinary text: strings that look like special tokens have no special meaning."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.words, self.chunks = regex.compile(WORDS).findall, re.compile(_CHUNK).findall
        self.word_ids: dict[str, list[int]] = {}
        self.chunk_ids: dict[str, list[int]] = {}

    def _chunk(self, chunk: str) -> list[int]:
        known, out = self.word_ids, []
        for word in self.words(chunk):
            ids = known.get(word)
            if ids is None:
                ids = merge(word.encode("utf-8", "surrogatepass"), self.ranks)
                if len(known) < REMEMBERED and len(word) <= SHORT:
                    known[word] = ids
            out += ids
        if len(self.chunk_ids) < REMEMBERED and len(chunk) <= SHORT:
            self.chunk_ids[chunk] = out
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; of a null or empty one an empty list."""
        out: list[int] = []
        if not text:
            return out
        known, make = self.chunk_ids.get, self._chunk
        for chunk in self.chunks(text):
            ids = known(chunk)
            out += make(chunk) if ids is None else ids
        return out


def _file(name: str, folder: str) -> str:
    """The vocabulary's path here: in the folder, or where :func:`share` put it."""
    path = f"{folder}/{name}.tiktoken"
    return path if os.path.exists(path) else SparkFiles.get(f"{name}.tiktoken")


@lru_cache(maxsize=4)
def encoder(name: str = VOCABULARY, folder: str = VOCABULARIES) -> Encoder:
    return Encoder(_file(name, folder))


@lru_cache(maxsize=16)
def width(name: str = VOCABULARY, folder: str = VOCABULARIES) -> int:
    """Bytes of an id: 2, or 4 for a vocabulary of more than 65 536."""
    with open(_file(name, folder), "rb") as f:
        return 2 if max((int(x.split()[1]) for x in f if x.strip()), default=0) < 1 << 16 else 4


_shared: set[tuple[str, str]] = set()


def share(spark: SparkSession, name: str = VOCABULARY, folder: str = VOCABULARIES) -> None:
    """Give the vocabulary file to workers that don't see the folder, once an application; local ones see it."""
    context, path = spark.sparkContext, f"{folder}/{name}.tiktoken"
    if not context.master.startswith("local[") and (context.applicationId, path) not in _shared and os.path.exists(path):
        context.addFile(path)
        _shared.add((context.applicationId, path))


def encode_column(df: DataFrame, key: str, text: str, ids: str = "ids", name: str = VOCABULARY, folder: str = VOCABULARIES) -> DataFrame:
    """``key`` and the ids of ``text`` as ``array<int>``; null and empty texts give an empty array, never null.

    One row comes out for each that goes in, whatever the key (null and repeated keys too). Nothing is shuffled, and
    only the two columns are read.
    """
    share(df.sparkSession, name, folder)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name, folder).encode

        def made(batch: pa.RecordBatch, first: int, flat: array, ends: list[int]) -> pa.RecordBatch:
            values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if len(flat) else [], pa.int32()))
            return pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(ends) - 1), values], names=[key, ids])

        for batch in batches:
            first, flat, ends = 0, array("i"), [0]
            for at in range(0, batch.num_rows, TEXTS):
                for t in batch.column(1).slice(at, TEXTS).to_pylist():
                    flat.extend(encode(t))
                    ends.append(len(flat))
                if len(flat) >= SLICE:
                    yield made(batch, first, flat, ends)
                    first, flat, ends = first + len(ends) - 1, array("i"), [0]
            if len(ends) > 1:
                yield made(batch, first, flat, ends)

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, `{ids}` array<int>")
