"""Keyword-stuffed and link-list pages, found by the perplexity of their word-class sequences.

Texts become sequences of classes: function words stand for themselves, every other word is replaced by its shape, a link
and a number each by one class, a mark by itself. A class also tells how the token repeats what stands shortly before it:
not, the word alone, the pair with the word before, or within a long run of repeated pairs. An interpolated trigram model
of these sequences is trained on labelled pages of prose (and of code, logs, tables, all that isn't stuffed). A page is
flagged if its perplexity under this one model is abnormally high or low. The two bounds are set on the labelled pages,
each scored by a model that hasn't seen it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words kept as themselves: those in most labelled pages of prose.
FUNCTION_WORDS = 160
#: Texts with fewer class tokens aren't judged.
LEAST_TOKENS = 16
#: How many tokens before it a token is held against, and the lengths of runs of repeated pairs that make a class.
WINDOW = 64
RUNS = (8, 24)
#: Parts the labelled pages are put in; each is scored by the model of the others.
FOLDS = 4
#: A page of prose that is flagged counts as so many stuffed ones that are missed, since labels hold few pages of prose.
PROSE_COST = 4
#: A low bound is set only if it spares at least so many stuffed pages.
LEAST_LOW = 3
#: Bytes of text that are worked on at once.
SLICE = 1 << 20

# Classes of one repeat level: 0 page edge, 1 line end, 2.. shapes, 16.. marks, 16 + 112 + i function words.
_LOWER, _TITLE, _UPPER, _NUMBER, _MIXED, _HAN, _OTHER, _ACCENT, _LINK = range(2, 11)
_MARKS = 16
_FUNCTION = _MARKS + 112
_PLAIN = _FUNCTION + FUNCTION_WORDS + 1
_V = _PLAIN * (3 + len(RUNS))

#: What a link is replaced by before the text is cut into tokens, one of the private characters.
_LINK_MARK = "\ue000"
_LINKS = re.compile(r"(?:https?://|www\.)[^\s<>\"'，。；、）)\]|]+", re.I)
_NUMBERS = re.compile(r"\d+(?:[.,:]\d+)+")


def _char_table() -> np.ndarray:
    kind = np.full(1 << 16, 7, np.uint8)  # 0 blank, 1 line end, 2 lower, 3 upper, 4 digit, 5 han, 6 mark, 7 other, 8 link
    for c in range(1 << 16):
        x = chr(c)
        if 0x4E00 <= c <= 0x9FFF:
            kind[c] = 5
        elif 0xD800 <= c <= 0xDFFF:
            continue
        elif x in "\n\r  ":
            kind[c] = 1
        elif x.isspace() or c < 32:
            kind[c] = 0
        elif x.isdigit():
            kind[c] = 4
        elif x.isalpha() or x == "_":
            kind[c] = 3 if x.isupper() else 2
        elif c < 128 or 0x3000 <= c <= 0x303F or 0xFF00 <= c <= 0xFF65 or 0x2010 <= c <= 0x203B or 0x2190 <= c <= 0x21FF:
            kind[c] = 6
    kind[ord(_LINK_MARK)] = 8
    return kind


_KIND = _char_table()
_MULT = np.uint64(1099511628211)
_PRIME = np.array([pow(1099511628211, i, 1 << 64) for i in range(64)], np.uint64)


def _pieces(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: each token's shape class, hash (lower case), text number, and whether it is a word or Han character."""
    joined = "\x00".join(_NUMBERS.sub("0", _LINKS.sub(_LINK_MARK, (t or "").replace("\x00", " "))) for t in texts)
    codes = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), np.uint32) if len(joined.lower()) == len(joined) else None
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = raw if codes is None else codes
    edge = raw == 0
    kind = np.where(raw < 1 << 16, _KIND[np.minimum(raw, (1 << 16) - 1)], 7).astype(np.uint8)
    kind[edge] = 1
    word = (kind >= 2) & (kind <= 4)
    start = np.ones(len(raw), bool)
    start[1:] = ~(word[1:] & word[:-1])
    start &= kind != 0
    at = np.flatnonzero(start)
    if not len(at):
        return (np.zeros(0, np.int32),) * 2 + (np.zeros(0, np.int64), np.zeros(0, bool))
    # a word ends where the next blank or token starts; blanks add nothing to sums
    w = word.astype(np.int32)
    n = np.add.reduceat(w, at)
    upper = np.add.reduceat((kind == 3).astype(np.int32), at)
    digit = np.add.reduceat((kind == 4).astype(np.int32), at)
    owner = np.cumsum(start) - 1
    offset = np.arange(len(raw)) - at[np.maximum(owner, 0)]
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * _PRIME[np.clip(offset, 0, 63)]
    mixed[kind == 0] = 0
    hashed = np.add.reduceat(mixed, at)
    hashed ^= hashed >> np.uint64(29)
    k = kind[at]
    wide = np.add.reduceat(((raw > 127) & word).astype(np.int32), at)
    shape = np.select(
        [k == 1, k == 5, k == 6, k == 7, k == 8, digit == n, digit > 0, upper == 0, (upper == 1) & (k == 3), upper == n],
        [1, _HAN, _MARKS + (hashed % np.uint64(112)).astype(np.int32), _OTHER, _LINK, _NUMBER, _MIXED, np.where(wide > 0, _ACCENT, _LOWER), _TITLE, _UPPER],
        _MIXED,
    ).astype(np.int32)
    doc = np.cumsum(edge)[at]
    keep = ~edge[at]
    wordy = ((k >= 2) & (k <= 5))[keep]
    return shape[keep], hashed[keep].view(np.int64), doc[keep], wordy


@dataclass
class Model:
    words: np.ndarray  # sorted hashes of the function words
    prose: tuple  # of _prepare
    low: float  # mean negative log-probabilities below and above which a page is flagged
    high: float


def _repeats(shape: np.ndarray, hashed: np.ndarray, doc: np.ndarray, wordy: np.ndarray) -> np.ndarray:
    """Of each token: 0, or 1 if its word, 2 if its pair with the word before stands in the ``WINDOW`` tokens before it,
    3 and more within runs of such pairs. Numbers repeat nothing."""
    n = len(shape)
    index = np.arange(n)
    begins = np.r_[True, doc[1:] != doc[:-1]]

    def again(keys: np.ndarray) -> np.ndarray:
        own = keys.view(np.uint64) ^ (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(own, kind="stable")
        same = (own[order][1:] == own[order][:-1]) & (order[1:] - order[:-1] <= WINDOW)
        out = np.zeros(n, bool)
        out[order[1:]] = same
        return out

    pair = (hashed.view(np.uint64) * _MULT ^ np.r_[np.uint64(0), hashed.view(np.uint64)[:-1]]).view(np.int64)
    level = np.where(again(pair), 2, (again(hashed) & wordy).astype(np.int64))
    level[shape == _NUMBER] = 0
    broken = np.where(((level != 2) & wordy) | begins, index, 0)
    run = index - np.maximum.accumulate(broken)
    return level + np.where(level == 2, sum((run >= r).astype(np.int64) for r in RUNS), 0)


def _classes(texts: list, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    shape, hashed, doc, wordy = _pieces(texts)
    if not len(shape):
        return shape.astype(np.int64), doc
    cls = shape + _repeats(shape, hashed, doc, wordy) * _PLAIN * (shape >= 2)
    if len(words):
        i = np.minimum(np.searchsorted(words, hashed), len(words) - 1)
        cls = np.where(wordy & (words[i] == hashed), _FUNCTION + i, cls)
    return cls.astype(np.int64), doc


def _grams(cls: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the trigram and the bigram that end at each token, and of the two classes before it; at first the page edge."""
    c = cls.astype(np.int64)
    p1 = np.zeros_like(c)
    p2 = np.zeros_like(c)
    if len(c) > 1:
        p1[1:] = np.where(doc[1:] == doc[:-1], c[:-1], 0)
    if len(c) > 2:
        p2[2:] = np.where(doc[2:] == doc[:-2], c[:-2], 0)
    return (p2 * _V + p1) * _V + c, p1 * _V + c, p2 * _V + p1


def _lookup(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    k, v = table
    if not len(k):
        return np.zeros(len(keys))
    i = np.minimum(np.searchsorted(k, keys), len(k) - 1)
    return np.where(k[i] == keys, v[i], 0.0)


def _prepare(keys: np.ndarray, n: np.ndarray) -> tuple:
    """A model from its trigram counts, sorted by key: Witten and Bell's interpolation of 3, 2 and 1 classes. A context seen
    n times with t different followers gives its own estimate the weight n / (n + t), and the rest to the shorter one."""
    pair, at = np.unique(keys % (_V * _V), return_inverse=True)
    pairs = np.bincount(at, n, len(pair))
    uni = np.bincount(pair % _V, pairs, _V)
    seen = max((uni > 0).sum(), 1)  # a model of nothing finds every class alike
    uni = (uni + seen / _V) / (uni.sum() + seen)

    def weights(context: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u, at = np.unique(context, return_inverse=True)
        seen, kinds = np.bincount(at, count, len(u)), np.bincount(at, minlength=len(u))
        return u, seen / (seen + kinds), count / (seen + kinds)[at]

    context, own, tri_p = weights(keys // _V, n)
    before, own2, pair_p = weights(pair // _V, pairs)
    rest = np.ones(_V)
    rest[before] -= own2
    return (keys, tri_p), (context, own), (pair, pair_p), rest, uni


def _logprob(model: tuple, cls: np.ndarray, doc: np.ndarray) -> np.ndarray:
    tri, context, pair, rest, uni = model
    keys, two, before = _grams(cls, doc)
    shorter = _lookup(pair, two) + rest[before % _V] * uni[cls]
    return np.log(_lookup(tri, keys) + (1 - _lookup(context, before)) * shorter)


def score_texts(texts: list, words: np.ndarray, prose: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Class tokens and mean negative log-probability of each text."""
    cls, doc = _classes(texts, words)
    n = np.bincount(doc, minlength=len(texts)).astype(np.float64)
    return n, -np.bincount(doc, _logprob(prose, cls, doc), len(texts)) / np.maximum(n, 1)


def bounds(score: np.ndarray, stuffed: np.ndarray) -> tuple[float, float]:
    """The low and the high bound that tell labelled pages apart with the least cost; of equal ones the middle."""
    order = np.argsort(score, kind="stable")
    s, y = score[order], stuffed[order].astype(bool)
    # flagging the first i pages costs what is prose in them and spares what is stuffed; the same from the other end
    gain = np.cumsum(np.r_[0.0, np.where(y, 1.0, -PROSE_COST)])
    middle = np.r_[s[0] - 1, (s[1:] + s[:-1]) / 2, s[-1] + 1]
    fits = np.r_[True, s[1:] > s[:-1], True]  # no bound between equal scores
    suffix = np.where(fits, gain[-1] - gain, -np.inf)
    best_high = len(s) - np.argmax(suffix[::-1])  # fewest pages flagged
    widest = suffix == suffix.max()
    first = best_high
    while first > 0 and widest[first - 1]:
        first -= 1
    high = (middle[best_high] + middle[first]) / 2 if best_high < len(s) else middle[best_high]
    prefix = np.where(fits[: first + 1], gain[: first + 1], -np.inf)
    i = int(np.argmax(prefix))
    low = middle[i] if prefix[i] >= LEAST_LOW else -np.inf
    return float(low), float(high)


def _arrow(run, df: DataFrame, schema: str) -> DataFrame:
    """Apply ``run`` to slices of the batches that hold about ``SLICE`` bytes: working arrays take many times that."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            step = max(1, b.num_rows * SLICE // max(b.nbytes, 1))
            for at in range(0, b.num_rows, step):
                yield run(b.slice(at, step))

    return df.mapInArrow(batches, schema)


def bounds_of(judged: DataFrame) -> tuple[float, float] | None:
    """:func:`bounds` of the rows ``y, score`` in the tasks: scores are sorted into ranges, gains summed up in each, and the
    ranges' sums added up. None if a label has no row."""
    from pyspark.sql.window import Window

    from lorekeep.session import cut

    each = judged.groupBy("score").agg(F.sum(F.when(F.col("y") > 0, 1).otherwise(-PROSE_COST)).alias("gain"), F.max("y").alias("most"), F.min("y").alias("least"))
    ranged = cut(each.repartitionByRange("score").withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("part").agg(F.sum("gain").alias("all"))
    base = sums.select(F.col("part").alias("p"), F.coalesce(F.sum("all").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    before = F.coalesce(F.sum("gain").over(Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = cut(ranged.withColumn("own", before).join(base, F.col("part") == F.col("p")).select("score", (F.col("own") + F.col("base")).alias("gain")))

    total, most, least, last = ranged.agg(F.sum("gain"), F.max("most"), F.min("least"), F.max("score")).first()
    if most is None or not (most > 0 >= least):
        return None

    def middle(score: float) -> float:
        below = cuts.where(F.col("score") < score).agg(F.max("score")).first()[0]
        return score - 1 if below is None else (score + below) / 2

    gain, at = cuts.agg(F.min(F.struct("gain", -F.col("score"))).alias("x")).select("x.*").first()
    none = gain >= total  # then no page is flagged for being high
    gain, low = (cuts if none else cuts.where(F.col("score") <= -at)).agg(F.max(F.struct("gain", -F.col("score"))).alias("x")).select("x.*").first()
    if none and total > gain:
        gain, low = total, None
    return (-np.inf if gain < LEAST_LOW else last + 1 if low is None else middle(-low)), (last + 1 if none else middle(-at))


def labelled_pages(documents: DataFrame, labels: DataFrame, most: int | None = None) -> DataFrame:
    """``text, is_spam`` of all labelled documents, or of each label at most ``most``, in the order of a hash of the id.

    A document labelled both ways counts as stuffed; rows with a null id or label and repeated rows add nothing.
    """
    from pyspark.sql.window import Window

    one = labels.where("doc_id is not null and is_spam is not null").groupBy("doc_id").agg(F.max("is_spam").alias("is_spam"))
    if most is not None:
        rank = F.row_number().over(Window.partitionBy("is_spam").orderBy(F.xxhash64("doc_id"), "doc_id"))
        one = one.withColumn("__n", rank).where(F.col("__n") <= most)
    return documents.select("doc_id", "text").join(one.select("doc_id", "is_spam"), "doc_id").select("text", F.col("is_spam").cast("int").alias("is_spam"))


def fit(documents: DataFrame, labels: DataFrame) -> Model | None:
    """Function words and the trigram model of all labelled prose, and the bounds; None if a label has no page.

    What reaches the driver is bounded by the number of classes (function words, distinct trigrams).
    """
    from lorekeep.session import cut

    pages = cut(labelled_pages(documents, labels).withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")))

    def words(b: pa.RecordBatch) -> pa.RecordBatch:
        _, h, d, w = _pieces(b.column(0).to_pylist())
        pairs = np.unique(np.stack([d[w], h[w]], 1), axis=0)
        keys, n = np.unique(pairs[:, 1], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["h", "n"])

    prose = pages.where("is_spam = 0")
    top = _arrow(words, prose.select("text"), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(FUNCTION_WORDS).toPandas()
    known = np.sort(top["h"].to_numpy(np.int64))

    def grams(b: pa.RecordBatch) -> pa.RecordBatch:
        fold = b.column(1).to_numpy(zero_copy_only=False)
        cls, doc = _classes(b.column(0).to_pylist(), known)
        keys, n = np.unique(_grams(cls, doc)[0] * FOLDS + fold[doc], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["k", "n"])

    counts = _arrow(grams, prose.select("text", "fold"), "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    keys, n = counts["k"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)

    def model_of(chosen: np.ndarray) -> tuple:
        u, at = np.unique(keys[chosen] // FOLDS, return_inverse=True)
        return _prepare(u, np.bincount(at, n[chosen], len(u)))

    if not len(keys):
        return None
    others = [model_of(keys % FOLDS != k) for k in range(FOLDS)]

    def scores(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, fold = b.column(0).to_pylist(), b.column(2).to_numpy(zero_copy_only=False)
        size, score = np.zeros(len(texts)), np.zeros(len(texts))
        for k in np.unique(fold):
            at = np.flatnonzero(fold == k)
            size[at], score[at] = score_texts([texts[i] for i in at], known, others[k])
        return pa.RecordBatch.from_arrays([b.column(1).cast(pa.int32()), pa.array(size), pa.array(score)], names=["y", "n", "score"])

    judged = _arrow(scores, pages.select("text", "is_spam", "fold"), "y int, n double, score double").where(F.col("n") >= LEAST_TOKENS)
    found = bounds_of(judged)
    return Model(known, model_of(keys >= 0), *found) if found else None


def page_scores(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_tokens, perplexity, flagged`` of every document.

    Null, empty and very short texts (under ``LEAST_TOKENS`` class tokens) are never flagged; one row comes out for each
    row that goes in.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n, score = score_texts(b.column(1).to_pylist(), model.words, model.prose)
        flagged = (n >= LEAST_TOKENS) & ((score > model.high) | (score < model.low))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype(np.int64)), pa.array(np.exp(score)), pa.array(flagged)], names=["doc_id", "n_tokens", "perplexity", "flagged"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return _arrow(run, documents.select("doc_id", "text"), f"doc_id {kind}, n_tokens bigint, perplexity double, flagged boolean")


def stuffed_pages(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id`` of the pages that are keyword lists, link lists or product tags; none if the labels lack a kind."""
    model = fit(documents, labels)
    if model is None:
        return documents.select("doc_id").where("false")
    return page_scores(documents, model).where("flagged").select("doc_id").distinct()
