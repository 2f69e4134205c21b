"""Credentials in code, settings, commands and remarks.

First the corpus is indexed: every literal that stands where a credential stands (behind a key name, in a URL, behind
an option ...), has the form of an issued one or is made up as keys are, with the number of records that hold it. Literals that many records share are
placeholders and go, where records of near-equal text count once; references, masks and templates are none. What is left
is confirmed: values of an issued format, however many records hold them, and rare values. Then every text is scanned again
with an automaton of the confirmed values, so that an occurrence without any telling context is found too.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.session import written

#: A literal in more groups of records than this, and than one in ``SHARE`` of all records, is a placeholder.
MOST_OWNERS = 12
SHARE = 1000
#: Words beside the literals from which on a text tells whether records are near-equal, and min-hashes of a text.
_TELLING = 8
_HASHES = 16
#: Bytes of confirmed values up to which one automaton, sent to every task, finds them; more are found by joins.
AUTOMATON_BYTES = 4 << 20
#: Bits of the map of values' runs; its size doesn't depend on the data.
_BITS = 1 << 24
#: Parts of texts of which a task remembers whether the map has them.
_REMEMBERED = 200_000
PLACEHOLDER = "<SECRET>"

# Values of an issued format, wherever they stand.
_ISSUED = re.compile(
    r"""(?<![A-Za-z0-9_\-])(?:
      (?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])
    | sk-(?:ant-|proj-)?[A-Za-z0-9_\-]{20,}
    | [sr]k_(?:live|test)_[A-Za-z0-9]{16,}
    | gh[pousr]_[A-Za-z0-9]{30,}
    | glpat-[A-Za-z0-9_\-]{20}
    | xox[abeprs]-[0-9]{6,}-[A-Za-z0-9\-]{10,}
    | AIza[A-Za-z0-9_\-]{30,}
    | eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{16,}
    )""",
    re.X,
)
_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----(?:(?!-----BEGIN)[\s\S])*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----|-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s\\]*")

#: Characters a bare value ends at, Han characters among them.
_BARE = r"[^\s\"'`<>,;&(){}\[\]，。；（）、|\u4e00-\u9fff]"
_QUOTED = rf"(?:\"([^\"\n]+)\"|'([^'\n]+)'|({_BARE}+))"
# Forms are matched on the text in lower case; the value is the last group that matched.
_KEYED = re.compile(
    r"(?:passw(?:or)?d|passphrase|pwd|secret|token|api[_\-]?key|access[_\-]?key|private[_\-]?key|auth[_\-]?key|credential|(?<![a-z0-9_.\-])pass)"
    rf"(?:[_\-.]?(?:key|base|id|value|string|hash)|s)*[\"'\])]*\s*(?:=>|:=|[=:：]|,(?=\s*[\"']))\s*{_QUOTED}"
)
_NOT_KEYS = re.compile(r"(?:min|max)[_\-]?(?:length|tokens?)|tokenizer|token[_\-]?(?:url|ttl|type|count|limit)|secret[_\-]?(?:name|ref)|public|hash\W*$")
_BEFORE = re.compile(r"[a-z0-9_.\-]*$")

# Places where a credential stands without a key name, each with literals one of which its texts hold.
_PLACES = [(hints, re.compile(p)) for hints, p in (
    (("://",), r"://[^\s:/@\"'<>]*:([^\s/@\"'<>]+)@"),
    (("-u ", "-u=", "--user"), r"(?:^|\s)(?:-u|--user)[ =](?:['\"][^\s:'\"]+:([^\s'\"@]+)|[^\s:'\"]+:([^\s'\"@\u4e00-\u9fff]+))"),
    (("sshpass",), rf"sshpass\s+-p\s*{_QUOTED}"),
    (("login ",), r"\blogin\s+\S+\s+password\s+([^\s\u4e00-\u9fff]+)"),
    (("identified",), r"\bidentified\s+by\s+(?:'([^']+)'|\"([^\"]+)\")"),
    (("basic",), r"\bauthorization[\"']?\s*[:=,]\s*[\"']?basic\s+([a-z0-9+/]{8,}={0,2})"),
    (("bearer", "token "), r"\b(?:bearer|token)\s+([a-z0-9_\-.=+/]{16,})"),
    (("value:",), rf"name:\s*[\"']?[a-z0-9_\-]*(?:password|secret|token|key)[\"']?\s*\n\s*value:\s*{_QUOTED}"),
    (("value=",), r"name=\"[a-z0-9_.\-]*(?:password|secret|token)\"\s+value=\"([^\"]+)\""),
    (('(\"',), r"\bnew\s+[a-z]\w*\(\s*\"[a-z0-9_]+\",\s*\"([^\"\s]{6,})\"\s*[,)]"),
    (("/ pass", "/pass", "/ pwd"), r"\b(?:login|user|account|admin)\b[^\n]{0,40}?/\s*(?:pass|password|pwd)\s+([^\s,，。\u4e00-\u9fff]+)"),
    (("密码", "口令", "密钥", "令牌"), r"(?:密码|口令|密钥|令牌)\s*(?:是|为|：|:)\s*([^\s，。；、（）\u4e00-\u9fff]+)"),
    ((" is ",), r"\b(?:password|passphrase|secret|api key|token)\s+is\s+([^\s,，。\u4e00-\u9fff]+)"),
)]
_ENTRY = re.compile(r"(?:^|\s)[A-Za-z0-9.\-]+:\d{2,5}:[A-Za-z0-9_*]+:[A-Za-z0-9_]+:([^\s\u4e00-\u9fff]+)")

# Strings without any telling place that are made up as keys are, and what such strings are public behind.
_STRUCTURED = re.compile(r"(?<![A-Za-z0-9+/_\-=.~@#$%^&*:\\])[A-Za-z0-9_\-+/]{24,88}={0,2}(?![A-Za-z0-9+/_\-=.@:(])")
_PUBLIC = re.compile(r"(?:base64,|sha-?\d{1,3}[-:=]|ssh-[\w-]+\s|ecdsa-[\w-]+\s|(?:integrity|fingerprint|checksum|digest|etag|nonce|signature|thumbprint)\W{0,5})\s*$", re.I)
_ARMOUR = re.compile(r"-----BEGIN [^-\n]*-----[\s\S]*?(?:-----END|\Z)")
#: Least information a character, and least share of neighbours of different kinds, of such a string.
_INFORMATION, _CHANGES = 4.0, 0.45


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def _made_up(value: str) -> bool:
    """Whether a string has the make-up of a key: all kinds of characters, as evenly spread as if drawn, and often changing."""
    if value.startswith("AAAA"):  # public key material
        return False
    kinds = [_kind(c) for c in value]
    if not {0, 1, 2} <= set(kinds) or sum(a != b for a, b in pairwise(kinds)) < _CHANGES * (len(value) - 1):
        return False
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values()) >= _INFORMATION


def _structured(text: str) -> list[tuple[int, int, bool]]:
    out, armour = [], None
    for m in _STRUCTURED.finditer(text):
        a, b = m.span()
        if _made_up(m.group()) and not _PUBLIC.search(text[max(0, a - 40) : a]):
            armour = [x.span() for x in _ARMOUR.finditer(text)] if armour is None else armour
            if all(b <= x or a >= y for x, y in armour):
                out.append((a, b, False))
    return out


_ISSUED_HINTS = ("akia", "asia", "sk-", "k_live_", "k_test_", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-", "xox", "aiza", "eyj")
_KEY_HINTS = ("passw", "passphrase", "pwd", "secret", "token", "api_key", "api-key", "apikey", "access_key", "access-key", "accesskey", "private_key", "private-key", "privatekey", "auth_key", "auth-key", "authkey", "credential", "pass", "private key-----")


def _hints():
    """One automaton of all literals that call for a form: 0 issued values, 1 keyed ones, 2.. the places."""
    machine, at = ahocorasick.Automaton(), {}
    for k, hints in enumerate((_ISSUED_HINTS, _KEY_HINTS, *(h for h, _ in _PLACES))):
        for h in hints:
            at.setdefault(h, set()).add(k)
    # a literal inside another calls for its forms too, so every match counts
    for h, kinds in at.items():
        machine.add_word(h, tuple(kinds))
    machine.make_automaton()
    return machine


_HINTS = _hints()
_BASIC = 2 + next(i for i, (h, _) in enumerate(_PLACES) if h == ("basic",))


# Words that only placeholders consist of.
_EMPTY = re.compile(
    r"""^(?:[*•·.xX_\-#?]+|null|none|nil|true|false|undefined|empty|string|str|yes|no|\d{1,6}|
    .*(?:\*{3,}|\.{3}|…|redacted|masked|example$|placeholder|changeme|change[_\-]me|your[_\-]|_here\b|dummy|<[^>]*>).*|
    (?:password|passwd|secret|token|pass|pwd|key|api[_\-]?key)s?|x{4,}.*)$""",
    re.I | re.X,
)
_REFERENCE = re.compile(r"^(?:\$|%[A-Z_]+%|\{\{|\{%|@\{|#\{|env[.:(]|vault[:(]|os\.|process\.|System\.|getenv|getpass|config[.\[(]|settings[.\[]|self\.|this\.|ENC\(|arn:|ssm:|secretKeyRef|valueFrom|https?://|=|\\n?$|/(?=[a-z]+(?:/|$))(?!\S*[A-Z]))")
_CODE = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+(?:\(.*)?$|^[A-Za-z_][A-Za-z0-9_.]*\(.*$|^[a-z]+(?:_[a-z]+)+$")


def _plausible(value: str, quoted: bool) -> bool:
    if len(value) < 4 or _EMPTY.match(value) or _REFERENCE.match(value):
        return False
    if any("\u4e00" <= c <= "\u9fff" for c in value) or " " in value:
        return False
    if not quoted and _CODE.match(value) and not any(c.isdigit() for c in value) and not any(c.isupper() for c in value):
        return False
    return not re.fullmatch(r"[a-z]+(?:_[a-z]+)*", value) or len(value) > 24


def _hides_login(value: str) -> bool:
    try:
        text = base64.b64decode(value + "=" * (-len(value) % 4), validate=True)
    except (binascii.Error, ValueError):
        return False
    return b":" in text


def literals(text: str) -> list[tuple[int, int, bool]]:
    """``start, end, issued`` of what may be a credential in a text, in order and apart from each other."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    kinds = {k for _, some in _HINTS.iter(low) for k in some}
    found: list[tuple[int, int, bool]] = []
    if 0 in kinds:
        found += [(m.start(), m.end(), True) for m in _ISSUED.finditer(text)]
    if 1 in kinds:
        if "PRIVATE KEY-----" in text:
            found += [(m.start(), m.end(), True) for m in _BLOCK.finditer(text)]
        for m in _KEYED.finditer(low):
            a = m.start(m.lastindex)
            name = _BEFORE.search(low[max(0, m.start() - 40) : m.start()]).group() + low[m.start() : a]
            if not _NOT_KEYS.search(name):
                found.append((a, m.end(m.lastindex), False))
    for k in sorted(kinds - {0, 1}):
        for m in _PLACES[k - 2][1].finditer(low):
            a, b = m.span(m.lastindex)
            if k != _BASIC or _hides_login(text[a:b]):
                found.append((a, b, False))
    if low.count(":") >= 4:
        found += [(*m.span(1), False) for m in _ENTRY.finditer(text)]
    found += _structured(text)
    out: list[tuple[int, int, bool]] = []
    for a, b, issued in sorted(found, key=lambda x: (not x[2], x[0], -x[1])):
        value = text[a:b]
        if not issued:
            if value.endswith("..."):
                continue
            value = value.rstrip(".,;:)\\")
            b = a + len(value)
            if not _plausible(value, text[a - 1 : a] in "\"'"):
                continue
        if all(b <= x or a >= y for x, y, _ in out):
            out.append((a, b, issued))
    return sorted(out)


#: Characters of a value that the automaton holds; of longer values the rest is compared by digest.
_HEAD = 64


def _key(value: str) -> str:
    """A value, or what stands for a long one: its head, length and digest."""
    return value if len(value) <= _HEAD else f"{value[:_HEAD]}\0{len(value)}\0{hashlib.sha1(value.encode()).hexdigest()}"  # noqa: S324


#: Characters from which on a value is looked for away from telling places.
_ALONE = 5
_KINDS, _LETTER = [re.compile(p) for p in (r"[0-9]", r"[a-z]", r"[A-Z]", r"[^A-Za-z0-9]")], re.compile(r"[A-Za-z0-9]")


def _stands_alone(text: str, a: int, b: int) -> bool:
    """Whether a value without telling context isn't a plain word (of ``_ALONE`` characters or more, of two kinds at least:
    digits, small and capital letters, others), and no part of a longer word. Words are of ASCII letters and digits; Han
    characters stand beside them without a blank."""
    return b - a >= _ALONE and not _LETTER.match(text, a - 1 if a else len(text)) and not _LETTER.match(text, b) and sum(k.search(text, a, b) is not None for k in _KINDS) > 1


def _settled(text: str, told: list[tuple[int, int]], good: list[tuple[int, int]], places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The told places that are ``good`` and those of the other places that stand alone, apart from each other; of two
    that overlap the first counts, then the longer."""
    out = list(good)
    for a, b in sorted(places, key=lambda s: (s[0], -s[1])):
        if not any(a < y and x < b for x, y in told) and not any(a < y and x < b for x, y in out) and _stands_alone(text, a, b):
            out.append((a, b))
    return sorted(out)


def _spans(text: str, keys: frozenset, automaton) -> list[tuple[int, int]]:
    """Where confirmed values stand: at telling places, and elsewhere if they stand alone."""
    told = literals(text)
    places = []
    if automaton is not None:
        for end, (head, lengths) in automaton.iter(text):
            a = end + 1 - head
            places += [(a, a + n) for n in lengths if _key(text[a : a + n]) in keys]
    return _settled(text, [(a, b) for a, b, _ in told], [(a, b) for a, b, _ in told if _key(text[a:b]) in keys], places)


_built: list = []


def _automaton(keys: list[str]):
    if not _built or _built[0] is not keys:
        lengths: dict[str, set[int]] = {}
        for k in keys:
            head, _, rest = k.partition("\0")
            lengths.setdefault(head, set()).add(int(rest.partition("\0")[0]) if rest else len(head))
        machine = ahocorasick.Automaton()
        for head, some in lengths.items():
            machine.add_word(head, (len(head), sorted(some, reverse=True)))
        machine.make_automaton()
        _built[:] = [keys, frozenset(keys), machine if len(machine) else None]
    return _built[1:]


_WORD = re.compile(r"[A-Za-z0-9_]+|[\u4e00-\u9fff]")
_FACTORS = np.array([xxhash.xxh64_intdigest(f"{i}".encode()) | 1 for i in range(_HASHES)], dtype=np.uint64)


def _sketch(text: str, spans: list[tuple[int, int, bool]]) -> list[int] | None:
    """Min-hashes of the pairs of words around the literals; near-equal texts have most of them in common. None if there
    are too few words to tell."""
    parts, at = [], 0
    for a, b, _ in spans:
        parts.append(text[at:a])
        at = b
    words = _WORD.findall(" ".join([*parts, text[at:]]))
    if len(words) < _TELLING:
        return None
    pairs = np.array([xxhash.xxh64_intdigest(f"{x} {y}".encode()) for x, y in {*zip(words, words[1:], strict=False)}], dtype=np.uint64)
    return [int(((pairs * f) ^ (pairs * f >> np.uint64(29))).min() >> np.uint64(1)) for f in _FACTORS]


def _held(texts: DataFrame) -> DataFrame:
    """``value, owner, issued, sketch``: every literal of the corpus with each record that holds it, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, owners, issued, sketches = [], [], [], []
            for owner, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = literals(text)
                sketch = _sketch(text, found) if found else None
                for x, y, good in found:
                    values.append(text[x:y])
                    owners.append(owner)
                    issued.append(good and not _EMPTY.match(text[x:y]))
                    sketches.append(sketch)
            arrays = [pa.array(values, pa.string()), pa.array(owners, pa.int64()), pa.array(issued, pa.bool_()), pa.array(sketches, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["value", "owner", "issued", "sketch"])

    found = texts.select(F.xxhash64("src", "record_id").alias("owner"), "text").mapInArrow(run, "value string, owner bigint, issued boolean, sketch array<bigint>")
    return written(found.groupBy("value", "owner").agg(F.max("issued").alias("issued"), F.min("sketch").alias("sketch")), "literals")


def index(held: DataFrame) -> DataFrame:
    """``value, owners, issued``: every literal of :func:`_held` with the number of records that hold it."""
    return held.groupBy("value").agg(F.count("*").alias("owners"), F.max("issued").alias("issued"))


def _groups(held: DataFrame) -> DataFrame:
    """``value, groups``: in how many groups of near-equal records a literal stands: the fewest different values that one
    of the min-hashes has over its records. A record without a sketch is a group."""
    own = F.coalesce("sketch", F.array_repeat("owner", _HASHES))
    each = held.select("value", F.posexplode(own).alias("n", "h")).distinct().groupBy("value", "n").agg(F.count("*").alias("groups"))
    return each.groupBy("value").agg(F.min("groups").alias("groups"))


def confirmed(texts: DataFrame, most_owners: int = MOST_OWNERS) -> DataFrame:
    """``value`` of the literals that have an issued form or aren't shared widely: that stand in at most ``most_owners``
    groups of near-equal records or, in a large corpus, in one of ``SHARE`` for each of its records."""
    held = _held(texts)
    records = texts.select(F.xxhash64("src", "record_id").alias("owner")).agg(F.approx_count_distinct("owner")).first()[0]
    most = max(most_owners, records // SHARE)
    counts = index(held)
    fine = counts.where((F.col("owners") <= most) | F.col("issued")).select("value")
    shared = counts.where((F.col("owners") > most) & ~F.col("issued")).select("value")
    return fine.unionByName(_groups(held.join(shared, "value", "left_semi")).where(F.col("groups") <= most).select("value"))


_RUN = re.compile(r"[A-Za-z0-9]{4,}")
#: The first characters of a value without such a run, where it stands alone; neither they nor a run are ever the other.
_SHORT = re.compile(rf"(?<![A-Za-z0-9])(?=((?:(?![A-Za-z0-9]{{4}})[^ ]){{{_ALONE}}}))")
#: Characters beside a run that make it rarer.
_BESIDE = 4


def _bit(part: str) -> int:
    return xxhash.xxh64_intdigest(part.encode(), 42) % _BITS


def _part(value: str) -> tuple[str | None, int | None]:
    """What a value is looked for by, and where in the value that begins: its longest run of letters and digits with the
    ``_BESIDE`` characters behind it, or those before it, or alone if the value has neither; without a run of 4, the first
    ``_ALONE`` characters. Shorter values have none, as they are found at telling places only."""
    m = max(_RUN.finditer(value), key=lambda m: (m.end() - m.start(), -m.start()), default=None)
    if m is None:
        return (value[:_ALONE], 0) if len(value) >= _ALONE else (None, None)
    a, b = m.span()
    if len(value) >= b + _BESIDE:
        return value[a : b + _BESIDE], a
    return (value[a - _BESIDE : b], a - _BESIDE) if a >= _BESIDE else (value[a:b], a)


def _parts(text: str) -> Iterator[tuple[int, str]]:
    """Everything in a text that may be the part of a value, with its place."""
    for m in _RUN.finditer(text):
        a, b = m.span()
        yield a, m.group()
        if b + _BESIDE <= len(text):
            yield a, text[a : b + _BESIDE]
        if a >= _BESIDE:
            yield a - _BESIDE, text[a - _BESIDE : b]
    for m in _SHORT.finditer(text):
        yield m.start(), m.group(1)


def _keys(texts: DataFrame, most_owners: int) -> tuple[DataFrame, int]:
    """``key, part, offset, bit`` of the confirmed values, written, and how many bytes the keys have; see :func:`_part`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for v in b.column(0).to_pylist():
                part, at = _part(v)
                rows.append((_key(v), part, at, part and _bit(part)))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["key", "part", "offset", "bit"])

    keys = written(confirmed(texts, most_owners).mapInArrow(run, "key string, part string, offset int, bit bigint"), "values")
    return keys, keys.agg(F.sum(F.length("key"))).first()[0] or 0


_UNIT = ["src", "record_id", "msg_pos"]
_SPAN = "src string, record_id string, msg_pos int, start int, end int"


def _shared_keys(keys: DataFrame):
    return keys.sparkSession.sparkContext.broadcast([r[0] for r in keys.select("key").collect()])  # at most AUTOMATON_BYTES


def _by_automaton(texts: DataFrame, keys: DataFrame) -> DataFrame:
    shared = _shared_keys(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, machine = _automaton(shared.value)
        for b in batches:
            rows, starts, ends = [], [], []
            for i, text in enumerate(b.column(3).to_pylist()):
                for x, y in _spans(text, known, machine):
                    rows.append(i)
                    starts.append(x)
                    ends.append(y)
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(j).take(at) for j in range(3)), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[*_UNIT, "start", "end"])

    return texts.select(*_UNIT, "text").mapInArrow(run, _SPAN)


def _by_join(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """As the automaton, for any number of values: told literals are joined by value, other occurrences by the part of a
    value that :func:`_part` names, which stands whole in every text that holds the value by itself. A bitmap of fixed
    size keeps parts of no value from being shuffled."""

    held = keys.where("part is not null")
    maps = held.groupBy((F.col("bit") / 32768).cast("int").alias("n")).agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("m")).collect()  # _BITS bits in all
    shared = texts.sparkSession.sparkContext.broadcast({r["n"]: bytes(r["m"]) for r in maps})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps, told = shared.value, {}

        def may(part: str) -> bool:
            hit = told.get(part)
            if hit is None:
                bit = _bit(part)
                own = maps.get(bit // 32768)
                hit = bool(own and own[bit % 32768 // 8] >> bit % 8 & 1)
                if len(told) < _REMEMBERED:
                    told[part] = hit
            return hit

        for b in batches:
            rows, starts, ends, values = [], [], [], []
            for i, text in enumerate(b.column(3).to_pylist()):
                for x, y, _ in literals(text):
                    rows.append(i), starts.append(x), ends.append(y), values.append(_key(text[x:y]))
                for x, part in _parts(text):
                    if may(part):
                        rows.append(i), starts.append(x), ends.append(-1), values.append(part)
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(j).take(at) for j in range(3)), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(values, pa.string())], names=[*_UNIT, "start", "end", "value"])

    found = written(texts.select(*_UNIT, "text").mapInArrow(scan, _SPAN + ", value string"), "occurrences")
    told = found.where(F.col("end") >= 0).join(keys.select(F.col("key").alias("value"), F.lit(True).alias("good")), "value", "left").select(*_UNIT, "start", "end", F.coalesce("good", F.lit(False)).alias("good"), F.lit(None).cast("string").alias("key"))
    runs = found.where(F.col("end") < 0).withColumnRenamed("value", "part").join(held.select("part", "offset", "key"), "part").select(*_UNIT, (F.col("start") - F.col("offset")).alias("start"), F.lit(-1).alias("end"), F.lit(True).alias("good"), "key")
    units = told.unionByName(runs).groupBy(*_UNIT).agg(F.collect_list(F.struct("start", "end", "good", "key")).alias("x")).join(texts.select(*_UNIT, "text"), _UNIT).select(*_UNIT, "text", "x")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, starts, ends = [], [], []
            for i, (text, spans) in enumerate(zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)):
                told = [(s["start"], s["end"]) for s in spans if s["key"] is None]
                good = [(s["start"], s["end"]) for s in spans if s["key"] is None and s["good"]]
                places = []
                for s in spans:
                    if s["key"] is not None and s["start"] >= 0:
                        _, _, rest = s["key"].partition("\0")
                        a = s["start"]
                        z = a + (int(rest.partition("\0")[0]) if rest else len(s["key"]))
                        if _key(text[a:z]) == s["key"]:
                            places.append((a, z))
                for x, y in _settled(text, told, good, places):
                    rows.append(i), starts.append(x), ends.append(y)
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(j).take(at) for j in range(3)), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[*_UNIT, "start", "end"])

    return units.mapInArrow(settle, _SPAN)


def spans(texts: DataFrame, most_owners: int = MOST_OWNERS) -> DataFrame:
    """``src, record_id, msg_pos, start, end`` of every occurrence of a confirmed secret in ``units``."""
    keys, weight = _keys(texts, most_owners)
    return _by_automaton(texts, keys) if weight <= AUTOMATON_BYTES else _by_join(texts, keys)


def find(texts: DataFrame, most_owners: int = MOST_OWNERS) -> DataFrame:
    """``src, record_id, msg_pos, start_at`` of every occurrence of a confirmed secret in ``units``.

    An empty table, and texts without any credential, give no rows. Offsets count code points.
    """
    return spans(texts, most_owners).select(*_UNIT, F.col("start").alias("start_at"))


def _masked(text: str, spans: list[tuple[int, int]]) -> str:
    for a, b in reversed(spans):
        text = text[:a] + PLACEHOLDER + text[b:]
    return text


def redact(texts: DataFrame, most_owners: int = MOST_OWNERS) -> DataFrame:
    """The units with every secret value replaced by ``PLACEHOLDER``, the code around it as it was, and ``secrets``, how many."""
    keys, weight = _keys(texts, most_owners)
    schema = "src string, record_id string, msg_pos int, text string, secrets int"
    if weight <= AUTOMATON_BYTES:  # found and replaced in one go
        shared = _shared_keys(keys)

        def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, machine = _automaton(shared.value)
            for whole in batches:
                for first in range(0, whole.num_rows, 512):
                    b = whole.slice(first, 512)
                    out, counts = [], []
                    for text in b.column(3).to_pylist():
                        own = _spans(text, known, machine)
                        out.append(_masked(text, own) if own else text)
                        counts.append(len(own))
                    yield pa.RecordBatch.from_arrays([*(b.column(j) for j in range(3)), pa.array(out, pa.string()), pa.array(counts, pa.int32())], names=[*_UNIT, "text", "secrets"])

        return texts.select(*_UNIT, "text").mapInArrow(replace, schema)
    found = _by_join(texts, keys).groupBy(*_UNIT).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("x"))
    joined = texts.join(found, _UNIT, "left").select(*_UNIT, "text", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                b = whole.slice(first, 512)
                out, counts = [], []
                for text, own in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                    out.append(_masked(text, [(s["start"], s["end"]) for s in own or []]))
                    counts.append(len(own or []))
                yield pa.RecordBatch.from_arrays([*(b.column(j) for j in range(3)), pa.array(out, pa.string()), pa.array(counts, pa.int32())], names=[*_UNIT, "text", "secrets"])

    return joined.mapInArrow(run, schema)
