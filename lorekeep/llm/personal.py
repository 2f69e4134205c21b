"""Personal items in free text: addresses of mail, telephone numbers, identity numbers, street addresses and names.

Bootstrapped contextual extraction. One scan collects candidates with their patterns: the two tokens before and behind
(context), and the form of what is inside (shape). Seeds are few: mail addresses in plain lower case, telephone numbers in
international form, resident numbers with a valid check digit, addresses with a ZIP code or a Chinese city and road, and
names whose parts are in the list of name parts. Everything else has to be reached from them. Spark scores the graph of
patterns and candidates in rounds: a pattern that enough known items stand in is trusted, a candidate of a known form with
a trusted context or shape becomes known, one of a loose form only in a context that is sure, and so on; for names a
trusted context makes the unknown part of a half-known name known. All that is counted stays in tables; only the list of
name parts, of checked size, goes to every task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.session import cut, written

#: Rounds in which patterns and instances are scored.
ROUNDS = 3
#: A pattern of names is trusted if so many of its instances, and this share of them, are known.
LEAST_KNOWN, LEAST_SHARE = 2, 0.6
#: The same of a context and of a shape of the other items, whose seeds are only some of their forms.
CONTEXT_SHARE, SHAPE_SHARE = 0.15, 0.3
#: The share that makes an unknown instance of a pattern count by itself.
SURE_KNOWN, SURE_SHARE = 8, 0.95
#: Characters on each side that the two tokens of a context are looked for in.
REACH = 64
#: Most rows a list of name parts may have; it goes to every task.
MOST_PARTS = 100_000

_WIDE = {0xFF01 + i: 0x21 + i for i in range(94)} | {0x3000: 0x20}

_DOT = r"(?:\.|\s?[(\[{]\s?dot\s?[)\]}]\s?|\sdot\s)"
_AT = r"(?:@|\s?[(\[{]\s?(?:at|@)\s?[)\]}]\s?|\sat\s(?=[A-Za-z0-9\-]+(?:\sdot\s|\s?[(\[{]\s?dot)))"
_MAIL = re.compile(r"(?<![A-Za-z0-9._%+\-@/~])[A-Za-z0-9][A-Za-z0-9._%+\-]*" + _AT + r"(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?" + _DOT + r")+[A-Za-z]{2,12}(?![A-Za-z0-9@\-]|:[A-Za-z0-9_/~])", re.I)
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*://\S+")
_FILES = frozenset("png jpg jpeg gif svg webp ico bmp js ts jsx tsx py java kt go rs rb php css html json yml yaml toml lock md txt sh sql xml".split())
_LOGIN = re.compile(r"(?:\b(?:ssh|scp|rsync|sftp|mosh|git clone|git remote add \S+)\b[^\n]{0,40}|[#$]\s?)$")
_HOST = re.compile(r"@[a-z]+(?:-[a-z]+)*-\d+\.", re.I)

_PHONE = re.compile(
    r"""(?<![A-Za-z0-9_.+\-/#])(?:
      \+\d{1,3}[ .\-]?(?:\(0\)[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?)?\d{1,5}(?:[ .\-]?\d{2,5}){1,4}
    | \(\d{3}\)\s?\d{3}[ .\-]\d{4}
    | \d{3}[.\-]\d{3}[.\-]\d{4}
    | 0\d{4}\ \d{6} | 0\d{3}\ \d{3}\ \d{4} | 0\d(?:\ \d{2}){4} | 0\d{2,4}[\-/ ]\d{6,8}
    | 1[3-9]\d(?:\d{8}|[ \-]\d{4}[ \-]\d{4})
    )(?![A-Za-z0-9_]|[.\-/]\d)""",
    re.X,
)
_LOOSE_PHONE = re.compile(r"(?<![A-Za-z0-9_.+\-/#])[+(]?\d[\d ().\-]{6,18}\d(?![A-Za-z0-9_]|[.\-/]\d)")
_ID = re.compile(
    r"""(?<![A-Za-z0-9_\-])(?:
      [1-9]\d{5}\ ?(?:18|19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\ ?\d{3}[\dXx]
    | \d{3}-\d{2}-\d{4}
    | [A-CEGHJ-PRQTW-Z][A-Z]\ ?\d{2}\ ?\d{2}\ ?\d{2}\ ?[A-D]
    | [A-Z]{1,2}\d{7,8}
    | (?:\d{8}|[XYZ]\d{7})-?[A-HJ-NP-TV-Z]
    )(?![A-Za-z0-9_]|-\d)""",
    re.X,
)
_LOOSE_ID = re.compile(r"(?<![A-Za-z0-9_.\-/@#])(?=[A-Z\-]{0,6}\d)[A-Z0-9][A-Z0-9\-]{5,18}[A-Z0-9](?![A-Za-z0-9_]|[.\-/]\w)")
_UP = "A-ZÀ-ÖØ-ÞŁŚŽ"
_LOW = "a-zß-öø-ÿłśž"
_TOWN = rf"[{_UP}][{_LOW}]+(?:[ \-][{_UP}][{_LOW}]+)?"
_ADDRESS = re.compile(
    rf"""(?<![A-Za-z0-9])(?:
      \d{{1,5}}[A-Za-z]?\ (?:(?:[NSEW]\.|North|South|East|West)\ )?(?:[{_UP}][{_LOW}]+\ ){{1,3}}
        (?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Close|Row|Drive|Dr\.?|Boulevard|Blvd\.?|Court|Ct\.?|Way|Place|Terrace|Square|Crescent)
        (?:,?\s(?:\#\s?\d+|(?:Apt|Unit|Suite|Flat|Floor)\.?\s\w+))?(?:,?\s+{_TOWN})?
        ,?\s+(?:[A-Z]{{2}}\ \d{{5}}(?:-\d{{4}})?|[A-Z]{{1,2}}\d{{1,2}}[A-Z]?\ \d[A-Z]{{2}})
    | [{_UP}][{_LOW}]+(?:gasse|stra(?:ß|ss)e|str\.|weg|ring|allee|platz|damm|ufer|hof|steig)\ \d{{1,4}}\ ?[a-z]?,?\s+\d{{5}}\ {_TOWN}
    | \d{{1,4}}(?:\ (?:bis|ter))?,?\ (?:rue|avenue|boulevard|place|impasse|chemin|all[ée]e|quai|cours)\ (?:(?:de\ la|de\ l'|des|du|de|d')\ ?)?(?:[{_UP}][{_LOW}'\-]+\ ?){{1,4}},?\s+\d{{5}}\ {_TOWN}
    | (?:Calle|Avenida|Plaza|Paseo|Camino|Carrera)\ (?:(?:de\ la|de\ los|del|de)\ )?(?:[{_UP}][{_LOW}]+\ ){{1,3}}\d{{1,4}}(?:,\s\d{{1,2}}[ºª]\ ?\w+)?,?\s+\d{{5}}\ {_TOWN}
    )(?![A-Za-z0-9])
    | (?:[一-鿿]{{2}}(?:省|自治区)\s?)?[一-鿿]{{2}}市\s?[一-鿿]{{2,3}}[区县]\s?[一-鿿]{{1,6}}?(?:路|街|巷|大道|道|弄|胡同|村)\s?\d+\s?号(?:\s?(?:[A-Za-z]座|\d+(?:号楼|栋|幢|单元|层|楼|室)|\d+(?!\d)))*""",
    re.X,
)

_T = rf"(?:[{_UP}][{_LOW}]+|[{_UP}]{{2,}})"
_FAMILY = rf"(?:(?:[Vv]an der|VAN DER|[Vv]an|[Vv]on|[Dd]e|[Dd]e la|[Dd]i) )?(?:[OD]['’])?{_T}(?:-{_T})?"
_CAPS = re.compile(rf"(?<![A-Za-z0-9_À-ÿŁł`/.\-]){_FAMILY}(?:,? (?:[{_UP}]\.|{_FAMILY}))+(?![a-zA-Z0-9_/`(])")
_PART = re.compile(rf"[{_UP}]\.|{_FAMILY}")
_PREFIX = re.compile(r"^(?:(?:van der|van|von|de la|de|di) )?(?:[od]['’])?", re.I)
_TOKEN = re.compile(r"[A-Za-zÀ-ÿŁł]+|\d+|[一-鿿]|[^\sA-Za-z\d]")
_ODD = re.compile(f"[{''.join(map(chr, sorted(_WIDE)))}]")

# What is a seed by its form alone.
_SEED_MAIL = re.compile(r"[a-z0-9._%+\-]+@[a-z0-9.\-]+")
_SEED_ADDRESS = re.compile(r"[\s\S]*(?:\b[A-Z]{2} \d{5}(?:-\d{4})?$|市[\s\S]*(?:路|街|巷|大道|道)\s?\d+\s?号)")
_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)


def _resident(value: str) -> bool:
    """A resident number of 18 places whose check digit is right."""
    v = value.replace(" ", "")
    return len(v) == 18 and v[:17].isdigit() and "10X98765432"[sum(int(a) * b for a, b in zip(v, _WEIGHTS, strict=False)) % 11] == v[17].upper()


_SEED = {
    "email": lambda v: _SEED_MAIL.fullmatch(v) is not None,
    "phone": lambda v: v.startswith("+"),
    "id_number": _resident,
    "address": lambda v: _SEED_ADDRESS.match(v) is not None,
}
_SHAPES = [(re.compile(r"[一-鿿]+"), "H"), (re.compile(rf"[{_LOW}]+"), "a"), (re.compile(rf"[{_UP}]+"), "A")]
_DIGIT, _DIGITS, _BLANK = re.compile(r"\d"), re.compile(r"\d+"), re.compile(r"\s+")


def _shape(kind: str, value: str) -> str:
    """The form of an item: letters as classes, digits as 0, of numbers one for one."""
    out = (_DIGIT if kind in ("phone", "id_number") else _DIGITS).sub("0", value)
    for form, mark in _SHAPES:
        out = form.sub(mark, out)
    return _BLANK.sub(" ", out)


def _context(text: str, a: int, b: int) -> tuple[str, str]:
    """The two tokens before and behind a span; numbers as 0, capitalized words as N."""

    def plain(t: str) -> str:
        return "0" if t[0].isdigit() else "N" if t[0].isupper() else t

    left = [plain(t) for t in _TOKEN.findall(text[max(0, a - REACH) : a])[-2:]]
    right = [plain(t) for t in _TOKEN.findall(text[b : b + REACH])[:2]]
    return " ".join(left), " ".join(right)


def _mails(text: str) -> list[tuple[int, int]]:
    if "@" not in text and not re.search(r"(?i)[(\[{ ]\s?at\s?[)\]} ]", text):
        return []
    urls = [m.span() for m in _URL.finditer(text) if not m.group().lower().startswith("mailto")]
    out = []
    for m in _MAIL.finditer(text):
        a, b = m.span()
        if any(x < b and a < y for x, y in urls) or m.group().rpartition(".")[2].lower() in _FILES:
            continue
        before = text[max(0, a - 60) : a]
        if _HOST.search(m.group()) or _LOGIN.search(before) or m.group().lower().startswith("git@"):
            continue
        out.append((a, b))
    return out


def _key(part: str) -> str:
    return _PREFIX.sub("", part).split("-")[0].lower()


def _latin(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Spans that may be a full name in Latin script, with the keys of the given and of the family name."""
    for m in _CAPS.finditer(text):
        parts = [(m.start() + p.start(), m.start() + p.end(), p.group()) for p in _PART.finditer(m.group())]
        for i in range(len(parts) - 1):
            for j in (i + 1, i + 2, i + 3):
                if j >= len(parts):
                    break
                between = [text[parts[k][1] : parts[k + 1][0]] for k in range(i, j)]
                first, last = parts[i][2], parts[j][2]
                if all(x == " " for x in between):
                    if not first.endswith(".") and not last.endswith(".") and j - i <= 2:
                        yield parts[i][0], parts[j][1], _key(first), _key(last)
                elif between[0] == ", " and all(x == " " for x in between[1:]) and not first.endswith(".") and not parts[i + 1][2].endswith("."):
                    yield parts[i][0], parts[j][1], _key(parts[i + 1][2]), _key(first)


class Scanner:
    """Candidates of one text."""

    def __init__(self, han_given: frozenset[str], han_family: frozenset[str]):
        some = "".join(sorted(x for x in han_given if len(x) == 1))
        self.given = re.compile(rf"[{some}]{{1,2}}") if some else None
        family = "|".join(sorted(han_family, key=lambda x: (-len(x), x)))
        self.family = re.compile(rf"(?:{family})[一-鿿]{{1,2}}(?![一-鿿])") if family else None
        self.families = han_family

    def _han(self, text: str) -> Iterator[tuple[int, int, str, str]]:
        seen = set()
        if self.given:
            for m in self.given.finditer(text):
                for n in (1, 2):
                    a = m.start() - n
                    if a >= 0 and all("一" <= c <= "鿿" for c in text[a : m.start()]):
                        for end in {m.end(), m.start() + 1}:
                            seen.add((a, end))
                            yield a, end, text[m.start() : end], text[a : m.start()]
                if m.end() - m.start() == 2 and m.group()[0] in self.families:
                    yield m.start(), m.end(), m.group()[1], m.group()[0]
        if self.family:
            for m in self.family.finditer(text):
                n = 2 if m.group()[:2] in self.families else 1
                if len(m.group()) > n and m.span() not in seen:
                    yield m.start(), m.end(), m.group()[n:], m.group()[:n]

    def scan(self, raw: str) -> list[tuple[str, int, int, int, str, str, str, str, str]]:
        """``kind, start, end, tier, given, family, shape, left, right``; tier 2 is a seed, 1 of a known form, 0 loose."""
        text = raw.translate(_WIDE) if not raw.isascii() and _ODD.search(raw) else raw
        out = []
        taken = [*(("email", *x) for x in _mails(text))]
        digits = _DIGIT.search(text) is not None
        if digits:
            for kind, form in (("id_number", _ID), ("address", _ADDRESS), ("phone", _PHONE)):
                for m in form.finditer(text):
                    if kind == "phone" and not 7 <= sum(c.isdigit() for c in m.group()) <= 15:
                        continue
                    if all(m.end() <= x or m.start() >= y for _, x, y in taken):
                        taken.append((kind, *m.span()))
        for kind, a, b in taken:
            value = raw[a:b]
            out.append((kind, a, b, 2 if _SEED[kind](value) else 1, "", "", _shape(kind, text[a:b]), *_context(text, a, b)))
        if digits:
            for kind, form, least in (("phone", _LOOSE_PHONE, 7), ("id_number", _LOOSE_ID, 5)):
                for m in form.finditer(text):
                    if least <= sum(c.isdigit() for c in m.group()) <= 18 and all(m.end() <= x or m.start() >= y for _, x, y in taken):
                        out.append((kind, *m.span(), 0, "", "", _shape(kind, m.group()), *_context(text, *m.span())))
        mails = [(a, b) for kind, a, b in taken if kind in ("email", "address")]
        for a, b, given, family in (*_latin(text), *self._han(text)):
            if all(b <= x or a >= y for x, y in mails):
                out.append(("name", a, b, 0, given, family, "", *_context(text, a, b)))
        return out


_UNIT = ["src", "record_id", "msg_pos"]


def name_parts(names: DataFrame) -> DataFrame:
    """``part, script, key``: the list of name parts, trimmed and in lower case, each once."""
    key = F.lower(F.regexp_replace("name", r"(?U)^\s+|\s+$", ""))
    return names.select("part", "script", key.alias("key")).where("key <> '' and part is not null").distinct()


def candidates(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Every candidate of every text with its pattern."""
    rows = name_parts(names).where("script = 'han'").limit(MOST_PARTS + 1).collect()
    if len(rows) > MOST_PARTS:
        raise ValueError(f"more than {MOST_PARTS} name parts")
    given = frozenset(r["key"] for r in rows if r["part"] == "given")
    family = frozenset(r["key"] for r in rows if r["part"] == "family")
    columns = [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("tier", pa.int32()), ("given", pa.string()), ("family", pa.string()), ("shape", pa.string()), ("left", pa.string()), ("right", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(given, family).scan
        for b in batches:
            rows, found = [], []
            for i, text in enumerate(b.column(3).to_pylist()):
                one = scan(text)
                found += one
                rows += [i] * len(one)
            at = pa.array(rows, pa.int32())
            fields = list(zip(*found, strict=True)) if found else [[]] * len(columns)
            yield pa.RecordBatch.from_arrays([*(b.column(j).take(at) for j in range(3)), *(pa.array(x, t) for x, (_, t) in zip(fields, columns, strict=True))], names=[*_UNIT, *(n for n, _ in columns)])

    schema = "src string, record_id string, msg_pos int, kind string, start int, end int, tier int, given string, family string, shape string, left string, right string"
    return texts.select(*_UNIT, "text").mapInArrow(run, schema)


def bootstrap(found: DataFrame, names: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Known given names, known family names (``key``) and the contexts sure for unknown ones (``left, right``)."""
    parts = name_parts(names)
    given = parts.where("part = 'given'").select("key").distinct()
    family = parts.where("part = 'family'").select("key").distinct()
    every = cut(found.where("kind = 'name'").groupBy("given", "family", "left", "right").agg(F.count("*").alias("n")))
    han = F.col("given").rlike(r"^[\x{4e00}-\x{9fff}]{2}$")
    sure = every.select("left", "right").where("false")
    for _ in range(rounds):
        g, f = given.withColumnRenamed("key", "given").withColumn("g", F.lit(1)), family.withColumnRenamed("key", "family").withColumn("f", F.lit(1))
        graph = every.withColumn("first", F.when(han, F.substring("given", 1, 1)).otherwise(F.col("given"))).withColumn("second", F.when(han, F.substring("given", 2, 1)))
        graph = graph.join(g.withColumnRenamed("given", "first"), "first", "left").join(g.select(F.col("given").alias("second"), F.col("g").alias("g2")), "second", "left").join(f, "family", "left")
        graph = graph.withColumn("g", F.when(F.col("second").isNull(), F.col("g")).when(F.col("g").isNotNull() & F.col("g2").isNotNull(), 1))
        score = graph.groupBy("left", "right").agg(F.count("*").alias("all"), F.count(F.when(F.col("g").isNotNull() & F.col("f").isNotNull(), 1)).alias("known"))
        trusted = score.where((F.col("known") >= LEAST_KNOWN) & (F.col("known") >= LEAST_SHARE * F.col("all")))
        sure = score.where((F.col("known") >= SURE_KNOWN) & (F.col("known") >= SURE_SHARE * F.col("all"))).select("left", "right")
        half = graph.join(trusted.select("left", "right"), ["left", "right"])
        given = cut(given.unionByName(half.where("f is not null and g is null and second is null").select(F.col("first").alias("key"))).distinct())
        family = cut(family.unionByName(half.where("g is not null and f is null").select(F.col("family").alias("key"))).distinct())
    return given, family, cut(sure)


_PATTERN = ["kind", "tier", "shape", "left", "right"]


def reached(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``kind, tier, shape, left, right`` of the candidates other than names that are seeds or are reached from them.

    Each round counts, of every context and of every shape, how many of its candidates are known. One of a known form is
    reached by a context or a shape with at least ``LEAST_KNOWN`` known ones and ``CONTEXT_SHARE`` or ``SHAPE_SHARE`` of all;
    one of a loose form by a context with ``SURE_KNOWN`` and ``SURE_SHARE``. Candidates alike in form and context are
    counted together, so that no round sees single rows.
    """
    graph = cut(found.where("kind <> 'name'").groupBy(*_PATTERN).agg(F.count("*").alias("n")).withColumn("known", F.col("tier") == 2))
    for _ in range(rounds):
        seen = F.sum(F.when(F.col("known"), F.col("n")).otherwise(0))
        contexts = graph.groupBy("kind", "left", "right").agg(seen.alias("ck"), F.sum("n").alias("cn"), F.sum(F.when(F.col("tier") > 0, F.col("n")).otherwise(0)).alias("cf"))
        shapes = graph.where("tier > 0").groupBy("kind", "shape").agg(seen.alias("sk"), F.sum("n").alias("sn"))
        scored = graph.join(contexts, ["kind", "left", "right"]).join(shapes, ["kind", "shape"], "left").na.fill(0, ["sk", "sn"])
        by_context = (F.col("ck") >= LEAST_KNOWN) & (F.col("ck") >= CONTEXT_SHARE * F.col("cf"))
        by_shape = (F.col("sk") >= LEAST_KNOWN) & (F.col("sk") >= SHAPE_SHARE * F.col("sn"))
        sure = (F.col("ck") >= SURE_KNOWN) & (F.col("ck") >= SURE_SHARE * F.col("cn"))
        reach = F.col("known") | F.when(F.col("tier") > 0, by_context | by_shape).otherwise(sure)
        graph = cut(scored.select(*_PATTERN, "n", reach.alias("known")))
    return graph.where("known").select(*_PATTERN)


def _resolve(spans: list[dict]) -> list[dict]:
    """Spans apart from each other: firm shapes first, then the leftmost, of these the longest."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["kind"] == "name", s["tier"] == 0, s["start"], -s["end"])):
        if all(s["end"] <= o["start"] or s["start"] >= o["end"] for o in out):
            out.append(s)
    return sorted(out, key=lambda s: s["start"])


def items(texts: DataFrame, names: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``src, record_id, msg_pos, pii_type, nth, start, end`` of every personal item of ``units``, offsets in code points.

    Texts without any item give no rows, an empty table none at all. With an empty list of names no name is found. A corpus
    too small to show a pattern gives its seeds only, as do no rounds.
    """
    found = written(candidates(texts, names), "candidates")
    given, family, sure = bootstrap(found, names, rounds)
    others = found.where("kind <> 'name'").join(reached(found, rounds), _PATTERN, "left_semi")
    named = found.where("kind = 'name'")
    two = F.col("given").rlike(r"^[\x{4e00}-\x{9fff}]{2}$")
    split = named.withColumn("first", F.when(two, F.substring("given", 1, 1)).otherwise(F.col("given"))).withColumn("second", F.when(two, F.substring("given", 2, 1)).otherwise(F.col("given")))
    known = split.join(given.select(F.col("key").alias("first")), "first", "left_semi").join(given.select(F.col("key").alias("second")), "second", "left_semi").join(family.select(F.col("key").alias("family")), "family", "left_semi")
    loose = named.join(sure, ["left", "right"], "left_semi")
    columns = [*_UNIT, "kind", "start", "end", "tier"]
    every = others.select(*columns).unionByName(known.select(*columns)).unionByName(loose.select(*columns))
    by_unit = every.groupBy(*_UNIT).agg(F.collect_list(F.struct("kind", "start", "end", "tier")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, kinds, nth, starts, ends = [], [], [], [], []
            for i, spans in enumerate(b.column(3).to_pylist()):
                count: dict[str, int] = {}
                for s in _resolve(spans):
                    count[s["kind"]] = count.get(s["kind"], 0) + 1
                    rows.append(i)
                    kinds.append(s["kind"])
                    nth.append(count[s["kind"]])
                    starts.append(s["start"])
                    ends.append(s["end"])
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(j).take(at) for j in range(3)), pa.array(kinds, pa.string()), *(pa.array(x, pa.int32()) for x in (nth, starts, ends))], names=[*_UNIT, "pii_type", "nth", "start", "end"])

    return by_unit.mapInArrow(run, "src string, record_id string, msg_pos int, pii_type string, nth int, start int, end int")


def redact(texts: DataFrame, names: DataFrame) -> DataFrame:
    """The units with each personal item replaced by ``<EMAIL>``, ``<PHONE>`` ..., everything else as it was, and ``items``."""
    spans = items(texts, names).groupBy(*_UNIT).agg(F.array_sort(F.collect_list(F.struct("start", "end", "pii_type"))).alias("spans"))
    joined = texts.join(spans, _UNIT, "left").select(*_UNIT, "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, counts = [], []
            for text, spans in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                for s in reversed(spans or []):
                    text = f"{text[: s['start']]}<{s['pii_type'].upper()}>{text[s['end'] :]}"
                out.append(text)
                counts.append(len(spans or []))
            yield pa.RecordBatch.from_arrays([*(b.column(j) for j in range(3)), pa.array(out, pa.string()), pa.array(counts, pa.int32())], names=[*_UNIT, "text", "items"])

    return joined.mapInArrow(run, "src string, record_id string, msg_pos int, text string, items int")
