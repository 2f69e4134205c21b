"""Tokens, similarity and small text functions, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pairs of Chinese characters that carry no meaning.
STOP_PAIRS = (
    "的是", "不是", "是一", "一个", "了一", "在一", "的一",
    "是在", "了的", "的了", "在了", "不了", "也是", "就是",
    "但是", "还是", "只是", "可以", "这个", "那个", "什么",
    "没有", "已经", "因为", "所以", "如果", "虽然", "然后",
    "或者", "以及", "而且", "不过",
)


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def or_else(text: Column, other: Column) -> Column:
    """``other`` for null and for the empty string."""
    return F.coalesce(F.nullif(text, F.lit("")), other)


def han_tokens(text: Column) -> Column:
    """Neighbouring pairs of Chinese characters but for the stop list, and the last character of each run."""
    han = "[\\x{4e00}-\\x{9fff}]"
    pairs = F.regexp_extract_all(text, F.lit(f"(?=({han}{han}))"), F.lit(1))
    # a set looked into for each pair costs a fifth of what the list costs as a part of the pattern
    return F.concat(F.filter(pairs, lambda p: ~p.isin(*STOP_PAIRS)), F.regexp_extract_all(text, F.lit(f"{han}(?!{han})"), F.lit(0)))


def tokens(text: Column) -> Column:
    """Search tokens: runs of Latin letters, digits, ``_`` and ``-`` in lower case, then the Chinese ones. Null: none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.concat(F.regexp_extract_all(low, F.lit(r"[A-Za-z0-9_\-]+"), F.lit(0)), han_tokens(low))


def words(text: Column) -> Column:
    """Distinct Unicode words in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def title(body: Column, any_depth: bool = False) -> Column:
    """The first heading: of one ``#`` only, or of any depth. Empty if there is none."""
    mark = r"#+" if any_depth else r"#"
    return strip(F.regexp_extract(F.coalesce(body, F.lit("")), rf"(?mU)^[^\S\n]*{mark}\s+(\S[^\n\r]*)$", 1))


def slug(text: Column) -> Column:
    """ASCII slug: other characters go, blanks become hyphens."""
    plain = F.regexp_replace(strip(F.lower(F.coalesce(text, F.lit("")))), r"[^A-Za-z0-9_\s\-]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"\s+", "-"), r"-+", "-"), r"^-+|-+$", "")


def han_slug(text: Column, most: int = 50) -> Column:
    """Slug that keeps Chinese characters: all else but letters, digits, ``_`` and ``-`` goes."""
    plain = F.regexp_replace(strip(F.lower(F.coalesce(text, F.lit("")))), r"[^A-Za-z0-9_\x{4e00}-\x{9fff}\s\-]", "")
    return F.left(F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"\s+", "-"), r"-+", "-"), r"^-+|-+$", ""), F.lit(most))


def rendered(template: str, values: dict[str, Column]) -> Column:
    """A template with each ``{name}`` replaced by its value, in the order given; a null value leaves an empty place."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def inside(path: Column, root: str) -> Column:
    """Whether a path lies below a root once ``.`` and ``..`` are resolved; a path that climbs out of it doesn't."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    base = [x for x in root.split("/") if x not in ("", ".")]
    return F.coalesce(path.startswith("/") & (F.size(up) > len(base)) & (F.slice(up, 1, len(base)) == F.array(*map(F.lit, base)).cast("array<string>")), F.lit(False))


def head(text: Column, n: int) -> Column:
    """The first ``n`` lines that aren't blank, and the number of the first of them."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\R")
    full = F.transform(lines, lambda x: strip(x) != "")
    return F.struct(F.greatest(F.array_position(full, True), F.lit(1)).cast("int").alias("line"), F.array_join(F.slice(F.filter(lines, lambda x: strip(x) != ""), 1, n), "\n").alias("snippet"))


def note_id(name: Column, date: Column) -> Column:
    """``date-slug-hex``; the hex is a digest of both, so the same note gets the same id."""
    digest = F.substring(F.sha2(F.concat_ws("\n", date, name), 256), 1, 4)
    return F.concat_ws("-", date, F.substring(F.coalesce(F.nullif(slug(name), F.lit("")), F.lit("memory")), 1, 50), digest)


def remote_key(url: Column) -> Column:
    """``host/path`` of a git remote in any notation; null for other texts."""
    u = strip(url)
    # The notations of a remote, with host and path as groups.
    forms = (
        (r"^git@([^:]+):(.+?)(?:\.git)?$", 1),
        (r"^https?://(?:[^@]+@)?([^/]+)/(.+?)(?:\.git)?$", 1),
        (r"^ssh://(?:[^@]+@)?([^/:]+)(?::\d+)?/(.+?)(?:\.git)?$", 1),
        (r"^git://([^/]+)/(.+?)(?:\.git)?$", 1),
    )
    cases = None
    for form, _ in forms:
        path = F.regexp_replace(F.regexp_replace(F.regexp_extract(u, form, 2), r"^/+|/+$", ""), r"\.git$", "")
        key = F.when((F.regexp_extract(u, form, 1) != "") & (path != ""), F.concat_ws("/", F.lower(F.regexp_extract(u, form, 1)), path))
        cases = F.when(u.rlike(form), key) if cases is None else cases.when(u.rlike(form), key)
    return cases


def directory(key: Column) -> Column:
    """A key as a directory name; not invertible."""
    return F.regexp_replace(F.replace(key, F.lit("/"), F.lit("_")), r"[^A-Za-z0-9._\-]", "_")


def url_text(text: Column) -> Column:
    """Percent escapes decoded; ``+`` and broken escapes stay."""
    safe = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(safe), text)


def snippet_line(query: str, text: Column) -> Column:
    """Number of the line to show: the first with the whole query, else the first with most of its words; null if none."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\R")
    q = query.lower()
    parts = [w for w in q.split() if len(w) >= 2]
    low = F.transform(lines, F.lower)
    whole = F.array_position(F.transform(low, lambda x: x.contains(q)), True)
    if not parts:
        return F.nullif(whole, F.lit(0))
    counts = F.transform(low, lambda x: sum(((x.contains(w)).cast("int") for w in parts), F.lit(0)))
    best = F.array_max(counts)
    return F.coalesce(F.nullif(whole, F.lit(0)), F.when(best > 0, F.array_position(counts, best)))


def snippet(query: str, text: Column, around: int = 2) -> Column:
    """The lines around :func:`snippet_line`, else the first lines that aren't blank."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\R")
    at = snippet_line(query, text)
    start = F.greatest(at - around, F.lit(1))
    part = F.slice(lines, start.cast("int"), (F.least(at + around, F.size(lines)) - start + 1).cast("int"))
    head = F.slice(F.filter(lines, lambda x: strip(x) != ""), 1, around * 2 + 2)
    return F.array_join(F.when(at.isNotNull(), part).otherwise(head), "\n")
