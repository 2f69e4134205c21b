"""Notes as markdown files with a YAML head. The one place where Python is on the data path."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOTE = (
    "id string, scope string, title string, body string, project_key string, source string, value string, created string, updated string, tags array<string>, "
    "origin struct<ide:string,session_id:string,workspace:string,msg_range:array<int>,distilled_at:string,remembered_at:string>, potential_conflicts array<string>, "
    "potentially_superseded_by array<string>, archived boolean, extra map<string,string>, file_path string, file_mtime double, _mtime_at_write double"
)
_TEXTS = ("id", "scope", "project_key", "source", "value", "created", "updated")
_LISTS = ("tags", "potential_conflicts", "potentially_superseded_by")
_ORIGIN = ("ide", "session_id", "workspace", "distilled_at", "remembered_at")
_OWN = {*_TEXTS, *_LISTS, "origin", "archived", "_mtime_at_write", "title"}


def split(text: str) -> tuple[dict, str]:
    """Head and body; a text whose first line isn't ``---`` followed by a plain line end, or with a broken head, has no head."""
    if not text.startswith("---\n"):
        return {}, text
    head, mark, body = text[4:].partition("\n---\n")
    if not mark:
        head, mark, body = (text[4:-4], "---", "") if text.endswith("\n---") else ("", "", text)
    if not mark:
        return {}, text
    try:
        values = yaml.load(head, Loader=yaml.BaseLoader)  # noqa: S506  every scalar stays the string it is
    except yaml.YAMLError:
        return {}, text
    return (values, body.lstrip("\n")) if isinstance(values, dict) else ({}, text)


def _none(x):
    return None if x is None or x in ("", "null", "~") else str(x)


def _list(x) -> list[str]:
    return [str(v) for v in x] if isinstance(x, list) else []


def _number(x) -> float | None:
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


def note(text: str, path: str = "", mtime: float | None = None) -> dict | None:
    """The note of a file; None without ``id`` or ``scope``. Keys without a column of their own go to ``extra``."""
    head, body = split(text)
    if not _none(head.get("id")) or not _none(head.get("scope")):
        return None
    out = {k: _none(head.get(k)) for k in _TEXTS} | {k: _list(head.get(k)) for k in _LISTS}
    origin = head.get("origin")
    if isinstance(origin, dict):
        span = [int(v) for v in _list(origin.get("msg_range")) if str(v).lstrip("-").isdigit()]
        out["origin"] = {k: _none(origin.get(k)) for k in _ORIGIN} | {"msg_range": span or None}
    else:
        out["origin"] = None
    titles = [x.lstrip("#").strip() for x in body.splitlines() if x.strip().startswith("#")]
    extra = {k: v if isinstance(v, str) else yaml.safe_dump(v, allow_unicode=True) for k, v in head.items() if k not in _OWN}
    return out | {
        "title": next((t for t in titles if t), ""), "body": body, "archived": str(head.get("archived", "")).lower() == "true", "extra": extra,
        "file_path": path, "file_mtime": mtime, "_mtime_at_write": _number(head.get("_mtime_at_write")),
    }


def text_of(row: dict) -> str:
    """A note as a file's text; empty fields are left out, :func:`note` gives the same row back."""
    head = {k: row[k] for k in _TEXTS if row.get(k)}
    head |= {k: list(row[k]) for k in _LISTS if row.get(k) is not None and len(row[k])}
    if row.get("origin"):
        head["origin"] = {k: (list(map(int, v)) if k == "msg_range" else v) for k, v in dict(row["origin"]).items() if v is not None}
    if row.get("archived"):
        head["archived"] = True
    written = row.get("_mtime_at_write")
    if written is not None and written == written:
        head["_mtime_at_write"] = float(written)
    extra = row.get("extra") or {}
    head |= {k: v for k, v in (extra.items() if isinstance(extra, dict) else extra) if k not in head}
    quoted = {k: str(v) if isinstance(v, str) else v for k, v in head.items()}
    return "---\n" + yaml.safe_dump(quoted, allow_unicode=True, sort_keys=False, width=10**6) + "---\n\n" + (row.get("body") or "").lstrip("\n")


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """All notes below a folder; unreadable files, files without id or scope and compiled overviews don't come out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(path)
    files = files.where(~F.col("path").contains("/_compiled/")).select("path", (F.unix_micros("modificationTime") / 1e6).alias("mtime"), "content")
    names = [f.split(" ")[0] for f in NOTE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, mtime, content in b.itertuples(index=False):
                try:
                    row = note(bytes(content).decode("utf-8"), path, mtime)
                except UnicodeDecodeError:
                    row = None
                if row:
                    rows.append(row)
            yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(run, NOTE)


def as_texts(notes: DataFrame) -> DataFrame:
    """``id, text``: every note as the text of its file."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "text": [text_of(r) for r in b.astype(object).where(b.notna(), None).to_dict("records")]})

    return notes.mapInPandas(run, "id string, text string")


def from_texts(texts: DataFrame) -> DataFrame:
    """Notes of ``id, text`` rows."""
    names = [f.split(" ")[0] for f in NOTE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for r in map(note, b["text"]) if r], columns=names)

    return texts.mapInPandas(run, NOTE)
