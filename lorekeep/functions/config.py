"""Settings in layers, and where a working folder belongs to."""

from __future__ import annotations

import configparser
import os
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def layered(defaults: Mapping, *layers: Mapping) -> dict:
    """Settings of several layers, later ones first, nested ones key by key. A value that isn't of its default's type is
    read as such if it can be, and otherwise left out."""
    out = dict(defaults)
    for layer in layers:
        for key, value in layer.items():
            base = out.get(key)
            if isinstance(base, Mapping):
                out[key] = layered(base, value) if isinstance(value, Mapping) else base
            else:
                out[key] = _as(value, base)
    return out


def _as(value, base):
    if base is None or value is None or type(value) is type(base):
        return base if value is None else value
    try:
        if isinstance(base, bool):
            low = str(value).strip().lower()
            return low in ("1", "true", "yes", "on") if low in ("1", "0", "true", "false", "yes", "no", "on", "off") else base
        return type(base)(value)
    except (TypeError, ValueError):
        return base


def settings(rows: DataFrame) -> DataFrame:
    """``key, value`` of settings in rows (``layer, key, value``): of each key that of the highest layer whose value isn't null."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("layer"), "value"))
    return rows.where("value is not null and key is not null").withColumn("__n", rank).where("__n = 1").select("key", "value")


def number(value: Column, default: float) -> Column:
    """A setting as a number; what can't be read is the default."""
    return F.coalesce(value.try_cast("double"), F.lit(float(default)))


def remote_of(folder: str | os.PathLike) -> str | None:
    """The ``origin`` of the git repository that a folder lies in, from its config; None outside of one. Files only, no git."""
    here = Path(folder).resolve()
    for place in (here, *here.parents):
        git = place / ".git"
        if git.is_file():  # a worktree names its repository
            line = git.read_text(errors="replace").partition("gitdir:")[2].strip()
            git = (place / line).resolve()
            common = git / "commondir"
            git = (git / common.read_text().strip()).resolve() if common.exists() else git
        if git.is_dir():
            parser = configparser.ConfigParser(strict=False, interpolation=None)
            try:
                parser.read_string("\n".join(x.strip() for x in (git / "config").read_text(errors="replace").splitlines()))
            except (OSError, configparser.Error):
                return None
            return parser.get('remote "origin"', "url", fallback=None)
    return None


def workspace(given: str | None = None, env: Mapping[str, str] | None = None, variable: str = "LOREKEEP_WORKSPACE") -> str:
    """The working folder: the one given, else that of the environment, else the current one."""
    return given or (os.environ if env is None else env).get(variable) or os.getcwd()
