"""Editing of settings files as text, with their comments and order kept, and a report of the environment without values."""

from __future__ import annotations

import json
import os
import platform
import re
import tomllib
from typing import Any

from maskwright.plans.config import Config, ConfigError, merge

HEADER = re.compile(r"\s*\[(?!\[)([^\]]*)\]\s*(?:#.*)?$")


def literal(value: Any) -> str:
    """A value as TOML."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(literal, value)) + "]"
    return json.dumps(str(value), ensure_ascii=False)


def parse_value(text: str) -> Any:
    """A value given on a command line: TOML where it is TOML, else a string."""
    try:
        return tomllib.loads(f"x = {text}")["x"]
    except tomllib.TOMLDecodeError:
        return text


def get(text: str, key: str) -> Any:
    """The value of a dotted key, or None."""
    at: Any = tomllib.loads(text)
    for part in key.split("."):
        if not isinstance(at, dict) or part not in at:
            return None
        at = at[part]
    return at


def _entry(lines: list[str], key: str) -> tuple[int, int, int | None]:
    """(first line, line after the last) of a key's entry, or (-1, -1); and the line after its table's last entry, if there is one."""
    *table, name = key.split(".")
    now, end, last = [], None, 0
    assign = re.compile(rf"\s*(?:{re.escape(name)}|\"{re.escape(name)}\")\s*=")
    if not table:
        end = 0
    i = 0
    while i < len(lines):
        if lines[i].lstrip().startswith("[["):
            now = None
        elif m := HEADER.match(lines[i]):
            now = [x.strip().strip('"') for x in m[1].split(".")]
        elif now == table:
            if assign.match(lines[i]):
                last = i + 1
                while last < len(lines) and not _whole("\n".join(lines[i:last])):
                    last += 1
                return i, last, None
        if now == table and (lines[i].strip() or end is None):
            end = i + 1
        i += 1
    return -1, -1, end


def _whole(text: str) -> bool:
    try:
        tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return False
    return True


def set_value(text: str, key: str, value: Any) -> str:
    """The file with key = value; everything else stays as it is. Raises ConfigError if that can't be read."""
    lines = text.split("\n")
    first, last, end = _entry(lines, key)
    *table, name = key.split(".")
    line = f"{name} = {literal(value)}"
    if first >= 0:
        comment = re.search(r"\s+#[^\"']*$", lines[first]) if last == first + 1 else None
        lines[first:last] = [line + (comment[0] if comment else "")]
    elif end is not None:
        lines.insert(end, line)
    else:
        while lines and not lines[-1].strip():
            lines.pop()
        lines += ["", f"[{'.'.join(table)}]", line, ""]
    return _checked("\n".join(lines))


def unset(text: str, key: str) -> str:
    """The file without the key's entry."""
    lines = text.split("\n")
    first, last, _ = _entry(lines, key)
    if first >= 0:
        del lines[first:last]
    return _checked("\n".join(lines))


def _checked(text: str) -> str:
    try:
        tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from None
    return text


def dump(table: dict, at: str = "") -> str:
    """A table as TOML."""
    plain = {k: v for k, v in table.items() if not isinstance(v, dict) and not (isinstance(v, list) and v and isinstance(v[0], dict))}
    out = [f"{k} = {literal(v)}" for k, v in plain.items()]
    for k, v in table.items():
        path = f"{at}.{k}" if at else k
        if isinstance(v, dict):
            out += ["", f"[{path}]", dump(v, path).strip("\n")]
        elif k not in plain:
            for row in v:
                out += ["", f"[[{path}]]", dump(row, path).strip("\n")]
    return "\n".join(out) + "\n"


def imported(text: str, other: str) -> str:
    """The settings of one file on top of another's, as a new file."""
    return dump(merge(tomllib.loads(text), tomllib.loads(other)))


def diagnose(spark, config: Config) -> list[tuple[str, str]]:
    """(what, value) about the environment and the settings; no path, word, pattern or salt of a user is in it."""
    from maskwright.plans.catalog import CATALOG

    return [
        ("python", platform.python_version()), ("spark", spark.version), ("system", platform.system()), ("cores", str(os.cpu_count())),
        ("master", spark.sparkContext.master.split("[")[0].split(":")[0]), ("shared folder", "set" if spark.conf.get("spark.checkpoint.dir", None) else "not set"),
        ("detectors on", str(sum(config.detector_enabled(d.id) for d in CATALOG))), ("custom rules", str(len(config.rules))), ("keyword groups", str(len(config.keywords))),
        ("allowlist", f"{len(config.allow_values)} values, {len(config.allow_patterns)} patterns, {len(config.allow_domains)} domains"), ("hash salt", "set" if config.hash_salt else "not set"),
        ("warnings", str(len(config.warnings))),
    ]
