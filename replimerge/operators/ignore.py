"""Ignore rules in gitignore syntax."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors

#: The default rules, in force before a folder's own lines.
DEFAULT_RULES = [".DS_Store", "._*", "*.swp", "*~", ".#*", ".Trash*"]


class Malformed(ValueError):
    """The line is no rule and no comment."""


def _class(line: str, i: int) -> tuple[str, int]:
    """Regex of the character class that opens at ``i``, and the place after it. A ``]`` that comes first, and what a backslash precedes, stand for themselves."""
    start = i + 2 if line[i + 1 : i + 2] in ("!", "^") else i + 1
    members, k = [], start  # a character, or "-" unescaped for a range
    while k < len(line) and (line[k] != "]" or k == start):
        escaped = line[k] == "\\" and k + 1 < len(line)
        members.append((line[k + escaped], escaped))
        k += 1 + escaped
    if k >= len(line):
        raise Malformed("open character class")
    out, m = "", 0
    while m < len(members):
        low, ranged = members[m][0], m + 2 < len(members) and members[m + 1] == ("-", False)
        high = members[m + 2][0] if ranged else low
        if low > high:
            raise Malformed(f"range {low}-{high} is reversed")
        out += _literal(low) + (f"-{_literal(high)}" if ranged else "")
        m += 3 if ranged else 1
    return (f"[^/{out}]" if start == i + 2 else f"[{out}&&[^/]]"), k + 1


def rule_line(line: str, first: bool) -> str:
    """A line of a rule file as the parser takes it: without the byte-order mark that the first may have, and the CR of its end."""
    return (line.removeprefix("\ufeff") if first else line).removesuffix("\r")


def _literal(c: str) -> str:
    return c if c.isalnum() or c in "_/" else f"\\{c}"


def rule_regex(rule: str) -> tuple[str, bool, bool] | None:
    """Regex of the paths that a rule names, whether it re-includes, whether it is for directories only.

    None for blank lines and comments; :class:`Malformed` for what cannot be a rule.
    """
    line = unicodedata.normalize("NFC", re.sub(r"(?<!\\)[ \t]+$", "", rule))
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    line = line[1:] if line.startswith("\\") and line[1:2] in ("#", "!") else line
    dirs = line.endswith("/")
    line = line.rstrip("/")
    if not line:
        return None
    anchored = "/" in line
    line = line.lstrip("/")
    out, i = [], 0
    while i < len(line):
        c, step = line[i], 1
        if line.startswith("**/", i) and (i == 0 or line[i - 1] == "/"):
            piece, step = "(?:.*/)?", 3
        elif line.startswith("**", i) and i + 2 == len(line) and i and line[i - 1] == "/":
            piece, step = ".+", 2
        elif c == "*":
            while line[i + step : i + step + 1] == "*":
                step += 1
            piece = "[^/]*"
        elif c == "?":
            piece = "[^/]"
        elif c == "[":
            piece, end = _class(line, i)
            step = end - i
        elif c == "\\":
            if i + 1 == len(line):
                raise Malformed("nothing after the last backslash")
            piece, step = _literal(line[i + 1]), 2
        else:
            piece = _literal(c)
        out.append(piece)
        i += step
    return ("^" if anchored else "^(?:.*/)?") + "".join(out) + "$", negated, dirs


def compile_rules(lines: list[str], defaults: bool = True) -> list[tuple[str, str, bool, bool]]:
    """``(source, pattern, negated, dirs_only)`` in order: the defaults, then the given lines. Lines that are no rule are left out (see :func:`invalid_rules`)."""
    every = [("default", r) for r in DEFAULT_RULES if defaults] + [(f"line {n}", rule_line(r, n == 1)) for n, r in enumerate(lines, 1)]
    out = []
    for source, rule in every:
        try:
            got = rule_regex(rule)
        except Malformed:
            continue
        out += [(source, *got)] if got else []
    return out


def rule_fault(raw: bytes, first: bool) -> str | None:
    """Why the bytes of a line are no rule; None if they are one, a comment or blank. A BOM on the first line and a CR are no fault."""
    try:
        line = raw.decode()
    except UnicodeDecodeError:
        return "not UTF-8"
    try:
        rule_regex(rule_line(line, first))
    except Malformed:
        return "malformed"
    return None


def deciding_rule(path: Column, is_dir: Column, rules: list[tuple[str, str, bool, bool]]) -> Column:
    """Source of the last rule that matches, if it ignores; null if it re-includes or there is none. One CASE, last rule first."""
    out = F.lit(None).cast("string")
    for source, pattern, negated, dirs_only in rules:
        hit = path.rlike(pattern) & is_dir if dirs_only else path.rlike(pattern)
        out = F.when(hit, F.lit(None if negated else source)).otherwise(out)
    return out


def apply_ignore_rules(df: DataFrame, rules: list[tuple[str, str, bool, bool]]) -> DataFrame:
    """Adds ``ignored`` and ``ignored_by`` to ``folder, path, kind`` rows.

    The last rule that matches decides. Nothing beneath an ignored directory comes back: the highest
    ignored directory decides for all beneath it. Rules of a folder are a small file, so they become
    part of the expression and nothing is joined or shuffled.
    """
    above = F.transform(ancestors(F.col("path")), lambda p: deciding_rule(p, F.lit(True), rules))
    own = deciding_rule(F.col("path"), F.col("kind") == "dir", rules)
    by = F.get(F.filter(F.concat(above, F.array(own)), lambda s: s.isNotNull()), 0)
    return df.withColumn("ignored_by", by).withColumn("ignored", F.col("ignored_by").isNotNull())


def invalid_rules(lines: DataFrame) -> DataFrame:
    """P5: ``folder, line_no, reason`` of the lines (``folder, line_no`` from 1, ``bytes``) that :func:`compile_rules` leaves out: the same parser judges them."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[["folder", "line_no"]].assign(reason=[rule_fault(bytes(x), n == 1) for x, n in zip(b["bytes"], b["line_no"], strict=True)])
            yield out[out["reason"].notna()]

    return lines.select("folder", F.col("line_no").cast("long"), "bytes").where("bytes is not null").mapInPandas(judge, "folder string, line_no long, reason string")
