"""Include and exclude patterns over paths."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored regular expression; * and ? also match slashes, [..] and [!..] are classes."""
    out = []
    for part in re.findall(r"\*+|\?|\[[!^]?\]?[^\]]*\]|[^*?\[]+|\[", pattern):
        if part[0] == "*":
            out.append(".*")
        elif part == "?":
            out.append(".")
        elif part[0] == "[" and len(part) > 1:
            inner = part[1:-1]
            negated = inner[0] in "!^"
            out.append("[" + ("^" if negated else "") + re.sub(r"([\\\[\]&^])", r"\\\1", inner[negated:]) + "]")
        else:
            out.append(re.escape(part))
    return "^" + "".join(out) + "$"


def matches(path: Column, pattern: str) -> Column:
    """FLT01: the whole path, its last name, a directory with its files, or a pattern under any directory."""
    if pattern.endswith("/"):
        return path.startswith(pattern)
    rooted = pattern[3:] if pattern.startswith("**/") else pattern
    out = path.rlike(glob_regex(pattern)) | F.substring_index(path, "/", -1).rlike(glob_regex(pattern))
    if pattern.startswith("**/"):
        out = out | F.concat(F.lit("/"), path).rlike(glob_regex("*/" + rooted))
    return out


def exclude_paths(df: DataFrame, path: str, patterns: list[str]) -> DataFrame:
    """FLT01, SRC03: rows whose path no pattern matches; a null path stays."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.coalesce(matches(F.col(path), p), F.lit(False))
    return df.filter(~hit)


def include_paths(df: DataFrame, keys: list[str], path: str, patterns: list[str]) -> DataFrame:
    """FLT02, SRC05: (keys, ord) with the first pattern that names the row; directories, globs or files."""
    order = F.lit(None).cast("int")
    for i in range(len(patterns) - 1, -1, -1):
        p = patterns[i]
        named = F.col(path).rlike(glob_regex(p)) if re.search(r"[*?\[]", p) else (F.col(path) == p) | F.col(path).startswith(p.rstrip("/") + "/")
        order = F.when(named, i).otherwise(order)
    return df.select(*keys, order.alias("ord")).filter("ord is not null")
