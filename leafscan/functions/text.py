"""Path, text and number expressions (all plain Spark SQL functions)."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from .. import rulebook as rb


def severity_rank(severity: Column) -> Column:
    rank = F.when(severity == "critical", 3).when(severity == "high", 2)
    return rank.when(severity == "medium", 1).when(severity.isNotNull(), 0)


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in rb.SEVERITIES]), rank + 1)


def status_of(score: Column) -> Column:
    out = F.when(score.isNull(), F.lit(None).cast("string"))
    for least, name in rb.STATUS_BANDS:
        out = out.when(score >= least, name)
    return out.otherwise(rb.LOWEST_STATUS)


def round_half_up(x: Column) -> Column:
    """Rounding to the nearest integer with halves going up (88.5 -> 89)."""
    return F.floor(x + F.lit(0.5)).cast("int")


def normal_path(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def infer_layer(path: Column) -> Column:
    return layer_of(normal_path(path))


def layer_of(p: Column) -> Column:
    """The layer of a normal path."""
    out = F.when(p.isNull(), F.lit("unknown"))
    for layer, fragments in rb.LAYER_FRAGMENTS:
        hit = F.lit(False)
        for fragment in fragments:
            hit = hit | p.contains(fragment)
        if layer == "sql":
            hit = hit | p.endswith(".sql")
        out = out.when(hit, layer)
    return out.otherwise("unknown")


def relative_path(path: Column, root: Column) -> Column:
    """``path`` below ``root`` without a leading slash; unchanged when it lies elsewhere."""
    base = F.rtrim(F.coalesce(root, F.lit("")), F.lit("/"))
    inside = F.startswith(path, F.concat(base, F.lit("/")))
    return F.when(inside, F.substring(path, F.length(base) + 2, F.length(path))).otherwise(path)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def count_newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def truncate(text: Column, width: int) -> Column:
    return F.when(F.length(text) <= width, text).otherwise(
        F.concat(F.substring(text, 1, width - 1), F.lit("…")))


def short_snippet(text: Column, lines: int = 2, width: int = 50) -> Column:
    """First non-blank trimmed lines of a snippet, each cut to ``width``."""
    trimmed = F.transform(F.split(text, r"\r?\n"), lambda l: F.regexp_replace(l, r"^\s+|\s+$", ""))
    kept = F.slice(F.filter(trimmed, lambda l: F.length(l) > 0), 1, lines)
    return F.array_join(F.transform(kept, lambda l: truncate(l, width)), "\n")


def join_path(folder: Column, relative: Column) -> Column:
    """Resolve ``./`` and ``../`` of ``relative`` against ``folder``."""
    rooted = F.startswith(folder, F.lit("/"))
    parts = F.split(F.concat_ws("/", folder, relative), "/")
    empty = F.array().cast("array<string>")
    folded = F.aggregate(
        parts, empty,
        lambda acc, s: F.when(s.isin("", "."), acc)
        .when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc))
        .otherwise(F.concat(acc, F.array(s))),
    )
    return F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), F.array_join(folded, "/"))


def glob_pattern(glob: str) -> str:
    """One path glob as an anchored regular expression."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out.append("/.*")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        elif glob[i] == "*":
            out.append("[^/]*")
            i += 1
        elif glob[i] == "?":
            out.append("[^/]")
            i += 1
        elif glob[i] == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out.append("(?:" + "|".join(re.escape(s) for s in glob[i + 1:end].split(",")) + ")")
            i = end + 1
        else:
            out.append(re.escape(glob[i]))
            i += 1
    return "".join(out)


def globs_pattern(globs: Iterable[str]) -> str:
    return "^(?:" + "|".join(glob_pattern(g) for g in globs) + ")$"
