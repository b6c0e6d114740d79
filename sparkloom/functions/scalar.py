"""Scalar functions as columns: normalisers, categorisers, buckets, scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def git_url(url: Column) -> Column:
    """One form for a repository's addresses: ssh as https, no scheme, no .git, no slash at the end, lower case."""
    out = F.regexp_replace(F.lower(F.trim(url)), r"^git@([^:]+):", "$1/")
    return F.regexp_replace(F.regexp_replace(out, r"^[a-z+]+://(?:[^@/]+@)?", ""), r"(?:\.git)?/*$", "")


def layer_of(path: Column) -> Column:
    """The first directory of a path, without a leading src or lib; a bare file's stem."""
    rest = F.regexp_replace(path, "^(?:src|lib)/", "")
    return F.when(rest.contains("/"), F.substring_index(rest, "/", 1)).otherwise(F.regexp_replace(rest, r"\.[^.]*$", ""))


def commands(line: Column) -> Column:
    """The commands of a shell line, split at ; && and ||, without comments."""
    return F.filter(F.transform(F.split(line, r";|&&|\|\|"), lambda c: F.trim(c)), lambda c: (c != "") & ~c.startswith("#"))


def week(day: Column) -> Column:
    """Whole weeks since the epoch."""
    return F.floor(F.unix_date(day) / 7)


def risk(complexity: Column, callers: Column, lines: Column, minor: Column) -> Column:
    """complexity * ln(callers + 1) * ln(lines + 1), a tenth of it for minor functions."""
    return complexity * F.log(callers + 1) * F.log(lines + 1) * F.when(minor, 0.1).otherwise(1.0)


def security_score(critical: Column, high: Column, medium: Column, low: Column) -> Column:
    """100 less 40, 20, 10 and 5 for each finding, at least 0."""
    return F.greatest(F.lit(0), 100 - (40 * critical + 20 * high + 10 * medium + 5 * low))


def grade(score: Column) -> Column:
    return F.when(score >= 0.9, "A").when(score >= 0.8, "B").when(score >= 0.7, "C").when(score >= 0.6, "D").otherwise("F")


def weighted(parts: list[tuple[Column, float]]) -> Column:
    """Scores by weight, over the sum of weights."""
    return sum((s * w for s, w in parts), F.lit(0.0)) / sum(w for _, w in parts)


def band(value: Column, edges: list[tuple[int, str]], last: str) -> Column:
    """The name of the first edge a value doesn't exceed."""
    out = None
    for most, name in edges:
        out = F.when(value <= most, name) if out is None else out.when(value <= most, name)
    return out.otherwise(last)
