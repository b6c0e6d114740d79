"""Gitignore-like globs as columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F


def to_regex(glob: str) -> str:
    """A glob's regular expression: ** crosses folders, * and ? don't, {a,b} and [..] are alternatives and sets.

    A glob without a slash matches a name at any depth; one that ends in a slash matches all below.
    """
    if glob.endswith("/"):
        glob += "**"
    if "/" not in glob:
        glob = f"**/{glob}"
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        end = glob.find("]", i + 1) if c == "[" else -1
        if end > 0:
            body = glob[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[:1] == "!" else body).replace("\\", "\\\\") + "]", end + 1
            continue
        depth += (c == "{") - (c == "}" and depth > 0)
        out += {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")"}.get(c) or ("|" if c == "," and depth else re.escape(c))
        i += 1
    return f"^{out.removeprefix('^')}$"


def matches(path: Column, glob: str) -> Column:
    return path.rlike(to_regex(glob.lstrip("/")))


def any_glob(path: Column, globs) -> Column:
    """Whether one of the globs takes the path; False for none."""
    return reduce(Column.__or__, [matches(path, g) for g in globs], F.lit(False))


def selected(path: Column, only=(), exclude=()) -> Column:
    """A path that one of ``only`` takes (any, if there is none) and none of ``exclude``."""
    kept = any_glob(path, only) if only else F.lit(True)
    return kept & ~any_glob(path, exclude)


#: The built-in aliases of the path filters.
ALIASES = {
    "tests": ["**/test_*.py", "**/*_test.py", "**/*_test.go", "**/*.test.ts", "**/*.test.js", "**/*.spec.ts", "**/*.spec.js", "**/tests/**", "**/__tests__/**"],
    "config": ["**/*.toml", "**/*.yaml", "**/*.yml", "**/*.json", "**/*.ini"],
    "build": ["**/target/**", "**/dist/**", "**/build/**"],
    "docs": ["**/*.md", "**/*.rst", "**/docs/**"],
    "generated": ["**/*.lock", "**/*.min.js", "**/*.pb.go"],
}


def resolve(patterns: list[str], aliases: dict[str, list[str]] | None = None) -> tuple[list[str], list[str]]:
    """(globs, warnings): @name stands for an alias's globs, the caller's before the built-in ones; an empty alias is off, an unknown one warns."""
    known, out, warnings = ALIASES | (aliases or {}), [], []
    for p in patterns:
        if not p.startswith("@"):
            out.append(p)
        elif p[1:] not in known:
            warnings.append(f"unknown alias {p}")
        elif not known[p[1:]]:
            warnings.append(f"alias {p} is off")
        else:
            out += known[p[1:]]
    return out, warnings
