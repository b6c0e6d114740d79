"""Rules as a user runs them: metadata, allow globs, suppressions, severities and one diagnostics table.

A diagnostic is (severity, rule, file, line, message). Rule files are Datalog text under a block of comment lines that
holds TOML between lines of dashes: id, severity, tags, allow, enabled.
"""

from __future__ import annotations

import re
import tomllib
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.datalog.engine import evaluate, parse
from sparkloom.datalog.rules import RULES, Program
from sparkloom.functions.globs import any_glob
from sparkloom.runtime import Scratch

SCHEMA = "severity string, rule string, file string, line int, message string"
_FRONT = re.compile(r"\A\s*#\s*-{3,}\s*\n(?P<meta>(?:#.*\n)*?)#\s*-{3,}\s*\n")


def read_rule(text: str, default_id: str) -> tuple[str, Program] | None:
    """(id, program) of a rule file; None if its front matter isn't TOML. Without any, all metadata are defaults."""
    m = _FRONT.match(text)
    try:
        meta = tomllib.loads("\n".join(line.lstrip("#").strip() for line in m["meta"].splitlines())) if m else {}
    except tomllib.TOMLDecodeError:
        return None
    body = text[m.end() :] if m else text
    heads = {r.head.relation for r in parse(body)[1]}
    gives = ("diagnostic",) if "diagnostic" in heads else ("found",) if "found" in heads else tuple(sorted(heads))
    return str(meta.get("id", default_id)), Program(body, gives, str(meta.get("severity", "warning")), tuple(meta.get("tags", ())), tuple(meta.get("allow", ())), bool(meta.get("enabled", True)))


def select(rules: dict[str, Program], tag: str | None = None, enabled_only: bool = True, switch: dict[str, bool] | None = None, groups: dict[str, list[str]] | None = None) -> dict[str, Program]:
    """The rules that run: those enabled (``switch`` overrides by id) that have the tag, or one that the tag's group leads to."""
    switch, wanted = switch or {}, expand_tag(tag, groups or {}) if tag else None
    return {n: r for n, r in sorted(rules.items()) if (not enabled_only or switch.get(n, r.enabled)) and (wanted is None or wanted & set(r.tags))}


def expand_tag(tag: str, groups: dict[str, list[str]]) -> set[str]:
    """A tag and all that groups of tags lead to from it; groups may hold each other."""
    found, todo = set(), [tag]
    while todo:
        t = todo.pop()
        if t not in found:
            found.add(t)
            todo += groups.get(t, [])
    return found


def run_rule(name: str, rule: Program, relations: dict[str, DataFrame], scratch: Scratch, allow: tuple[str, ...] = (), severity: str | None = None) -> DataFrame:
    """The diagnostics of one rule, without files that an allow glob takes; ``severity`` overrides the rule's own."""
    out = evaluate(rule.text, relations, scratch)
    if "diagnostic" in out:
        found = out["diagnostic"].select(F.col("c0").alias("severity"), F.col("c1").alias("rule"), F.col("c2").alias("file"), F.col("c3").cast("int").alias("line"), F.col("c4").cast("string").alias("message"))
        found = found.withColumn("severity", F.lit(severity)) if severity else found
    else:
        found = out["found"].select(F.lit(severity or rule.severity).alias("severity"), F.lit(name.replace("_", "-")).alias("rule"), F.col("c0").alias("file"), F.col("c1").cast("int").alias("line"), F.col("c2").cast("string").alias("message"))
    globs = (*rule.allow, *allow)
    return found.where(~any_glob(F.col("file"), globs)) if globs else found


def run_rules(rules: dict[str, Program], relations: dict[str, DataFrame], scratch: Scratch) -> DataFrame:
    """The diagnostics of all rules that report any, in one table; each rule is a plan of its own."""
    reporting = {n: r for n, r in rules.items() if r.gives in (("found",), ("diagnostic",))}
    empty = scratch.spark.createDataFrame([], SCHEMA)
    return reduce(DataFrame.unionByName, [run_rule(n, r, relations, scratch) for n, r in reporting.items()], empty)


def suppressed(found: DataFrame, lines: DataFrame, first: int = 10) -> DataFrame:
    """``found`` without what a file's own ``allow: rule`` comment in its first lines lets through. ``lines`` is (file, line, text)."""
    marks = lines.where(F.col("line") <= first).select("file", F.explode(F.regexp_extract_all("text", F.lit(r"allow:\s*([\w/-]+)"), F.lit(1))).alias("rule")).distinct()
    return found.join(marks, ["file", "rule"], "left_anti")


def rerun(cached: DataFrame, name: str, rule: Program, relations: dict[str, DataFrame], changed: DataFrame, scratch: Scratch) -> DataFrame:
    """Diagnostics after files changed, from those before: of a rule that looks at one file at a time only the changed
    files are looked at anew, any other rule runs again. ``changed`` is (file)."""
    if not local(rule):
        return run_rule(name, rule, relations, scratch)
    touched = {k: df.join(changed.toDF(df.columns[0]), df.columns[0], "left_semi") for k, df in relations.items()}
    return cached.join(changed, "file", "left_anti").unionByName(run_rule(name, rule, touched, scratch))


def local(rule: Program) -> bool:
    """Whether every clause of every rule is about the file that its head names first."""
    from sparkloom.datalog.engine import Atom, Count, Var

    _, rules = parse(rule.text)
    derived = {r.head.relation for r in rules if not r.body}
    for r in rules:
        if not r.body:
            continue
        own = r.head.terms[0] if r.head.terms else None
        atoms = [c.atom if isinstance(c, Count) else c for c in r.body if isinstance(c, Atom | Count)]
        if not isinstance(own, Var) or any(a.relation not in derived and (not a.terms or not isinstance(a.terms[0], Var) or a.terms[0].name != own.name) for a in atoms):
            return False
    return True


def sort(found: DataFrame) -> DataFrame:
    """By file, line, rule and message."""
    return found.orderBy("file", "line", "rule", "message")


def merge(*reports: DataFrame) -> DataFrame:
    """Several reports as one, what two of them say alike once."""
    return reduce(DataFrame.unionByName, reports).distinct()


def promoted(found: DataFrame, strict: bool = True) -> Column:
    """The severity column with warnings as errors."""
    return F.when((F.col("severity") == "warning") & F.lit(strict), "error").otherwise(F.col("severity"))


BUILT_IN = RULES
