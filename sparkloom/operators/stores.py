"""Tables that are kept and changed: caches, blobs, baselines, knowledge units. Each function gives the table's next state or a look at it.

A change is an anti join on keys and a union, so it holds for tables of any size; a caller writes the result as the
table's next version.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def upsert(rows: DataFrame, fresh: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with those of ``fresh`` in place of rows of equal keys; of repeated fresh rows all stay."""
    return rows.join(fresh.select(*keys).distinct(), list(keys), "left_anti").unionByName(fresh)


def delete(rows: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def apply(rows: DataFrame, upserts: DataFrame, deletes: DataFrame, *keys: str) -> DataFrame:
    """Deletes first, then upserts."""
    return upsert(delete(rows, deletes, *keys), upserts, *keys)


def keep_marked(rows: DataFrame, marks: DataFrame, key: str, keep: bool = True) -> DataFrame:
    """The rows whose key is marked, or those whose isn't."""
    return rows.join(marks.select(key).distinct(), key, "left_semi" if keep else "left_anti")


def load_blobs(blobs: DataFrame, engine: str, config_hash: str) -> DataFrame:
    """What an engine saved under just this configuration; under another it is a miss."""
    return blobs.where((F.col("engine") == engine) & (F.col("config_hash") == config_hash))


def missing(wanted: DataFrame, cache: DataFrame, *keys: str) -> DataFrame:
    """What a cache has to be filled with: wanted rows without a cached one of equal keys."""
    return wanted.join(cache.select(*keys).distinct(), list(keys), "left_anti")


def evict(cache: DataFrame, size: str, used: str, limit: int, chunk: int = 100, share: float = 0.9) -> DataFrame:
    """A cache after the least recently used rows went, ``chunk`` at a time, until the rest is at most ``share`` of the limit; untouched within the limit.

    Running sums go over buckets of the order first, so no row meets all others.
    """
    total = cache.agg(F.coalesce(F.sum(size), F.lit(0)).alias("total"), F.count("*").alias("n")).first()
    if total["total"] <= limit:
        return cache
    goal = total["total"] - share * limit
    cells = max(1, min(4096, total["n"] // 256))
    ends = cache.agg(F.min(used).alias("a"), F.max(used).alias("z")).first()
    width = max(1, -(-(ends["z"] - ends["a"] + 1) // cells))
    rows = cache.withColumn("__cell", F.floor((F.col(used) - F.lit(ends["a"])) / width))
    w = Window.orderBy("__cell")
    before = rows.groupBy("__cell").agg(F.sum(size).alias("s"), F.count("*").alias("c")).select("__cell", (F.sum("s").over(w) - F.col("s")).alias("__s"), (F.sum("c").over(w) - F.col("c")).alias("__c"))
    inner = Window.partitionBy("__cell").orderBy(used, F.xxhash64(*cache.columns)).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(F.broadcast(before), "__cell").withColumn("__sum", F.col("__s") + F.sum(size).over(inner)).withColumn("__k", F.col("__c") + F.row_number().over(inner))
    # The first row at which enough has gone; its whole chunk goes with it.
    last = placed.where(F.col("__sum") >= goal).agg(F.min("__k").alias("k")).first()["k"]
    cut = -(-last // chunk) * chunk if last else total["n"]
    return placed.where(F.col("__k") > cut).select(*cache.columns)


def current_versions(cache: DataFrame, version: str) -> DataFrame:
    """The cached rows that this version made."""
    return cache.where(F.col("version") == version)


def baseline_update(baseline: DataFrame, measured: DataFrame, higher_is_worse: bool = True, force: bool = False) -> DataFrame:
    """Baseline entries (address, metric, value) moved to what is measured where that is better, or always if forced."""
    now = measured.select("address", "metric", F.col("value").alias("now"))
    better = F.col("now") < F.col("value") if higher_is_worse else F.col("now") > F.col("value")
    value = F.when(F.col("now").isNotNull() & (better | F.lit(force)), F.col("now")).otherwise(F.col("value"))
    return baseline.join(now, ["address", "metric"], "left").select("address", "metric", value.alias("value"))


def violations(checked: DataFrame, rule: str, address: str, status: Column, message: Column) -> DataFrame:
    """Failed checks as diagnostics (severity, rule, file, line, message)."""
    return checked.where(status).select(F.lit("error").alias("severity"), F.lit(rule).alias("rule"), F.col(address).cast("string").alias("file"), F.lit(0).alias("line"), message.alias("message"))


def copy_plan(source: DataFrame, target: DataFrame, checksum: bool = False) -> DataFrame:
    """(path, action): what copying a tree has to do: copy where the target lacks a file or has another (by size and mtime, or by digest), else skip.

    Tables are (path, size, mtime, digest).
    """
    both = source.join(target.select("path", F.col("size").alias("s2"), F.col("mtime").alias("m2"), F.col("digest").alias("d2")), "path", "left")
    same = F.col("digest") == F.col("d2") if checksum else (F.col("size") == F.col("s2")) & (F.col("mtime") == F.col("m2"))
    return both.select("path", F.when(F.coalesce(same, F.lit(False)), "skip").otherwise("copy").alias("action"))


def audit(installed: DataFrame, advisories: DataFrame) -> DataFrame:
    """Installed packages (name, version) with the advisories (name, below, severity, id) that hold for their version."""
    return installed.join(advisories, "name").where(F.col("version") < F.col("below")).select("name", "version", "severity", "id")


def transform_units(units: DataFrame, change: Column) -> DataFrame:
    """Units (id, body) with their bodies changed; a change to null deletes the unit."""
    return units.withColumn("body", change).where("body is not null")


def diff_lines(before: DataFrame, after: DataFrame, what: Column = None) -> DataFrame:
    """(file, added, removed) of lines (file, text) between two versions, as multisets; ``what`` says which lines count."""
    n = lambda df, name: (df if what is None else df.where(what)).groupBy("file", "text").agg(F.count("*").alias(name))
    both = n(before, "b").join(n(after, "a"), ["file", "text"], "full").fillna(0, ["a", "b"])
    return both.groupBy("file").agg(F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("added"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("removed")).where("added + removed > 0")


def diff_sets(before: DataFrame, after: DataFrame, by: str, *key: str) -> DataFrame:
    """(by, added, removed) of distinct things between two versions."""
    b, a = (df.select(by, *key).distinct() for df in (before, after))
    changes = a.join(b, [by, *key], "left_anti").select(by, F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.join(a, [by, *key], "left_anti").select(by, F.lit(0).alias("x"), F.lit(1).alias("y")))
    return changes.groupBy(by).agg(F.sum("x").alias("added"), F.sum("y").alias("removed"))


def diff_values(before: DataFrame, after: DataFrame, by: str, key: str, value: str) -> DataFrame:
    """(by, added, removed): how much values grew and fell in all; what is new or gone counts in full."""
    both = before.select(by, key, F.col(value).alias("b")).join(after.select(by, key, F.col(value).alias("a")), [by, key], "full").fillna(0, ["a", "b"])
    return both.groupBy(by).agg(F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("added"), F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("removed")).where("added + removed > 0")


def around(lines: DataFrame, key: str, pattern: str, context: int, nth: int = 1) -> DataFrame:
    """(key, line, text): the lines within ``context`` of the ``nth`` matching line of each file. ``lines`` is (key, line, text)."""
    hits = lines.where(F.col("text").rlike(pattern)).groupBy(key).agg(F.get(F.sort_array(F.collect_list("line")), F.lit(nth - 1)).alias("at")).where("at is not null")
    return lines.join(hits, key).where(F.abs(F.col("line") - F.col("at")) <= context).select(key, "line", "text")


def chunks(lines: DataFrame, key: str, size: int, n: int) -> DataFrame:
    """(key, line, text, chunks): the ``n``-th run (from 1) of ``size`` lines of each file, with how many runs it has."""
    count = lines.groupBy(key).agg(F.ceil(F.count("*") / size).alias("chunks"))
    return lines.where(F.floor((F.col("line") - 1) / size) == n - 1).join(count, key)


def grep(lines: DataFrame, key: str, pattern: str, ignore_case: bool = False, limit: int = 0) -> DataFrame:
    """(key, line, start, end, content): matching lines, trimmed, with the first match's place in the line as it is (from 0)."""
    p = f"(?i){pattern}" if ignore_case else pattern
    found = F.regexp_substr("text", F.lit(p))
    start = F.regexp_instr("text", F.lit(p)) - 1
    out = lines.where(F.col("text").rlike(p)).select(key, "line", start.alias("start"), (start + F.length(found)).alias("end"), F.trim("text").alias("content"))
    return out.orderBy(key, "line").limit(limit) if limit else out


def union_reports(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
