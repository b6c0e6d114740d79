"""Health ladders, native rules and cross-table reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def module_health(tests: DataFrame, density: DataFrame, uniqueness: DataFrame, ceremony: DataFrame) -> DataFrame:
    """(module, test, density, uniq, ceremony, score): four reports joined in full, with defaults 0, 0.5, 1 and 0."""
    parts = [tests.toDF("module", "test"), density.toDF("module", "density"), uniqueness.toDF("module", "uniq"), ceremony.toDF("module", "ceremony")]
    out = reduce(lambda a, b: a.join(b, "module", "full"), parts).fillna({"test": 0.0, "density": 0.5, "uniq": 1.0, "ceremony": 0.0})
    return out.withColumn("score", F.round((F.col("test") + F.col("density") + F.col("uniq") + (1 - F.col("ceremony"))) / 4, 6))


def boundary_violations(imports: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(from, to, rule): imports from one glob into another; the rules are a driver-side list, one filter each."""
    glob = lambda g: "^" + g.replace(".", r"\.").replace("**", "\0").replace("*", "[^/]*").replace("\0", ".*") + "$"
    found = [imports.where(F.col("from").rlike(glob(a)) & F.col("to").rlike(glob(b))).select("from", "to", F.lit(f"{a} -> {b}").alias("rule")) for a, b in rules]
    return reduce(DataFrame.unionByName, found)


def stale_docs(docs: DataFrame, code: DataFrame, covers: DataFrame) -> DataFrame:
    """(doc, newer): docs older than code that they cover, with the count of newer files. Tables are (doc, mtime), (path, mtime), (doc, path)."""
    both = covers.join(docs.withColumnRenamed("mtime", "d"), "doc").join(code.withColumnRenamed("mtime", "c"), "path")
    return both.where("d < c").groupBy("doc").agg(F.count("*").alias("newer"))


def doc_coverage(symbols: DataFrame) -> DataFrame:
    """(file, documented, total, key): public symbols with a doc; the sort key is (documented + 1) / (total + 2)."""
    out = symbols.groupBy("file").agg(F.sum(F.col("documented").cast("long")).alias("documented"), F.count("*").alias("total"))
    return out.withColumn("key", F.round((F.col("documented") + 1) / (F.col("total") + 2), 9))


def above(rows: DataFrame, key: str, value: str, limit: float, rule: str) -> DataFrame:
    """(rule, key, value): a native rule's findings, values of more than its limit."""
    return rows.where(F.col(value) > limit).select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value"))


def keep_latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last state of each key of a log, by partial maxima."""
    return log.groupBy(key).agg(F.max_by(F.struct(*log.columns), order).alias("r")).select("r.*")


def outdated(installed: DataFrame, latest: DataFrame) -> DataFrame:
    """(name, version, newest): installed packages that are not the latest; an unknown latest counts as outdated."""
    return installed.join(latest.withColumnRenamed("version", "newest"), "name", "left").where(~F.col("version").eqNullSafe(F.col("newest"))).select("name", "version", "newest")


def debt(metrics: DataFrame) -> DataFrame:
    """(repo, score): churn, complexity and coupling, each over its maximum as 0 to 100, weighed 0.4, 0.4 and 0.2."""
    top = metrics.agg(*[F.max(c).alias(f"max_{c}") for c in ("churn", "complexity", "coupling")])
    share = lambda c: F.when(F.col(f"max_{c}") > 0, 100 * F.col(c) / F.col(f"max_{c}")).otherwise(0.0)
    return metrics.join(F.broadcast(top), F.lit(True)).select("repo", F.round(0.4 * share("churn") + 0.4 * share("complexity") + 0.2 * share("coupling"), 1).alias("score"))
