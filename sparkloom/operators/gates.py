"""Ratchets and budgets over metric points (address, metric, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def within(address: Column, prefix: str) -> Column:
    """The address is the prefix or lies below it."""
    return (address == prefix) | address.startswith(prefix + "/")


def aggregates(points: DataFrame, *by: str) -> DataFrame:
    """Mean, median (midpoint), max, min, sum and count of the finite values."""
    v = F.col("value")
    finite = points.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return finite.groupBy(*by).agg(
        F.round(F.avg(v), 6).alias("mean"), F.round(F.median(v), 6).alias("median"), F.round(F.max(v), 6).alias("max"), F.round(F.min(v), 6).alias("min"), F.round(F.sum(v), 4).alias("sum"), F.count("*").alias("n"))


def ratchet(now: DataFrame, baseline: DataFrame, key: str, value: str, tolerance: float = 1e-9, higher_is_worse: bool = True) -> DataFrame:
    """(key, value, baseline, status): regressed, improved, unchanged; new without a baseline, missing without a value."""
    old = baseline.select(key, F.col(value).alias("baseline"))
    worse = F.col(value) - F.col("baseline") if higher_is_worse else F.col("baseline") - F.col(value)
    status = F.when(F.col("baseline").isNull(), "new").when(F.col(value).isNull(), "missing").when(worse > tolerance, "regressed").when(worse < -tolerance, "improved").otherwise("unchanged")
    return now.select(key, value).join(old, key, "full").select(key, value, "baseline", status.alias("status"))


def budget(changes: DataFrame, key: str, limits: dict[str, float]) -> DataFrame:
    """(key, added, removed, total, net, exceeded) from (key, added, removed); limits are max_added, max_removed, max_total, max_net, each strict."""
    out = changes.groupBy(key).agg(F.coalesce(F.sum("added"), F.lit(0)).alias("added"), F.coalesce(F.sum("removed"), F.lit(0)).alias("removed"))
    out = out.withColumn("total", F.col("added") + F.col("removed")).withColumn("net", F.col("added") - F.col("removed"))
    over = [F.when(F.col(name.removeprefix("max_")) > most, F.lit(name)) for name, most in sorted(limits.items())]
    return out.withColumn("exceeded", F.concat_ws(",", *over))


def file_metrics(symbols: DataFrame) -> DataFrame:
    """(address, metric, value) of each file: most complex function, functions, classes, lines of symbols."""
    n = lambda c: F.sum(c.cast("long")).cast("double")
    wide = symbols.groupBy(F.col("file").alias("address")).agg(F.max("complexity").cast("double").alias("complexity"), n(F.col("kind") != "class").alias("functions"), n(F.col("kind") == "class").alias("classes"), F.sum(F.col("end_line") - F.col("start_line")).cast("double").alias("lines"))
    return wide.unpivot("address", ["complexity", "functions", "classes", "lines"], "metric", "value")
