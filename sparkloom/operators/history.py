"""Change-history analytics: co-change, hotspots, ownership, contributors, activity, temporal coupling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkloom.operators.components import connected_components
from sparkloom.runtime import Scratch


def cochange_pairs(touches: DataFrame, min_count: int = 2, max_basket: int = 50) -> DataFrame:
    """Pairs a < b of items that share baskets: (a, b, shared, confidence).

    ``touches`` is (basket, item). Baskets of one item or of more than ``max_basket`` make no pairs (that bound is
    the operator's own and keeps the self-join linear); confidence divides by the larger of the items' counts over
    all baskets.
    """
    rows = touches.where("basket is not null and item is not null").distinct()
    usable = rows.join(rows.groupBy("basket").count().where(F.col("count").between(2, max_basket)).select("basket"), "basket", "left_semi")
    a, b = usable.withColumnRenamed("item", "a"), usable.withColumnRenamed("item", "b")
    pairs = a.join(b, "basket").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= min_count)
    total = rows.groupBy("item").agg(F.count("*").alias("n"))
    out = pairs.join(total.toDF("a", "na"), "a").join(total.toDF("b", "nb"), "b")
    return out.select("a", "b", "shared", F.round(F.col("shared") / F.greatest("na", "nb"), 9).alias("confidence"))


def cap_fanout(pairs: DataFrame, k: int = 20) -> DataFrame:
    """Pairs that are among the ``k`` strongest of either end; ties go to the smaller partner."""
    both = pairs.select("a", "b", "shared", F.col("a").alias("own"), F.col("b").alias("other")).unionByName(pairs.select("a", "b", "shared", F.col("b").alias("own"), F.col("a").alias("other")))
    w = Window.partitionBy("own").orderBy(F.desc("shared"), "other")
    return both.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("a", "b", "shared").distinct()


def clusters(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """Components of a pair table: (cluster, n_items, n_edges, total_shared, cohesion), cluster named by its least item."""
    pairs = scratch.stage(pairs)
    parts = connected_components(pairs, scratch, "a", "b")
    sizes = parts.groupBy(F.col("component").alias("cluster")).agg(F.count("*").alias("n_items"))
    edges = pairs.join(parts, pairs["a"] == parts["node"]).groupBy(F.col("component").alias("cluster")).agg(F.count("*").alias("n_edges"), F.sum("shared").alias("total_shared"))
    return sizes.join(edges, "cluster").withColumn("cohesion", F.round(F.col("n_edges") / (F.col("n_items") * (F.col("n_items") - 1) / 2), 9))


def hotspots(changes: DataFrame, complexity: DataFrame | None = None) -> DataFrame:
    """(path, commits, churn, score) with score commits * sqrt(churn), times log2(1 + complexity) where that is above 0.

    ``changes`` is (path, commit, churn); ``complexity`` (path, cc).
    """
    out = changes.groupBy("path").agg(F.countDistinct("commit").alias("commits"), F.sum("churn").alias("churn"))
    score = F.col("commits") * F.sqrt("churn")
    if complexity is not None:
        out = out.join(complexity, "path", "left")
        score = score * F.when(F.col("cc") > 0, F.log2(1 + F.col("cc"))).otherwise(1.0)
    return out.select("path", "commits", "churn", F.round(score, 6).alias("score"))


def recency_hotspots(changes: DataFrame, age_days: Column, half_life: float = 180.0) -> DataFrame:
    """(path, score): the sum over changes of sqrt(churn) that halves every ``half_life`` days."""
    return changes.withColumn("age", age_days).groupBy("path").agg(F.round(F.sum(F.exp(-F.log(F.lit(2.0)) / half_life * F.col("age")) * F.sqrt("churn")), 6).alias("score"))


def ownership(lines: DataFrame) -> DataFrame:
    """(path, total, authors, top_author, top_pct, bus_factor) from (path, author, n).

    The bus factor is how few authors hold more than half (integer half) of the lines.
    """
    by = lines.groupBy("path", "author").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("path").orderBy(F.desc("n"), "author")
    total = F.sum("n").over(Window.partitionBy("path"))
    ranked = by.withColumn("r", F.row_number().over(w)).withColumn("run", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", total)
    enough = F.min(F.when(F.col("run") > F.floor(F.col("total") / 2), F.col("r")))
    return ranked.groupBy("path").agg(
        F.max("total").alias("total"), F.count("*").alias("authors"), F.max(F.when(F.col("r") == 1, F.col("author"))).alias("top_author"),
        F.round(F.max(F.when(F.col("r") == 1, F.col("n") / F.col("total"))) * 100, 6).alias("top_pct"), enough.cast("long").alias("bus_factor"),
    )


def contributors(commits: DataFrame) -> DataFrame:
    """(author, repos, commits, top_repo) from (repo, author, n); the top repo is that of most commits, then least name."""
    by = commits.groupBy("author", "repo").agg(F.sum("n").alias("n"))
    return by.groupBy("author").agg(F.count("*").alias("repos"), F.sum("n").alias("commits"), F.min(F.struct(-F.col("n"), F.col("repo"))).getField("repo").alias("top_repo"))


def repo_overlap(commits: DataFrame) -> DataFrame:
    """(repo_a, repo_b, shared): authors that two repositories share."""
    one = commits.select("repo", "author").distinct()
    return one.toDF("repo_a", "author").join(one.toDF("repo_b", "author"), "author").where("repo_a < repo_b").groupBy("repo_a", "repo_b").agg(F.count("*").alias("shared"))


def activity(events: DataFrame, start: int, end: int) -> DataFrame:
    """(window, commits, authors, churn) for every window from ``start`` to ``end``, zero-filled; events are (window, commit, author, churn)."""
    spine = events.sparkSession.range(start, end + 1).select(F.col("id").alias("window"))
    got = events.groupBy("window").agg(F.countDistinct("commit").alias("commits"), F.countDistinct("author").alias("authors"), F.sum("churn").alias("churn"))
    return spine.join(got, "window", "left").fillna(0)


def trend(windows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, first_half, second_half, trend): above 1.2 rising, below 0.8 declining; under two windows stable."""
    w = Window.partitionBy(by).orderBy("window")
    half = windows.withColumn("r", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy(by)))
    early = F.col("r") <= F.floor(F.col("n") / 2)
    sums = half.groupBy(by).agg(F.max("n").alias("n"), F.sum(F.when(early, F.col(value)).otherwise(0)).alias("first_half"), F.sum(F.when(~early, F.col(value)).otherwise(0)).alias("second_half"))
    a, b = F.col("first_half"), F.col("second_half")
    name = F.when(F.col("n") < 2, "stable").when(a == 0, F.when(b > 0, "rising").otherwise("stable")).when(b / a > 1.2, "rising").when(b / a < 0.8, "declining").otherwise("stable")
    return sums.select(by, "first_half", "second_half", name.alias("trend"))


def temporal_coupling(active: DataFrame, min_windows: int = 3) -> DataFrame:
    """(repo_a, repo_b, shared, score) from (repo, window): windows in which both are active, over the fewer of either."""
    one = active.distinct()
    n = one.groupBy("repo").agg(F.count("*").alias("n"))
    pairs = one.toDF("repo_a", "window").join(one.toDF("repo_b", "window"), "window").where("repo_a < repo_b").groupBy("repo_a", "repo_b").agg(F.count("*").alias("shared")).where(F.col("shared") >= min_windows)
    out = pairs.join(n.toDF("repo_a", "na"), "repo_a").join(n.toDF("repo_b", "nb"), "repo_b")
    return out.select("repo_a", "repo_b", "shared", F.round(F.col("shared") / F.least("na", "nb"), 9).alias("score"))


def neighbours(pairs: DataFrame, k: int) -> DataFrame:
    """(path, neighbours): the ``k`` items each changes with most, by comma; ties by the least."""
    both = pairs.select(F.col("a").alias("path"), F.col("b").alias("other"), "shared").unionByName(pairs.select(F.col("b").alias("path"), F.col("a").alias("other"), "shared"))
    w = Window.partitionBy("path").orderBy(F.desc("shared"), "other")
    top = both.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return top.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "other"))), lambda x: x["other"].cast("string")), ",").alias("neighbours"))
