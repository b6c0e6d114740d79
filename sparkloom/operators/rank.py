"""The uniform rank, statistics and diff pipeline, and sort specifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def sort_spec(spec: str, descending: set[str] = frozenset()) -> list[Column]:
    """Sort columns of a comma list such as ``-score,+name``; without a sign, fields in ``descending`` go down."""
    out = []
    for field in filter(None, map(str.strip, spec.split(","))):
        name = field.lstrip("+-")
        down = field[0] == "-" if field[0] in "+-" else name in descending
        out.append(F.col(name).desc_nulls_last() if down else F.col(name).asc_nulls_last())
    return out


def ranked(df: DataFrame, spec: str, limit: int = 0) -> DataFrame:
    """``df`` in the order of ``spec``, its first ``limit`` rows (0: all); a top-k, not a global sort, where limited."""
    out = df.orderBy(*sort_spec(spec))
    return out.limit(limit) if limit else out


def stats(df: DataFrame, score: str) -> DataFrame:
    """One row (count, avg, max, min) of a score over the whole list; zeros if it is empty."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.agg(F.count(score).alias("n"), F.round(zero(F.avg(score)), 6).alias("avg_score"), zero(F.max(score)).alias("max_score"), zero(F.min(score)).alias("min_score"))


def diff(now: DataFrame, baseline: DataFrame, key: str, score: str) -> DataFrame:
    """(key, score, delta): the change against a baseline; a key that is new counts in full."""
    old = baseline.select(key, F.col(score).alias("__old"))
    return now.join(old, key, "left").select(key, score, F.round(F.col(score) - F.coalesce("__old", F.lit(0.0)), 6).alias("delta"))
