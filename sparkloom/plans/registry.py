"""Where queries register themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.runtime import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: DuckDB SQL over views of the same tables.
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle if SQL expresses it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def touches(spark: SparkSession, d: str) -> DataFrame:
    """Baskets and items: orders and their parts, which stand for commits and files."""
    return load(spark, d, "lineitem").select(F.col("l_orderkey").alias("basket"), F.col("l_partkey").alias("item"))


def part_edges(spark: SparkSession, d: str, loops: bool = False) -> DataFrame:
    """The import edges: from the part of each returned line to that of the order's next line. Returned lines stand for imports, others for calls."""
    rows = load(spark, d, "lineitem")
    a = rows.where("l_returnflag = 'R'").select("l_orderkey", (F.col("l_linenumber") + 1).alias("n"), F.col("l_partkey").alias("src"))
    b = rows.select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("dst"))
    return a.join(b, ["l_orderkey", "n"]).where("true" if loops else "src <> dst").select("src", "dst").distinct()


EDGES = (
    "SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 "
    "WHERE a.l_returnflag = 'R' AND a.l_partkey <> b.l_partkey"
)
