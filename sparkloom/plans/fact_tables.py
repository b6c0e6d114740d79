"""The fact tables of a code index, made of every row of the driver tables.

Parts stand for symbols (brand and type are their file), suppliers for imports, orders for calls, customers for
attributes, users' events for control flow. Each table is one SELECT that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.runtime import load


def _file(k: str) -> str:
    return f"'Brand#' || CAST(({k}) % 25 AS STRING) || '/' || CASE ({k}) % 6 WHEN 0 THEN 'economy' WHEN 1 THEN 'small' WHEN 2 THEN 'large' WHEN 3 THEN 'standard' WHEN 4 THEN 'promo' ELSE 'medium' END || CASE WHEN ({k}) % 6 = 4 THEN '_test.py' ELSE '.py' END"


def _name(k: str) -> str:
    return f"CASE ({k}) % 7 WHEN 0 THEN 'small_ring' WHEN 1 THEN 'red_widget' WHEN 2 THEN 'blue_bolt' WHEN 3 THEN 'hot_gear' WHEN 4 THEN 'as1' WHEN 5 THEN 'as2' ELSE 'print' END"


_PATH = "p_brand || '/' || lower(p_type) || CASE WHEN p_type = 'PROMO' THEN '_test.py' ELSE '.py' END"
_USER = "'u' || CAST(user_id % 50 AS STRING) AS file, 'g' || CAST(user_id AS STRING) AS func, CAST(user_id % 90 AS INT) AS func_line"

TABLES = {
    "files": f"SELECT {_PATH} AS path, CAST(0 AS INT) AS is_dir, max(p_partkey) AS mtime, CAST(sum(p_size) AS BIGINT) AS lines FROM part GROUP BY 1",
    "symbols": f"SELECT {_PATH} AS file, replace(p_name, ' ', '_') AS name, CASE WHEN p_size % 4 = 0 THEN 'class' WHEN p_size % 4 = 1 THEN 'method' ELSE 'function' END AS kind, p_partkey % 400 AS start_line, p_partkey % 400 + p_size AS end_line, CASE WHEN p_size % 4 = 1 THEN 'T' || CAST(p_size % 9 AS STRING) END AS parent, CASE WHEN p_size % 3 = 0 THEN 'private' ELSE 'public' END AS visibility, p_size % 10 = 0 AS is_impl, p_size AS complexity FROM part",
    "imports": f"SELECT {_file('s_suppkey')} AS file, 'mod' || CAST(s_nationkey % 7 AS STRING) AS module, CASE WHEN s_suppkey % 5 = 4 THEN '*' ELSE {_name('s_suppkey % 5')} END AS name, CASE WHEN s_suppkey % 4 = 0 THEN 'as' || CAST(s_suppkey % 3 AS STRING) END AS alias, CAST(s_suppkey % 60 AS INT) AS line, CASE WHEN s_suppkey % 5 <> 0 THEN {_file('s_suppkey * 7 + 3')} END AS resolved_file FROM supplier",
    "calls": f"SELECT {_file('o_custkey')} AS caller_file, CASE WHEN o_custkey % 5 = 0 THEN 'test_' || CAST(o_custkey % 9 AS STRING) ELSE {_name('o_custkey')} END AS caller_symbol, {_name('o_orderkey')} AS callee_name, CASE WHEN o_custkey % 3 = 0 THEN 'mod' || CAST(o_custkey % 7 AS STRING) WHEN o_custkey % 11 = 0 THEN 'self' END AS callee_qualifier, CASE WHEN o_custkey % 13 = 0 THEN {_file('o_custkey + 1')} END AS callee_resolved_file, CAST(o_orderkey % 997 AS INT) AS line FROM orders",
    "attributes": f"SELECT {_file('c_custkey')} AS file, {_name('c_custkey')} AS name, CASE c_mktsegment WHEN 'BUILDING' THEN '#[test]' WHEN 'MACHINERY' THEN 'mock' WHEN 'HOUSEHOLD' THEN 'doc:' || c_name ELSE 'inline' END AS attribute FROM customer",
    "implements": f"SELECT {_file('s_suppkey')} AS file, 'T' || CAST(s_suppkey % 9 AS STRING) AS name, 'I' || CAST(s_nationkey % 5 AS STRING) AS interface FROM supplier",
    "type_methods": f"SELECT {_file('s_suppkey')} AS file, 'T' || CAST(s_suppkey % 9 AS STRING) AS type_name, 'm' || CAST(s_nationkey % 6 AS STRING) AS method_name FROM supplier",
    "cfg_edges": f"SELECT {_USER}, CAST(event_id % 12 AS INT) AS from_block, CAST((event_id + 1 + event_id % 3) % 12 AS INT) AS to_block, CASE WHEN event_type = 'error' THEN 'exception' ELSE 'next' END AS kind, CASE WHEN event_type = 'error' THEN 'E' || CAST(event_id % 3 AS STRING) END AS exception_type FROM events",
    "cfg_effects": f"SELECT {_USER}, CAST(event_id % 12 AS INT) AS block, event_type AS kind, CAST(event_id % 90 AS INT) AS line, CASE WHEN event_id % 4 > 0 THEN 'l' || CAST(event_id % 30 AS STRING) END AS label FROM events",
    "commits": "SELECT o_orderkey AS id, CAST(o_custkey % 40 AS STRING) || '@x' AS author, o_orderdate AS at, o_orderpriority || ' ' || o_orderstatus AS message FROM orders",
    "commit_files": "SELECT l_orderkey AS id, l_partkey AS path, CAST(l_quantity AS INT) AS added, CAST(floor(l_quantity * l_discount) AS INT) AS removed FROM lineitem",
    "turns": "SELECT conv_id AS session, turn, role, text, length(text) AS chars FROM conversations",
    "tool_calls": "SELECT user_id AS session, event_id AS pos, CASE event_type WHEN 'view' THEN 'Read' WHEN 'click' THEN 'Grep' WHEN 'purchase' THEN 'Edit' WHEN 'signup' THEN 'Bash' ELSE 'Write' END AS tool, event_id % 37 AS target, event_type = 'error' AS is_error, CAST(floor(value * 10) AS BIGINT) AS tokens, ts FROM events",
}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    body = TABLES[name]
    source = body.split(" FROM ")[1].split()[0]
    return spark.sql(body.replace(f" FROM {source}", f" FROM {{{source}}}"), **{source: load(spark, d, source)})


def ctes(*names: str) -> str:
    """The tables as the start of a WITH clause."""
    return ", ".join(f"{n} AS ({TABLES[n]})" for n in names)


def sql(names: str, body: str, recursive: bool = False) -> str:
    """DuckDB SQL: ``body`` over the named tables; a body may go on with tables of its own."""
    glue = ", " if body.startswith(", ") else " "
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes(*names.split())}{glue}{body.removeprefix(', ')}"
