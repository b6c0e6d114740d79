"""The built-in rules over facts made of every row of the driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from sparkloom.datalog import diagnostics
from sparkloom.datalog.engine import evaluate
from sparkloom.datalog.rules import MOCK_MARKS, RULES, TEST_FILE_MARKS, TEST_MARKS
from sparkloom.plans.registry import ORACLES, QUERIES
from sparkloom.runtime import Scratch, load

#: Fact relations as SQL that Spark and DuckDB read alike. Parts are symbols, returned lines imports, orders calls, users functions.
_NAME = "'s' || CAST((p_partkey * 7) % 701 AS STRING)"
_OWN = "'f' || CAST(p_partkey % 12 AS STRING)"
_IMPORT = "'f' || CAST(l_suppkey % 67 AS STRING) AS a, 'f' || CAST(l_partkey * 3 % 400 + 3 AS STRING) AS b, 's' || CAST(l_partkey % 180 AS STRING) AS c"
_FUNC = "'u' || CAST(user_id % 50 AS STRING) AS f, 'g' || CAST(user_id AS STRING) AS u, CAST(user_id % 90 AS INT) AS s"
FACTS = {
    "symbol": f"SELECT DISTINCT {_OWN} AS a, {_NAME} AS b, CASE WHEN p_size % 4 = 0 THEN 'class' WHEN p_size % 4 = 1 THEN 'method' ELSE 'function' END AS c, p_size AS d FROM part",
    "visibility": f"SELECT DISTINCT {_OWN} AS a, {_NAME} AS b, CASE WHEN p_partkey % 3 = 0 THEN 'private' ELSE 'public' END AS c FROM part",
    "parent": f"SELECT DISTINCT {_OWN} AS a, {_NAME} AS b, 's' || CAST((p_partkey % 12 + (p_size % 4) * 12) * 7 % 701 AS STRING) AS c FROM part",
    "import": f"SELECT DISTINCT {_IMPORT} FROM lineitem WHERE l_returnflag = 'R'",
    "resolved_import": f"SELECT DISTINCT {_IMPORT}, '' AS d, CASE WHEN l_linenumber % 2 = 0 THEN 'direct' ELSE 'reexport' END AS e FROM lineitem WHERE l_returnflag = 'R'",
    "reexport": "SELECT DISTINCT 'f' || CAST(l_partkey * 3 % 400 + 3 AS STRING) AS a, 'f' || CAST(l_suppkey % 12 AS STRING) AS b, 's' || CAST(l_partkey % 180 AS STRING) AS c, '' AS d FROM lineitem WHERE l_returnflag = 'N'",
    "call": "SELECT DISTINCT 'f' || CAST(o_custkey % 12 AS STRING) AS a, 's' || CAST((o_custkey % 100) * 7 % 701 AS STRING) AS b, 's' || CAST(o_orderkey % 620 AS STRING) AS c, CAST(o_orderkey % 90 AS INT) AS d FROM orders",
    "symbol_use": "SELECT DISTINCT 'f' || CAST(o_custkey % 12 AS STRING) AS a, 's' || CAST(o_orderkey % 620 AS STRING) AS b, CAST(o_orderkey % 90 AS INT) AS c FROM orders",
    "attribute": "SELECT DISTINCT 'f' || CAST(c_custkey % 9 AS STRING) AS a, 's' || CAST((c_custkey * 7) % 701 AS STRING) AS b, CASE c_mktsegment WHEN 'BUILDING' THEN '@Test' WHEN 'MACHINERY' THEN 'mock' WHEN 'HOUSEHOLD' THEN 'test' ELSE 'inline' END AS c FROM customer",
    "implements": "SELECT DISTINCT 'f' || CAST(s_suppkey % 12 AS STRING) AS a, 's' || CAST((s_suppkey % 48) * 7 % 701 AS STRING) AS b, 't' || CAST(s_suppkey % 7 AS STRING) AS c FROM supplier",
    "type_method": "SELECT DISTINCT 'f' || CAST(s_suppkey % 12 AS STRING) AS a, 't' || CAST(s_suppkey % 15 AS STRING) AS b, 's' || CAST((s_nationkey % 6) * 7 AS STRING) AS c FROM supplier",
    "cfg_edge": f"SELECT DISTINCT {_FUNC}, CAST(event_id % 12 AS INT) AS a, CAST((event_id + 1 + event_id % 3) % 12 AS INT) AS b, CASE WHEN event_type = 'error' THEN 'exception' ELSE 'next' END AS c, CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'E' || CAST(event_id % 3 AS STRING) ELSE '' END AS d FROM events",
    "cfg_block": f"SELECT DISTINCT {_FUNC}, CAST(event_id % 12 AS INT) AS b, CASE WHEN event_id % 12 = 7 THEN 'exit' ELSE 'body' END AS c FROM events",
    "cfg_def": f"SELECT DISTINCT {_FUNC}, CAST(event_id % 12 AS INT) AS b, 'v' || CAST(event_id % 5 AS STRING) AS c FROM events WHERE event_type = 'signup'",
    "cfg_use": f"SELECT DISTINCT {_FUNC}, CAST(event_id % 12 AS INT) AS b, 'v' || CAST(event_id % 5 AS STRING) AS c FROM events WHERE event_type = 'view'",
    "cfg_effect": f"SELECT DISTINCT {_FUNC}, CAST(event_id % 12 AS INT) AS b, CASE event_type WHEN 'purchase' THEN 'acquire' WHEN 'click' THEN 'release' WHEN 'signup' THEN 'await' WHEN 'view' THEN 'yield' ELSE 'defer' END AS c, CAST(event_id % 90 AS INT) AS d, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'l' || CAST(event_id % 30 AS STRING) END AS e FROM events",
}

_API = "SELECT DISTINCT s.c0, s.c1, s.c3 FROM r_symbol s JOIN r_visibility v ON s.c0 = v.c0 AND s.c1 = v.c1 AND v.c2 = 'public' WHERE s.c2 IN ('function', 'method')"
_list = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"

#: The same rules in SQL over views named r_<relation> with columns c0, c1 and so on, by what they give.
_SQL = {
    "circular_deps": "WITH RECURSIVE e AS (SELECT DISTINCT c0, c1 FROM r_import), x(a, b) AS (SELECT c0, c1 FROM e UNION SELECT a, c1 FROM x JOIN e ON b = c0) SELECT DISTINCT p.a, 0, p.a FROM x p JOIN x q ON p.a = q.b AND p.b = q.a WHERE p.a < p.b",
    "bidirectional_deps": "SELECT DISTINCT p.c0, 0, p.c0 FROM r_import p JOIN r_import q ON p.c0 = q.c1 AND p.c1 = q.c0 WHERE p.c0 < p.c1",
    "self_import": "SELECT DISTINCT c0, 0, c0 FROM r_import WHERE c0 = c1",
    "barrel_file": "SELECT DISTINCT c0, 0, c0 FROM r_import WHERE c0 NOT IN (SELECT c0 FROM r_symbol WHERE c2 IN ('function', 'method', 'class'))",
    "orphan_file": "SELECT DISTINCT c0, 0, c0 FROM r_symbol WHERE c0 NOT IN (SELECT c1 FROM r_import)",
    "missing_export": f"SELECT DISTINCT c0, 0, c0 FROM ({_API}) WHERE c0 NOT IN (SELECT c1 FROM r_import)",
    "dead_api": f"SELECT c0, c3, c1 FROM ({_API}) a WHERE NOT EXISTS (SELECT 1 FROM r_call c WHERE c.c2 = a.c1 AND c.c0 <> a.c0)",
    "deep_nesting": "SELECT DISTINCT p.c0, y.c3, p.c1 FROM r_parent p JOIN r_parent q ON p.c0 = q.c0 AND p.c2 = q.c1 JOIN r_parent r ON r.c0 = p.c0 AND q.c2 = r.c1 JOIN r_parent s ON s.c0 = p.c0 AND r.c2 = s.c1 JOIN r_symbol y ON y.c0 = p.c0 AND y.c1 = p.c1",
    "duplicate_symbol": "WITH t AS (SELECT DISTINCT p.c1 AS n, p.c0 AS f, q.c0 AS g FROM r_symbol p JOIN r_symbol q ON p.c1 = q.c1 AND p.c0 < q.c0 WHERE p.c2 = 'function' AND q.c2 = 'function') SELECT s.c0, s.c3, n FROM t JOIN r_symbol s ON s.c1 = n AND s.c0 = f UNION SELECT s.c0, s.c3, n FROM t JOIN r_symbol s ON s.c1 = n AND s.c0 = g",
    "fan_out": "SELECT DISTINCT s.c0, s.c3, s.c1 FROM (SELECT c0, c1 FROM r_call GROUP BY c0, c1 HAVING count(*) > 50) x JOIN r_symbol s ON s.c0 = x.c0 AND s.c1 = x.c1",
    "hub_file": "SELECT '', 0, i.c1 FROM r_import i GROUP BY i.c1 HAVING count(*) > 30",
    "god_file": "SELECT c0, 0, c0 FROM r_symbol s WHERE c2 = 'function' GROUP BY c0 HAVING count(DISTINCT s.c1) > 50",
    "god_class": "WITH m AS (SELECT p.c0, p.c2 AS c FROM (SELECT DISTINCT p.c0, p.c1, p.c2 FROM r_parent p JOIN r_symbol s ON p.c0 = s.c0 AND p.c1 = s.c1 WHERE s.c2 IN ('method', 'function')) p GROUP BY 1, 2 HAVING count(*) > 20) SELECT DISTINCT s.c0, s.c3, c FROM m JOIN r_symbol s ON s.c0 = m.c0 AND s.c1 = c",
    "layering_violation": f"WITH t AS (SELECT c0 FROM r_attribute WHERE c2 IN {_list(TEST_FILE_MARKS)}) SELECT DISTINCT c0, 0, c0 FROM r_import WHERE c0 <> c1 AND c0 IN (SELECT c0 FROM t) AND c1 IN (SELECT c0 FROM t)",
    "missing_test": f"WITH t AS (SELECT a.c1 FROM r_attribute a JOIN r_symbol s ON a.c0 = s.c0 AND a.c1 = s.c1 WHERE a.c2 IN {_list(TEST_MARKS)}) SELECT c0, c3, c1 FROM ({_API}) WHERE c1 NOT IN (SELECT c.c2 FROM r_call c WHERE c.c1 IN (SELECT c1 FROM t))",
    "stale_mock": f"SELECT DISTINCT s.c0, s.c3, s.c1 FROM r_attribute a JOIN r_symbol s ON a.c0 = s.c0 AND a.c1 = s.c1 JOIN r_call c ON c.c0 = s.c0 AND c.c1 = s.c1 WHERE a.c2 IN {_list(MOCK_MARKS)} AND c.c2 NOT IN (SELECT c1 FROM r_symbol)",
    "unused_import": "SELECT DISTINCT c0, 0, c2 FROM r_import i WHERE c2 <> '*' AND NOT EXISTS (SELECT 1 FROM r_call c WHERE c.c0 = i.c0 AND c.c2 = i.c2)",
    "missing_impl": "WITH h AS (SELECT i.c1 AS c, p.c1 AS m FROM r_implements i JOIN r_parent p ON p.c2 = i.c1) SELECT DISTINCT s.c0, s.c3, s.c1 FROM r_implements i JOIN r_type_method m ON i.c2 = m.c1 JOIN r_symbol s ON s.c1 = i.c1 WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.c = i.c1 AND h.m = m.c2)",
    "resolution": (_REF := "WITH x AS (SELECT u.c0 AS f, u.c2 AS l, i.c1 AS t, u.c1 AS n FROM r_symbol_use u JOIN r_resolved_import i ON i.c0 = u.c0 AND i.c2 = u.c1 AND i.c4 = 'direct' UNION SELECT u.c0, u.c2, e.c1, u.c1 FROM r_symbol_use u JOIN r_resolved_import i ON i.c0 = u.c0 AND i.c2 = u.c1 AND i.c4 = 'reexport' JOIN r_reexport e ON e.c0 = i.c1 AND e.c2 = u.c1 UNION SELECT c0, c2, c0, c1 FROM r_symbol_use), y AS (SELECT DISTINCT x.*, s.c2 AS k FROM x JOIN r_symbol s ON s.c0 = x.t AND s.c1 = x.n)") + " SELECT f, l, t, n, k FROM y",
    "resolution_target": _REF + " SELECT DISTINCT c.c0, c.c1, t, n, l FROM r_call c JOIN y ON y.f = c.c0 AND y.l = c.c3 AND y.n = c.c2",
    "liveness": (_LIVE := "WITH RECURSIVE x(f, u, s, b, v) AS (SELECT c0, c1, c2, c3, c4 FROM r_cfg_use UNION SELECT e.c0, e.c1, e.c2, e.c3, v FROM x JOIN r_cfg_edge e ON e.c0 = f AND e.c1 = u AND e.c2 = s AND e.c4 = b WHERE EXISTS (SELECT 1 FROM r_cfg_block k WHERE k.c0 = e.c0 AND k.c1 = e.c1 AND k.c2 = e.c2 AND k.c3 = e.c3) AND NOT EXISTS (SELECT 1 FROM r_cfg_def d WHERE d.c0 = e.c0 AND d.c1 = e.c1 AND d.c2 = e.c2 AND d.c3 = e.c3 AND d.c4 = v))") + " SELECT * FROM x",
    "liveness_live_out": _LIVE + " SELECT DISTINCT e.c0, e.c1, e.c2, e.c3, v FROM x JOIN r_cfg_edge e ON e.c0 = f AND e.c1 = u AND e.c2 = s AND e.c4 = b",
    "effects": "SELECT DISTINCT c0, c1, c2 FROM r_cfg_effect WHERE c4 = 'await'",
    "effects_defer_fn": "SELECT DISTINCT c0, c1, c2 FROM r_cfg_effect WHERE c4 = 'defer'",
    "effects_generator": "SELECT DISTINCT c0, c1, c2 FROM r_cfg_effect WHERE c4 = 'yield'",
    "effects_acquire": "SELECT DISTINCT c0, c1, c2, c6 FROM r_cfg_effect WHERE c4 = 'acquire' AND c6 <> ''",
    "effects_leak": "SELECT DISTINCT c0, c1, c2, c6 FROM r_cfg_effect a WHERE c4 = 'acquire' AND c6 <> '' AND NOT EXISTS (SELECT 1 FROM r_cfg_effect r WHERE r.c4 = 'release' AND r.c0 = a.c0 AND r.c1 = a.c1 AND r.c2 = a.c2 AND r.c6 = a.c6)",
    "exception_flow": "SELECT DISTINCT c0, c1, c2, c3, c4, c6 FROM r_cfg_edge WHERE c5 = 'exception' AND c6 <> ''",
    "exception_flow_unhandled": (_THROWN := "SELECT DISTINCT e.c0, e.c1, e.c2, e.c3, e.c6 FROM r_cfg_edge e JOIN r_cfg_block b ON e.c0 = b.c0 AND e.c1 = b.c1 AND e.c2 = b.c2 AND e.c4 = b.c3 AND b.c4 = 'exit' WHERE e.c5 = 'exception'"),
    "exception_flow_throws": f"SELECT DISTINCT c0, c1, c2 FROM ({_THROWN})",
}


def relations(spark, d: str, names: set[str]) -> dict:
    """The named base relations as DataFrames, columns c0, c1 and so on."""
    out = {}
    for name in sorted(names):
        table = FACTS[name].split(" FROM ")[1].split()[0]
        df = spark.sql(FACTS[name].replace(f" FROM {table}", f" FROM {{{table}}}"), **{table: load(spark, d, table)})
        out[name] = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return out


def _views(used: set[str]) -> str:
    columns = lambda n: ", ".join(f"c{i}" for i in range(WIDTHS[n]))
    return ", ".join(f"r_{n}({columns(n)}) AS ({FACTS[n]})" for n in sorted(used))


#: How many terms each relation has.
WIDTHS = {"symbol": 4, "visibility": 3, "parent": 3, "import": 3, "resolved_import": 5, "reexport": 4, "call": 4, "symbol_use": 3, "attribute": 3, "implements": 3, "type_method": 3, "cfg_edge": 7, "cfg_block": 5, "cfg_def": 5, "cfg_use": 5, "cfg_effect": 7}


def used_by(text: str) -> set[str]:
    return {name for name in FACTS if any(f"{c}{name}(" in text for c in " !,;\n(")}


def _oracle(name: str, used: set[str]) -> str:
    sql = _SQL[name]
    for head in ("WITH RECURSIVE ", "WITH "):
        if sql.startswith(head):
            views = f"{head}{_views(used)}, {sql.removeprefix(head)}"
            break
    else:
        views = f"WITH {_views(used)} {sql}"
    return views


def _register(rule: str) -> None:
    program = RULES[rule]
    used = used_by(f" {program.text}")
    for k, give in enumerate(program.gives):
        name = rule if k == 0 else f"{rule}_{give}"

        def run(spark, d, give=give, name=name):
            out = evaluate(program.text, relations(spark, d, used), Scratch(spark, f"dl_{name}"))[give]
            return out.toDF("file", "line", "message") if give == "found" else out

        run.__name__, run.__doc__ = f"dl_{name}", f"The relation {give} of the rule {rule}, over facts of every row."
        run.__module__ = __name__
        QUERIES[f"dl_{name}"] = run
        n = {"found": 3, "reference": 5, "target": 5, "live_in": 5, "live_out": 5, "async_fn": 3, "defer_fn": 3, "generator": 3, "acquire": 4, "leak": 4, "flow": 6, "unhandled": 5, "throws": 3}[give]
        columns = "file, line, message" if give == "found" else ", ".join(f"c{i}" for i in range(n))
        sql = _oracle(name, used)
        body = f"SELECT * FROM ({sql}) AS q({columns})"
        ORACLES[f"dl_{name}"] = body


for _rule in RULES:
    _register(_rule)

_REPORTING = [n for n, r in RULES.items() if r.gives == ("found",)]


def rules_report(spark, d: str) -> DataFrame:
    """The diagnostics of all enabled built-in rules, in one table."""
    chosen = diagnostics.select(RULES)
    used = reduce(set.__or__, [used_by(f" {r.text}") for r in chosen.values()])
    return diagnostics.run_rules(chosen, relations(spark, d, used), Scratch(spark, "rules"))


def rules_strict(spark, d: str) -> DataFrame:
    """The rules tagged testing, enabled or not, with warnings as errors."""
    chosen = diagnostics.select(RULES, tag="quality-gate", enabled_only=False, groups={"quality-gate": ["testing", "correctness"]})
    used = reduce(set.__or__, [used_by(f" {r.text}") for r in chosen.values()])
    found = diagnostics.run_rules(chosen, relations(spark, d, used), Scratch(spark, "strict"))
    return found.withColumn("severity", diagnostics.promoted(found))


def _union(rules: list[str], severity: str) -> str:
    return " UNION ALL ".join(f"SELECT '{severity}' AS severity, '{r.replace('_', '-')}' AS rule, file, line, message FROM ({ORACLES[f'dl_{r}']})" for r in rules)


for _f, _rules, _severity in ((rules_report, [n for n in _REPORTING if RULES[n].enabled], "warning"), (rules_strict, [n for n in _REPORTING if {"testing", "correctness"} & set(RULES[n].tags)], "error")):
    QUERIES[_f.__name__] = _f
    ORACLES[_f.__name__] = _union(_rules, _severity)


def rules_rerun(spark, d: str) -> DataFrame:
    """God files after the files of even number changed: the rest of the report before is kept."""
    rel = relations(spark, d, {"symbol"})
    scratch = Scratch(spark, "rerun")
    cached = scratch.stage(diagnostics.run_rule("god_file", RULES["god_file"], rel, scratch))
    changed = rel["symbol"].select(F.col("c0").alias("file")).where("cast(substring(file, 2) as int) % 2 = 0").distinct()
    return diagnostics.rerun(cached, "god_file", RULES["god_file"], rel, changed, scratch)


QUERIES["rules_rerun"] = rules_rerun
ORACLES["rules_rerun"] = _union(["god_file"], "warning")
