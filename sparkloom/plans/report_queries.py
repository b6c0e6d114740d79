"""Report queries: health, audits, diffs, trees, searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.datalog import diagnostics
from sparkloom.functions import health
from sparkloom.operators import audits, graph, history, index, messages, stores, text
from sparkloom.plans import index_queries, logs, rule_queries  # noqa: F401 - the queries these reports are made of
from sparkloom.plans.fact_tables import sql, table
from sparkloom.plans.graphs import _DEPTH, _E, _starts
from sparkloom.plans.registry import ORACLES, QUERIES, part_edges, query, touches
from sparkloom.plans.similar_and_streams import _CLUSTERS, _SHINGLES, _pairs
from sparkloom.runtime import Scratch, load

_MEASURES = "m AS (SELECT p_brand AS module, avg(p_size) / 3 AS complexity, avg(CASE WHEN p_size > 48 THEN 1.0 ELSE 0.0 END) AS risk, CAST(count(*) FILTER (WHERE p_partkey % 97 = 0) AS INT) AS massive, CAST(count(*) FILTER (WHERE p_partkey % 31 = 0) AS INT) AS very_large, avg(CASE WHEN p_type = 'PROMO' THEN 1.0 ELSE 0.0 END) AS tests, avg(CASE WHEN p_size % 3 = 0 THEN 1.0 ELSE 0.0 END) AS ceremony, CAST(count(DISTINCT p_type) AS INT) AS duplicates, count(DISTINCT p_name) / count(*) AS uniq FROM part GROUP BY 1)"


@query(f"""
WITH {_MEASURES}, s AS (SELECT module, CASE WHEN complexity <= 3 THEN 1.0 WHEN complexity <= 5 THEN 0.9 WHEN complexity <= 7 THEN 0.8 WHEN complexity <= 10 THEN 0.7 WHEN complexity <= 15 THEN 0.5 ELSE 0.3 END AS complexity_score,
CASE WHEN risk <= 0.01 THEN 1.0 WHEN risk <= 0.02 THEN 0.9 WHEN risk <= 0.03 THEN 0.8 WHEN risk <= 0.05 THEN 0.7 WHEN risk <= 0.1 THEN 0.5 ELSE 0.3 END AS risk_score,
CASE WHEN massive > 0 THEN greatest(0.3, 0.5 - massive * 0.1) WHEN very_large > 5 THEN 0.5 WHEN very_large > 0 THEN 0.7 ELSE 1.0 END AS file_size_score,
CASE WHEN tests >= 0.3 THEN 1.0 WHEN tests >= 0.2 THEN 0.9 WHEN tests >= 0.1 THEN 0.7 WHEN tests >= 0.05 THEN 0.5 ELSE 0.3 END AS tests_score,
CASE WHEN ceremony <= 0.2 THEN 1.0 WHEN ceremony <= 0.3 THEN 0.9 WHEN ceremony <= 0.4 THEN 0.8 WHEN ceremony <= 0.5 THEN 0.7 WHEN ceremony <= 0.6 THEN 0.5 ELSE 0.3 END AS ceremony_score,
1 / (1 + duplicates / 10.0) AS duplicates_score, CASE WHEN uniq >= 0.95 THEN 1.0 WHEN uniq >= 0.9 THEN 0.9 WHEN uniq >= 0.8 THEN 0.7 WHEN uniq >= 0.7 THEN 0.5 ELSE 0.3 END AS uniqueness_score FROM m),
t AS (SELECT *, complexity_score * 0.15 + risk_score * 0.15 + file_size_score * 0.2 + tests_score * 0.2 + ceremony_score * 0.05 + duplicates_score * 0.15 + uniqueness_score * 0.1 AS total FROM s)
SELECT module, complexity_score, risk_score, file_size_score, tests_score, ceremony_score, round(duplicates_score, 9) AS duplicates_score, uniqueness_score, round(total, 9) AS total, CASE WHEN round(total, 9) >= 0.9 THEN 'A' WHEN round(total, 9) >= 0.8 THEN 'B' WHEN round(total, 9) >= 0.7 THEN 'C' WHEN round(total, 9) >= 0.6 THEN 'D' ELSE 'F' END AS grade FROM t
""")
def health_score(spark, d):
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    n = lambda c: F.sum(c.cast("int"))
    m = load(spark, d, "part").groupBy(F.col("p_brand").alias("module")).agg(
        (F.avg("p_size") / 3).alias("complexity"), share(F.col("p_size") > 48).alias("risk"), n(F.col("p_partkey") % 97 == 0).alias("massive"), n(F.col("p_partkey") % 31 == 0).alias("very_large"), share(F.col("p_type") == "PROMO").alias("tests"),
        share(F.col("p_size") % 3 == 0).alias("ceremony"), F.countDistinct("p_type").alias("duplicates"), (F.countDistinct("p_name") / F.count("*")).alias("unique"))
    return audits.health_report(m, "module")


@query("WITH s AS (SELECT p_brand AS module, round(sum(p_size / 50 * (p_partkey % 4 + 1)) / sum(p_partkey % 4 + 1), 9) AS score FROM part GROUP BY 1) SELECT module, score, CASE WHEN score >= 0.9 THEN 'A' WHEN score >= 0.8 THEN 'B' WHEN score >= 0.7 THEN 'C' WHEN score >= 0.6 THEN 'D' ELSE 'F' END AS grade FROM s")
def weighted_grade(spark, d):
    return audits.weighted_grade(load(spark, d, "part").select(F.col("p_brand").alias("module"), (F.col("p_size") / 50).alias("score"), (F.col("p_partkey") % 4 + 1).alias("weight")), "module")


_VERSIONS = "v AS (SELECT p_brand AS file, p_name AS name, CASE WHEN p_size % 3 = 0 THEN 'class' ELSE 'function' END AS kind, max(p_type) AS signature, max(p_size) AS lines, p_partkey % 2 AS v FROM part GROUP BY 1, 2, 3, 6)"


@query(f"""
WITH {_VERSIONS}, j AS (SELECT file, name, kind, b.signature AS s1, a.signature AS s2, b.lines AS n1, a.lines AS n2 FROM (SELECT * FROM v WHERE v = 0) b FULL JOIN (SELECT * FROM v WHERE v = 1) a USING (file, name, kind))
SELECT file, name, kind, CASE WHEN n1 IS NULL THEN 'added' WHEN n2 IS NULL THEN 'removed' WHEN s1 IS DISTINCT FROM s2 THEN 'signature' ELSE 'body' END AS change FROM j WHERE n1 IS NULL OR n2 IS NULL OR s1 IS DISTINCT FROM s2 OR (abs(n2 - n1) > 0.2 * n1 AND abs(n2 - n1) > 2)
""")
def symbol_diff(spark, d):
    v = load(spark, d, "part").groupBy(F.col("p_brand").alias("file"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 3 == 0, "class").otherwise("function").alias("kind"), (F.col("p_partkey") % 2).alias("v")).agg(F.max("p_type").alias("signature"), F.max("p_size").alias("lines"))
    return audits.symbol_diff(v.where("v = 0"), v.where("v = 1"))


@query("""
WITH t AS (SELECT DISTINCT l_orderkey AS b, l_partkey AS i FROM lineitem), s AS (SELECT b FROM t GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50), p AS (SELECT x.i AS a, y.i AS b, count(*) AS shared FROM t x JOIN t y ON x.b = y.b AND x.i <> y.i WHERE x.b IN (SELECT b FROM s) GROUP BY 1, 2 HAVING count(*) >= 3),
l AS (SELECT l_partkey AS path, max(l_orderkey) AS m FROM lineitem GROUP BY 1)
SELECT p.a AS doc, p.b AS code, shared, c.m - d.m AS lag FROM p JOIN l d ON d.path = p.a AND p.a % 5 = 0 JOIN l c ON c.path = p.b AND p.b % 5 <> 0 WHERE c.m > d.m
""")
def stale_documents(spark, d):
    t = touches(spark, d)
    return audits.stale_docs(history.cochange_pairs(t), t.select(F.col("item").alias("path"), F.col("basket").alias("at")), F.col("path") % 5 == 0)


@query("SELECT 'd' || p_partkey AS file, p_size AS line, 'n' || p_size AS name FROM part WHERE 'n' || p_size NOT IN (SELECT 'n' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)")
def broken_references(spark, d):
    docs = load(spark, d, "part").selectExpr("'d' || cast(p_partkey as string) AS file", "p_size AS line", "'see `n' || cast(p_size as string) || '()` and ' || p_name AS text")
    return audits.broken_references(docs, load(spark, d, "supplier").where("s_suppkey % 2 = 0").selectExpr("'n' || cast(s_suppkey as string) AS name"))


@query("SELECT 'd' || p_partkey AS file, p_size AS line, 'ex' || p_size AS name FROM part WHERE p_size NOT IN (SELECT n_nationkey FROM nation)")
def missing_examples(spark, d):
    docs = load(spark, d, "part").selectExpr("'d' || cast(p_partkey as string) AS file", "p_size AS line", "'{{example: ex' || cast(p_size as string) || '}}' AS text")
    return audits.broken_references(docs, load(spark, d, "nation").selectExpr("'ex' || cast(n_nationkey as string) AS name"), r"\{\{example:\s*([\w-]+)\}\}")


@query(sql("symbols", "SELECT 'warning' AS severity, 'high-complexity' AS rule, file, CAST(start_line AS INT) AS line, name || ' ' || complexity AS message FROM symbols WHERE kind <> 'class' AND complexity > 20"))
def high_complexity(spark, d):
    s = table(spark, d, "symbols").where("kind <> 'class' and complexity > 20")
    return audits.to_diagnostics(s, "high-complexity", message=F.concat_ws(" ", "name", F.col("complexity").cast("string")), line=F.col("start_line"))


def unified_report(spark, d):
    """Rules over facts, native checks and broken references in one report."""
    rules = QUERIES["rules_report"](spark, d)
    broken = audits.to_diagnostics(QUERIES["broken_references"](spark, d), "check-refs", message=F.col("name"), line=F.col("line"))
    return audits.unified(rules, QUERIES["high_complexity"](spark, d), broken)


QUERIES["unified_report"] = unified_report
ORACLES["unified_report"] = f"SELECT * FROM ({ORACLES['rules_report']}) UNION SELECT * FROM ({ORACLES['high_complexity']}) UNION SELECT 'warning', 'check-refs', file, line, name FROM ({ORACLES['broken_references']})"


def top_concerns(spark, d):
    """The rules that report most."""
    return audits.concerns(QUERIES["unified_report"](spark, d))


QUERIES["top_concerns"] = top_concerns
ORACLES["top_concerns"] = f"SELECT rule, severity, count(*) AS n FROM ({ORACLES['unified_report']}) GROUP BY 1, 2 ORDER BY n DESC, rule LIMIT 5"


def sorted_diagnostics(spark, d):
    """The report in its order, the first hundred."""
    return diagnostics.sort(QUERIES["unified_report"](spark, d)).limit(100)


QUERIES["sorted_diagnostics"] = sorted_diagnostics
ORACLES["sorted_diagnostics"] = f"SELECT * FROM ({ORACLES['unified_report']}) ORDER BY file, line, rule, message LIMIT 100"


@query(sql("files commit_files", ", x AS (SELECT 'Brand#' || CAST(path % 27 AS VARCHAR) || '/small.py' AS path FROM commit_files GROUP BY 1) SELECT count(x.path) AS files, count(*) FILTER (WHERE f.path IS NOT NULL AND x.path IS NOT NULL) AS indexed, count(*) FILTER (WHERE f.path IS NULL) AS unindexed, count(*) FILTER (WHERE x.path IS NULL) AS gone FROM files f FULL JOIN x USING (path)"))
def health_snapshot(spark, d):
    found = table(spark, d, "commit_files").select(F.concat(F.lit("Brand#"), (F.col("path") % 27).cast("string"), F.lit("/small.py")).alias("path")).distinct()
    return audits.unindexed(table(spark, d, "files"), found)


@query(sql("files commit_files", ", x AS (SELECT 'Brand#' || CAST(path % 25 AS VARCHAR) || '/economy.py' AS path, max(id) AS mtime FROM commit_files GROUP BY 1) SELECT count(*) > 0 AS stale FROM files f FULL JOIN x USING (path) WHERE f.mtime IS DISTINCT FROM x.mtime"))
def needs_refresh(spark, d):
    return QUERIES["changed_files"](spark, d).agg((F.count("*") > 0).alias("stale"))


@query(sql("files", ", m AS (SELECT DISTINCT 'small' AS module FROM files UNION SELECT 'Brand#3.large' UNION SELECT 'none') SELECT module, path FROM m JOIN files ON path LIKE '%/' || replace(module, '.', '/') || '.py' OR path = replace(module, '.', '/') || '.py'"))
def module_files(spark, d):
    return audits.module_files(table(spark, d, "files"), spark.createDataFrame([("small",), ("Brand#3.large",), ("none",)], "module string"))


@query(sql("files", ", i AS (SELECT path AS file, CASE WHEN lines % 3 = 0 THEN 'large' WHEN lines % 3 = 1 THEN 'Brand#7.small' ELSE 'nowhere' END AS module FROM files), o AS (SELECT file, module, path, split_part(file, '/', 1) = split_part(path, '/', 1) AS near FROM i JOIN files ON path LIKE '%/' || replace(module, '.', '/') || '.py' OR path = replace(module, '.', '/') || '.py'), r AS (SELECT *, row_number() OVER (PARTITION BY file, module ORDER BY near DESC, path) AS k FROM o) SELECT i.file, i.module, r.path AS resolved_file FROM i LEFT JOIN r ON r.file = i.file AND r.module = i.module AND k = 1"))
def resolve_imports(spark, d):
    f = table(spark, d, "files")
    return audits.resolve_imports(f.select(F.col("path").alias("file"), F.when(F.col("lines") % 3 == 0, "large").when(F.col("lines") % 3 == 1, "Brand#7.small").otherwise("nowhere").alias("module")), f)


@query(sql("symbols", "SELECT file, name, kind, start_line FROM symbols WHERE kind = 'class'"))
def types_only(spark, d):
    return table(spark, d, "symbols").where("kind = 'class'").select("file", "name", "kind", "start_line")


@query(sql("symbols attributes", "SELECT file, name, start_line FROM symbols s WHERE file NOT LIKE '%\\_test.py' ESCAPE '\\' AND NOT EXISTS (SELECT 1 FROM attributes a WHERE a.file = s.file AND a.name = s.name AND attribute = '#[test]')"))
def without_tests(spark, d):
    tests = table(spark, d, "attributes").where("attribute = '#[test]'")
    return table(spark, d, "symbols").where(~index.is_test_path(F.col("file"))).join(tests, ["file", "name"], "left_anti").select("file", "name", "start_line")


@query(sql("symbols", "SELECT file, name, kind, start_line FROM symbols WHERE contains(lower(name), 'widget') ORDER BY lower(name) <> 'widget', NOT (coalesce(lower(parent), '') = 't1' OR contains(lower(file), 't1')), NOT starts_with(lower(name), 'widget'), length(name), name, file, start_line LIMIT 10"))
def search_hinted(spark, d):
    return audits.search_hinted(table(spark, d, "symbols"), "T1.widget")


@query(sql("calls", "SELECT DISTINCT 'caller' AS side, caller_symbol AS symbol, caller_file AS file, line FROM calls WHERE callee_name = 'hot_gear' UNION SELECT 'callee', callee_name, caller_file, line FROM calls WHERE caller_symbol = 'hot_gear'"))
def call_neighbours(spark, d):
    return audits.call_neighbours(table(spark, d, "calls"), "hot_gear")


@query(f"WITH RECURSIVE {_E}, p(root, node, depth, path) AS (SELECT DISTINCT src, src, 0, [src] FROM e WHERE src % 100 = 0 UNION ALL SELECT root, dst, depth + 1, list_append(path, dst) FROM p JOIN e ON node = src WHERE depth < 3 AND NOT list_contains(path, dst)) SELECT root, node, depth, array_to_string(path, '>') AS path FROM p WHERE depth > 0")
def dependency_tree(spark, d):
    e = part_edges(spark, d)
    return audits.dependency_tree(e, Scratch(spark, "tree"), _starts(e), 3)


_PAIRS = "t AS (SELECT DISTINCT l_orderkey AS b, l_partkey AS i FROM lineitem), s AS (SELECT b FROM t GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50)"


@query(f"WITH {_PAIRS} SELECT x.i AS a, y.i AS b, count(*) AS shared FROM t x JOIN t y ON x.b = y.b AND x.i < y.i WHERE x.b IN (SELECT b FROM s) GROUP BY 1, 2")
def cochange_merged(spark, d):
    t = touches(spark, d)
    part = lambda k: history.cochange_pairs(t.where(F.col("basket") % 2 == k), min_count=1)
    return audits.merge_cochange(part(0), part(1))


@query(f"""
WITH RECURSIVE {_E}, {_DEPTH}, cd AS (SELECT node, depth FROM dm WHERE node IN (SELECT component FROM sc)), w(node, depth, path) AS (SELECT node, 0, CAST(node AS VARCHAR) FROM cd WHERE depth = 0 UNION
SELECT c.node, c.depth, min(w.path || '>' || CAST(c.node AS VARCHAR)) FROM w JOIN fo ON src = w.node JOIN cd c ON c.node = dst AND c.depth = w.depth + 1 GROUP BY 1, 2) SELECT node, depth, path FROM w
""")
def longest_paths(spark, d):
    return audits.longest_paths(part_edges(spark, d), Scratch(spark, "longest"))


@query(f"WITH RECURSIVE {_SHINGLES}, {_CLUSTERS}, m AS (SELECT cluster, count(*) AS members FROM ct GROUP BY 1), s AS (SELECT cluster, sum(similarity) AS s FROM pr JOIN ct ON a = node GROUP BY 1) SELECT cluster, members, round(s / (members * (members - 1) / 2), 6) AS similarity FROM m JOIN s USING (cluster)")
def fuzzy_groups(spark, d):
    scratch = Scratch(spark, "fuzzy")
    return audits.fuzzy_groups(_pairs(spark, d, scratch), scratch)


_NODE = "CASE l_linenumber WHEN 1 THEN 'If' WHEN 2 THEN 'Call' WHEN 3 THEN 'Return' WHEN 4 THEN 'For' WHEN 5 THEN 'Assign' ELSE 'Name' END"


@query(f"""
WITH n AS (SELECT l_partkey AS f, CASE l_linenumber WHEN 1 THEN 'branch' WHEN 2 THEN 'call' WHEN 3 THEN 'exit' WHEN 4 THEN 'loop' WHEN 5 THEN 'data' ELSE 'other' END AS c, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY n DESC, c) AS r FROM n)
SELECT f, string_agg(c, '+' ORDER BY r) AS label FROM r WHERE r <= 2 GROUP BY 1
""")
def pattern_labels(spark, d):
    return audits.labels(load(spark, d, "lineitem").selectExpr("l_partkey AS f", f"{_NODE} AS kind"), "f", "kind")


@query("SELECT p_partkey AS id, p_size <= 3 AS minor FROM part WHERE p_size > 0")
def minor_functions(spark, d):
    p = load(spark, d, "part").where("p_size > 0").select(F.col("p_partkey").alias("id"), F.concat(F.lit("get_"), F.translate("p_name", " ", "_")).alias("name"), F.col("p_size").alias("lines"))
    return p.select("id", health.minor(F.col("name"), F.col("lines")).alias("minor"))


@query("SELECT p_partkey AS id FROM part WHERE p_type = 'SMALL' AND p_brand <> 'Brand#1' AND regexp_matches(p_name, '^r') AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')")
def captures(spark, d):
    c = F.create_map(F.lit("t"), F.col("p_type"), F.lit("b"), F.col("p_brand"), F.lit("n"), F.col("p_name"))
    tests = [("eq?", "t", "SMALL"), ("not-eq?", "b", "Brand#1"), ("match?", "n", "^r"), ("any-of?", "b", "Brand#1", "Brand#2", "Brand#3"), ("unknown?", "b", "x"), ("eq?", "b")]
    return load(spark, d, "part").where(health.captures_hold(c, tests)).select(F.col("p_partkey").alias("id"))


_COS = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(x.embedding AS DOUBLE[]))"


@query(f"SELECT x.vec_id, round({_COS} * (1 - 0.3 * least(1.0, (x.vec_id % 80) / 50)), 6) AS score FROM embeddings q, embeddings x WHERE q.vec_id = 0 AND x.label = 1 ORDER BY score DESC, x.vec_id LIMIT 15")
def context_search(spark, d):
    e = load(spark, d, "embeddings")
    one = F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("q")))  # one row
    hits = e.where("label = 1").join(one, F.lit(True))
    return text.rerank(hits, text.cosine(F.col("q"), F.col("embedding")), F.least(F.lit(1.0), F.col("vec_id") % 80 / 50), 15, "vec_id").select("vec_id", "score")


@query(sql("commit_files commits", ", t AS (SELECT path % 12 AS repo, author, count(*) AS n FROM commit_files JOIN commits USING (id) GROUP BY 1, 2), r AS (SELECT repo, sum(n) OVER (PARTITION BY repo ORDER BY n DESC, author ROWS UNBOUNDED PRECEDING) AS s, sum(n) OVER (PARTITION BY repo) AS t, row_number() OVER (PARTITION BY repo ORDER BY n DESC, author) AS k FROM t) SELECT repo, CAST(min(k) AS BIGINT) AS bus_factor FROM r WHERE s > floor(t / 2) GROUP BY 1"))
def repo_bus_factor(spark, d):
    n = table(spark, d, "commit_files").join(table(spark, d, "commits"), "id").groupBy((F.col("path") % 12).alias("path"), "author").agg(F.count("*").alias("n"))
    return history.ownership(n).select(F.col("path").alias("repo"), F.col("bus_factor").cast("long").alias("bus_factor"))


@query(sql("commit_files", ", f AS (SELECT path, count(DISTINCT id) AS commits, sum(added + removed) AS churn FROM commit_files GROUP BY 1) SELECT path, commits, CAST(churn AS BIGINT) AS churn, round(commits * sqrt(churn), 6) AS score FROM f ORDER BY score DESC, path LIMIT 20"))
def top_hotspots(spark, d):
    f = table(spark, d, "commit_files").select("path", F.col("id").alias("commit"), (F.col("added") + F.col("removed")).alias("churn"))
    return history.hotspots(f).orderBy(F.desc("score"), "path").limit(20)


@query(sql("commits", "SELECT author, count(DISTINCT floor(epoch(at) / 604800)) AS windows FROM commits GROUP BY 1".replace("epoch(at)", 'epoch("at")')).replace("o_orderdate AS at,", 'o_orderdate AS "at",'))
def active_windows(spark, d):
    c = table(spark, d, "commits")
    return c.groupBy("author").agg(F.countDistinct(F.floor(F.unix_timestamp("at") / 604800)).alias("windows"))


@query(sql("symbols", "SELECT kind, visibility, count(*) AS symbols, count(DISTINCT file) AS files, CAST(sum(end_line - start_line) AS BIGINT) AS lines FROM symbols GROUP BY 1, 2"))
def index_stats(spark, d):
    return table(spark, d, "symbols").groupBy("kind", "visibility").agg(F.count("*").alias("symbols"), F.countDistinct("file").alias("files"), F.sum(F.col("end_line") - F.col("start_line")).alias("lines"))


@query("WITH p AS (SELECT p_brand AS file, p_name AS name, max(p_size) FILTER (WHERE p_partkey % 2 = 0) AS was, max(p_size) FILTER (WHERE p_partkey % 2 = 1) AS now FROM part GROUP BY 1, 2) SELECT file, CAST(sum(greatest(coalesce(now, 0) - coalesce(was, 0), 0)) AS BIGINT) AS added, CAST(sum(greatest(coalesce(was, 0) - coalesce(now, 0), 0)) AS BIGINT) AS removed FROM p GROUP BY 1 HAVING sum(abs(coalesce(now, 0) - coalesce(was, 0))) > 0")
def length_diff(spark, d):
    n = lambda v: load(spark, d, "part").where(F.col("p_partkey") % 2 == v).groupBy(F.col("p_brand").alias("file"), F.col("p_name").alias("name")).agg(F.max("p_size").alias("n"))
    return stores.diff_values(n(0), n(1), "file", "name", "n")


@query("""
WITH m AS (SELECT o_custkey % 10 AS k, o_orderkey AS s, o_totalprice AS price, CAST(o_custkey AS DOUBLE) AS customers FROM orders), u AS (SELECT k || '.price' AS metric, s, price AS v FROM m UNION ALL SELECT k || '.customers', s, customers FROM m), x AS (SELECT metric, arg_min(v, s) AS first, arg_max(v, s) AS last FROM u GROUP BY 1)
SELECT metric, first, last, round(last - first, 6) AS delta, CASE WHEN abs(first) >= 1e-9 THEN round(100 * (last - first) / abs(first), 6) END AS delta_pct FROM x WHERE abs(first) >= 1e-9
""")
def multi_metric_trends(spark, d):
    m = load(spark, d, "orders").select((F.col("o_custkey") % 10).alias("k"), F.col("o_orderkey").alias("at"), F.col("o_totalprice").alias("price"), F.col("o_custkey").cast("double").alias("customers"))
    long_ = m.unpivot(["k", "at"], ["price", "customers"], "name", "value").withColumn("metric", F.concat_ws(".", F.col("k").cast("string"), "name"))
    return messages.trend(long_.select("metric", "at", "value"), "metric").where("abs(first) >= 1e-9")


@query(sql("cfg_edges", "SELECT file, func, count(DISTINCT from_block) AS blocks, count(*) FILTER (WHERE kind = 'exception') AS throwing FROM cfg_edges GROUP BY 1, 2"))
def flow_report(spark, d):
    return table(spark, d, "cfg_edges").groupBy("file", "func").agg(F.countDistinct("from_block").alias("blocks"), F.sum((F.col("kind") == "exception").cast("long")).alias("throwing"))


def liveness_report(spark, d):
    """Live names by function and block."""
    return QUERIES["dl_liveness_live_out"](spark, d).groupBy("c0", "c1", "c3").agg(F.array_join(F.array_sort(F.collect_set("c4")), ",").alias("names"))


QUERIES["liveness_report"] = liveness_report
ORACLES["liveness_report"] = f"SELECT c0, c1, c3, string_agg(c4, ',' ORDER BY c4) AS names FROM ({ORACLES['dl_liveness_live_out']}) GROUP BY 1, 2, 3"


def untested_paths(spark, d):
    """Of what reaches each query node, the shortest ways from nodes that are no tests."""
    scratch = Scratch(spark, "untested")
    back = graph.cleaned(part_edges(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst")), scratch)
    tests = load(spark, d, "part").where("p_size % 5 = 0").select(F.col("p_partkey").alias("node"))
    return graph.shortest_paths(back, scratch, _starts(back), max_depth=0, without=tests).select("node", "start", "depth", "path")


QUERIES["untested_paths"] = untested_paths
ORACLES["untested_paths"] = f"""
WITH RECURSIVE {_E}, l(start, node, depth, path) USING KEY (start, node) AS (SELECT DISTINCT dst, dst, 0, CAST(dst AS VARCHAR) FROM e WHERE dst % 100 = 0 UNION
SELECT l.start, e.src, min(l.depth) + 1, min(l.path || '>' || CAST(e.src AS VARCHAR)) FROM l JOIN e ON l.node = e.dst LEFT JOIN recurring.l x ON x.start = l.start AND x.node = e.src WHERE x.start IS NULL GROUP BY 1, 2)
SELECT node, start, depth, path FROM l WHERE depth > 0 AND node NOT IN (SELECT p_partkey FROM part WHERE p_size % 5 = 0)"""


@query()
def density(spark, d):
    """(source, gzip, uniqueness): mean compression of texts of 200 bytes or more, and distinct over all words."""
    docs = load(spark, d, "documents").where("octet_length(text) >= 200")
    gzip = docs.groupBy("source").agg(F.round(F.avg(health.gzip_ratio(F.col("text"))), 6).alias("gzip"))
    return gzip.join(QUERIES["token_stats"](spark, d).select("source", "uniqueness"), "source")
