"""Health, native-rule and scalar-function queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from sparkloom.functions import scalar
from sparkloom.operators import reports
from sparkloom.plans.registry import query
from sparkloom.runtime import load


@query("""
WITH t AS (SELECT p_brand AS module, avg(CASE WHEN p_size > 25 THEN 1.0 ELSE 0.0 END) AS test FROM part GROUP BY 1), d AS (SELECT 'Brand#' || CAST(l_suppkey % 30 AS VARCHAR) AS module, avg(l_quantity) / 50 AS density FROM lineitem GROUP BY 1),
u AS (SELECT 'Brand#' || CAST(o_custkey % 28 AS VARCHAR) AS module, count(DISTINCT o_orderpriority || o_orderstatus) / count(*) AS uniq FROM orders GROUP BY 1), c AS (SELECT 'Brand#' || CAST(s_nationkey + 8 AS VARCHAR) AS module, avg(s_suppkey % 10) / 10 AS ceremony FROM supplier GROUP BY 1),
j AS (SELECT module, coalesce(test, 0.0) AS test, coalesce(density, 0.5) AS density, coalesce(uniq, 1.0) AS uniq, coalesce(ceremony, 0.0) AS ceremony FROM t FULL JOIN d USING (module) FULL JOIN u USING (module) FULL JOIN c USING (module))
SELECT module, round(test, 6) AS test, round(density, 6) AS density, round(uniq, 6) AS uniq, round(ceremony, 6) AS ceremony, round((test + density + uniq + (1 - ceremony)) / 4, 6) AS score FROM j
""")
def module_health(spark, d):
    by = lambda x: F.concat(F.lit("Brand#"), x.cast("string")).alias("module")
    t = load(spark, d, "part").groupBy(F.col("p_brand").alias("module")).agg(F.avg(F.when(F.col("p_size") > 25, 1.0).otherwise(0.0)))
    den = load(spark, d, "lineitem").groupBy(by(F.col("l_suppkey") % 30)).agg(F.avg("l_quantity") / 50)
    u = load(spark, d, "orders").groupBy(by(F.col("o_custkey") % 28)).agg(F.countDistinct(F.concat("o_orderpriority", "o_orderstatus")) / F.count("*"))
    c = load(spark, d, "supplier").groupBy(by(F.col("s_nationkey") + 8)).agg(F.avg(F.col("s_suppkey") % 10) / 10)
    out = reports.module_health(t, den, u, c)
    return out.select("module", *[F.round(x, 6).alias(x) for x in ("test", "density", "uniq", "ceremony")], "score")


@query("""
WITH i AS (SELECT DISTINCT x.p_brand || '/' || x.p_type AS f, y.p_brand || '/' || y.p_type AS t FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 7)
SELECT f AS "from", t AS "to", 'Brand#1/* -> Brand#2*/**' AS rule FROM i WHERE regexp_matches(f, '^Brand#1/[^/]*$') AND regexp_matches(t, '^Brand#2[^/]*/.*$')
UNION ALL SELECT f, t, '**/SMALL -> **/LARGE' FROM i WHERE regexp_matches(f, '/SMALL$') AND regexp_matches(t, '/LARGE$')
""")
def boundary_violations(spark, d):
    p = load(spark, d, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type").alias("f"))
    imports = p.join(p.select((F.col("p_partkey") - 7).alias("p_partkey"), F.col("f").alias("to")), "p_partkey").select(F.col("f").alias("from"), "to").distinct()
    return reports.boundary_violations(imports, [("Brand#1/*", "Brand#2*/**"), ("**/SMALL", "**/LARGE")])


@query("""
WITH d AS (SELECT o_custkey AS doc, min(o_orderdate) AS m FROM orders GROUP BY 1), c AS (SELECT o_custkey + 1 AS doc, o_orderkey AS path, o_orderdate AS m FROM orders)
SELECT doc, count(*) AS newer FROM c JOIN d USING (doc) WHERE d.m < c.m GROUP BY doc
""")
def stale_docs(spark, d):
    o = load(spark, d, "orders")
    docs = o.groupBy(F.col("o_custkey").alias("doc")).agg(F.min("o_orderdate").alias("mtime"))
    code = o.select(F.col("o_orderkey").alias("path"), F.col("o_orderdate").alias("mtime"))
    return reports.stale_docs(docs, code, o.select((F.col("o_custkey") + 1).alias("doc"), F.col("o_orderkey").alias("path")))


@query("SELECT p_brand AS file, CAST(sum(CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS documented, count(*) AS total, round((sum(CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END) + 1) / (count(*) + 2), 9) AS key FROM part GROUP BY p_brand")
def doc_coverage(spark, d):
    return reports.doc_coverage(load(spark, d, "part").select(F.col("p_brand").alias("file"), (F.col("p_size") % 2 == 0).alias("documented")))


@query("""
WITH o AS (SELECT l_orderkey AS k, count(DISTINCT l_partkey) AS v FROM lineitem GROUP BY 1), i AS (SELECT l_partkey AS k, count(DISTINCT l_orderkey) AS v FROM lineitem GROUP BY 1)
SELECT 'high-fan-out' AS rule, CAST(k AS VARCHAR) AS key, CAST(v AS DOUBLE) AS value FROM o WHERE v > 8 UNION ALL SELECT 'high-fan-in', CAST(k AS VARCHAR), CAST(v AS DOUBLE) FROM i WHERE v > 40
UNION ALL SELECT 'long-file', CAST(doc_id AS VARCHAR), CAST(n_chars AS DOUBLE) FROM documents WHERE n_chars > 5000 UNION ALL SELECT 'long-function', CAST(p_partkey AS VARCHAR), CAST(p_size AS DOUBLE) FROM part WHERE p_size > 45
""")
def native_rules(spark, d):
    li = load(spark, d, "lineitem")
    parts = [
        reports.above(li.groupBy("l_orderkey").agg(F.countDistinct("l_partkey").alias("v")), "l_orderkey", "v", 8, "high-fan-out"),
        reports.above(li.groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("v")), "l_partkey", "v", 40, "high-fan-in"),
        reports.above(load(spark, d, "documents"), "doc_id", "n_chars", 5000, "long-file"), reports.above(load(spark, d, "part"), "p_partkey", "p_size", 45, "long-function"),
    ]
    return reduce(DataFrame.unionByName, parts)


@query("""
WITH e AS (SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2) SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM e GROUP BY user_id
""")
def log_replay(spark, d):
    return reports.keep_latest(load(spark, d, "events").select("user_id", "event_type", "event_id"), "user_id", "event_id")


@query("""
WITH a AS (SELECT 'p' || CAST(p_partkey % 90 AS VARCHAR) AS name, CAST(max(p_size) AS VARCHAR) AS version FROM part GROUP BY 1), b AS (SELECT 'p' || CAST(l_suppkey % 80 AS VARCHAR) AS name, CAST(CAST(max(l_quantity) AS BIGINT) AS VARCHAR) AS newest FROM lineitem GROUP BY 1)
SELECT name, version, newest FROM a LEFT JOIN b USING (name) WHERE version IS DISTINCT FROM newest
""")
def outdated(spark, d):
    version = lambda x, key, value: x.groupBy(F.concat(F.lit("p"), key.cast("string")).alias("name")).agg(F.max(value).cast("long").cast("string").alias("version"))
    return reports.outdated(version(load(spark, d, "part"), F.col("p_partkey") % 90, "p_size"), version(load(spark, d, "lineitem"), F.col("l_suppkey") % 80, "l_quantity"))


@query("""
WITH m AS (SELECT n_name AS repo, sum(c_acctbal) AS churn, count(*) AS complexity, count(DISTINCT c_mktsegment) AS coupling FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT repo, round(CASE WHEN max(churn) OVER () > 0 THEN 0.4 * (100 * churn / max(churn) OVER ()) ELSE 0 END + 0.4 * (100 * complexity / max(complexity) OVER ()) + 0.2 * (100 * coupling / max(coupling) OVER ()), 1) AS score FROM m
""")
def repo_debt(spark, d):
    c = load(spark, d, "customer").join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return reports.debt(c.groupBy(F.col("n_name").alias("repo")).agg(F.sum("c_acctbal").alias("churn"), F.count("*").alias("complexity"), F.countDistinct("c_mktsegment").alias("coupling")))


@query("SELECT page_id, regexp_replace(regexp_replace(lower(trim(url)), '^[a-z+]+://(?:[^@/]+@)?', ''), '(?:\\.git)?/*$', '') AS address FROM pages")
def url_normalise(spark, d):
    return load(spark, d, "pages").select("page_id", scalar.git_url(F.col("url")).alias("address"))


@query("""
SELECT p_partkey, CASE WHEN p_size <= 5 THEN 'low' WHEN p_size <= 10 THEN 'moderate' WHEN p_size <= 20 THEN 'high' ELSE 'very high' END AS band,
  round(p_size * ln(p_partkey % 50 + 1) * ln(p_size + 1) * CASE WHEN p_type = 'SMALL' THEN 0.1 ELSE 1.0 END, 6) AS risk,
  greatest(0, 100 - (40 * (p_size % 2) + 20 * (p_size % 3) + 10 * (p_size % 5) + 5 * (p_size % 7))) AS security,
  CASE WHEN p_size / 50 >= 0.9 THEN 'A' WHEN p_size / 50 >= 0.8 THEN 'B' WHEN p_size / 50 >= 0.7 THEN 'C' WHEN p_size / 50 >= 0.6 THEN 'D' ELSE 'F' END AS grade FROM part
""")
def scores(spark, d):
    n = F.col("p_size")
    return load(spark, d, "part").select(
        "p_partkey", scalar.band(n, [(5, "low"), (10, "moderate"), (20, "high")], "very high").alias("band"), F.round(scalar.risk(n, F.col("p_partkey") % 50, n, F.col("p_type") == "SMALL"), 6).alias("risk"),
        scalar.security_score(n % 2, n % 3, n % 5, n % 7).alias("security"), scalar.grade(n / 50).alias("grade"),
    )
