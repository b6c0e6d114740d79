"""Change-history, ranking and gate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import gates, history, rank
from sparkloom.plans.registry import query, touches
from sparkloom.runtime import Scratch, load

_PAIRS = """
t AS (SELECT DISTINCT l_orderkey AS basket, l_partkey AS item FROM lineitem),
u AS (SELECT t.* FROM t JOIN (SELECT basket FROM t GROUP BY basket HAVING count(*) BETWEEN 2 AND 50) USING (basket)),
n AS (SELECT item, count(*) AS n FROM t GROUP BY item),
p AS (SELECT x.item AS a, y.item AS b, count(*) AS shared FROM u x JOIN u y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2 HAVING count(*) >= 2)
"""
_CAPPED = """
e AS (SELECT a, b, shared, a AS own, b AS other FROM p UNION ALL SELECT a, b, shared, b, a FROM p),
c AS (SELECT DISTINCT a, b, shared FROM (SELECT *, row_number() OVER (PARTITION BY own ORDER BY shared DESC, other) AS r FROM e) WHERE r <= 20)
"""


@query(f"WITH {_PAIRS} SELECT a, b, shared, round(shared / greatest(x.n, y.n), 9) AS confidence FROM p JOIN n x ON a = x.item JOIN n y ON b = y.item")
def cochange_pairs(spark, d):
    return history.cochange_pairs(touches(spark, d))


@query(f"WITH {_PAIRS}, {_CAPPED} SELECT a, b, shared FROM c")
def cochange_capped(spark, d):
    return history.cap_fanout(history.cochange_pairs(touches(spark, d)))


@query(f"""
WITH RECURSIVE {_PAIRS.replace("HAVING count(*) >= 2)", "HAVING count(*) >= 3)")},
bo AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(a, b) AS (SELECT a, b FROM bo UNION SELECT r.a, bo.b FROM r JOIN bo ON r.b = bo.a),
k AS (SELECT a AS node, least(a, min(b)) AS cluster FROM r GROUP BY a),
s AS (SELECT cluster, count(*) AS n_items FROM k GROUP BY cluster),
g AS (SELECT cluster, count(*) AS n_edges, CAST(sum(shared) AS BIGINT) AS total_shared FROM p JOIN k ON a = node GROUP BY cluster)
SELECT cluster, n_items, n_edges, total_shared, round(n_edges / (n_items * (n_items - 1) / 2), 9) AS cohesion FROM s JOIN g USING (cluster)
""")
def cochange_clusters(spark, d):
    return history.clusters(history.cochange_pairs(touches(spark, d), 3).drop("confidence"), Scratch(spark, "clusters"))


def _changes(spark, d):
    return load(spark, d, "lineitem").select(F.col("l_partkey").alias("path"), F.col("l_orderkey").alias("commit"), F.col("l_quantity").alias("churn"), "l_shipdate")


@query("""
SELECT l_partkey AS path, count(DISTINCT l_orderkey) AS commits, sum(l_quantity) AS churn,
  round(count(DISTINCT l_orderkey) * sqrt(sum(l_quantity)) * CASE WHEN max(p_size) > 0 THEN log2(1 + max(p_size)) ELSE 1.0 END, 6) AS score
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_partkey
""")
def hotspots(spark, d):
    return history.hotspots(_changes(spark, d), load(spark, d, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("cc")))


@query("""
SELECT l_partkey AS path, round(sum(exp(-ln(2.0) / 180 * date_diff('day', CAST(l_shipdate AS DATE), DATE '2000-01-01')) * sqrt(l_quantity)), 6) AS score
FROM lineitem GROUP BY l_partkey
""")
def hotspots_recency(spark, d):
    age = F.datediff(F.lit("2000-01-01").cast("date"), F.to_date("l_shipdate")).cast("double")
    return history.recency_hotspots(_changes(spark, d), age)


@query("""
WITH b AS (SELECT l_partkey AS path, l_suppkey AS author, count(*) AS n FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS r, sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS run, sum(n) OVER (PARTITION BY path) AS total FROM b WINDOW w AS (PARTITION BY path ORDER BY n DESC, author))
SELECT path, CAST(max(total) AS BIGINT) AS total, count(*) AS authors, max(CASE WHEN r = 1 THEN author END) AS top_author,
  round(max(CASE WHEN r = 1 THEN n / total END) * 100, 6) AS top_pct, min(CASE WHEN run > floor(total / 2) THEN r END) AS bus_factor
FROM r GROUP BY path
""")
def ownership_bus_factor(spark, d):
    lines = load(spark, d, "lineitem").select(F.col("l_partkey").alias("path"), F.col("l_suppkey").alias("author"), F.lit(1).alias("n"))
    return history.ownership(lines)


def _commits(spark, d):
    orders = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return orders.join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("repo"), F.pmod("o_custkey", F.lit(97)).alias("author"), "o_orderkey", "o_orderdate")


_COMMITS = "k AS (SELECT n_name AS repo, o_custkey % 97 AS author, o_orderkey, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"


@query(f"""
WITH {_COMMITS}, b AS (SELECT author, repo, count(*) AS n FROM k GROUP BY 1, 2)
SELECT author, count(*) AS repos, CAST(sum(n) AS BIGINT) AS commits, first(repo ORDER BY n DESC, repo) AS top_repo FROM b GROUP BY author
""")
def contributors(spark, d):
    return history.contributors(_commits(spark, d).withColumn("n", F.lit(1)))


@query(f"""
WITH {_COMMITS}, o AS (SELECT DISTINCT repo, author FROM k)
SELECT x.repo AS repo_a, y.repo AS repo_b, count(*) AS shared FROM o x JOIN o y ON x.author = y.author AND x.repo < y.repo GROUP BY 1, 2
""")
def repo_overlap(spark, d):
    return history.repo_overlap(_commits(spark, d))


def _month(c):
    return F.year(c) * 12 + F.month(c) - 1


@query("""
WITH e AS (SELECT year(o_orderdate) * 12 + month(o_orderdate) - 1 AS w, * FROM orders)
SELECT s.w AS "window", count(DISTINCT o_orderkey) AS commits, count(DISTINCT o_custkey) AS authors, coalesce(round(sum(o_totalprice), 2), 0) AS churn
FROM (SELECT unnest(range(1992 * 12, 1999 * 12)) AS w) s LEFT JOIN e USING (w) GROUP BY s.w
""")
def activity_windows(spark, d):
    o = load(spark, d, "orders").select(_month("o_orderdate").alias("window"), F.col("o_orderkey").alias("commit"), F.col("o_custkey").alias("author"), F.col("o_totalprice").alias("churn"))
    return history.activity(o, 1992 * 12, 1999 * 12 - 1).withColumn("churn", F.round("churn", 2))


@query(f"""
WITH {_COMMITS}, w AS (SELECT repo, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS "window", count(*) AS commits FROM k GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY "window") AS r, count(*) OVER (PARTITION BY repo) AS n FROM w),
s AS (SELECT repo, max(n) AS n, CAST(sum(CASE WHEN r <= floor(n / 2) THEN commits ELSE 0 END) AS BIGINT) AS first_half, CAST(sum(CASE WHEN r > floor(n / 2) THEN commits ELSE 0 END) AS BIGINT) AS second_half FROM r GROUP BY repo)
SELECT repo, first_half, second_half, CASE WHEN n < 2 THEN 'stable' WHEN first_half = 0 THEN CASE WHEN second_half > 0 THEN 'rising' ELSE 'stable' END
  WHEN second_half / first_half > 1.2 THEN 'rising' WHEN second_half / first_half < 0.8 THEN 'declining' ELSE 'stable' END AS trend FROM s
""")
def activity_trend(spark, d):
    w = _commits(spark, d).groupBy("repo", _month("o_orderdate").alias("window")).agg(F.count("*").alias("commits"))
    return history.trend(w, "repo", "commits")


@query(f"""
WITH {_COMMITS}, w AS (SELECT DISTINCT repo, CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) AS "window" FROM k), n AS (SELECT repo, count(*) AS n FROM w GROUP BY repo)
SELECT x.repo AS repo_a, y.repo AS repo_b, count(*) AS shared, round(count(*) / least(any_value(nx.n), any_value(ny.n)), 9) AS score
FROM w x JOIN w y ON x."window" = y."window" AND x.repo < y.repo JOIN n nx ON x.repo = nx.repo JOIN n ny ON y.repo = ny.repo GROUP BY 1, 2 HAVING count(*) >= 3
""")
def temporal_coupling(spark, d):
    k = _commits(spark, d).select("repo", F.floor(F.unix_timestamp("o_orderdate") / 86400).alias("window"))
    return history.temporal_coupling(k)


@query("SELECT p_partkey, p_brand, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50")
def rank_pipeline(spark, d):
    return rank.ranked(load(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice"), "-p_retailprice,+p_partkey", 50)


@query("SELECT count(p_retailprice) AS n, round(avg(p_retailprice), 6) AS avg_score, max(p_retailprice) AS max_score, min(p_retailprice) AS min_score FROM part")
def rank_stats(spark, d):
    return rank.stats(load(spark, d, "part"), "p_retailprice")


@query("SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier ORDER BY s_nationkey, s_acctbal DESC, s_suppkey LIMIT 40")
def sort_spec(spark, d):
    return rank.ranked(load(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), "s_nationkey,s_acctbal,s_suppkey".replace("s_acctbal", "-s_acctbal"), 40)


def _years(spark, d):
    return load(spark, d, "lineitem").groupBy("l_partkey", F.year("l_shipdate").alias("y")).agg(F.sum("l_quantity").alias("q"))


@query("""
WITH y AS (SELECT l_partkey, year(l_shipdate) AS y, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
SELECT a.l_partkey, a.q, round(a.q - coalesce(b.q, 0), 6) AS delta FROM y a LEFT JOIN y b ON a.l_partkey = b.l_partkey AND b.y = 1996 WHERE a.y = 1997
""")
def rank_diff(spark, d):
    y = _years(spark, d)
    return rank.diff(y.where("y = 1997"), y.where("y = 1996"), "l_partkey", "q")


@query("""
SELECT p_brand, round(avg(p_retailprice), 6) AS mean, round(median(p_retailprice), 6) AS median, round(max(p_retailprice), 6) AS max, round(min(p_retailprice), 6) AS min,
  round(sum(p_retailprice), 4) AS sum, count(*) AS n FROM part WHERE isfinite(p_retailprice) GROUP BY p_brand
""")
def metric_aggregates(spark, d):
    return gates.aggregates(load(spark, d, "part").select("p_brand", F.col("p_retailprice").alias("value")), "p_brand")


@query("""
WITH y AS (SELECT l_partkey, year(l_shipdate) AS y, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
a AS (SELECT l_partkey, q FROM y WHERE y = 1997), b AS (SELECT l_partkey, q AS baseline FROM y WHERE y = 1996)
SELECT l_partkey, q, baseline, CASE WHEN baseline IS NULL THEN 'new' WHEN q IS NULL THEN 'missing' WHEN q - baseline > 1e-9 THEN 'regressed' WHEN q - baseline < -1e-9 THEN 'improved' ELSE 'unchanged' END AS status
FROM a FULL JOIN b USING (l_partkey)
""")
def ratchet_check(spark, d):
    y = _years(spark, d)
    return gates.ratchet(y.where("y = 1997"), y.where("y = 1996"), "l_partkey", "q")


@query("""
WITH c AS (SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END) AS added, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS removed FROM lineitem GROUP BY 1)
SELECT l_suppkey, added, removed, added + removed AS total, added - removed AS net,
  concat_ws(',', CASE WHEN added > 10000 THEN 'max_added' END, CASE WHEN added - removed > 5000 THEN 'max_net' END, CASE WHEN added + removed > 15000 THEN 'max_total' END) AS exceeded FROM c
""")
def budget_check(spark, d):
    back = F.col("l_returnflag") == "R"
    rows = load(spark, d, "lineitem").select("l_suppkey", F.when(back, 0.0).otherwise(F.col("l_quantity")).alias("added"), F.when(back, F.col("l_quantity")).otherwise(0.0).alias("removed"))
    return gates.budget(rows, "l_suppkey", {"max_added": 10000, "max_total": 15000, "max_net": 5000})
