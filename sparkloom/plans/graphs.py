"""Graph and architecture queries over all import edges between parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import graph
from sparkloom.operators.components import connected_components
from sparkloom.plans.registry import EDGES, part_edges, query
from sparkloom.runtime import Scratch, load

#: Searches from a node take those divisible by this as their queries, against all edges.
QUERIES_EVERY = 100
_E = f"e AS ({EDGES})"
_N = "n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)"
_REACH = "r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)"
_DEGREES = "g AS (SELECT node, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT dst AS node, 1 AS i, 0 AS o FROM e UNION ALL SELECT src, 0, 1 FROM e) GROUP BY node)"
_BOTH = "b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"
_SCC = "sc AS (SELECT node, least(node, coalesce(min(x.dst), node)) AS component FROM n LEFT JOIN (SELECT p.src, p.dst FROM r p JOIN r q ON p.src = q.dst AND p.dst = q.src) x ON node = x.src GROUP BY node)"
_FOLD = "fo AS (SELECT DISTINCT a.component AS src, b.component AS dst FROM e JOIN sc a ON e.src = a.node JOIN sc b ON e.dst = b.node WHERE a.component <> b.component)"


def _levels(src: str, dst: str) -> str:
    """SQL for l(start, node, depth): least steps from each query node, along edges from ``src`` to ``dst``."""
    return (
        f"l(start, node, depth) USING KEY (start, node) AS (SELECT DISTINCT {src}, {dst}, 1 FROM e WHERE {src} % {QUERIES_EVERY} = 0 UNION "
        f"SELECT l.start, e.{dst}, min(l.depth) + 1 FROM l JOIN e ON l.node = e.{src} LEFT JOIN recurring.l x ON x.start = l.start AND x.node = e.{dst} WHERE x.start IS NULL GROUP BY 1, 2)"
    )


def _edges(spark, d):
    return part_edges(spark, d)


def _starts(edges):
    return edges.select("src").where(F.col("src") % QUERIES_EVERY == 0).distinct()


@query(f"WITH {_E} SELECT dst AS node, count(*) AS fan_in FROM e GROUP BY dst")
def fan_in(spark, d):
    return _edges(spark, d).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("fan_in"))


@query(f"WITH {_E} SELECT src AS node, count(*) AS fan_out FROM e GROUP BY src")
def fan_out(spark, d):
    return _edges(spark, d).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("fan_out"))


@query(f"WITH {_E}, {_DEGREES} SELECT node, fan_in, fan_out, round(fan_out / (fan_in + fan_out), 9) AS instability FROM g")
def instability(spark, d):
    return graph.degrees(_edges(spark, d))


@query(f"WITH {_E}, {_DEGREES} SELECT node, fan_in, fan_out, fan_in * fan_out AS score FROM g WHERE fan_in >= 3 AND fan_out >= 3 ORDER BY score DESC, node LIMIT 10")
def coupling_hubs(spark, d):
    return graph.hubs(_edges(spark, d)).orderBy(F.desc("score"), "node").limit(10)


@query(f"WITH {_E} SELECT x.src AS a, x.dst AS b FROM e x JOIN e y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst")
def cross_edges(spark, d):
    return graph.mutual(_edges(spark, d))


@query(f"WITH {_E} SELECT DISTINCT src AS node FROM e WHERE src NOT IN (SELECT dst FROM e)")
def dead_nodes(spark, d):
    return graph.dead_nodes(_edges(spark, d))


@query(f"WITH {_E} SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT src FROM e UNION SELECT dst FROM e)")
def orphan_nodes(spark, d):
    return load(spark, d, "part").select(F.col("p_partkey").alias("node")).join(graph.nodes(_edges(spark, d)), "node", "left_anti")


@query(f"""
WITH {_E}, n AS (SELECT p_partkey AS k, p_brand AS layer FROM part)
SELECT x.layer AS from_layer, y.layer AS to_layer, count(*) AS edges FROM e JOIN n x ON src = x.k JOIN n y ON dst = y.k WHERE x.layer <> y.layer GROUP BY 1, 2 ORDER BY edges DESC, 1, 2 LIMIT 15
""")
def layer_flows(spark, d):
    n = load(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("layer"))
    e = _edges(spark, d).join(n.toDF("src", "from_layer"), "src").join(n.toDF("dst", "to_layer"), "dst").where("from_layer <> to_layer")
    return e.groupBy("from_layer", "to_layer").agg(F.count("*").alias("edges")).orderBy(F.desc("edges"), "from_layer", "to_layer").limit(15)


@query(f"""
WITH {_E}, t AS (SELECT x.src AS top, x.dst AS mid, y.dst AS bottom FROM e x JOIN e y ON x.dst = y.src WHERE x.src <> y.dst)
SELECT x.top, x.mid AS low, y.mid AS high, x.bottom FROM t x JOIN t y ON x.top = y.top AND x.bottom = y.bottom AND x.mid < y.mid
""")
def diamonds(spark, d):
    return graph.diamonds(_edges(spark, d))


@query(f"WITH {_E} SELECT z.src, z.dst, min(x.dst) AS via FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst WHERE x.dst <> z.src AND x.dst <> z.dst GROUP BY 1, 2")
def redundant_edges(spark, d):
    return graph.redundant(_edges(spark, d))


@query(f"""
WITH RECURSIVE {_E}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), {_BOTH},
r(src, dst) AS (SELECT src, dst FROM b UNION SELECT r.src, b.dst FROM r JOIN b ON r.dst = b.src)
SELECT node, least(node, coalesce(min(dst), node)) AS component FROM n LEFT JOIN r ON node = src GROUP BY node
""")
def wcc(spark, d):
    return connected_components(_edges(spark, d), Scratch(spark, "wcc"))


@query(f"""
WITH {_E}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)
SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, round((SELECT count(*) FROM e) / ((SELECT count(*) FROM n) * ((SELECT count(*) FROM n) - 1)), 9) AS density
""")
def graph_stats(spark, d):
    e = _edges(spark, d)
    n = graph.nodes(e).agg(F.count("*").alias("nodes"))
    both = n.join(e.agg(F.count("*").alias("edges")), F.lit(True))  # one row each
    return both.withColumn("density", F.round(F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 9))


@query(f"WITH RECURSIVE {_E}, {_REACH}, {_N}, {_SCC} SELECT node, component FROM sc")
def scc(spark, d):
    return graph.strongly_connected(_edges(spark, d), Scratch(spark, "scc"))


@query(f"WITH RECURSIVE {_E}, {_levels('src', 'dst')} SELECT start, node, depth FROM l")
def bfs_depth(spark, d):
    scratch = Scratch(spark, "bfs")
    e = graph.cleaned(_edges(spark, d), scratch)
    return graph.reach(e, scratch, _starts(e))


@query(f"WITH RECURSIVE {_E}, {_REACH} SELECT dst AS node, count(*) AS dependents FROM r WHERE src <> dst GROUP BY dst")
def dependents(spark, d):
    return graph.dependents(_edges(spark, d), Scratch(spark, "closure"))


@query(f"""
WITH RECURSIVE {_E}, {_levels('dst', 'src')}, {_DEGREES}
SELECT start AS node, count(*) FILTER (WHERE depth = 1) AS direct, count(*) FILTER (WHERE depth > 1) AS transitive, max(depth) AS depth, count(*) FILTER (WHERE p_size % 5 <> 0) AS untested, any_value(s.fan_in) AS fan_in
FROM l JOIN part ON l.node = p_partkey JOIN g s ON l.start = s.node WHERE start <> l.node GROUP BY start
""")
def blast_radius(spark, d):
    scratch = Scratch(spark, "blast")
    back = graph.cleaned(_edges(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst")), scratch)
    tested = load(spark, d, "part").select(F.col("p_partkey").alias("node"), (F.col("p_size") % 5 == 0).alias("is_test"))
    out = graph.blast_radius(back, scratch, _starts(back), tested)
    fan_in = back.where(F.col("src") % QUERIES_EVERY == 0).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("fan_in"))
    return out.join(fan_in, "node")


_DEPTH = f"{_REACH}, {_N}, {_SCC}, {_FOLD}, z(node, depth) AS (SELECT DISTINCT component, 0 FROM sc UNION SELECT dst, depth + 1 FROM z JOIN fo ON node = src), dm AS (SELECT sc.node, max(depth) AS depth FROM sc JOIN z ON component = z.node GROUP BY sc.node)"


@query(f"WITH RECURSIVE {_E}, {_DEPTH} SELECT node, depth FROM dm")
def depth_map(spark, d):
    return graph.longest_depth(_edges(spark, d), Scratch(spark, "depth"))


@query(f"""
WITH RECURSIVE {_E}, {_DEPTH}, y AS (SELECT p_partkey AS k, p_brand AS layer FROM part), a AS (SELECT layer, avg(depth) AS d FROM dm JOIN y ON node = k GROUP BY layer),
c AS (SELECT x.layer AS f, x2.layer AS t FROM e JOIN y x ON src = x.k JOIN y x2 ON dst = x2.k WHERE x.layer <> x2.layer),
s AS (SELECT f AS layer, CAST(sum(CASE WHEN q.d > p.d THEN 1 ELSE 0 END) AS BIGINT) AS down, CAST(sum(CASE WHEN q.d < p.d THEN 1 ELSE 0 END) AS BIGINT) AS up, CAST(sum(CASE WHEN q.d = p.d THEN 1 ELSE 0 END) AS BIGINT) AS level
  FROM c JOIN a p ON f = p.layer JOIN a q ON t = q.layer GROUP BY f)
SELECT *, round(CASE WHEN down + up = 0 THEN 1.0 ELSE down / (down + up) END, 9) AS compliance FROM s
""")
def layering(spark, d):
    e = _edges(spark, d)
    layer = load(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("layer"))
    return graph.layering(e, graph.longest_depth(e, Scratch(spark, "layers")), layer)


@query(f"""
WITH RECURSIVE {_E}, {_REACH}, c AS (SELECT p_partkey AS k, p_size AS cc FROM part)
SELECT src AS node, CAST(sum(y.cc) + any_value(x.cc) AS BIGINT) AS reachable_cc, max(y.cc) AS max_cc, round((sum(y.cc) + any_value(x.cc)) / any_value(x.cc), 9) AS amplification
FROM r JOIN c x ON src = x.k JOIN c y ON dst = y.k WHERE src <> dst GROUP BY src
""")
def reachable_sum(spark, d):
    c = load(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_size").alias("cost"))
    r = graph.reachable_totals(_edges(spark, d), c, Scratch(spark, "reachable"))
    return r.select("node", F.col("total").alias("reachable_cc"), F.col("most").alias("max_cc"), F.round(F.col("total") / F.col("cost"), 9).alias("amplification"))


@query(f"""
WITH RECURSIVE {_E}, l(start, node, depth, path) USING KEY (start, node) AS (SELECT DISTINCT src, src, 0, CAST(src AS VARCHAR) FROM e WHERE src % {QUERIES_EVERY} = 0 UNION
SELECT l.start, e.dst, min(l.depth) + 1, min(l.path || '>' || CAST(e.dst AS VARCHAR)) FROM l JOIN e ON l.node = e.src LEFT JOIN recurring.l x ON x.start = l.start AND x.node = e.dst WHERE x.start IS NULL GROUP BY 1, 2)
SELECT start, node, depth, path FROM l WHERE depth > 0
""")
def shortest_path(spark, d):
    scratch = Scratch(spark, "paths")
    e = graph.cleaned(_edges(spark, d), scratch)
    return graph.shortest_paths(e, scratch, _starts(e), max_depth=0)


@query(f"WITH RECURSIVE {_E}, {_DEPTH} SELECT node AS \"end\", depth + 1 AS n_nodes FROM dm WHERE depth >= 3 AND node NOT IN (SELECT src FROM e)")
def longest_chain(spark, d):
    return graph.longest_chain(_edges(spark, d), Scratch(spark, "chains"))


@query()
def bridges(spark, d):
    return graph.bridges(_edges(spark, d), Scratch(spark, "bridges"))
