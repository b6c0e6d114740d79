"""Session, text, JSON, vector and similarity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import sessions, text, vectors
from sparkloom.plans.registry import query
from sparkloom.runtime import load

_EV = "ev AS (SELECT user_id AS session, event_id AS pos, event_type AS tool, event_type = 'error' AS error, value, ts, event_id % 40 AS target, event_type = 'purchase' AS write FROM events)"


def _events(spark, d):
    e = load(spark, d, "events")
    return e.select(F.col("user_id").alias("session"), F.col("event_id").alias("pos"), F.col("event_type").alias("tool"), (F.col("event_type") == "error").alias("error"), "value", "ts", (F.col("event_id") % 40).alias("target"), (F.col("event_type") == "purchase").alias("write"))


_TR = """
st AS (SELECT session, lag(tool) OVER w AS f, tool AS t, lead(tool) OVER w AS n FROM ev WINDOW w AS (PARTITION BY session ORDER BY pos)),
tr AS (SELECT session, f, t, count(*) AS n FROM (SELECT session, coalesce(f, 'start') AS f, t FROM st UNION ALL SELECT session, t, 'end' FROM st WHERE n IS NULL) GROUP BY 1, 2, 3)
"""
_RUN = "ru AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY pos) - row_number() OVER (PARTITION BY session, tool ORDER BY pos) AS island FROM ev)"


@query(f'WITH {_EV}, {_TR} SELECT session, f AS "from", t AS "to", n FROM tr')
def transitions(spark, d):
    return sessions.transitions(_events(spark, d))


@query(f'WITH {_EV}, {_TR} SELECT f AS "from", t AS "to", round(sum(n) / sum(sum(n)) OVER (PARTITION BY f), 9) AS p FROM tr GROUP BY f, t')
def markov(spark, d):
    c = sessions.transitions(_events(spark, d)).groupBy("from", "to").agg(F.sum("n").alias("n"))
    return sessions.markov(c).select("from", "to", F.round("p", 9).alias("p"))


@query(f"""
WITH {_EV}, {_TR}, o AS (SELECT session, f, t, n / sum(n) OVER (PARTITION BY session, f) AS p FROM tr), a AS (SELECT f, t, sum(n) / sum(sum(n)) OVER (PARTITION BY f) AS q FROM tr GROUP BY f, t),
s AS (SELECT DISTINCT session FROM tr), x AS (SELECT s.session, a.f, a.t, a.q, coalesce(o.p, 0) AS p FROM s CROSS JOIN a LEFT JOIN o ON o.session = s.session AND o.f = a.f AND o.t = a.t)
SELECT session, round(sqrt(sum((p - q) * (p - q))), 6) AS distance FROM x GROUP BY session ORDER BY distance DESC, session LIMIT 10
""")
def frobenius_outliers(spark, d):
    return sessions.frobenius_outliers(sessions.transitions(_events(spark, d)))


@query(f"WITH {_EV}, {_RUN} SELECT session, tool, min(pos) AS start, count(*) AS length FROM ru GROUP BY session, tool, island HAVING count(*) >= 3")
def tool_chains(spark, d):
    return sessions.runs(_events(spark, d))


@query(f"WITH {_EV}, {_RUN} SELECT session, tool, min(pos) AS start, count(*) - 1 AS savings FROM ru GROUP BY session, tool, island HAVING count(*) > 1 AND count(DISTINCT target) >= 2")
def parallel_runs(spark, d):
    return sessions.parallel_runs(_events(spark, d))


@query(f"""
WITH {_EV}, l AS (SELECT tool AS a, lead(tool) OVER w AS b, lead(tool, 2) OVER w AS c, lead(tool, 3) OVER w AS e, lead(tool, 4) OVER w AS f FROM ev WINDOW w AS (PARTITION BY session ORDER BY pos)),
p AS (SELECT a || '>' || b AS pattern, 2 AS length FROM l WHERE b IS NOT NULL UNION ALL SELECT a || '>' || b || '>' || c, 3 FROM l WHERE c IS NOT NULL
  UNION ALL SELECT a || '>' || b || '>' || c || '>' || e, 4 FROM l WHERE e IS NOT NULL UNION ALL SELECT a || '>' || b || '>' || c || '>' || e || '>' || f, 5 FROM l WHERE f IS NOT NULL)
SELECT pattern, length, count(*) AS n FROM p GROUP BY 1, 2 HAVING count(*) >= 2
""")
def subsequence_patterns(spark, d):
    return sessions.subsequences(_events(spark, d))


@query(f"WITH {_EV}, l AS (SELECT session, pos, tool AS a, lead(tool) OVER w AS b, lead(tool, 2) OVER w AS c FROM ev WINDOW w AS (PARTITION BY session ORDER BY pos)) SELECT session, pos FROM l WHERE a LIKE 'view%' AND b LIKE 'cl%' AND c LIKE 'purch%'")
def sequence_match(spark, d):
    return sessions.matches(_events(spark, d), ["View", "cl", "Purch"])


@query(f"WITH {_EV}, g AS (SELECT session, greatest(0.0, value - coalesce(lag(value) OVER (PARTITION BY session ORDER BY pos), 0.0)) AS g FROM ev) SELECT session, round(sum(g), 4) AS \"unique\" FROM g GROUP BY session")
def context_growth(spark, d):
    return sessions.growth(_events(spark, d))


@query(f"WITH {_EV} SELECT tool, count(*) AS calls, CAST(sum(CAST(error AS INT)) AS BIGINT) AS errors, round(1 - sum(CAST(error AS INT)) / count(*), 9) AS success_rate FROM ev GROUP BY tool")
def tool_stats(spark, d):
    return sessions.tool_stats(_events(spark, d))


@query(f"WITH {_EV} SELECT session, tool, count(*) AS attempts, CAST(sum(CAST(error AS INT)) AS BIGINT) AS failures FROM ev GROUP BY 1, 2 HAVING count(*) >= 3 AND sum(CAST(error AS INT)) >= 2")
def retry_hotspots(spark, d):
    return sessions.retry_hotspots(_events(spark, d))


@query(f"""
WITH {_EV}, h AS (SELECT target, CAST(sum(CAST(NOT write AS INT)) AS BIGINT) AS reads, CAST(sum(CAST(write AS INT)) AS BIGINT) AS writes, count(*) AS touches FROM ev GROUP BY target)
SELECT *, CASE WHEN writes > 5 THEN 'hot' WHEN writes = 0 AND reads > 0 THEN 'read-only' ELSE 'normal' END AS heat FROM h
""")
def heatmap(spark, d):
    return sessions.heatmap(_events(spark, d))


@query(f"WITH {_EV} SELECT session, count(*) AS turns, count(DISTINCT tool) AS tools, CAST(sum(CAST(error AS INT)) AS BIGINT) AS errors, CAST(max(floor(epoch(ts))) - min(floor(epoch(ts))) AS BIGINT) AS seconds FROM ev GROUP BY session")
def session_summary(spark, d):
    return sessions.summary(_events(spark, d))


@query("""
WITH t AS (SELECT conv_id AS session, sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END) AS i, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS o, sum(CASE WHEN turn > 1 THEN length(text) ELSE 0 END) AS r, sum(CASE WHEN role = 'system' THEN length(text) ELSE 0 END) AS c FROM conversations GROUP BY 1)
SELECT session, round(i * 3e-6 + o * 15e-6 + r * 0.3e-6 + c * 3.75e-6, 9) AS cost, round(r * 2.7e-6, 9) AS saved, round(CASE WHEN i + r > 0 THEN 100 * r / (i + r) ELSE 0.0 END, 6) AS efficiency FROM t
""")
def cost_report(spark, d):
    c, n = load(spark, d, "conversations"), F.length("text")
    pick = lambda ok: F.when(ok, n).otherwise(0)
    rows = c.select(F.col("conv_id").alias("session"), pick(F.col("role") == "user").alias("input"), pick(F.col("role") == "assistant").alias("output"), pick(F.col("turn") > 1).alias("cache_read"), pick(F.col("role") == "system").alias("cache_create"))
    return sessions.cost(rows, {"input": 3.0, "output": 15.0, "cache_read": 0.3, "cache_create": 3.75})


@query("SELECT role, count(*) AS messages, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY role")
def role_counts(spark, d):
    return load(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("messages"), F.sum(F.length("text")).alias("chars"))


@query("SELECT conv_id, turn, role FROM conversations WHERE role = 'user' AND length(text) BETWEEN 20 AND 400 AND regexp_matches(text, '[0-9]|un') AND turn <= 3")
def message_filter(spark, d):
    c = load(spark, d, "conversations")
    return c.where((F.col("role") == "user") & F.length("text").between(20, 400) & F.col("text").rlike("[0-9]|un") & (F.col("turn") <= 3)).select("conv_id", "turn", "role")


@query(f"WITH {_EV} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, tool, count(*) AS n, round(avg(value), 6) AS mean FROM ev GROUP BY 1, 2")
def grouped_stats(spark, d):
    return _events(spark, d).groupBy(F.to_date("ts").cast("string").alias("day"), "tool").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


_TOK = "tk AS (SELECT doc_id, source, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9'']+'), lambda x: x <> '')) AS w FROM documents)"


def _words(spark, d):
    return load(spark, d, "documents").select("doc_id", "source", F.explode(text.tokens(F.col("text"))).alias("w"))


@query(f"WITH {_TOK} SELECT source, count(*) AS tokens, count(DISTINCT w) AS vocabulary, round(count(DISTINCT w) / count(*), 9) AS uniqueness FROM tk GROUP BY source")
def token_stats(spark, d):
    n = F.countDistinct("w")
    return _words(spark, d).groupBy("source").agg(F.count("*").alias("tokens"), n.alias("vocabulary"), F.round(n / F.count("*"), 9).alias("uniqueness"))


@query(f"WITH {_TOK}, n AS (SELECT source, w, count(*) AS n FROM tk GROUP BY 1, 2), p AS (SELECT source, n / sum(n) OVER (PARTITION BY source) AS p FROM n) SELECT source, round(CASE WHEN count(*) < 2 THEN 0.0 ELSE sum(-p * log2(p)) / log2(count(*)) END, 6) AS entropy FROM p GROUP BY source")
def entropy(spark, d):
    return text.entropy(_words(spark, d), "source", "w")


@query(f"""
WITH {_TOK}, n AS (SELECT source, w, count(*) AS n FROM tk GROUP BY 1, 2), c AS (SELECT w, sum(n) AS q FROM n GROUP BY w), z AS (SELECT sum(q) AS al, count(*) AS v FROM c),
p AS (SELECT source, w, n / sum(n) OVER (PARTITION BY source) AS p FROM n)
SELECT source, round(sum(p * log2(p / ((q + 1) / (al + v)))), 6) AS kl FROM p JOIN c USING (w) CROSS JOIN z GROUP BY source
""")
def kl_divergence(spark, d):
    return text.kl_divergence(_words(spark, d), "source", "w")


@query("""
WITH t AS (SELECT list_filter(regexp_split_to_array(lower(text), '[^a-z0-9'']+'), lambda x: x <> '') AS t FROM conversations),
g AS (SELECT t[i] || ' ' || t[i + 1] AS ngram FROM t, range(1, 5000) r(i) WHERE i < len(t)) SELECT ngram, count(*) AS n FROM g GROUP BY ngram ORDER BY n DESC, ngram LIMIT 100
""")
def ngrams(spark, d):
    return text.ngrams(load(spark, d, "conversations"), "text", 2)


@query("SELECT page_id, CAST(k AS INT) AS line, trim(content) AS content FROM (SELECT page_id, unnest(string_split(html, chr(10))) AS content, generate_subscripts(string_split(html, chr(10)), 1) AS k FROM pages) WHERE regexp_matches(content, 'href=\"/[A-Z]')")
def grep_lines(spark, d):
    return text.grep(load(spark, d, "pages"), "page_id", "html", 'href="/[A-Z]')


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) > 50")
def json_dotted_lookup(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return load(spark, d, "events").select("event_id", k.alias("k")).where("k > 50")


@query("SELECT event_id FROM events WHERE (event_type = 'error' AND json_extract_string(props, '$.k') IN ('1', '2', '3')) OR (contains(event_type, 'pur') AND regexp_matches(json_extract_string(props, '$.k'), '^9'))")
def predicate_tree(spark, d):
    tree = {"any": [{"all": [{"type": {"equals": "error"}}, {"k": {"one_of": ["1", "2", "3"]}}]}, {"all": [{"type": {"contains": "pur"}}, {"k": {"regex": "^9"}}, {"k": {"exists": True}}]}]}
    field = {"type": F.col("event_type"), "k": F.get_json_object("props", "$.k")}
    return load(spark, d, "events").where(text.predicate(tree, field.__getitem__)).select("event_id")


_COS = "CASE WHEN list_dot_product(q.v, q.v) * list_dot_product(x.v, x.v) = 0 THEN 0.0 ELSE greatest(-1.0, least(1.0, list_dot_product(q.v, x.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(x.v, x.v))))) END"
_VEC = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query(f"WITH {_VEC}, s AS (SELECT q.vec_id AS query, x.vec_id, round({_COS}, 6) AS score FROM v q CROSS JOIN v x WHERE q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS r FROM s) SELECT query, vec_id, score FROM r WHERE r <= 10")
def knn_cosine(spark, d):
    e = load(spark, d, "embeddings")
    return vectors.nearest(e, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q")), "vec_id", "embedding")


@query(f"WITH {_VEC} SELECT x.vec_id, round({_COS} * (1 - 0.3 * ((x.vec_id % 10) / 10)), 6) AS score FROM v q CROSS JOIN v x WHERE q.vec_id = 0 ORDER BY score DESC, x.vec_id LIMIT 20")
def rerank_staleness(spark, d):
    e = load(spark, d, "embeddings")
    one = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    hits = e.join(F.broadcast(one), F.lit(True))  # one row
    return text.rerank(hits, text.cosine(F.col("q"), F.col("embedding")), (F.col("vec_id") % 10) / 10, 20, "vec_id").select("vec_id", "score")
