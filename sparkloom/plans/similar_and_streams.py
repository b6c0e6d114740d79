"""Similarity and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import similarity
from sparkloom.plans.registry import query
from sparkloom.runtime import Scratch, load
from sparkloom.streaming import windows


@query("""
WITH h AS (SELECT doc_id, md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS h FROM documents WHERE text IS NOT NULL), g AS (SELECT h, min(doc_id) AS representative, count(*) AS members FROM h GROUP BY h HAVING count(*) > 1)
SELECT doc_id, representative, members FROM h JOIN g USING (h)
""")
def exact_dup(spark, d):
    return similarity.exact_groups(load(spark, d, "documents"), "doc_id", "text")


_SHINGLES = """w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \t\n\r]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(1) ORDER BY s)) AS c FROM g GROUP BY 1), cl AS (SELECT c, min(doc_id) AS a FROM n GROUP BY 1), own AS (SELECT n.* FROM n JOIN cl ON doc_id = a), og AS (SELECT g.* FROM g JOIN cl ON doc_id = a),
h AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM og x JOIN og y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
pr AS (SELECT h.a, h.b, round(k / (p.n + q.n - k), 9) AS similarity FROM h JOIN own p ON h.a = p.doc_id JOIN own q ON h.b = q.doc_id WHERE k / (p.n + q.n - k) >= 0.8 UNION ALL SELECT a, doc_id, 1.0 FROM n JOIN cl USING (c) WHERE doc_id <> a)"""
_CLUSTERS = "e AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr), r(x, y) AS (SELECT a, a FROM e UNION SELECT x, b FROM r JOIN e ON y = a), ct AS (SELECT x AS node, min(y) AS cluster FROM r GROUP BY 1)"


def _pairs(spark, d, scratch):
    return scratch.stage(similarity.minhash_pairs(load(spark, d, "documents"), "doc_id", "text", scratch))


def _functions(spark, d):
    return load(spark, d, "documents").select(F.col("doc_id").alias("key"), F.concat("lang", (F.col("doc_id") % 7).cast("string")).alias("name"), F.col("n_chars").alias("lines"), F.coalesce("source", F.lit("none")).alias("module"))


@query(f"WITH {_SHINGLES} SELECT a, b, similarity FROM pr")
def minhash_pairs(spark, d):
    return similarity.minhash_pairs(load(spark, d, "documents"), "doc_id", "text", Scratch(spark, "minhash"))


@query(f"WITH RECURSIVE {_SHINGLES}, {_CLUSTERS} SELECT node, cluster FROM ct")
def lsh_clusters(spark, d):
    scratch = Scratch(spark, "lsh")
    return similarity.clone_clusters(_pairs(spark, d, scratch), scratch)


@query(f"WITH {_SHINGLES}, f AS (SELECT doc_id, lang || CAST(doc_id % 7 AS VARCHAR) AS name, n_chars AS lines FROM documents) SELECT a, b, similarity FROM pr JOIN f p ON a = p.doc_id JOIN f q ON b = q.doc_id WHERE similarity < 1 AND least(p.lines, q.lines) >= 0.5 * greatest(p.lines, q.lines) AND p.name <> q.name")
def similar_functions(spark, d):
    return similarity.similar_functions(_pairs(spark, d, Scratch(spark, "functions")), _functions(spark, d))


@query(f"""
WITH RECURSIVE {_SHINGLES}, {_CLUSTERS} SELECT cluster, members, lines, similarity FROM (SELECT cluster, count(*) AS members, CAST(sum(n_chars) AS BIGINT) AS lines FROM ct JOIN documents ON node = doc_id GROUP BY 1) JOIN (SELECT cluster, round(avg(similarity), 6) AS similarity FROM pr JOIN ct ON a = node GROUP BY 1) USING (cluster)
""")
def clone_report(spark, d):
    scratch = Scratch(spark, "clones")
    return similarity.cluster_report(_pairs(spark, d, scratch), _functions(spark, d), scratch)


@query(f"""
WITH RECURSIVE {_SHINGLES}, {_CLUSTERS} SELECT coalesce(source, 'none') AS module, count(*) AS functions, count(node) AS clustered, round(1 - count(node) / count(*), 9) AS uniqueness FROM documents LEFT JOIN ct ON node = doc_id GROUP BY 1
""")
def uniqueness(spark, d):
    scratch = Scratch(spark, "unique")
    return similarity.uniqueness(_functions(spark, d), similarity.clone_clusters(_pairs(spark, d, scratch), scratch))


@query(f"""
WITH RECURSIVE {_SHINGLES}, {_CLUSTERS}, bad AS (SELECT cluster FROM ct JOIN documents ON node = doc_id GROUP BY 1 HAVING count(DISTINCT coalesce(source, 'none')) >= 3 INTERSECT SELECT cluster FROM pr JOIN ct ON a = node GROUP BY 1 HAVING count(*) >= 5)
SELECT a, b, similarity FROM pr JOIN ct ON a = node WHERE cluster NOT IN (SELECT cluster FROM bad)
""")
def without_patterns(spark, d):
    scratch = Scratch(spark, "patterns")
    files = _functions(spark, d).select("key", F.col("module").alias("file"))
    return similarity.without_patterns(_pairs(spark, d, scratch), files, scratch)


@query("""
WITH g AS (SELECT p_size AS id, p_brand AS a_dir, p_type AS b_dir FROM part), h AS (SELECT a_dir, b_dir FROM g GROUP BY 1, 2 HAVING count(DISTINCT id) >= 12) SELECT id, a_dir, b_dir FROM g WHERE (a_dir, b_dir) NOT IN (SELECT (a_dir, b_dir) FROM h)
""")
def without_hot_folders(spark, d):
    return similarity.without_hot_folders(load(spark, d, "part").select(F.col("p_size").alias("id"), F.col("p_brand").alias("a_dir"), F.col("p_type").alias("b_dir")), 12)


@query("""
WITH b AS (SELECT p_partkey % 40 AS id, p_brand AS file, p_partkey % 300 AS st, p_partkey % 300 + p_size AS en FROM part), l AS (SELECT DISTINCT x.* FROM b x WHERE NOT EXISTS (SELECT 1 FROM b y WHERE y.file = x.file AND y.st <= x.st AND y.en >= x.en AND y.en - y.st > x.en - x.st))
SELECT id, file, st AS start, en AS "end" FROM b WHERE (id, file, st, en) IN (SELECT (id, file, st, en) FROM l) AND id IN (SELECT z.id FROM b z WHERE (z.id, z.file, z.st, z.en) IN (SELECT (id, file, st, en) FROM l) GROUP BY 1 HAVING count(*) >= 2)
""")
def outermost_blocks(spark, d):
    n = F.col("p_partkey") % 300
    return similarity.outermost(load(spark, d, "part").select((F.col("p_partkey") % 40).alias("id"), F.col("p_brand").alias("file"), n.alias("start"), (n + F.col("p_size")).alias("end")))


@query("""
WITH l AS (SELECT doc_id, unnest(range(0, len(x))) AS i, x FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)), f AS (SELECT doc_id, i, trim(x[i + 1]) || chr(1) || trim(x[i + 2]) AS t FROM l WHERE i + 2 <= len(x))
SELECT members, count(*) AS groups FROM (SELECT t, count(*) AS members FROM f GROUP BY 1 HAVING count(*) >= 2) GROUP BY 1
""")
def fragment_groups(spark, d):
    t = load(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("file"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return similarity.fragments(t, 2).groupBy("members").agg(F.count("*").alias("groups"))


@query("SELECT p_name AS entity, p_size % 5 AS field, count(*) AS n, array_to_string(list_sort(list(DISTINCT p_brand || ':' || CAST(p_partkey % 400 AS VARCHAR))), ',') AS locations FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def restatements(spark, d):
    p = load(spark, d, "part")
    return similarity.restatements(p.select(F.col("p_name").alias("entity"), (F.col("p_size") % 5).alias("field"), F.col("p_brand").alias("file"), (F.col("p_partkey") % 400).alias("line")), "entity", "field")


@query("""
WITH f AS (SELECT p_brand AS b, list(DISTINCT p_type || ':' || CAST(p_size % 4 AS VARCHAR)) AS v FROM part GROUP BY 1), x AS (SELECT p.b AS a, q.b AS b, len(list_intersect(p.v, q.v)) AS k, len(p.v) AS n, len(q.v) AS m FROM f p JOIN f q ON p.b < q.b)
SELECT a, b, CASE WHEN k = n AND k = m THEN 'equal' WHEN k = m THEN 'subtype' WHEN k = n THEN 'supertype' WHEN k > 0 THEN 'related' ELSE 'unrelated' END AS relation FROM x WHERE k > 0
""")
def type_relations(spark, d):
    f = load(spark, d, "part").groupBy(F.col("p_brand").alias("t")).agg(F.collect_set(F.concat_ws(":", "p_type", (F.col("p_size") % 4).cast("string"))).alias("v"))
    # Types meet by the fields they have in common; two without any are unrelated and have no row.
    by = f.select("t", F.explode("v").alias("x"))
    pairs = by.toDF("a", "x").join(by.toDF("b", "x"), "x").where("a < b").select("a", "b").distinct()
    both = pairs.join(f.toDF("a", "va"), "a").join(f.toDF("b", "vb"), "b")
    return both.select("a", "b", similarity.relation(F.col("va"), F.col("vb")).alias("relation"))


@query("""
WITH o AS (SELECT DISTINCT p_brand AS type, p_name AS field FROM part), f AS (SELECT field, ln(1 + (SELECT count(DISTINCT type) FROM o) / count(*)) AS w FROM o GROUP BY field),
x AS (SELECT type, field, w FROM o JOIN f USING (field)), t AS (SELECT type, sum(w) AS t FROM x GROUP BY type),
s AS (SELECT p.type AS a, q.type AS b, sum(p.w) AS c FROM x p JOIN x q ON p.field = q.field AND p.type < q.type GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT a, b, CAST(floor(round(100 * c / (p.t + q.t - c), 6)) AS BIGINT) AS score FROM s JOIN t p ON a = p.type JOIN t q ON b = q.type
""")
def idf_jaccard_types(spark, d):
    return similarity.idf_jaccard(load(spark, d, "part").select(F.col("p_brand").alias("type"), F.col("p_name").alias("field")))


_LAST = "(SELECT max(ts) FROM events)"


@query(f"""
SELECT epoch(time_bucket(INTERVAL '1 hour', ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL '1 hour', min(ts)) + INTERVAL '1 hour' <= {_LAST} - INTERVAL '10 minutes'
""")
def stream_tumbling(spark, d):
    out = windows.drain(windows.tumbling(windows.source(spark, d), "1 hour", "10 minutes"), "tumbling")
    return out.withColumn("start", F.unix_timestamp("start"))


@query("SELECT event_id, event_type FROM events")
def stream_dedup_watermark(spark, d):
    return windows.drain(windows.deduplicated(windows.source(spark, d), ["event_id"], "10 minutes").select("event_id", "event_type"), "dedup")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def stream_upsert(spark, d):
    return windows.upsert(windows.source(spark, d).select("user_id", "event_id", "event_type"), "user_id", "event_id", "upsert")


@query("""
WITH k AS (SELECT user_id * 100000 + CAST(floor(event_id / 40) AS BIGINT) AS key, event_id FROM events), b AS (SELECT key, count(*) AS n FROM k WHERE event_id % 2 = 0 GROUP BY 1), a AS (SELECT key, count(*) AS n FROM k WHERE event_id % 2 = 1 GROUP BY 1)
SELECT key, CASE WHEN b.n IS NULL THEN 'added' WHEN a.n IS NULL THEN 'removed' ELSE 'updated' END AS change FROM b FULL JOIN a USING (key) WHERE a.n IS DISTINCT FROM b.n
""")
def stream_delta(spark, d):
    e = load(spark, d, "events").select((F.col("user_id") * 100000 + F.floor(F.col("event_id") / 40)).alias("key"), "event_id")
    n = lambda x: x.groupBy("key").agg(F.count("*").alias("n"))
    return windows.delta(n(e.where("event_id % 2 = 0")), n(e.where("event_id % 2 = 1")), "key", "n")


@query(f"""
WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, CAST(floor(epoch(max(ts) + INTERVAL '30 minutes')) AS BIGINT) AS "end", count(*) AS n FROM g GROUP BY user_id, k HAVING max(ts) + INTERVAL '30 minutes' <= {_LAST} - INTERVAL '10 minutes'
""")
def stream_session(spark, d):
    out = windows.drain(windows.bursts(windows.source(spark, d), "30 minutes", "10 minutes"), "bursts")
    return out.select("user_id", F.unix_timestamp("start").alias("start"), F.unix_timestamp("end").alias("end"), "n")


@query(f"""
WITH w AS (SELECT user_id, time_bucket(INTERVAL '15 minutes', ts) - k * INTERVAL '15 minutes' AS s FROM events, range(0, 4) r(k))
SELECT epoch(s)::BIGINT AS start, user_id, count(*) AS n FROM w GROUP BY 1, 2, s HAVING count(*) >= 2 AND s + INTERVAL '1 hour' <= {_LAST} - INTERVAL '10 minutes'
""")
def stream_spin_detect(spark, d):
    out = windows.drain(windows.spin(windows.source(spark, d), "1 hour", "15 minutes", 2, "10 minutes"), "spin")
    return out.select(F.unix_timestamp("start").alias("start"), "user_id", "n")
