"""Queries over sessions, their commands and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import texts
from sparkloom.operators import messages
from sparkloom.plans.fact_tables import sql, table
from sparkloom.plans.registry import query
from sparkloom.runtime import load

#: Shell commands that orders stand for, with the category and the pattern each has.
COMMANDS = (
    ("cargo t --all", "test", "cargo test"), ("FOO=1 cargo clippy", "lint", "cargo clippy"), ("cargo run", "build", "cargo run"), ("cargo add serde", "install", "cargo add"), ("npm run lint:fix", "lint", "npm run lint"),
    ("yarn run start", "other", "yarn run start"), ("pnpm i", "install", "pnpm install"), ("npx tsx a.ts", "other", "npx tsx"), ("./bin/make all", "build", "make"), ("pytest -x", "test", "pytest"),
    ("go test ./...", "test", "go test"), ("go build", "other", "go"), ("/usr/bin/git commit -m x", "git", "git commit"), ("gh", "git", "gh git"), ("pip3 install x", "install", "pip install"),
    ("apt-get update", "install", "apt-get update"), ("rg -n foo", "search", "rg"), ("ruff check", "lint", "ruff"), ("A=b", "other", "A=b"), ("echo hi", "other", "echo"),
)
#: Messages with the class or the kind of correction that each has.
MESSAGES = (
    ("Process ended with Exit Code 1", "Command failure", None), ("No file: not found", "File not found", None), ("PERMISSION denied", "Permission error", None), ("timeout after 3 s", "Timeout", None), ("bad syntax near import", "Syntax error", None),
    ("cannot import x", "Import error", None), ("Oh. I apologize for it", "Other", "apology"), ("well, My mistake: I was wrong", "Other", "mistake"), ("Let me fix that now", "Other", "let_me_fix"), ("Actually, sorry about this", "Other", "apology"), ("no, actually that holds", "Other", "actually"), ("all fine", "Other", None),
)
#: Model names with their price of input.
MODELS = (("x-opus-4-5", 5.0), ("opus 3", 15.0), ("Sonnet-4.6", 3.0), ("haiku-3-5", 0.8), ("haiku", 0.25), ("other", None))


def _pick(key: str, values) -> str:
    """SQL for the value that a key picks."""
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, float) else "'" + v.replace("'", "''") + "'"
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {quote(v)}" for i, v in enumerate(values)) + " END"


_C = "o_orderkey"
_COMMAND, _CATEGORY, _PATTERN = (_pick(_C, [c[i] for c in COMMANDS]) for i in range(3))
_MESSAGE, _CLASS, _KIND = (_pick(_C, [m[i] for m in MESSAGES]) for i in range(3))
_MODEL, _RATE = (_pick(_C, [m[i] for m in MODELS]) for i in range(2))


def _orders(spark, d, *columns: str):
    return load(spark, d, "orders").selectExpr(*columns)


@query(f"SELECT o_orderkey AS id, {_CATEGORY} AS category, {_PATTERN} AS pattern FROM orders")
def command_class(spark, d):
    c = _orders(spark, d, "o_orderkey AS id", f"{_COMMAND} AS command").withColumn("c", texts.command_class(F.col("command")))
    return c.select("id", "c.category", "c.pattern")


@query(f"SELECT o_orderkey AS id, {_CLASS} AS class, {_KIND} AS kind FROM orders")
def error_and_correction(spark, d):
    m = _orders(spark, d, "o_orderkey AS id", f"{_MESSAGE} AS message")
    return m.select("id", texts.error_class(F.col("message")).alias("class"), texts.correction(F.col("message"))["kind"].alias("kind"))


@query(f"WITH m AS (SELECT o_orderkey AS id, {_MESSAGE} AS t, {_KIND} AS kind FROM orders) SELECT id, substr(t, CASE WHEN contains(t, 'apologize') THEN 5 WHEN contains(t, 'My mistake') THEN 19 WHEN contains(t, 'sorry') THEN 11 WHEN contains(t, 'no,') THEN 5 ELSE 1 END, 80) AS excerpt FROM m WHERE kind IS NOT NULL")
def correction_excerpts(spark, d):
    m = _orders(spark, d, "o_orderkey AS id", f"{_MESSAGE} AS message")
    return m.select("id", texts.correction(F.col("message"))["excerpt"].alias("excerpt")).where("excerpt is not null")


@query(f"SELECT id, unnest(['cd x', c, 'echo a']) AS command FROM (SELECT o_orderkey AS id, {_COMMAND} AS c FROM orders)")
def split_commands(spark, d):
    c = _orders(spark, d, "o_orderkey AS id", f"'cd x && ' || {_COMMAND} || '; # note || echo a' AS line")
    return c.select("id", F.explode(texts.split_commands(F.col("line"))).alias("command"))


@query(f"""
WITH c AS (SELECT floor(o_orderkey / 3) AS turn, {_CATEGORY} AS category, o_orderstatus = 'F' AS e, floor(o_orderkey / 3) % 50 AS tokens FROM orders),
t AS (SELECT category, turn, max(tokens) AS t FROM c GROUP BY 1, 2)
SELECT category, calls, errors, turns, tokens FROM (SELECT category, count(*) AS calls, count(*) FILTER (WHERE e) AS errors FROM c GROUP BY 1) JOIN (SELECT category, count(*) AS turns, CAST(sum(t) AS BIGINT) AS tokens FROM t GROUP BY 1) USING (category)
""")
def command_stats(spark, d):
    return messages.command_stats(_orders(spark, d, "cast(floor(o_orderkey / 3) as bigint) AS turn", f"{_COMMAND} AS command", "o_orderstatus = 'F' AS is_error", "cast(floor(o_orderkey / 3) as bigint) % 50 AS tokens"))


@query(f"SELECT o_custkey AS session, o_orderkey AS turn, round((o_orderkey % 1000 * {_RATE} + o_custkey % 500 * {_RATE} * 5) / 1e6, 9) AS cost FROM orders")
def turn_costs(spark, d):
    u = _orders(spark, d, "o_custkey AS session", "o_orderkey AS turn", f"{_MODEL} AS model", "o_orderkey % 1000 AS input", "o_custkey % 500 AS output", "0 AS cache_write", "0 AS cache_read")
    return messages.turn_costs(u)


@query("SELECT o_custkey AS session, CAST(floor(sum(o_orderkey % 1000 + o_orderkey % 77) / count(*)) AS BIGINT) AS average FROM orders GROUP BY 1")
def average_context(spark, d):
    return messages.average_context(_orders(spark, d, "o_custkey AS session", "o_orderkey % 1000 AS input", "o_orderkey % 77 AS cache_read"))


@query(sql("tool_calls", """, r AS (SELECT session % 7 AS report, tool, count(*) AS calls, count(*) FILTER (WHERE is_error) AS errors, sum(tokens) AS output, max(tokens) AS context FROM tool_calls GROUP BY 1, 2)
SELECT tool, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(output) AS BIGINT) AS output, max(context) AS most, min(context) AS least, round(1 - sum(errors) / sum(calls), 9) AS rate FROM r GROUP BY 1"""))
def merged_reports(spark, d):
    r = table(spark, d, "tool_calls").groupBy((F.col("session") % 7).alias("report"), "tool").agg(F.count("*").alias("calls"), F.sum(F.col("is_error").cast("long")).alias("errors"), F.sum("tokens").alias("output"), F.max("tokens").alias("context"))
    return messages.merge_reports(r)


@query(sql("tool_calls", """, t AS (SELECT session % 12 AS repo, session, floor(pos / 300) AS turn, count(*) AS n FROM tool_calls GROUP BY 1, 2, 3)
SELECT a.repo, sessions, calls, tokens, error_rate, parallel_rate FROM (SELECT session % 12 AS repo, count(DISTINCT session) AS sessions, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, round(avg(CASE WHEN is_error THEN 1 ELSE 0 END), 9) AS error_rate FROM tool_calls GROUP BY 1) a
JOIN (SELECT repo, round(avg(CASE WHEN n >= 2 THEN 1 ELSE 0 END), 9) AS parallel_rate FROM t GROUP BY 1) b ON a.repo = b.repo"""))
def repo_stats(spark, d):
    c = table(spark, d, "tool_calls").withColumn("turn", F.floor(F.col("pos") / 300))
    return messages.repo_stats(c, F.col("session") % 12)


@query(sql("tool_calls", """, f AS (SELECT session, arg_min(tool, pos) AS a, arg_max(tool, pos) AS z FROM tool_calls GROUP BY 1)
SELECT tool, CAST(sum(s) AS BIGINT) AS starts, CAST(sum(e) AS BIGINT) AS ends FROM (SELECT a AS tool, 1 AS s, 0 AS e FROM f UNION ALL SELECT z, 0, 1 FROM f) GROUP BY 1"""))
def session_ends(spark, d):
    return messages.ends(table(spark, d, "tool_calls"))


@query(sql("tool_calls", ", t AS (SELECT session, floor(pos / 300) AS turn, list(tool ORDER BY pos) AS tools FROM tool_calls GROUP BY 1, 2) SELECT session, CAST(turn AS BIGINT) AS turn, CAST(len(tools) - 1 AS INT) AS savings, len(list_filter(tools, lambda x: x NOT IN ('Read', 'Grep'))) = 0 AS safe FROM t"))
def parallel_safe(spark, d):
    c = table(spark, d, "tool_calls").groupBy("session", F.floor(F.col("pos") / 300).alias("turn")).agg(F.array_sort(F.collect_list(F.struct("pos", "tool")))["tool"].alias("tools"))
    return messages.parallel_safe(c).select("session", "turn", "savings", "safe")


@query(sql("turns", ", h AS (SELECT DISTINCT session, turn FROM turns WHERE regexp_matches(text, 'ch')) SELECT DISTINCT t.session, t.turn, t.role FROM turns t JOIN h ON h.session = t.session AND abs(h.turn - t.turn) <= 1"))
def message_context(spark, d):
    t = table(spark, d, "turns")
    return messages.around(t, messages.select(t, grep="ch").select("session", "turn"), 1).select("session", "turn", "role")


@query(sql("turns", "SELECT session, turn, chars FROM turns WHERE role = 'assistant' AND session::VARCHAR LIKE '1%' AND chars BETWEEN 100 AND 3000 AND turn BETWEEN 1 AND 9 AND NOT regexp_matches(text, 'zz') ORDER BY session DESC, turn DESC LIMIT 40"))
def message_search(spark, d):
    return messages.select(table(spark, d, "turns"), role="assistant", session_prefix="1", min_chars=100, max_chars=3000, turn_from=1, turn_to=9, exclude="zz", limit=40, newest_first=True).select("session", "turn", "chars")


@query(sql("tool_calls", "SELECT session, pos FROM tool_calls WHERE CAST(ts AS DATE) >= DATE '2024-01-02' AND ts < TIMESTAMP '2024-01-06' AND is_error"))
def messages_between(spark, d):
    c = table(spark, d, "tool_calls").withColumn("is_error", F.array("is_error"))
    return messages.select(c, since="2024-01-02", until="2024-01-05", errors_only=True).select("session", "pos")


@query(sql("tool_calls", ", t AS (SELECT session, floor(pos / 300) AS turn, list(tool) AS tools FROM tool_calls GROUP BY 1, 2) SELECT session, CAST(turn AS BIGINT) AS turn FROM t WHERE list_contains(tools, 'Edit')"))
def turns_with_tool(spark, d):
    t = table(spark, d, "tool_calls").groupBy("session", F.floor(F.col("pos") / 300).alias("turn")).agg(F.collect_set("tool").alias("tools"))
    return messages.select(t, has_tool="eDi").select("session", "turn")


_SESSIONS = "s AS (SELECT user_id AS session, CASE WHEN user_id % 4 = 0 THEN user_id - 1 END AS parent, count(*) AS calls, CAST(epoch(max(ts)) - epoch(min(ts)) AS BIGINT) AS seconds FROM events GROUP BY 1)"


def _sessions(spark, d):
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = load(spark, d, "events").groupBy(F.col("user_id").alias("session")).agg(F.count("*").alias("calls"), F.round(F.max(t) - F.min(t)).cast("long").alias("seconds"))
    return e.withColumn("parent", F.when(F.col("session") % 4 == 0, F.col("session") - 1))


@query(f"WITH {_SESSIONS} SELECT session, calls, seconds FROM s WHERE parent IS NULL")
def session_list(spark, d):
    return messages.listing(_sessions(spark, d)).select("session", "calls", "seconds")


@query(f"WITH {_SESSIONS} SELECT session, parent, calls FROM s WHERE parent IS NOT NULL")
def subagent_list(spark, d):
    return messages.listing(_sessions(spark, d), "subagent").select("session", "parent", "calls")


@query(f"""
WITH {_SESSIONS}, t AS (SELECT session, CAST(session AS VARCHAR) AS i FROM s)
SELECT session FROM t ORDER BY CASE WHEN i = '143' THEN 0 WHEN starts_with(i, '143') THEN 1 WHEN contains(i, '143') THEN 2 ELSE 3 + levenshtein(i, '143') END, i LIMIT 1
""")
def fuzzy_session(spark, d):
    return messages.fuzzy_id(_sessions(spark, d), "143").select("session")


_BLAME = """WITH c AS (SELECT o_orderkey AS chunk, o_custkey % 30 AS path, epoch(o_orderdate)::BIGINT AS done, 'chunk of ' || (o_orderkey % 60) || ' words' AS text FROM orders),
e AS (SELECT CAST(l_suppkey AS VARCHAR) AS session, l_partkey % 30 AS path, epoch(l_shipdate)::BIGINT AS ts, 'of ' || (l_orderkey % 60) || '  words' AS text FROM lineitem),
x AS (SELECT chunk, path, done, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM c), y AS (SELECT DISTINCT session, path, min(ts) AS ts, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS y FROM e GROUP BY 1, 2, 4),
h AS (SELECT chunk, count(DISTINCT session) AS n, min(session) AS session FROM x JOIN y USING (path) WHERE ts <= done AND (contains(x, y) OR contains(y, x)) GROUP BY 1)
SELECT chunk, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'unattributed' END AS status, CASE WHEN n = 1 THEN CAST(session AS VARCHAR) END AS session FROM c LEFT JOIN h USING (chunk)"""


@query(_BLAME)
def session_blame(spark, d):
    c = _orders(spark, d, "o_orderkey AS chunk", "o_custkey % 30 AS path", "unix_timestamp(o_orderdate) AS at", "'chunk of ' || (o_orderkey % 60) || ' words' AS text")
    e = load(spark, d, "lineitem").selectExpr("cast(l_suppkey as string) AS session", "l_partkey % 30 AS path", "unix_timestamp(l_shipdate) AS ts", "'of ' || (l_orderkey % 60) || '  words' AS text")
    # Of equal edits of a session the earliest decides.
    return messages.attribute_chunks(c, e.groupBy("session", "path", "text").agg(F.min("ts").alias("ts")))


@query("SELECT DISTINCT o_custkey AS session, 'b' || o_custkey % 3 AS branch, substr(md5(CAST(o_custkey % 90 AS VARCHAR)), 1, 8) AS hash FROM orders WHERE o_orderkey % 4 > 0")
def session_commits(spark, d):
    return messages.commits_of_sessions(_orders(spark, d, "o_custkey AS session", "CASE WHEN o_orderkey % 4 > 0 THEN 'ok [b' || (o_custkey % 3) || ' ' || substr(md5(CAST(o_custkey % 90 AS STRING)), 1, 8) || '] done' ELSE 'nothing [here]' END AS text"))


@query("WITH p AS (SELECT o_custkey % 20 AS metric, o_orderkey AS k, o_totalprice AS value FROM orders), x AS (SELECT metric, arg_min(value, k) AS first, arg_max(value, k) AS last FROM p GROUP BY 1) SELECT metric, first, last, round(last - first, 6) AS delta, round(100 * (last - first) / abs(first), 6) AS delta_pct FROM x")
def metric_trends(spark, d):
    return messages.trend(_orders(spark, d, "o_custkey % 20 AS metric", "o_orderkey AS at", "o_totalprice AS value"), "metric")


@query("""
WITH c AS (SELECT o_orderkey AS id, epoch(o_orderdate)::BIGINT AS m FROM orders), s AS (SELECT min(m) AS a, (max(m) - min(m)) / 11 AS step FROM c), t AS (SELECT i, a + step * i AS target FROM s, range(0, 12) r(i)),
x AS (SELECT i, id, m, row_number() OVER (PARTITION BY i ORDER BY abs(m - target), m, id) AS k FROM t, c)
SELECT DISTINCT id, m AS "at" FROM x WHERE k = 1
""")
def history_snapshots(spark, d):
    return messages.snapshots(_orders(spark, d, "o_orderkey AS id", "unix_timestamp(o_orderdate) AS at"), 12)


@query("WITH n AS (SELECT l_partkey AS path, l_suppkey AS author, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY path ORDER BY n DESC, author) AS INT) AS place FROM n) SELECT * FROM r WHERE place <= 3")
def top_authors(spark, d):
    n = load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("path"), F.col("l_suppkey").alias("author")).agg(F.count("*").alias("n"))
    return messages.heaviest(n, "path", "n", 3, "author")


@query(sql("turns", "SELECT session, turn, length(regexp_replace(text, '[^\\p{L}\\p{N}]+', '', 'g')) AS meaningful, trim(regexp_replace(lower(text), '[^\\p{L}\\p{Nl}0-9'']+', ' ', 'g')) AS words, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS squeezed FROM turns"))
def text_normalise(spark, d):
    t = F.col("text")
    return table(spark, d, "turns").select("session", "turn", texts.meaningful(t).alias("meaningful"), texts.for_ngrams(t).alias("words"), texts.squeeze(t).alias("squeezed"))


@query(sql("files", "SELECT path, replace(replace(replace(lower(path), '-', ' '), '.', ' '), '_', ' ') AS loose, CASE WHEN length(path) <= 16 THEN path ELSE '...' || substr(path, length(path) - 12) END AS short, split_part(path, '/', 2) AS repo FROM files"))
def path_normalise(spark, d):
    p = F.col("path")
    return table(spark, d, "files").select("path", texts.loose(p).alias("loose"), texts.truncated(p, 16).alias("short"), texts.repo_name(F.concat(p, F.lit(".git/"))).alias("repo"))


_NAMES = (("createdAt", "created at"), ("created_at", "created at"), ("CreatedAt", "created at"), ("HTTPServerInfo", "http server"), ("user2Name", "user 2 name"), ("DataType", "data"), ("parse-json-data", "parse json"))


@query(f"SELECT o_orderkey AS id, {_pick(_C, [n[1] for n in _NAMES])} AS canonical FROM orders")
def canonical_names(spark, d):
    n = _orders(spark, d, "o_orderkey AS id", f"{_pick(_C, [n[0] for n in _NAMES])} AS name")
    return n.select("id", texts.canonical(F.col("name")).alias("canonical"))


@query("""
WITH m AS (SELECT o_custkey % 25 AS k, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1, 2), s AS (SELECT k, list(coalesce(n, 0) ORDER BY i) AS v FROM (SELECT DISTINCT k FROM m) CROSS JOIN range(1, 13) r(i) LEFT JOIN m USING (k) WHERE m.m IS NULL OR m.m = i GROUP BY 1)
SELECT k, strftime(max(o_orderdate), '%Y-%m') AS last_month, CAST(floor(epoch(max(o_orderdate)) / 604800) AS BIGINT) AS last_week FROM orders JOIN (SELECT DISTINCT k FROM m) ON k = o_custkey % 25 GROUP BY k
""")
def date_buckets(spark, d):
    o = load(spark, d, "orders").groupBy((F.col("o_custkey") % 25).alias("k")).agg(F.max("o_orderdate").alias("at"))
    return o.select("k", texts.month(F.col("at")).alias("last_month"), F.floor(F.unix_timestamp("at") / 604800).alias("last_week"))


@query("SELECT p_partkey AS id, list_reduce(list_prepend('', [substr('▁▂▃▄▅▆▇█', CAST(floor(v * 7 / greatest(p_size, p_partkey % 9, 1)) AS INT) + 1, 1) FOR v IN [p_size, p_partkey % 9, 1]]), lambda a, b: a || b) AS line, repeat('#', CAST(round(p_size / 50.0 * 20) AS INT)) || repeat('-', 20 - CAST(round(p_size / 50.0 * 20) AS INT)) AS bar FROM part")
def sparklines(spark, d):
    p = load(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), texts.sparkline(F.array(F.col("p_size").cast("long"), F.col("p_partkey") % 9, F.lit(1).cast("long"))).alias("line"), texts.progress_bar(F.col("p_size") / 50).alias("bar"))


@query("SELECT p_partkey AS id, 'a\\.b\\(' || p_size || '\\)' AS escaped, 'use ' || p_name || ' for ' || p_brand || ' in $other' AS filled FROM part")
def templates(spark, d):
    p = load(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("id"), texts.regex_escape(F.concat(F.lit("a.b("), F.col("p_size").cast("string"), F.lit(")"))).alias("escaped"),
        texts.fill(F.lit("use $name for $namespace in $other"), {"name": F.col("p_name"), "namespace": F.col("p_brand")}).alias("filled"),
    )


@query("SELECT p_brand AS brand, CASE WHEN count(DISTINCT p_type) = 1 THEN p_brand || '/' || min(p_type) || '/' ELSE p_brand || '/' END AS prefix FROM part GROUP BY 1")
def common_prefixes(spark, d):
    p = load(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.collect_set(F.concat_ws("/", "p_brand", "p_type", "p_name")).alias("paths"))
    return p.select("brand", texts.common_prefix(F.col("paths")).alias("prefix"))


@query(sql("turns", "SELECT session, turn, replace(replace(replace(text, chr(10) || chr(10), chr(1)), chr(10), ' '), chr(1), chr(10) || chr(10)) AS text FROM turns WHERE NOT contains(text, chr(10) || chr(10) || chr(10))"))
def unwrapped(spark, d):
    t = table(spark, d, "turns").where(~F.col("text").contains("\n\n\n"))
    return t.select("session", "turn", texts.unwrap_lines(F.col("text")).alias("text"))
