"""Small cases of the findings of round 2, each of which failed before its change."""

from __future__ import annotations

import json
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from sparkloom.datalog import diagnostics
from sparkloom.datalog.engine import evaluate
from sparkloom.datalog.rules import RULES
from sparkloom.llm import mixing, suffix_dedup
from sparkloom.operators import depth_first, facts as joins, graph, messages, similarity, text, vectors
from sparkloom.runtime import Scratch
from sparkloom.sources import exports


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def facts(spark):
    """A public name that is a function on one line and a class on another line of the same file."""
    make = lambda rows, n: spark.createDataFrame(rows, ", ".join(f"c{i} {k}" for i, k in enumerate(n)))
    text = ["string"] * 3
    return {
        "symbol": make([("f", "n", "function", 5), ("f", "n", "class", 9), ("f", "m", "method", 7), ("f", "t", "function", 8)], [*text, "int"]), "visibility": make([("f", x, "public") for x in "nm"], text),
        "call": make([("f", "t", "m", 1), ("g", "a", "m", 2)], [*text, "int"]), "attribute": make([("f", "t", "test")], text), "implements": make([], text), "type_method": make([], text), "parent": make([], text),
    }


def test_missing_test_reports_functions_only(spark, facts):
    assert rows(evaluate(RULES["missing_test"].text, facts, Scratch(spark, "t"))["found"]) == [("f", 5, "n")]


def test_dead_api_reports_functions_only(spark, facts):
    assert rows(evaluate(RULES["dead_api"].text, facts, Scratch(spark, "t"))["found"]) == [("f", 5, "n")]


def test_strict_rules_report_functions_only(spark, facts):
    chosen = diagnostics.select(RULES, tag="quality-gate", enabled_only=False, groups={"quality-gate": ["testing", "correctness"]})
    assert {(r.rule, r.file, r.line, r.message) for r in diagnostics.run_rules(chosen, facts, Scratch(spark, "t")).collect()} == {("missing-test", "f", 5, "n")}


def test_chat_logs_of_long_texts(spark):
    text = 'a "quoted" line\n' * 20_000  # every line has four escapes
    line = json.dumps({"role": "user", "content": text})
    logs = [("a", f"[{line}]"), ("b", json.dumps({"type": "u", "message": {"role": "user", "content": text}}))]
    got = exports.chat_blocks(spark.createDataFrame(logs, "path string, value string"))
    assert rows(got.select("session", "role", "text")) == [("a", "user", text), ("b", "user", text)]


def test_blame_of_many_alike_edits(spark):
    """Chunks and edits that share a path and a text don't meet one by one: before, these were 4 * 10 ** 10 pairs."""
    chunks = spark.range(200_000).selectExpr("id AS chunk", "1 AS path", "id AS at", "'some words here' AS text")
    edits = spark.range(200_000).selectExpr("cast(id AS string) AS session", "1 AS path", "id + 5 AS ts", "'some  words' AS text")
    got = messages.attribute_chunks(chunks, edits)
    assert rows(got.where("chunk < 8").select("chunk", "status", "session")) == [(i, *(("unattributed", None) if i < 5 else ("matched", "0") if i == 5 else ("ambiguous", None))) for i in range(8)]
    assert rows(got.groupBy("status").count()) == [("ambiguous", 199_994), ("matched", 1), ("unattributed", 5)]


def test_blame_by_definition(spark):
    rng = random.Random(4)
    words = ["alpha beta", "alpha beta gamma", "beta gamma", "gamma delta words"]
    chunks = [(i, rng.randrange(3), rng.randrange(12), rng.choice(words)) for i in range(60)]
    edits = [(rng.choice("abc"), rng.randrange(3), rng.randrange(12), rng.choice(words)) for _ in range(14)]
    want = []
    for c, p, at, x in chunks:
        who = {s for s, q, ts, y in edits if q == p and ts <= at and (x in y or y in x)}
        want.append((c, "unattributed" if not who else "matched" if len(who) == 1 else "ambiguous", min(who) if len(who) == 1 else None))
    got = messages.attribute_chunks(spark.createDataFrame(chunks, "chunk int, path int, at int, text string"), spark.createDataFrame(edits, "session string, path int, ts int, text string"))
    assert rows(got) == sorted(want)


def test_callers_of_repeated_rows(spark):
    """Repeated imports and symbols do not multiply: before, the joins made 2 * 10 ** 10 rows here."""
    many = lambda n, **c: spark.range(n).selectExpr(*[f"{v} AS {k}" for k, v in c.items()])
    symbols, imports = many(3000, file="'b'", name="'n'"), many(3000, file="'a'", name="'n'", alias="cast(null AS string)", module="'m'", resolved_file="'b'")
    calls = many(2000, caller_file="'a'", caller_symbol="'s'", callee_name="'n'", callee_qualifier="cast(null AS string)", callee_resolved_file="cast(null AS string)", line="7")
    assert rows(joins.callers(symbols, imports, calls)) == [("b", "n", "a", "s", 7)]


def test_outermost_blocks_of_one_file(spark):
    """Blocks of a file don't meet in pairs: before, these made 10 ** 10."""
    many = spark.range(100_000).selectExpr("id % 2 AS id", "'f' AS file", "id % 40 AS start", "id % 40 + id % 30 AS end")
    plain = [(1, "g", 0, 9), (1, "h", 2, 5), (1, "h", 2, 6), (2, "g", 0, 9), (2, "h", 1, 6), (3, "g", 3, 4), (3, "h", 8, 9)]
    got = similarity.outermost(many.unionByName(spark.createDataFrame(plain, many.schema)))
    assert rows(got.where("file <> 'f'")) == [(1, "g", 0, 9), (2, "g", 0, 9), (2, "h", 1, 6)]
    spans = {(i % 40, i % 40 + i % 30) for i in range(120)}
    left = sorted(s for s in spans if not any(x <= s[0] and y >= s[1] and (x, y) != s for x, y in spans))
    assert rows(got.where("file = 'f'").select("start", "end").distinct()) == left


def test_crowded_windows_stay_packed():
    """Crowded windows go to buckets in packed rows: before, each was a row of its own."""
    body = np.unique(np.random.default_rng(1).integers(97, 105, (5000, suffix_dedup.MATCH), np.uint8), axis=0)
    send = lambda block, least: pa.RecordBatch.from_pylist([{"block": block, "tails": suffix_dedup._pack(body), "ords": suffix_dedup._pack(np.full(len(body), least, "<i8"))}])
    sent = pa.Table.from_batches(suffix_dedup._crowded(iter([send(1, 7), send(2, 9)]), 4))
    assert sent.num_rows == 8
    beaten = {1: 0, 2: 0}
    for b in range(4):
        for r in suffix_dedup._judge_windows(sent.filter(pc.equal(sent["bucket"], b))).to_pylist():
            beaten[r["block"]] += len(suffix_dedup._unpack(r["beaten"], "<u4"))
    assert beaten == {1: 0, 2: len(body)}


def test_search_stages_words_not_pairs(spark, monkeypatch):
    """64 starts share a word of bits: before, each pair of a start and a node was staged."""
    staged, stage = [], Scratch.stage

    def counted(self, df, *a, **k):
        out = stage(self, df, *a, **k)
        staged.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "stage", counted)
    edges = spark.createDataFrame([(i, 1000) for i in range(64)] + [(1000, 2000 + i) for i in range(300)], "src long, dst long")
    got = graph.reach(edges, Scratch(spark, "t"), edges.select("src").where("src < 64"))
    assert rows(got) == sorted([(i, 1000, 1) for i in range(64)] + [(i, 2000 + j, 2) for i in range(64) for j in range(300)])
    assert max(staged) <= 400


def _reaching(pairs):
    """Who each node reaches in one step or more, by brute force."""
    after = {}
    for s, d in pairs:
        after.setdefault(s, set()).add(d)
    out = {}
    for n in {x for p in pairs for x in p}:
        todo, seen = list(after.get(n, ())), set()
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += after.get(x, ())
        out[n] = seen
    return out


@pytest.mark.parametrize("local", [0, 1 << 20])
def test_components_and_totals_by_definition(spark, monkeypatch, local):
    """Both ways to strong components, and from them totals over pivots, on two graphs with a large component each and a third without any."""
    rng = random.Random(7)
    pairs = {(rng.randrange(60), rng.randrange(60)) for _ in range(110)} | {(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(60)} | {(200 + i, 200 + j) for i, j in ((0, 1), (0, 2), (1, 3), (2, 3), (3, 4))}
    pairs = sorted(p for p in pairs if p[0] != p[1])
    reach = _reaching(pairs)
    monkeypatch.setattr(graph, "LOCAL", local)
    e = spark.createDataFrame(pairs, "src int, dst int")
    got = graph.strongly_connected(e, Scratch(spark, "t"))
    assert got.schema.simpleString() == "struct<node:int,component:int>"
    assert rows(got) == sorted((n, min([n, *(m for m in r if n in reach[m])])) for n, r in reach.items())
    if not local:
        return
    want = {n: sum(n in r for m, r in reach.items() if m != n) for n in reach}
    assert rows(graph.dependents(e, Scratch(spark, "t"))) == sorted((n, k) for n, k in want.items() if k)
    cost = {n: n * 13 % 29 for n in reach}
    totals = graph.reachable_totals(e, spark.createDataFrame(list(cost.items()), "node int, cost int"), Scratch(spark, "t"))
    far = {n: [cost[m] for m in r if m != n] for n, r in reach.items()}
    assert rows(totals.select("node", "total", "most")) == sorted((n, cost[n] + sum(x), max(x)) for n, x in far.items() if x)


def test_pairs_across_a_pivot_are_not_made(spark, monkeypatch):
    """200 nodes lead to a cycle that leads to 200 others: before, these made 40000 pairs."""
    staged, stage = [], Scratch.stage

    def counted(self, df, *a, **k):
        out = stage(self, df, *a, **k)
        staged.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "stage", counted)
    pairs = [(1, 2), (2, 3), (3, 1)] + [(1000 + i, 1) for i in range(200)] + [(2, 2000 + i) for i in range(200)]
    got = dict(rows(graph.dependents(spark.createDataFrame(pairs, "src long, dst long"), Scratch(spark, "t"))))
    assert got == {1: 202, 2: 202, 3: 202} | {2000 + i: 203 for i in range(200)}
    assert max(staged) < 1000


def test_depth_first_search_of_deep_graphs():
    """A chain of a million nodes that ends in a cycle: in rounds, each step of it would be one."""
    src = np.arange(1_000_000)
    dst = np.append(src[1:], 999_000)
    nodes, least = depth_first.label(src[::-1].copy(), dst[::-1].copy())
    assert (nodes == src).all() and (least == np.minimum(src, 999_000)).all()


def test_blast_radius_counts_bits(spark, monkeypatch):
    """70 starts by 6 nodes on a cycle and off it: before, there was a row for each pair; and the counts by brute force."""
    monkeypatch.setattr(graph._Levels, "pairs", lambda *_: pytest.fail("pairs are made"))
    edges = [(i, 100) for i in range(70)] + [(100 + i, 101 + i) for i in range(5)] + [(105, 100), (100, 0)]
    e = spark.createDataFrame(edges, "src long, dst long")
    tests = {n: n % 3 == 0 for p in edges for n in p}
    got = graph.blast_radius(e, Scratch(spark, "t"), e.select("src").where("src < 70"), spark.createDataFrame(list(tests.items()), "node long, is_test boolean"))
    far = {n: r - {n} for n, r in _reaching(edges).items() if n < 70}
    assert rows(got) == sorted((n, 1, len(r) - 1, 6, sum(not tests[m] for m in r)) for n, r in far.items())


def test_nearest_of_copies_and_odd_vectors(spark, monkeypatch):
    """Even vectors don't meet through ``cosine`` (before, all did); copies, zeros, nulls and other lengths rank as its scores say."""
    rng = np.random.default_rng(2)
    vectors_ = [[float(x) for x in v] for v in rng.normal(size=(40, 3)).astype("f4")]
    data = [(i, vectors_[i % 40]) for i in range(200)] + [(200, [0.0] * 3), (201, None), (202, [1.0, None, 2.0]), (203, [1.0, 2.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3)
    q = df.where("vec_id % 100 = 0").selectExpr("vec_id AS query", "embedding AS q")
    s = q.crossJoin(df).select("query", "vec_id", F.round(text.cosine(F.col("q"), F.col("embedding")), 6).alias("score")).collect()
    want = [r for x in (0, 100, 200) for r in sorted((tuple(r) for r in s if r["query"] == x), key=lambda r: (-r[2], r[1]))[:10]]
    met, cosine = [], vectors.cosine
    monkeypatch.setattr(vectors, "cosine", lambda a, b: met.append(1) or cosine(a, b))
    assert rows(vectors.nearest(df, q, "vec_id", "embedding")) == sorted(want)
    assert len(met) == 2  # only for the odd ones


@pytest.mark.parametrize("classes", [False, True])
@pytest.mark.parametrize("few", [0, 20_000])
def test_callers_by_definition(spark, monkeypatch, few, classes):
    """Kinds of calls that go to every task and kinds that don't, with nulls, repeated rows and two kinds that lead to one place."""
    monkeypatch.setattr(joins, "_BROADCAST_KINDS", few)
    rng = random.Random(9)
    pick = lambda *x: rng.choice(x)
    symbols = [(pick(*"abc"), pick(*"nmk"), pick("T", "U", None)) for _ in range(14)] + [("a", None, "T"), (None, "n", "T")]
    imports = [(pick(*"abc"), pick("m1", "m2"), pick(*"nmk"), pick("n", "z", None), pick("a", "b", None)) for _ in range(12)]
    calls = [(pick("a", "b", "c", None), pick(*"nmk"), pick("n", "m", "k", "z", None), pick("self", "m1", "m2", None, None), pick("a", "b", None), rng.randrange(6)) for _ in range(160)]
    want = set()
    for f, s, c, q, r, line in calls:
        local = [i for i in imports if i[0] == f]
        ways = {(r, c), (f, c) if q is None else None} | {(i[4], i[2]) for i in local if c == (i[3] or i[2])} | {(i[4], c) for i in local if q == i[1]}
        own = {p for x, n, p in symbols if (x, n) == (f, s) and p}
        want |= {(x, n, f, s, line) for x, n, p in symbols if x and n and ((x, n) in ways or q == "self" and (x, n) == (f, c) and (not classes or p in own))}
    sy = spark.createDataFrame(symbols, "file string, name string, parent string")
    got = joins.callers(sy if classes else sy.drop("parent"), spark.createDataFrame(imports, "file string, module string, name string, alias string, resolved_file string"),
                        spark.createDataFrame(calls, "caller_file string, caller_symbol string, callee_name string, callee_qualifier string, callee_resolved_file string, line int"))
    key = lambda r: [(x is None, x) for x in r]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_callers_meet_one_table(spark):
    """Calls alike but for their lines are resolved once: before, each of the five ways read and joined all calls."""
    one = lambda **c: spark.range(1).selectExpr(*[f"{v} AS {k}" for k, v in c.items()])
    symbols, imports = one(file="'b'", name="'n'"), one(file="'a'", name="'n'", alias="cast(null AS string)", module="'m'", resolved_file="'b'")
    calls = spark.range(4321).selectExpr("'a' AS caller_file", "'s' AS caller_symbol", "if(id % 2 = 0, 'n', 'o') AS callee_name", "cast(if(id % 3 = 0, 'm', null) AS string) AS callee_qualifier", "cast(if(id % 5 = 0, 'b', null) AS string) AS callee_resolved_file", "id AS line")
    got = joins.callers(symbols, imports, calls)
    assert rows(got) == [("b", "n", "a", "s", i) for i in range(0, 4321, 2)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 4321") == 1


def test_mixing_counts_words_in_small_batches(spark, tmp_path, monkeypatch):
    """Before, the scan of texts decoded 4096 at once and made an object a word, and slim rows went to one file for each of 64 partitions."""
    rng = random.Random(4)
    texts = ["", None, " \t", "a", " a b\t\tc\n", "é x\u3000y z", "\v\f\r\x1c\x1fq"] + ["".join(rng.choice("ab é\t\n 😀") for _ in range(rng.randrange(60))) for _ in range(600)]
    size = lambda t: len(re.findall(mixing.WORD, t or ""))
    spark.createDataFrame([(i, t, f"s{i % 3}") for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(7).write.parquet(f"{tmp_path}/d")
    key, stage, seen = "spark.sql.parquet.columnarReaderBatchSize", Scratch.stage, []

    def staged(self, df, *args, **kw):
        out = stage(self, df, *args, **kw)
        seen.append((int(spark.conf.get(key)), "regexp" in df._jdf.queryExecution().optimizedPlan().toString(), len(out.inputFiles())))
        return out

    monkeypatch.setattr(Scratch, "stage", staged)
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in (*held, key)}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = mixing.draw(spark.read.parquet(f"{tmp_path}/d")).collect()
        assert spark.conf.get(key) == before[key]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.doc_id, r.size) for r in got) == [(i, size(t)) for i, t in enumerate(texts)]
    rows_at, by_regexp, files = seen[0]
    assert rows_at <= 256 and not by_regexp and files <= spark.sparkContext.defaultParallelism
    for kind in (pa.string(), pa.large_string()):
        for a in (pa.array(texts, kind), pa.array(texts, kind).slice(3, 200), pa.array([None, ""], kind), pa.array([], kind)):
            assert mixing.words(a).tolist() == [size(t) for t in a.to_pylist()]
