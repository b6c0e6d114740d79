"""Characterisation cases of the graph, rule, history and gate operators."""

import random
import re
from inspect import signature

import duckdb
import pytest

from sparkloom.datalog import diagnostics, engine
from sparkloom.functions import globs
from sparkloom.datalog.rules import RULES
from sparkloom.operators import facts, gates, graph, history, sessions, text
from sparkloom.operators.components import connected_components
from sparkloom.plans import catalogue, rule_queries
from sparkloom.runtime import Scratch


def edges(spark, *pairs):
    return spark.createDataFrame([tuple(p) for p in pairs], "src string, dst string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_components(spark):
    e = edges(spark, "ab", "cb", "de", ("f", None), "gg")
    assert rows(connected_components(e, Scratch(spark, "t"))) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("g", "g")]
    assert rows(connected_components(edges(spark, "ab").where("false"), Scratch(spark, "t"))) == []


def test_strong_components(spark):
    got = rows(graph.strongly_connected(edges(spark, "pq", "qr", "rp", "rx", "xy", "yx", "yz", "ww"), Scratch(spark, "t")))
    assert got == [("p", "p"), ("q", "p"), ("r", "p"), ("w", "w"), ("x", "x"), ("y", "x"), ("z", "z")]


def test_diamond_and_redundant(spark):
    assert rows(graph.diamonds(edges(spark, "tm", "tn", "tk", "mu", "nu", "ku", "uv"))) == [("t", "k", "m", "u"), ("t", "k", "n", "u"), ("t", "m", "n", "u")]
    assert rows(graph.redundant(edges(spark, "pq", "qr", "pr", "ps", "sr", "rt"))) == [("p", "r", "q")]


@pytest.mark.parametrize(("pairs", "want"), [(["mn", "no", "np"], ["mn", "no", "np"]), (["mn", "no", "op", "pm"], []), (["mn", "nm", "no"], ["no"]), (["mn", "no", "om", "xy", "yz", "zx", "ox"], ["ox"])])
def test_bridges(spark, pairs, want):
    assert rows(graph.bridges(edges(spark, *pairs), Scratch(spark, "t"))) == [tuple(w) for w in want]


def test_longest_chain(spark):
    assert rows(graph.longest_chain(edges(spark, "pq", "qr", "rs", "ps", "st", "xy", "yt", "tu"), Scratch(spark, "t"))) == [("u", 6)]
    assert rows(graph.longest_chain(edges(spark, "pq", "qp", "qr", "rs"), Scratch(spark, "t"))) == []


def test_datalog_cycle_and_count(spark):
    imports = spark.createDataFrame([("a", "b", "x"), ("b", "a", "x"), ("c", "d", "x")], "f string, t string, n string")
    text_ = "reaches(a, b) <-- import(a, b, _); reaches(a, c) <-- reaches(a, b), import(b, c, _); found(a, b) <-- reaches(a, b), reaches(b, a), if a < b;"
    assert rows(engine.evaluate(text_, {"import": imports}, Scratch(spark, "t"))["found"]) == [("a", "b")]
    symbols = spark.createDataFrame([("big.py", f"s{i}") for i in range(3)] + [("small.py", "s")], "f string, n string")
    out = engine.evaluate("found(f) <-- symbol(f, _), agg n = count() in symbol(f, _), if n > 2;", {"symbol": symbols}, Scratch(spark, "t"))
    assert rows(out["found"]) == [("big.py",)]


def test_datalog_checks():
    assert engine.check("found(x, y) <-- a(x), !b(x, z);", {"a": 1, "found": 2}) == ["unknown relation b", "y in the head of found is not bound"]
    with pytest.raises(engine.DatalogError):
        engine.strata(engine.parse("p(x) <-- a(x), !p(x);")[1])


def test_ownership(spark):
    lines = spark.createDataFrame([("f", "a", 3), ("f", "b", 2), ("f", "c", 1)], "path string, author string, n long")
    assert rows(history.ownership(lines)) == [("f", 6, 3, "a", 50.0, 2)]


def test_ratchet_and_median(spark):
    now, old = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "k string, v double"), spark.createDataFrame([("a", 1.0), ("c", 1.0)], "k string, v double")
    assert {(r.k, r.status) for r in gates.ratchet(now, old, "k", "v").collect()} == {("a", "regressed"), ("b", "new"), ("c", "missing")}
    points = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (float("nan"),)], "value double")
    assert gates.aggregates(points).first()["median"] == 2.5


def test_rerank(spark):
    from pyspark.sql import functions as F

    v = spark.createDataFrame([(1, [1.0, 0.0, 0.0], 0.0), (2, [0.0, 1.0, 0.0], 0.0), (3, [0.9, 0.4, 0.0], 0.5)], "id int, v array<double>, s double")
    q = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))
    assert text.rerank(v, text.cosine(F.col("v"), q), F.col("s"), 3, "id").first()["id"] == 1


def test_words_of(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([("createdAt",), ("HTTPServer_name",), ("a-kebab",)], "n string").select(text.words_of(F.col("n")).alias("w")).collect()
    assert [r.w for r in got] == [["created", "at"], ["http", "server", "name"], ["kebab"]]


def test_runs_and_nearest(spark):
    e = spark.createDataFrame([(1, i, t) for i, t in enumerate("aaab")], "session int, pos int, tool string")
    assert rows(sessions.runs(e)) == [(1, "a", 0, 3)]
    spine, shots = spark.createDataFrame([("k", 5), ("k", 9)], "k string, at long"), spark.createDataFrame([("k", 3), ("k", 7)], "k string, t long")
    assert rows(facts.nearest(spine, shots, "k", "at", "t")) == [("k", 5, 3), ("k", 9, 7)]
    rng = random.Random(2)
    wanted, at = [(rng.choice("ab"), rng.randint(-50, 1050)) for _ in range(60)], sorted({(rng.choice("ab"), rng.randint(0, 1000)) for _ in range(25)})
    got = facts.nearest(spark.createDataFrame(wanted, "k string, at long"), spark.createDataFrame(at, "k string, t long"), "k", "at", "t", cells=7)
    near = lambda k, x: min((t for c, t in at if c == k), key=lambda t: (abs(t - x), t))
    assert rows(got) == sorted((k, x, near(k, x)) for k, x in wanted)


def _norm(value):
    if value is None or value != value:
        return "~"
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0)
    if isinstance(value, bool):
        return str(value)
    return repr(float(value)) if isinstance(value, int) else str(value)


@pytest.mark.parametrize("name", ["cochange_pairs", "ownership_bus_factor", "hotspots", "coupling_hubs", "redundant_edges", "depth_map", "callers_union5", "transitions", "subsequence_patterns", "kl_divergence", "knn_cosine", "dl_missing_impl", "dl_circular_deps"])
def test_oracle(spark, small, name):
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, small).toPandas()
    want = c.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    fold = lambda df: sorted(tuple(_norm(v) for v in r) for r in df[cols].astype(object).itertuples(index=False, name=None))
    assert fold(got) == fold(want)


def brute_reach(pairs):
    """For each node the others it reaches, by steps."""
    out = {}
    for start in {x for p in pairs for x in p}:
        depth, front = {start: 0}, [start]
        while front:
            front = sorted({b for a, b in pairs if a in front} - set(depth))
            depth |= {b: max(depth.values()) + 1 for b in front}
        out[start] = depth
    return out


def test_graphs(spark, tmp_path):
    rng = random.Random(7)
    lines = [(o, n, rng.randint(1, 30), rng.choice("RRN")) for o in range(24) for n in range(1, 4)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(i, f"B{i % 4}", i % 5 + 1) for i in range(1, 34)], "p_partkey long, p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    by = {(o, n): p for o, n, p, _ in lines}
    pairs = {(p, by[o, n + 1]) for o, n, p, flag in lines if flag == "R" and (o, n + 1) in by and p != by[o, n + 1]}
    far = brute_reach(pairs)
    run = lambda name: rows(catalogue.QUERIES[name](spark, str(tmp_path)))
    strong = {n: min(m for m in far[n] if n in far[m]) for n in far}
    assert len(set(strong.values())) < len(far)  # it has cycles
    assert run("scc") == sorted(strong.items())
    count = {n: sum(n in far[m] for m in far) - 1 for n in far}
    assert run("dependents") == sorted((n, c) for n, c in count.items() if c)
    assert run("graph_stats")[0][:2] == (len(far), len(pairs))
    assert run("dead_nodes") == sorted({(a,) for a, _ in pairs} - {(b,) for _, b in pairs})
    assert run("orphan_nodes") == [(i,) for i in range(1, 34) if i not in far]
    both = pairs | {(b, a) for a, b in pairs}
    weak = brute_reach(both)
    assert run("wcc") == sorted((n, min(weak[n])) for n in weak)
    folded = {(strong[a], strong[b]) for a, b in pairs if strong[a] != strong[b]}
    longest = lambda n: max((1 + longest(a) for a, b in folded if b == n), default=0)
    assert run("depth_map") == sorted((n, longest(strong[n])) for n in far)
    size = {i: i % 5 + 1 for i in range(1, 34)}
    total = {n: (sum(size[m] for m in far[n]), max((size[m] for m in far[n] if m != n), default=0)) for n in far if len(far[n]) > 1}
    assert [r[:3] for r in run("reachable_sum")] == sorted((n, *x) for n, x in total.items())
    single = [(a, b) for a, b in pairs if (b, a) not in pairs and b not in brute_reach(both - {(a, b), (b, a)} | {(a, a)})[a]]
    assert run("bridges") == sorted(single)


def test_reach_from_starts(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")]
    e = spark.createDataFrame(pairs, "src string, dst string")
    far = brute_reach(set(pairs))
    starts = spark.createDataFrame([("a",), ("x",)], "src string")
    assert rows(graph.reach(e, Scratch(spark, "t"), starts)) == [("a", "a", 3), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("x", "y", 1)]
    assert rows(graph.shortest_paths(e, Scratch(spark, "t"), starts, max_depth=0)) == sorted((s, n, d, ">".join({"b": "ab", "c": "abc", "d": "abcd", "y": "xy"}[n])) for s in "ax" for n, d in far[s].items() if d)


def test_rule_facts_are_whole(spark, small):
    got = rule_queries.relations(spark, small, {"cfg_edge", "call", "symbol"})
    events, orders = (spark.read.parquet(f"{small}/{t}.parquet").collect() for t in ("events", "orders"))
    assert {r.c1 for r in got["cfg_edge"].collect()} == {f"g{r.user_id}" for r in events}
    assert got["call"].count() == len({(r.o_custkey % 12, r.o_custkey % 100 * 7 % 701, r.o_orderkey % 620, r.o_orderkey % 90) for r in orders})


@pytest.mark.parametrize(("rule", "limit"), [("fan_out", 50), ("hub_file", 30), ("god_file", 50), ("god_class", 20)])
def test_thresholds(spark, rule, limit):
    sizes = {"big": limit + 1, "even": limit, "small": 5}
    each = [(f, i) for f, n in sizes.items() for i in range(n)]
    facts_ = {
        "call": spark.createDataFrame([(f, "c", f"s{i}", i) for f, i in each], "c0 string, c1 string, c2 string, c3 int"),
        "import": spark.createDataFrame([(f"x{i}", f, "n") for f, i in each], "c0 string, c1 string, c2 string"),
        "symbol": spark.createDataFrame([(f, f"s{i}", "method" if rule == "god_class" else "function", i) for f, i in each], "c0 string, c1 string, c2 string, c3 int"),
        "parent": spark.createDataFrame([(f, f"s{i}", "C") for f, i in each], "c0 string, c1 string, c2 string"),
    }
    name = {"fan_out": "c", "god_class": "C"}.get(rule)
    if name:  # findings stand at the symbol that they name
        facts_["symbol"] = facts_["symbol"].union(spark.createDataFrame([(f, name, "class", 9) for f in sizes], facts_["symbol"].schema))
    found = rows(diagnostics.run_rule(rule, RULES[rule], facts_, Scratch(spark, "t")))
    assert [(r[2] or r[4], r[3]) for r in found] == [("big", 9 if name else 0)] and {r[:2] for r in found} == {("warning", rule.replace("_", "-"))}


def test_rule_files(spark):
    text_ = '# ---\n# id = "big-file"\n# severity = "error"\n# tags = ["size"]\n# allow = ["**/gen/**"]\n# enabled = false\n# ---\nfound(f, 0, f) <-- symbol(f, n), if n == "a" || n == "b" && f != "z";'
    name, rule = diagnostics.read_rule(text_, "x")
    assert (name, rule.severity, rule.tags, rule.allow, rule.enabled) == ("big-file", "error", ("size",), ("**/gen/**",), False)
    assert diagnostics.read_rule("# ---\n# id = \n# ---\n", "x") is None
    symbols = spark.createDataFrame([("src/a", "a"), ("src/gen/b", "a"), ("z", "b"), ("c", "c"), ("d", "b")], "f string, n string")
    found = diagnostics.run_rule(name, rule, {"symbol": symbols}, Scratch(spark, "t"))
    assert [(r.severity, r.rule, r.file) for r in found.orderBy("file").collect()] == [("error", "big-file", "d"), ("error", "big-file", "src/a")]
    lines = spark.createDataFrame([("d", 3, "# allow: big-file"), ("src/a", 11, "# allow: big-file")], "file string, line int, text string")
    assert [r.file for r in diagnostics.suppressed(found, lines).collect()] == ["src/a"]
    assert diagnostics.select({name: rule}) == {} and list(diagnostics.select({name: rule}, "big", switch={name: True}, groups={"big": ["size", "big"]})) == [name]
    assert diagnostics.local(rule) and diagnostics.local(RULES["god_file"]) and not diagnostics.local(RULES["circular_deps"])


@pytest.mark.parametrize(("glob", "hits", "misses"), [("**/tests/**", ["tests/a", "x/tests/b/c"], ["test/a"]), ("*.py", ["a.py", "x/b.py"], ["a.pyc"]), ("src/*.rs", ["src/a.rs"], ["src/x/a.rs"]), ("docs/", ["docs/a/b"], ["doc/a"]), ("a.{ts,js}", ["a.ts", "x/a.js"], ["a.tsx"]), ("[!a]b", ["cb"], ["ab"])])
def test_globs(glob, hits, misses):
    assert all(re.search(globs.to_regex(glob), h) for h in hits) and not any(re.search(globs.to_regex(glob), m) for m in misses)


def test_depth_is_not_cut(spark, monkeypatch):
    monkeypatch.setattr(graph, "MERGE", 3)
    e = edges(spark, "ab", "bc", "cd", "de", "ef", "fg")
    assert rows(graph.reach(e, Scratch(spark, "t"), max_rounds=6)) == [(a, b, ord(b) - ord(a)) for a in "abcdef" for b in "bcdefg" if a < b]
    assert rows(graph.longest_depth(e, Scratch(spark, "t"), max_rounds=6)) == rows(graph.longest_depth(e, Scratch(spark, "t"))) == [(x, i) for i, x in enumerate("abcdefg")]
    for f in (graph.reach, graph.longest_depth):
        assert signature(f).parameters["max_rounds"].default == 0
        with pytest.raises(RuntimeError):
            f(e, Scratch(spark, "t"), max_rounds=5)
