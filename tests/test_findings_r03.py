"""Findings of round 3, each on a small case that failed before; searches against brute force."""

import random

import pyarrow as pa
import pytest

from sparkloom.operators import breadth_first, graph
from sparkloom.runtime import Scratch


def rows(df):
    return sorted(map(tuple, df.collect()))


def _edges(n=90, m=260):
    """Cycles, self-edges, repeated edges and nodes of one to three digits, some below zero."""
    rng = random.Random(7)
    return [(rng.choice((5, 40, 300)) * rng.randrange(-2, n // 3), rng.choice((5, 40, 300)) * rng.randrange(-2, n // 3)) for _ in range(m)] + [(5, 5), (5, 40), (5, 40), (7001, 7001), (7002, 7003)]


def _far(edges, start):
    """Least steps to each node, the start's own by a cycle; and the least of the shortest paths."""
    depth, level, path, k = {}, {start}, {start: str(start)}, 0
    while level:
        k += 1
        step = [(f"{path[a]}>{b}", b) for a, b in edges if a in level and b not in depth]
        depth |= {b: k for _, b in step}
        path |= {b: min(p for p, x in step if x == b) for _, b in step if b != start}
        level = {b for _, b in step}
    return depth, path


@pytest.fixture
def staged(monkeypatch):
    """Rows of each table that is staged."""
    seen, stage = [], Scratch.stage

    def counted(self, df, *a, **k):
        out = stage(self, df, *a, **k)
        seen.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "stage", counted)
    return seen


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("local", [0, graph.LOCAL])
def test_reach_goes_straight_to_the_result(spark, monkeypatch, staged, local):
    """Before, each level was staged and moved with all before it, and the pairs were made by a join."""
    monkeypatch.setattr(graph, "LOCAL", local)
    edges = _edges()
    e = spark.createDataFrame([*edges, (None, 5), (5, None)], "src long, dst int")
    starts = spark.createDataFrame([(x,) for x in sorted({a for a, _ in edges}) * 2 + [None, 999999]], "src long")
    for most in (0, 2) if local else (0,):
        del staged[:]
        got = graph.reach(e, Scratch(spark, "t"), starts, max_depth=most)
        assert got.schema.simpleString() == "struct<start:bigint,node:int,depth:int>"
        assert rows(got) == sorted((s, n, k) for s in {a for a, _ in edges} for n, k in _far(edges, s)[0].items() if k <= most or not most)
        if local:
            assert staged == [len(set(edges)), 1] and "Exchange" not in _plan(got) and got.rdd.getNumPartitions() > 1


def test_reach_of_nothing(spark):
    e = spark.createDataFrame([], "src long, dst long")
    assert rows(graph.reach(e, Scratch(spark, "t"))) == []
    one = spark.createDataFrame([(1, 2)], "src long, dst long")
    assert rows(graph.reach(one, Scratch(spark, "t"), one.select("dst"))) == []


@pytest.mark.parametrize("local", [0, graph.LOCAL])
def test_blast_radius_keeps_no_levels(spark, monkeypatch, staged, local):
    """Before, each level was staged and moved with all before it; nodes without a row, with two, and that may be tests or not."""
    monkeypatch.setattr(graph, "LOCAL", local)
    edges = _edges()
    e = spark.createDataFrame(edges, "src long, dst long")
    tests = [(n, None if n % 7 == 0 else n % 3 == 0) for n in sorted({n for p in edges for n in p}) for _ in range(1 + (n % 11 == 0)) if n % 4 and n != 7003] + [(None, True), (123456, False)]
    got = graph.blast_radius(e, Scratch(spark, "t"), e.select("src"), spark.createDataFrame(tests, "node long, is_test boolean"))
    want = []
    for start in {a for a, _ in edges}:
        far = [(k, is_test) for n, k in _far(edges, start)[0].items() for x, is_test in tests if x == n != start]
        if far:
            want.append((start, sum(k == 1 for k, _ in far), sum(k > 1 for k, _ in far), max(k for k, _ in far), sum(t is False for _, t in far)))
    assert got.schema.simpleString() == "struct<node:bigint,direct:bigint,transitive:bigint,depth:int,untested:bigint>"
    assert len(want) > 30 and rows(got) == sorted(want)
    if local:
        assert staged == [len(set(edges)), 1] and got.rdd.getNumPartitions() > 1


@pytest.mark.parametrize("local", [0, graph.LOCAL])
def test_shortest_paths_go_straight_to_the_result(spark, monkeypatch, staged, local):
    """Before, the paths of each level were staged. The least path is by text, where 40 is before 5; left out nodes are gone through."""
    monkeypatch.setattr(graph, "LOCAL", local)
    edges = _edges()
    e = spark.createDataFrame(edges, "src long, dst long")
    starts = sorted({a for a, _ in edges})
    out = spark.createDataFrame([(n,) for n in range(-900, 9000, 3)] + [(None,)], "node int")
    for most, without in ((0, None), (3, None), (0, out)) if local else ((0, out),):
        del staged[:]
        got = graph.shortest_paths(e, Scratch(spark, "t"), e.select("src"), max_depth=most, without=without)
        assert got.schema.simpleString() == "struct<start:bigint,node:bigint,depth:int,path:string>"
        want = []
        for s in starts:
            depth, path = _far(edges, s)
            want += [(s, n, k, path[n]) for n, k in depth.items() if n != s and (k <= most or not most) and (without is None or n % 3)]
        assert rows(got) == sorted(want)
        if local:
            assert staged == [len(set(edges)), 1] and "Exchange" not in _plan(got) and got.rdd.getNumPartitions() > 1


def test_paths_of_a_wide_level(monkeypatch):
    """A level of more rows than a batch, and one behind it: batches stay small, and paths lead on from all of it."""
    pairs = [(1, 10_000 + i) for i in range(500)] + [(10_000 + i, 20_000 + i // 2) for i in range(500)]
    monkeypatch.setattr(breadth_first, "_ROWS", 100)
    given = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*[(0, a, b, 0) for a, b in pairs], (1, 1, 0, 0), strict=True)], list("kabc"))
    packed = next(breadth_first._pack(iter([given])))
    one = packed.append_column("share", pa.array([0])).append_column("shares", pa.array([1]))
    got = list(breadth_first._share(iter([one]), breadth_first._paths, ["start", "node", "depth", "path"], 0))
    assert max(b.num_rows for b in got) <= 100
    first = lambda n: min(f"1>{a}>{b}" for a, b in pairs if b == n and a != 1)
    want = [(1, b, 1, f"1>{b}") for a, b in pairs if a == 1] + [(1, n, 2, first(n)) for n in {b for a, b in pairs if a != 1}]
    assert sorted(tuple(r.values()) for b in got for r in b.to_pylist()) == sorted(want)


def test_untested_paths_are_not_joined(spark, small):
    """Before, all paths met the tests in a join."""
    from sparkloom.plans.catalogue import QUERIES
    from sparkloom.plans.registry import part_edges

    got = QUERIES["untested_paths"](spark, small)
    assert got.columns == ["node", "start", "depth", "path"] and not any(x in _plan(got) for x in ("Exchange", "Join"))
    edges = [(r.dst, r.src) for r in part_edges(spark, small).collect()]
    tests = {r.p_partkey for r in spark.read.parquet(f"{small}/part.parquet").collect() if r.p_size % 5 == 0}
    want = []
    for s in {a for a, _ in edges if a % 100 == 0}:
        depth, path = _far(edges, s)
        want += [(n, s, k, path[n]) for n, k in depth.items() if n != s and n not in tests]
    assert want and rows(got) == sorted(want)
