"""Graph analytics over an edge table (src, dst).

Loops stage their frontier in the shared folder each round, so plans stay short and a lost executor rereads
files. Bounded-depth results stop at the depth they are asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T

from sparkloom.runtime import Scratch, partitions

#: Rounds after which what was found is written as one table, so that plans of deep graphs stay short.
MERGE = 50
#: Edges of a graph that one worker searches; more take rounds over all workers.
LOCAL = 8 << 20


def clean(edges: DataFrame, loops: bool = False) -> DataFrame:
    """Distinct edges without nulls, and without self-edges unless ``loops``."""
    out = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    return out if loops else out.where("src <> dst")


def cleaned(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct edges without nulls, staged; a table that this has made is given back as it is."""
    if getattr(edges, "_cleaned", False):
        return edges
    out = scratch.stage(clean(edges, loops=True))
    out._cleaned = True
    return out


def _local(edges: DataFrame, starts: DataFrame) -> bool:
    """Whether one worker can search the staged ``edges``: between whole numbers, and up to ``LOCAL``."""
    whole = all(isinstance(f.dataType, T.IntegralType) for f in (*edges.schema, *starts.schema))
    return whole and edges.count() <= LOCAL


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out, instability): out over all, half where there is neither."""
    both = edges.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    out = both.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return out.withColumn("instability", F.round(F.col("fan_out") / (F.col("fan_in") + F.col("fan_out")), 9))


def hubs(edges: DataFrame, least: int = 3) -> DataFrame:
    """(node, fan_in, fan_out, score) of nodes with both at least ``least``; score is their product."""
    return degrees(edges).where((F.col("fan_in") >= least) & (F.col("fan_out") >= least)).select("node", "fan_in", "fan_out", (F.col("fan_in") * F.col("fan_out")).alias("score"))


def dead_nodes(edges: DataFrame) -> DataFrame:
    """Nodes that point somewhere and are pointed at from nowhere."""
    return edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def mutual(edges: DataFrame) -> DataFrame:
    """(a, b), a < b, with edges both ways."""
    return edges.where("src < dst").join(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi").toDF("a", "b")


def diamonds(edges: DataFrame) -> DataFrame:
    """(top, low, high, bottom): top reaches bottom through both low < high."""
    two = edges.toDF("top", "mid").join(edges.toDF("mid", "bottom"), "mid").where("top <> bottom and mid <> top and mid <> bottom")
    return two.withColumnRenamed("mid", "low").join(two.withColumnRenamed("mid", "high"), ["top", "bottom"]).where("low < high").select("top", "low", "high", "bottom")


def redundant(edges: DataFrame) -> DataFrame:
    """(src, dst, via): edges that a path of two edges bypasses, with the least node on one."""
    two = edges.toDF("src", "via").join(edges.toDF("via", "dst"), "via").where("via <> src and via <> dst")
    return two.join(edges, ["src", "dst"], "left_semi").groupBy("src", "dst").agg(F.min("via").alias("via"))


class _Levels:
    """Breadth-first levels from many starts at once, 64 starts to a word of bits.

    ``starts`` is (start, block, bit), neighbours in order in one word; each level (node, block, bits) has the bits of
    the starts that reach the node first there, so pairs of starts and nodes are only made by ``pairs``.
    """

    def __init__(self, edges: DataFrame, scratch: Scratch, starts: DataFrame) -> None:
        self.edges, self.scratch = edges, scratch
        given = scratch.stage(starts.toDF("start").where("start is not null").distinct())
        parts = max(1, min(partitions(scratch.spark), given.count() >> 12))
        place = F.monotonically_increasing_id()  # the partition above 33 bits of row
        numbered = given.repartitionByRange(parts, "start").sortWithinPartitions("start").withColumn("i", place)
        self.starts = scratch.stage(numbered.select("start", F.shiftright("i", 6).alias("block"), F.expr("cast(i & 63 AS int)").alias("bit")))
        self.seen: DataFrame | None = None

    def own(self) -> DataFrame:
        """The starts themselves as a level."""
        return self.starts.select(F.col("start").alias("node"), "block", F.expr("shiftleft(1L, bit)").alias("bits"))

    def next(self, level: DataFrame) -> DataFrame:
        """The level behind ``level``: what its nodes' edges reach and no level returned before has."""
        step = level.join(self.edges, level["node"] == self.edges["src"]).select(F.col("dst").alias("node"), "block", "bits", F.lit(0).cast("long").alias("old"))
        if self.seen is not None:
            step = step.unionByName(self.seen.select("node", "block", F.lit(0).cast("long").alias("bits"), F.col("bits").alias("old")))
        fresh = step.groupBy("node", "block").agg(F.bit_or("bits").alias("bits"), F.bit_or("old").alias("old")).select("node", "block", F.expr("bits & ~old").alias("bits")).where("bits <> 0")
        fresh = self.scratch.stage(fresh)
        self.add(fresh)
        return fresh

    def add(self, level: DataFrame) -> None:
        self.seen = level if self.seen is None else self.seen.unionByName(level)

    def merge(self) -> None:
        """One row for each node and word seen, as one table."""
        self.seen = self.scratch.stage(self.seen.groupBy("node", "block").agg(F.bit_or("bits").alias("bits")))

    def pairs(self, levels: DataFrame) -> DataFrame:
        """``levels`` with a row (start ...) for each bit in place of block and bits."""
        both = levels.join(self.starts, "block").where("(bits & shiftleft(1L, bit)) <> 0")
        return both.select("start", *[c for c in levels.columns if c not in ("block", "bits")])


def _search(edges: DataFrame, scratch: Scratch, starts: DataFrame, max_depth: int = 0, max_rounds: int = 0) -> tuple[_Levels, DataFrame]:
    """The levels from ``starts`` over staged edges, and (node, block, bits, depth) of all of them."""
    levels = _Levels(edges, scratch, starts)
    front, depth = levels.next(levels.own()), 1
    found = front.withColumn("depth", F.lit(depth))
    while depth != max_depth:
        depth += 1
        front = levels.next(front)
        if front.isEmpty():
            break
        if depth > max_rounds > 0:
            raise RuntimeError(f"some nodes are farther than {max_rounds} steps")
        found = found.unionByName(front.withColumn("depth", F.lit(depth)))
        if depth % MERGE == 0:
            levels.merge()
            found = scratch.stage(found)
    return levels, found


def reach(edges: DataFrame, scratch: Scratch, starts: DataFrame | None = None, max_depth: int = 0, max_rounds: int = 0) -> DataFrame:
    """(start, node, depth): the nodes reachable from each start (each source by default) in one step or more, by least depth.

    Up to ``LOCAL`` edges between whole numbers are searched by tasks that each hold all of them; larger graphs in
    rounds, of which more than ``max_rounds`` are an error, where it isn't 0.
    """
    edges = cleaned(edges, scratch)
    starts = edges.select("src") if starts is None else starts
    if not max_rounds and _local(edges, starts):
        from sparkloom.operators.breadth_first import depths

        return depths(edges, scratch, starts, max_depth).select(F.col("start").cast(starts.schema[0].dataType), F.col("node").cast(edges.schema["dst"].dataType), "depth")
    levels, found = _search(edges, scratch, starts, max_depth, max_rounds)
    return levels.pairs(found).select("start", "node", "depth")


def closure(edges: DataFrame, scratch: Scratch, max_rounds: int = 40) -> DataFrame:
    """(src, dst) of all paths, by doubling: as many rounds as the logarithm of the longest shortest path."""
    now = scratch.stage(clean(edges, loops=True))
    size = now.count()
    for _ in range(max_rounds):
        longer = now.toDF("src", "m").join(now.toDF("m", "dst"), "m").select("src", "dst")
        now = scratch.stage(now.unionByName(longer).distinct())
        if (n := now.count()) == size:
            return now
        size = n
    raise RuntimeError(f"the closure did not settle in {max_rounds} rounds")


def trim(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges on or between cycles: nodes without an edge in or out go, again and again."""
    now = scratch.stage(clean(edges))
    size = now.count()
    while size:
        kept = now.join(now.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst")
        kept = kept.join(now.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        after = scratch.stage(kept)
        n = after.count()
        if n == size:
            return after
        now, size = after, n
    return now


def _least_reaching(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, colour): the least node from which the node is reached, itself included."""
    now = scratch.stage(nodes(edges).select("node", F.col("node").alias("colour"), F.lit(True).alias("moved")))
    while not now.where("moved").isEmpty():
        pushed = now.where("moved").join(edges, F.col("node") == edges["src"]).groupBy("dst").agg(F.min("colour").alias("c"))
        after = now.join(pushed, now["node"] == pushed["dst"], "left").select("node", F.least("colour", "c").alias("colour"), F.coalesce(F.col("c") < F.col("colour"), F.lit(False)).alias("moved"))
        after = scratch.stage(after)
        scratch.drop(now)
        now = after
    return now.select("node", "colour")


def strongly_connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): nodes that reach each other, named by the least.

    Up to ``LOCAL`` edges between whole numbers are searched depth first by one worker. In larger graphs, after a trim
    each node is coloured by the least node that reaches it; what reaches that node within the colour is its component.
    The rest goes into the next round. No pairs of nodes are made; a node with an edge to itself alone is a component of
    its own.
    """
    given = cleaned(edges, scratch)
    kind = nodes(given).schema["node"].dataType
    if isinstance(kind, T.IntegralType) and given.count() <= LOCAL:
        from sparkloom.operators.depth_first import components

        return components(given).select(F.col("node").cast(kind).alias("node"), F.col("component").cast(kind).alias("component"))
    left, found = trim(given, scratch), None
    while not left.isEmpty():
        colour = _least_reaching(left, scratch)
        inner = left.join(colour.toDF("src", "component"), "src").join(colour.toDF("dst", "other"), "dst").where("component = other")
        inner = scratch.stage(inner.select("src", "dst", "component"))
        front = members = scratch.stage(colour.where("node = colour").toDF("node", "component"))
        while not front.isEmpty():
            step = front.select(F.col("node").alias("dst")).join(inner, "dst").select(F.col("src").alias("node"), "component").distinct()
            front = scratch.stage(step.join(members, "node", "left_anti"))
            members = members.unionByName(front)
        members = scratch.stage(members)
        found = members if found is None else found.unionByName(members)
        rest = inner.join(members.select(F.col("node").alias("src")), "src", "left_anti").join(members.select(F.col("node").alias("dst")), "dst", "left_anti")
        left = trim(rest, scratch)
    if found is None:
        return nodes(given).select("node", F.col("node").alias("component"))
    return nodes(given).join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def fold(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(src, dst) between the strong components ``parts``; no cycles are left."""
    return clean(edges.join(parts.toDF("src", "a"), "src").join(parts.toDF("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst")))


def _reached(edges: DataFrame, starts: DataFrame, scratch: Scratch) -> DataFrame:
    """(node): the starts (node) and all that edges lead to from them."""
    front = found = scratch.stage(starts)
    depth = 0
    while not front.isEmpty():
        depth += 1
        step = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        front = scratch.stage(step.join(found, "node", "left_anti"))
        found = found.unionByName(front)
        if depth % MERGE == 0:
            found = scratch.stage(found)
    return found


def over_ancestors(folded: DataFrame, own: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, sum, top): the sum and the largest of what all nodes that reach the node have; ``folded`` has no cycles.

    ``own`` is (node, n, sum, top), n the nodes a component stands for. In each weak component the largest strong one is
    a pivot. What it reaches is reached by all that reach the pivot, and by what still reaches it with those taken out;
    the rest is never reached from the pivot and is closed over without what is. So pairs across a pivot are not made.
    """
    from sparkloom.operators.components import connected_components

    folded = scratch.stage(folded)
    weak = scratch.stage(connected_components(folded, scratch).toDF("node", "weak").join(own, "node"))
    pivots = scratch.stage(weak.where("n > 1").groupBy("weak").agg(F.max_by("node", F.struct("n", "node")).alias("node")).select("node"))
    back = folded.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    below, above = (_reached(e, pivots, scratch).withColumn(c, F.lit(True)) for e, c in ((folded, "below"), (back, "above")))
    weak = scratch.stage(weak.join(below, "node", "left").join(above, "node", "left").fillna(False, ["below", "above"]))
    without = lambda c: folded.join(weak.where(c).select(F.col("node").alias("src")), "src", "left_anti").join(weak.where(c).select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
    under = closure(without("above"), scratch).join(weak.where("below").select(F.col("node").alias("dst")), "dst", "left_semi")
    pairs = under.select("src", "dst").unionByName(closure(without("below"), scratch))
    near = pairs.join(own.select(F.col("node").alias("src"), "sum", "top"), "src").select(F.col("dst").alias("node"), "sum", "top")
    side = lambda c: weak.where(c).groupBy("weak").agg(F.sum("sum").alias("sum"), F.max("top").alias("top"))
    far = weak.where("below and not above").select("node", "weak").join(side("above"), "weak")
    at = weak.where("below and above").select("node", "weak").join(side("above and not below"), "weak")
    every = near.unionByName(far.select("node", "sum", "top")).unionByName(at.select("node", "sum", "top"))
    return every.groupBy("node").agg(F.sum("sum").alias("sum"), F.max("top").alias("top"))


def dependents(edges: DataFrame, scratch: Scratch, parts: DataFrame | None = None) -> DataFrame:
    """(node, dependents): how many other nodes reach the node, where any do; only strong components are looked at.

    ``parts`` are the edges' strong components, if they are there already.
    """
    edges = cleaned(edges, scratch)
    parts = scratch.stage(strongly_connected(edges, scratch)) if parts is None else parts
    size = scratch.stage(parts.groupBy(F.col("component").alias("node")).agg(F.count("*").alias("n")))
    before = over_ancestors(fold(edges, parts), size.select("node", "n", F.col("n").alias("sum"), F.col("n").alias("top")), scratch)
    total = size.join(before, "node", "left").select(F.col("node").alias("component"), (F.col("n") - 1 + F.coalesce("sum", F.lit(0))).alias("dependents"))
    return parts.join(total, "component").where("dependents > 0").select("node", "dependents")


def longest_depth(edges: DataFrame, scratch: Scratch, max_rounds: int = 0, parts: DataFrame | None = None) -> DataFrame:
    """(node, depth): edges on the longest path that ends at the node; nodes of one cycle count as one.

    More than ``max_rounds`` edges are an error, where it isn't 0. ``parts`` are the edges' strong components, if they are there already.
    """
    edges = cleaned(edges, scratch)
    parts = scratch.stage(strongly_connected(edges, scratch)) if parts is None else parts
    folded = scratch.stage(fold(edges, parts))
    now = scratch.stage(parts.select(F.col("component").alias("node")).distinct().withColumn("depth", F.lit(0)))
    front, depth = now, 0
    while True:
        depth += 1
        front = scratch.stage(front.join(folded, front["node"] == folded["src"]).select(F.col("dst").alias("node")).distinct().withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        if depth > max_rounds > 0:
            raise RuntimeError(f"some paths are longer than {max_rounds} edges")
        now = now.unionByName(front)
        if depth % MERGE == 0:
            now = scratch.stage(now)
    top = now.groupBy("node").agg(F.max("depth").alias("depth"))
    return parts.join(top.toDF("component", "depth"), "component").select("node", "depth")


def blast_radius(edges: DataFrame, scratch: Scratch, starts: DataFrame, tests: DataFrame) -> DataFrame:
    """(node, direct, transitive, depth, untested): how many others lie one step back, and farther; how many are no tests.

    ``edges`` are turned round, and ``tests`` is (node, is_test). Up to ``LOCAL`` edges between whole numbers are searched
    by tasks that each hold all of them; in larger graphs each bit of the words is counted. Pairs of starts and nodes are not made.
    """
    edges = cleaned(edges, scratch)
    if _local(edges, starts) and isinstance(tests.schema["node"].dataType, T.IntegralType):
        from sparkloom.operators.breadth_first import totals

        counts = tests.groupBy("node").agg(F.count("*").alias("all"), F.count_if(~F.col("is_test")).alias("untested"))
        out = totals(edges, scratch, starts, counts)
        return out.select(F.col("node").cast(starts.schema[0].dataType), F.col("near").alias("direct"), F.col("far").alias("transitive"), "depth", F.col("other").alias("untested"))
    levels, found = _search(edges, scratch, starts)
    own = levels.starts.select(F.col("start").alias("node"), "block", F.expr("shiftleft(1L, bit)").alias("self")).groupBy("node", "block").agg(F.bit_or("self").alias("self"))
    others = found.join(own, ["node", "block"], "left").select("node", "block", "depth", F.expr("bits & ~coalesce(self, 0L)").alias("bits")).join(tests, "node")
    words = others.groupBy("block", "depth", "is_test").agg(*[F.sum(F.expr(f"shiftright(bits, {i}) & 1L")).alias(f"n{i}") for i in range(64)])
    each = words.select("block", "depth", "is_test", F.posexplode(F.array(*[f"n{i}" for i in range(64)])).alias("bit", "n")).where("n > 0").join(levels.starts, ["block", "bit"])
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return each.groupBy(F.col("start").alias("node")).agg(count(F.col("depth") == 1).alias("direct"), count(F.col("depth") > 1).alias("transitive"), F.max("depth").alias("depth"), count(~F.col("is_test")).alias("untested"))


def reachable_totals(edges: DataFrame, cost: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, total, most): the cost summed over the node and all it reaches, and the largest cost reached beside its own.

    ``cost`` is (node, cost). Only strong components are looked at, so no pairs of nodes are made; nodes that reach
    no other have no row.
    """
    edges = cleaned(edges, scratch)
    parts = scratch.stage(strongly_connected(edges, scratch).join(cost.toDF("node", "cost"), "node"))
    own = parts.groupBy("component").agg(F.count("*").alias("n"), F.sum("cost").alias("sum"), F.max("cost").alias("top"), F.slice(F.sort_array(F.collect_set("cost"), False), 1, 2).alias("tops"))
    alike = parts.join(own.select("component", "top"), "component").groupBy("component").agg(F.sum((F.col("cost") == F.col("top")).cast("int")).alias("with_top"))
    own = scratch.stage(own.join(alike, "component"))
    back = fold(edges, parts.select("node", "component")).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    below = over_ancestors(back, own.select(F.col("component").alias("node"), "n", "sum", "top"), scratch).toDF("component", "below", "below_top")
    both = parts.join(own, "component").join(below, "component", "left")
    beside = F.when((F.col("cost") < F.col("top")) | (F.col("with_top") > 1), F.col("top")).otherwise(F.element_at("tops", 2))
    out = both.where("n > 1 or below is not null")
    return out.select("node", "cost", (F.col("sum") + F.coalesce("below", F.lit(0))).alias("total"), F.greatest(F.when(F.col("n") > 1, beside), "below_top").alias("most"))


def layering(edges: DataFrame, depth: DataFrame, layer: DataFrame) -> DataFrame:
    """(layer, down, up, level, compliance): edges towards layers of larger, smaller, equal mean depth; 1 without any.

    ``depth`` is (node, depth) and ``layer`` (node, layer).
    """
    mean = depth.join(layer, "node").groupBy("layer").agg(F.avg("depth").alias("d"))
    across = edges.join(layer.toDF("src", "from"), "src").join(layer.toDF("dst", "to"), "dst").where("from <> to")
    both = across.join(mean.toDF("from", "df"), "from").join(mean.toDF("to", "dt"), "to")
    out = both.groupBy(F.col("from").alias("layer")).agg(F.sum((F.col("dt") > F.col("df")).cast("int")).alias("down"), F.sum((F.col("dt") < F.col("df")).cast("int")).alias("up"), F.sum((F.col("dt") == F.col("df")).cast("int")).alias("level"))
    moved = F.col("down") + F.col("up")
    return out.withColumn("compliance", F.round(F.when(moved == 0, 1.0).otherwise(F.col("down") / moved), 9))


def bridges(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges whose loss parts the undirected graph, where only one direction exists.

    Every component is labelled by a breadth-first tree from its least node; an edge off the tree marks the tree
    edges up to where its ends' paths meet, and tree edges without a mark are bridges.
    """
    from sparkloom.operators.components import connected_components

    edges = scratch.stage(clean(edges))
    undirected = scratch.stage(edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), F.lit(1).alias("one")).groupBy("u", "v").agg(F.sum("one").alias("ways")))
    both = scratch.stage(undirected.select("u", "v").union(undirected.select("v", "u")))
    parts = connected_components(undirected, scratch, "u", "v")
    front = scratch.stage(parts.where("node = component").select("node", F.lit(None).cast(edges.schema["src"].dataType).alias("parent"), F.lit(0).alias("depth")))
    tree, depth = front, 0
    while not front.isEmpty():
        depth += 1
        step = front.join(both, front["node"] == both["u"]).groupBy(F.col("v").alias("node")).agg(F.min("u").alias("parent"))
        front = scratch.stage(step.join(tree.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        tree = tree.unionByName(front)
    tree = scratch.stage(tree)
    off = undirected.join(tree.where("parent is not null").select(F.least("node", "parent").alias("u"), F.greatest("node", "parent").alias("v")), ["u", "v"], "left_anti").select("u", "v")
    climbing, marked = scratch.stage(off.distinct()), None
    while not climbing.isEmpty():
        up = climbing.join(tree.toDF("u", "pu", "du"), "u").join(tree.toDF("v", "pv", "dv"), "v")
        left, right = F.col("du") >= F.col("dv"), F.col("dv") >= F.col("du")
        step = up.select(F.when(left, F.col("u")).alias("mu"), F.when(right, F.col("v")).alias("mv"), F.when(left, F.col("pu")).otherwise(F.col("u")).alias("nu"), F.when(right, F.col("pv")).otherwise(F.col("v")).alias("nv"))
        step = scratch.stage(step)
        now = step.select(F.explode(F.array("mu", "mv")).alias("node")).where("node is not null").distinct()
        marked = now if marked is None else marked.union(now)
        climbing = scratch.stage(step.where("nu <> nv").select(F.least("nu", "nv").alias("u"), F.greatest("nu", "nv").alias("v")).distinct())
    cut = tree.where("parent is not null")
    if marked is not None:
        cut = cut.join(marked.distinct(), "node", "left_anti")
    single = undirected.where("ways = 1").join(cut.select(F.least("node", "parent").alias("u"), F.greatest("node", "parent").alias("v")), ["u", "v"], "left_semi")
    return edges.join(single, (F.least("src", "dst") == single["u"]) & (F.greatest("src", "dst") == single["v"]), "left_semi").select("src", "dst")


def shortest_paths(edges: DataFrame, scratch: Scratch, starts: DataFrame, max_depth: int = 6, without: DataFrame | None = None) -> DataFrame:
    """(start, node, depth, path): for each reachable node the least of its shortest paths, nodes joined by >; a ``max_depth`` of 0 is no limit.

    ``without`` is (node) of those that get no row, though paths may go through them. Up to ``LOCAL`` edges between whole
    numbers are searched by tasks that each hold all of them. In larger graphs levels of bits say which edges lie on
    shortest paths; only along those do paths grow.
    """
    edges = cleaned(edges, scratch)
    if _local(edges, starts) and (without is None or isinstance(without.schema["node"].dataType, T.IntegralType)):
        from sparkloom.operators.breadth_first import paths as search

        return search(edges, scratch, starts, max_depth, without).select(F.col("start").cast(starts.schema[0].dataType), F.col("node").cast(edges.schema["dst"].dataType), "depth", "path")
    levels = _Levels(edges, scratch, starts)
    level = levels.own()
    levels.add(level)
    paths = scratch.stage(levels.starts.select("start", F.col("start").alias("node"), F.col("start").cast("string").alias("path")))
    found, depth = None, 0
    while depth != max_depth or not max_depth:
        depth += 1
        fresh = levels.next(level)
        if fresh.isEmpty():
            break
        on = level.toDF("src", "block", "before").join(edges, "src").join(fresh.toDF("dst", "block", "after"), ["dst", "block"])
        on = levels.pairs(on.select("src", "dst", "block", F.expr("before & after").alias("bits")).where("bits <> 0"))
        step = on.join(paths.withColumnRenamed("node", "src"), ["start", "src"]).select("start", F.col("dst").alias("node"), F.concat("path", F.lit(">"), F.col("dst").cast("string")).alias("path"))
        paths = scratch.stage(step.groupBy("start", "node").agg(F.min("path").alias("path")))
        level, own = fresh, paths.select("start", "node", F.lit(depth).alias("depth"), "path")
        found = own if found is None else found.unionByName(own)
        if depth % MERGE == 0:
            levels.merge()
            found = scratch.stage(found)
    found = paths.select("start", "node", F.lit(0).alias("depth"), "path").limit(0) if found is None else found
    return found if without is None else found.join(without, "node", "left_anti").select(found.columns)


def longest_chain(edges: DataFrame, scratch: Scratch, least: int = 4) -> DataFrame:
    """(end, n_nodes) of the longest paths by their last node, of ``least`` nodes or more that no longer path goes through."""
    depth = longest_depth(edges, scratch)
    leaf = nodes(edges).join(edges.select(F.col("src").alias("node")), "node", "left_anti")
    return depth.join(leaf, "node", "left_semi").where(F.col("depth") + 1 >= least).select(F.col("node").alias("end"), (F.col("depth") + 1).alias("n_nodes"))


def knots(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(component, size, internal): strong components of two nodes or more with the edges inside them. ``parts`` is (node, component)."""
    inner = edges.join(parts.toDF("src", "component"), "src").join(parts.toDF("dst", "other"), "dst").where("component = other and src <> dst")
    size = parts.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")
    return size.join(inner.groupBy("component").agg(F.count("*").alias("internal")), "component")


def simple_paths(edges: DataFrame, scratch: Scratch, starts: DataFrame, targets: DataFrame, max_depth: int) -> DataFrame:
    """(start, target, depth, path): every path without a node twice from a start to a target, of ``max_depth`` edges at most, nodes joined by >.

    Each round keeps only paths that can still grow; a path ends at the first target it meets only if that has no way on.
    """
    edges = scratch.stage(clean(edges))
    goal = scratch.stage(targets.toDF("target").distinct())
    front = scratch.stage(starts.toDF("start").distinct().select("start", F.col("start").alias("node"), F.array("start").alias("path")))
    found = None
    for depth in range(1, max_depth + 1):
        grown = front.join(edges, front["node"] == edges["src"]).where(~F.array_contains("path", F.col("dst"))).select("start", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        front = scratch.stage(grown)
        hit = front.join(goal, front["node"] == goal["target"]).select("start", "target", F.lit(depth).alias("depth"), F.array_join(F.transform("path", lambda n: n.cast("string")), ">").alias("path"))
        found = hit if found is None else found.unionByName(hit)
    return found


def simple_cycles(edges: DataFrame, scratch: Scratch, max_length: int) -> DataFrame:
    """(length, path): every cycle without a node twice, of two to ``max_length`` nodes, from its least node on."""
    edges = scratch.stage(trim(edges, scratch))
    front = edges.where("src < dst").select(F.col("src").alias("start"), F.col("dst").alias("node"), F.array("src", "dst").alias("path"))
    found = None
    for length in range(2, max_length + 1):
        front = scratch.stage(front)
        closed = front.join(edges, (front["node"] == edges["src"]) & (front["start"] == edges["dst"])).select(F.lit(length).alias("length"), F.array_join(F.transform("path", lambda n: n.cast("string")), ">").alias("path"))
        found = closed if found is None else found.unionByName(closed)
        front = front.join(edges, front["node"] == edges["src"]).where((F.col("dst") > F.col("start")) & ~F.array_contains("path", F.col("dst"))).select("start", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
    return found


def ripple(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, fan_out, depth, downstream, score): how far a change goes: edges out times longest way in times nodes that reach it."""
    edges = scratch.stage(edges)
    d = degrees(edges).select("node", "fan_out")
    edges = cleaned(edges, scratch)
    parts = scratch.stage(strongly_connected(edges, scratch))
    out = d.join(longest_depth(edges, scratch, parts=parts), "node").join(dependents(edges, scratch, parts).withColumnRenamed("dependents", "downstream"), "node", "left").fillna(0, ["downstream"])
    return out.withColumn("score", F.col("fan_out") * F.col("depth") * F.col("downstream"))


def walk(links: DataFrame, scratch: Scratch, starts: DataFrame, kinds: tuple[str, ...] = (), max_depth: int = 0, include_start: bool = False) -> DataFrame:
    """(start, node, depth) along links (src, dst, kind) of some kinds (any, if none are named); ``max_depth`` 0 is no limit; a start itself at 0 if asked."""
    e = links.where(F.col("kind").isin(*kinds)) if kinds else links
    out = reach(clean(e, loops=True), scratch, starts, max_depth).join(starts.toDF("start").distinct(), "start", "left_semi").where("start <> node")
    own = starts.toDF("start").distinct().select("start", F.col("start").alias("node"), F.lit(0).alias("depth"))
    return out.unionByName(own) if include_start else out


def layer_summary(edges: DataFrame, depth: DataFrame, layer: DataFrame) -> DataFrame:
    """(layer, nodes, mean_depth, down, up, level, compliance) for every layer, also those without edges to others."""
    size = depth.join(layer, "node").groupBy("layer").agg(F.count("*").alias("nodes"), F.round(F.avg("depth"), 6).alias("mean_depth"))
    return size.join(layering(edges, depth, layer), "layer", "left").fillna({"down": 0, "up": 0, "level": 0, "compliance": 1.0})


def report(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """One row: nodes, edges, density, weak components, strong components, knots, edges in knots, mutual pairs."""
    from sparkloom.operators.components import connected_components

    e = scratch.stage(clean(edges))
    parts = scratch.stage(strongly_connected(e, scratch))
    k = knots(e, parts)
    pieces = [
        nodes(e).agg(F.count("*").alias("nodes")), e.agg(F.count("*").alias("edges")), connected_components(e, scratch).agg(F.countDistinct("component").alias("weak")), parts.agg(F.countDistinct("component").alias("strong")),
        k.agg(F.count("*").alias("knots"), F.coalesce(F.sum("internal"), F.lit(0)).alias("knotted")), mutual(e).agg(F.count("*").alias("mutual")),
    ]
    out = pieces[0]
    for p in pieces[1:]:
        out = out.join(F.broadcast(p), F.lit(True))  # one row each
    return out.withColumn("density", F.round(F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0), 9))


def typed_edges(kinds: dict[str, DataFrame]) -> DataFrame:
    """(src, dst, kind) distinct: several edge tables (src, dst) as one graph, ends as strings; rows with a null end go."""
    from functools import reduce

    parts = [df.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.lit(k).alias("kind")) for k, df in kinds.items()]
    return reduce(DataFrame.unionByName, parts).where("src is not null and dst is not null").distinct()
