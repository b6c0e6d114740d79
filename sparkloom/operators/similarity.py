"""Exact duplicates, MinHash near-duplicates, clone clusters and IDF-weighted similarity."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sparkloom.operators.components import connected_components
from sparkloom.runtime import Scratch, ship

#: The signature's prime, slots, bands and the words of a shingle.
PRIME, SLOTS, BANDS, WORDS = 2147483647, 128, 32, 5


def words(text: Column) -> Column:
    """Lower-cased words."""
    return F.filter(F.split(F.lower(text), "[ \t\n\r]+"), lambda x: x != "")


def exact_groups(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, representative, members) of texts that others share; the representative is the least key."""
    d = df.where(F.col(text).isNotNull()).select(key, F.md5(F.lower(F.trim(F.regexp_replace(F.col(text), r"\s+", " ")))).alias("h"))
    g = d.groupBy("h").agg(F.min(key).alias("representative"), F.count("*").alias("members")).where("members > 1")
    return d.join(g, "h").select(key, "representative", "members")


def shingle_sets(df: DataFrame, key: str, text: str, k: int = WORDS) -> DataFrame:
    """(key, s): the distinct hashed shingles of each text, in order; a text without words has no row."""
    hashed = F.transform(words(F.col(text)), lambda w: F.xxhash64(w))
    split = df.select(F.col(key).alias("key"), hashed.alias("w")).where(F.size("w") > 0)
    # A shingle is the hash of its words' hashes, so no text of it is made.
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - k + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, k)))
    return split.select("key", F.array_sort(F.array_distinct(grams)).alias("s"))


def signature(s: np.ndarray, slots: int = SLOTS, block: int = 4096) -> np.ndarray:
    """The least of each of ``slots`` linear hashes over a set of numbers, each hash with a multiplier of its own."""
    a = np.array([pow(48271, i + 1, PRIME) for i in range(slots)], np.uint64)
    b = np.array([pow(16807, i + 1, PRIME) for i in range(slots)], np.uint64)
    x = (s.astype(np.int64) % PRIME).astype(np.uint64)
    lows = [((x[lo : lo + block, None] * a + b) % np.uint64(PRIME)).min(axis=0) for lo in range(0, len(x), block)]
    return np.minimum.reduce(lows).astype(np.int64)


def signatures(sets: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(key, sig) of sets (key, s), in Arrow batches; a set's hashes are made a block at a time."""
    ship(sets.sparkSession)

    def batch(col):
        return col.map(lambda s: signature(np.asarray(s), slots))

    import pandas as pd

    batch.__annotations__ = {"col": pd.Series, "return": pd.Series}
    return sets.select("key", F.pandas_udf(batch, T.ArrayType(T.LongType()))("s").alias("sig"))


def candidates(sig: DataFrame, bands: int = BANDS) -> DataFrame:
    """(a, b) distinct, a < b: keys whose signatures agree in all slots of a band."""
    rows = F.size("sig") / bands
    cut = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(F.slice("sig", (i * rows + 1).cast("int"), rows.cast("int"))).alias("h")))
    slim = sig.select("key", F.explode(cut).alias("k")).select(F.col("key").alias("a"), "k.band", "k.h")
    return slim.join(slim.withColumnRenamed("a", "b"), ["band", "h"]).where("a < b").select("a", "b").distinct()


def jaccard(a: str, b: str) -> Column:
    """Shared over all of two sets; 0 if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - shared
    return F.when(total > 0, shared / total).otherwise(0.0)


def estimate(a: str, b: str) -> Column:
    """Equal slots over all slots of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v) / F.size(a)


def minhash_pairs(df: DataFrame, key: str, text: str, scratch: Scratch, threshold: float = 0.8, slots: int = SLOTS, bands: int = BANDS, k: int = WORDS) -> DataFrame:
    """(a, b, similarity): texts whose shingle sets have a Jaccard similarity of ``threshold`` or more.

    Signatures only find candidates; the sets decide. Texts of equal sets are one class named by its least key and
    linked to its members; other pairs are between classes.
    """
    sets = scratch.stage(shingle_sets(df, key, text, k).withColumn("c", F.struct(F.xxhash64("s").alias("x"), F.xxhash64(F.lit(1), "s").alias("y"))))
    classes = scratch.stage(sets.groupBy("c").agg(F.min("key").alias("a"), F.count("*").alias("n")))
    members = sets.join(classes.where("n > 1"), "c").where("key <> a").select("a", F.col("key").alias("b"), F.lit(1.0).alias("similarity"))
    own = scratch.stage(sets.join(classes.select(F.col("a").alias("key")), "key", "left_semi").select("key", "s"))
    pairs = scratch.stage(candidates(signatures(own, slots), bands))
    both = pairs.join(own.toDF("a", "sa"), "a").join(own.toDF("b", "sb"), "b")
    # A pair whose sizes alone rule the threshold out needs no comparison.
    fits = F.least(F.size("sa"), F.size("sb")) >= threshold * F.greatest(F.size("sa"), F.size("sb"))
    return both.where(fits).select("a", "b", F.round(jaccard("sa", "sb"), 9).alias("similarity")).where(F.col("similarity") >= threshold).unionByName(members)


def similar_functions(pairs: DataFrame, functions: DataFrame, least_ratio: float = 0.5, same_names: bool = False) -> DataFrame:
    """(a, b, similarity) of similar but unequal functions: lengths within a ratio, and unless asked not of one name.

    ``functions`` is (key, name, lines).
    """
    f = functions.select("key", "name", "lines")
    both = pairs.where("similarity < 1").join(f.toDF("a", "na", "la"), "a").join(f.toDF("b", "nb", "lb"), "b")
    kept = both.where(F.least("la", "lb") >= least_ratio * F.greatest("la", "lb"))
    return (kept if same_names else kept.where("na <> nb")).select("a", "b", "similarity")


def cluster_report(pairs: DataFrame, functions: DataFrame, scratch: Scratch) -> DataFrame:
    """(cluster, members, similarity, lines): components of similar pairs, the mean similarity of their pairs, and lines in all."""
    parts = scratch.stage(clone_clusters(pairs, scratch))
    size = parts.join(functions.select(F.col("key").alias("node"), "lines"), "node").groupBy("cluster").agg(F.count("*").alias("members"), F.sum("lines").alias("lines"))
    mean = pairs.join(parts.select(F.col("node").alias("a"), "cluster"), "a").groupBy("cluster").agg(F.round(F.avg("similarity"), 6).alias("similarity"))
    return size.join(mean, "cluster")


def uniqueness(functions: DataFrame, parts: DataFrame) -> DataFrame:
    """(module, functions, clustered, uniqueness): one less the share of a module's functions that are in a cluster. ``functions`` is (key, module)."""
    hit = functions.join(parts.select(F.col("node").alias("key"), F.lit(1).alias("c")), "key", "left")
    out = hit.groupBy("module").agg(F.count("*").alias("functions"), F.count("c").alias("clustered"))
    return out.withColumn("uniqueness", F.round(1 - F.col("clustered") / F.col("functions"), 9))


def without_hot_folders(groups: DataFrame, most: int = 5) -> DataFrame:
    """Groups of copies (id, a_dir, b_dir) but for those between two folders that ``most`` groups or more lie between."""
    pair = F.struct(F.least("a_dir", "b_dir").alias("x"), F.greatest("a_dir", "b_dir").alias("y"))
    hot = groups.groupBy(pair.alias("p")).agg(F.countDistinct("id").alias("n")).where((F.col("n") >= most) & (F.col("p.x") != F.col("p.y"))).select("p")
    return groups.withColumn("p", pair).join(hot, "p", "left_anti").drop("p")


def without_patterns(pairs: DataFrame, files: DataFrame, scratch: Scratch, most_pairs: int = 5, most_files: int = 3) -> DataFrame:
    """Pairs (a, b, similarity) but for those of a component with ``most_pairs`` pairs or more over ``most_files`` files or more. ``files`` is (key, file)."""
    parts = scratch.stage(clone_clusters(pairs, scratch))
    named = pairs.join(parts.select(F.col("node").alias("a"), "cluster"), "a")
    wide = parts.join(files.select(F.col("key").alias("node"), "file"), "node").groupBy("cluster").agg(F.countDistinct("file").alias("files")).where(F.col("files") >= most_files)
    many = named.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") >= most_pairs)
    return named.join(wide.join(many, "cluster").select("cluster"), "cluster", "left_anti").select("a", "b", "similarity")


def outermost(blocks: DataFrame) -> DataFrame:
    """Groups of equal blocks (id, file, start, end) without blocks that a longer one of the file holds; groups of one block left go.

    A longer block that holds one starts before it and ends no earlier, or starts with it and ends later: the last end by
    start, and the running one of all starts before, decide without pairs of blocks.
    """
    b = blocks.select("id", "file", "start", "end")
    last = b.where("file is not null and start is not null").groupBy("file", "start").agg(F.max("end").alias("last"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each start
    last = last.withColumn("earlier", F.max("last").over(before))
    held = F.coalesce(F.col("last") > F.col("end"), F.lit(False)) | F.coalesce(F.col("earlier") >= F.col("end"), F.lit(False))
    left = b.join(last, ["file", "start"], "left").where(~held).select("id", "file", "start", "end")
    return left.join(left.groupBy("id").agg(F.count("*").alias("n")).where("n >= 2").select("id"), "id", "left_semi")


def without_overlaps(pairs: DataFrame, most: float = 0.5) -> DataFrame:
    """Pairs of blocks (file_a, sa, ea, file_b, sb, eb, score), the best first, without those that overlap a better one kept by more than ``most`` on both sides.

    Pairs are walked one after the other within their two files.
    """
    import pandas as pd

    def walk(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["score", "sa", "sb"], ascending=[False, True, True], kind="stable")
        share = lambda s, e, x, y: max(0, min(e, y) - max(s, x) + 1) / (max(e, y) - min(s, x) + 1)
        kept: list = []
        for row in t.itertuples(index=False):
            if not any(share(row.sa, row.ea, k.sa, k.ea) > most and share(row.sb, row.eb, k.sb, k.eb) > most for k in kept):
                kept.append(row)
        return pd.DataFrame(kept, columns=t.columns)

    return pairs.groupBy("file_a", "file_b").applyInPandas(walk, pairs.schema)


def fragments(lines: DataFrame, size: int, least: int = 2) -> DataFrame:
    """(h, members, places): windows of ``size`` lines that stand in ``least`` places or more; lines (file, line, text) count trimmed.

    Each line goes to the windows it is in, so a file is never one row.
    """
    norm = lines.select("file", "line", F.xxhash64(F.trim("text")).alias("x"))
    each = norm.select("file", F.explode(F.sequence(F.greatest(F.col("line") - size + 1, F.lit(0)), F.col("line"))).alias("start"), F.struct("line", "x").alias("l"))
    windows = each.groupBy("file", "start").agg(F.array_sort(F.collect_list("l")).alias("ls")).where(F.size("ls") == size).select("file", "start", F.xxhash64(F.transform("ls", lambda l: l["x"])).alias("h"))
    out = windows.groupBy("h").agg(F.count("*").alias("members"), F.min(F.concat_ws(":", "file", "start")).alias("first")).where(F.col("members") >= least)
    return out


def restatements(occurrences: DataFrame, *identity: str) -> DataFrame:
    """(identity, n, locations) of facts stated in several places, by the columns that make them one fact."""
    out = occurrences.groupBy(*identity).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "file", F.col("line").cast("string")))), ",").alias("locations"))
    return out.where("n > 1")


def relation(a: Column, b: Column) -> Column:
    """How a type's fields (an array of name:type) relate to another's: equal, subtype (has them all and more), supertype, related (some), unrelated."""
    both = F.size(F.array_intersect(a, b))
    na, nb = F.size(F.array_distinct(a)), F.size(F.array_distinct(b))
    return F.when((both == na) & (both == nb), "equal").when(both == nb, "subtype").when(both == na, "supertype").when(both > 0, "related").otherwise("unrelated")


def clone_clusters(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, cluster) over similar pairs."""
    return connected_components(pairs, scratch, "a", "b").withColumnRenamed("component", "cluster")


def idf_jaccard(fields: DataFrame, least: int = 3) -> DataFrame:
    """(a, b, score): types by shared fields, weighted by ln(1 + n/df), as a whole percentage; at least ``least`` shared.

    ``fields`` is (type, field).
    """
    one = fields.distinct()
    n = one.select("type").distinct().agg(F.count("*").alias("n"))
    idf = one.groupBy("field").agg(F.count("*").alias("df")).join(n, F.lit(True)).select("field", F.log(1 + F.col("n") / F.col("df")).alias("w"))
    weighed = one.join(idf, "field")
    total = weighed.groupBy("type").agg(F.sum("w").alias("t"))
    shared = weighed.select(F.col("type").alias("a"), "field", "w").join(one.select(F.col("type").alias("b"), "field"), "field").where("a < b").groupBy("a", "b").agg(F.sum("w").alias("c"), F.count("*").alias("k")).where(F.col("k") >= least)
    both = shared.join(total.toDF("a", "ta"), "a").join(total.toDF("b", "tb"), "b")
    return both.select("a", "b", F.floor(F.round(100 * F.col("c") / (F.col("ta") + F.col("tb") - F.col("c")), 6)).alias("score"))
