"""Toxicity by a counterfactual-regularised classifier.

A logistic model over the words of a text and their stems (first letters), with weights of zero or more, so that
a long text is not excused by its length. It is trained in numpy on a bounded sample of labelled rows. Every
labelled text gives counterfactuals: a group that it names is swapped for another of its kind; into a text that
names none, a neutral mention is put, and that is swapped too. The squared changes of the score, by the swap and by
the mention, are penalised: naming a group in itself must not move the score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from sparkloom.llm.langid import held_out
from sparkloom.runtime import give_back, ship

#: Labelled rows learned from at most, by label; letters of the stems; how much likelier in toxic texts a feature must be.
TOXIC_ROWS, CLEAN_ROWS, STEMS, STRENGTH = 2500, 5000, (4, 5), 1.2
STEPS, RATE, SPARSITY, COUNTERFACTUAL, THRESHOLD = 500, 0.05, 2e-5, 10.0, 0.3
_WORD = re.compile(r"[^\W\d_]+")

#: Names of groups, by kind; those of one kind stand in for each other.
IDENTITY = {
    "gender": "women men woman man female male girls boys trans nonbinary frauen männer femmes hommes mujeres hombres".split(),
    "religion": "muslim muslims christian christians jewish jews hindu hindus buddhist buddhists atheist atheists catholic catholics".split(),
    "origin": "african asian european mexican american arab chinese indian immigrants refugees migrants foreigners ausländer étrangers extranjeros".split(),
    "colour": "black white brown".split(),
    "orientation": "gay lesbian straight bisexual queer homosexual heterosexual".split(),
    "ability": "disabled deaf blind autistic".split(),
    "age": "elderly young old teenage".split(),
}
_KIND = {w: (kind, i) for kind, words in IDENTITY.items() for i, w in enumerate(words)}
_TERMS = list(_KIND)


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features(found: set[str]) -> set[str]:
    """Words, and stems marked by a star."""
    return found | {f"{w[:n]}*" for w in found for n in STEMS if len(w) > n}


def swapped(found: set[str]) -> set[str]:
    """The words with each name of a group swapped for the next of its kind."""
    named = found & _KIND.keys()
    return (found - named) | {IDENTITY[k][(i + 1) % len(IDENTITY[k])] for k, i in (_KIND[w] for w in named)}


def counterfactuals(found: set[str], pick: int) -> list[tuple[set[str], set[str]]]:
    """Pairs of word sets whose scores should be equal. A text without a group's name is given the one that ``pick`` says."""
    if found & _KIND.keys():
        return [(found, swapped(found))]
    mention = found | {_TERMS[pick % len(_TERMS)]}
    return [(mention, found), (mention, swapped(mention))]


class _Matrix:
    """Rows of few non-zero numbers."""

    def __init__(self, columns: int) -> None:
        self.columns, self.rows = columns, 0
        self._parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, plus: list[int], minus: list[int] = []) -> None:  # noqa: B006
        at = np.array([*plus, *minus], np.int64)
        self._parts.append((np.full(len(at), self.rows), at, np.repeat([1.0, -1.0], [len(plus), len(minus)])))
        self.rows += 1

    def close(self) -> _Matrix:
        self.row, self.col, self.val = map(np.concatenate, zip(*self._parts)) if self._parts else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        del self._parts
        return self

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.rows)

    def back(self, e: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * e[self.row], self.columns)


class Toxicity:
    """Weights of features, and a base; ``pairs`` is how many counterfactual pairs held them."""

    def __init__(self, weights: dict[str, float], base: float, pairs: int = 0) -> None:
        self.weights, self.base, self.pairs = weights, base, pairs

    def score(self, text: str | None) -> float:
        w = self.weights
        z = self.base + sum(w[f] for f in features(words(text)) if f in w)
        return float(1 / (1 + np.exp(-z)))

    @staticmethod
    def fit(texts: list[str], labels: list[int], counterfactual_weight: float = COUNTERFACTUAL) -> Toxicity:
        # Word sets are made anew in each pass: held for all texts, they would be the driver's largest load.
        y = np.array(labels, np.float64)
        n1, n0 = int(y.sum()), len(y) - int(y.sum())
        if not n1 or not n0:
            return Toxicity({}, 8.0 if n1 else -8.0)

        def strength(hits, misses):
            """How much likelier toxic texts are to have a feature, as a logarithm, less its standard error."""
            a, b = hits + 0.5, misses + 0.5
            return np.log(a / (n1 + 1)) - np.log(b / (n0 + 1)) - np.sqrt(1 / a + 1 / b)

        hits = Counter(f for t, l in zip(texts, labels) if l for f in features(words(t)))
        # Features that no lack of clean texts could make strong enough needn't be counted there.
        least = next((k for k in range(1, n1 + 1) if strength(k, 0) > STRENGTH), n1 + 1)
        hits = {f: k for f, k in hits.items() if k >= least}
        misses = Counter(f for t, l in zip(texts, labels) if not l for f in features(words(t)) if f in hits)
        strong = {f: float(strength(k, misses[f])) for f, k in hits.items()}
        names = sorted({*(f for f, x in strong.items() if x > STRENGTH), *features(set(_KIND))})
        at = {f: i for i, f in enumerate(names)}
        index = lambda found: [at[f] for f in features(found) if f in at]
        # The weaker a feature's own evidence, the more its weight costs.
        cost = SPARSITY * np.array([min(100.0, (5 / max(strong.get(f, 0.0), 0.1)) ** 3) for f in names])
        x, d = _Matrix(len(names)), _Matrix(len(names))
        for t in texts:
            found = words(t)
            x.add(index(found))
            for one, other in counterfactuals(found, zlib.crc32(t.encode("utf-8", "surrogatepass"))):
                d.add(index(one), index(other))
        x.close(), d.close()
        each = np.where(y == 1, 0.5 / n1, 0.5 / n0)
        w, base = np.zeros(len(names)), -2.0
        m, v, bm, bv = np.zeros(len(names)), np.zeros(len(names)), 0.0, 0.0
        for t in range(1, STEPS + 1):
            e = each * (1 / (1 + np.exp(-(x.dot(w) + base))) - y)
            g = x.back(e) + cost + 2 * counterfactual_weight / d.rows * d.back(d.dot(w))
            b = e.sum()
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            bm, bv = 0.9 * bm + 0.1 * b, 0.999 * bv + 0.001 * b * b
            w = np.maximum(0, w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8))
            base -= RATE * (bm / (1 - 0.9**t)) / (np.sqrt(bv / (1 - 0.999**t)) + 1e-8)
        return Toxicity({f: float(k) for f, k in zip(names, w) if k > 1e-3}, float(base), d.rows)


def train(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic", toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Toxicity:
    """Learned from at most (about) ``toxic_rows`` and ``clean_rows`` labelled rows that are not held out, picked by a hash of the key.

    Null labels and null texts are not learned from; a key of several rows gives its least text. Without both labels
    every score is that of the one there is, and low if there is none.
    """
    known = labels.where(F.col(toxic).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("k")).agg(F.max(toxic).alias("y"))
    known = known.withColumn("u", F.pmod(F.xxhash64("k"), F.lit(1 << 30)))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    take = F.lit(False)
    for label, most in ((1, toxic_rows), (0, clean_rows)):
        if n := counts.get(label):
            take = take | ((F.col("y") == label) & (F.col("u") < int(min(1.0, most / n) * (1 << 30))))
    picked = F.broadcast(known.where(take).select("k", "y"))  # no more rows than the sample's bound
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).join(picked, "k").groupBy("k", "y").agg(F.min("t").alias("t")).collect()
    rows = sorted((r["k"], r["t"], int(r["y"])) for r in rows)
    if not rows:
        return Toxicity({}, -8.0)
    return Toxicity.fit([t for _, t, _ in rows], [y for _, _, y in rows])


def score(df: DataFrame, model: Toxicity, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with each text's score, from the text alone; a null text counts as empty. A column ``out`` is replaced."""
    ship(df.sparkSession)
    import pandas as pd

    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.base))  # words and stems of the bounded sample at most

    def each(it: Iterator) -> Iterator:
        own = Toxicity(*shared.value)
        for s in it:
            yield pd.Series([own.score(t) for t in s], dtype="float64")
        give_back()

    each.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(out, F.pandas_udf(each, T.DoubleType())(F.coalesce(F.col(text), F.lit(""))))


def op9(spark, sf_dir: str) -> DataFrame:
    """All documents' toxicity scores."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
