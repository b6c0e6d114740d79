"""Language identification by a byte convolutional network, trained and applied in numpy.

Each byte has an embedding; filters of several widths slide over it, their maximum over a window is pooled and a
softmax layer gives the languages. Because the first layer is linear, a filter's response to byte b at position j
is one table entry, so applying the network is table look-ups, sums and maxima over batches of fixed-length
windows. Windows tile the whole text; a text's probabilities are the mean over its windows, by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sparkloom.runtime import give_back, ship

WINDOW, WIDTHS, FILTERS, EMBED = 192, (2, 3, 4), 12, 12
#: Labelled rows the network learns from, in all: a bounded sample that is even over the languages, of whole texts.
SAMPLE_ROWS = 1200
#: Languages whose counts a join broadcasts at most (a name and a number each).
_BROADCAST_LANGUAGES = 10_000
EPOCHS, BATCH, RATE, SEED = 8, 64, 0.004, 11
UNKNOWN = "und"


def windows(texts: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' windows, zero-padded; each window's text and its number of bytes. An empty text has one window."""
    n = np.array([max(1, -(-len(t) // size)) for t in texts])
    flat = np.zeros(int(n.sum()) * size, np.uint8)
    starts = (np.cumsum(n) - n) * size
    for t, s in zip(texts, starts.tolist()):
        flat[s : s + len(t)] = np.frombuffer(t, np.uint8)
    owner = np.repeat(np.arange(len(texts)), n)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    sizes = np.clip(np.array([len(t) for t in texts])[owner] - inside * size, 1, size)
    return flat.reshape(-1, size), owner, sizes


class ByteCNN:
    """Multi-width convolution, max pooling, softmax."""

    def __init__(self, labels: list[str], seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.embed[0] = 0
        self.filters = [rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)

    def _parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.bias, self.out, self.out_bias]

    def tables(self) -> list[np.ndarray]:
        """For each width, (width, 256, FILTERS): what byte b at position j adds to each filter."""
        return [np.ascontiguousarray(np.einsum("be,wef->wbf", self.embed, f)) for f in self.filters]

    def pooled(self, x: np.ndarray, tables: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each window's pooled responses (after the rectifier) and where each maximum is."""
        tops, places = [], []
        for w, table, bias in zip(WIDTHS, tables, self.bias):
            n = x.shape[1] - w + 1
            r = table[0][x[:, :n]]
            for j in range(1, w):
                r += table[j][x[:, j : j + n]]
            at = r.argmax(axis=1)
            tops.append(np.maximum(np.take_along_axis(r, at[:, None, :], 1)[:, 0] + bias, 0))
            places.append(at)
        return np.concatenate(tops, axis=1), places

    def probabilities(self, x: np.ndarray, tables: list[np.ndarray] | None = None) -> np.ndarray:
        tables = tables or self.tables()
        out = np.empty((len(x), len(self.labels)), np.float32)
        for lo in range(0, len(x), 512):
            tops = []
            part = x[lo : lo + 512]
            for w, table, bias in zip(WIDTHS, tables, self.bias):
                n = part.shape[1] - w + 1
                r = table[0][part[:, :n]]
                for j in range(1, w):
                    r += table[j][part[:, j : j + n]]
                tops.append(np.maximum(r.max(axis=1) + bias, 0))
            z = np.concatenate(tops, axis=1) @ self.out + self.out_bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[lo : lo + 512] = z / z.sum(axis=1, keepdims=True)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> ByteCNN:
        """Adam on the cross-entropy of window labels; the same rows and seed give the same network."""
        rng = np.random.default_rng(seed)
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self._parameters()]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(order), BATCH):
                i = order[lo : lo + BATCH]
                step += 1
                for p, g, (m, v) in zip(self._parameters(), self._gradients(x[i], y[i]), moments):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        h, places = self.pooled(x, self.tables())
        z = h @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        z[np.arange(len(y)), y] -= 1
        z /= len(y)
        dh = (z @ self.out.T) * (h > 0)
        embed, filters, biases = np.zeros_like(self.embed), [], []
        rows = np.arange(len(x))[:, None]
        for k, (w, f, at) in enumerate(zip(WIDTHS, self.filters, places)):
            d = dh[:, k * FILTERS : (k + 1) * FILTERS]
            g = np.zeros_like(f)
            for j in range(w):
                b = x[rows, at + j]
                g[j] = np.einsum("nfe,nf->ef", self.embed[b], d)
                np.add.at(embed, b.ravel(), (d[:, :, None] * f[j].T[None]).reshape(-1, EMBED))
            filters.append(g)
            biases.append(d.sum(axis=0))
        return [embed, *filters, *biases, h.T @ z, z.sum(axis=0)]


def held_out(key: str) -> Column:
    """Rows of this quarter of the keys are never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def train(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS) -> ByteCNN | None:
    """A network learned from a bounded sample of the labelled rows that are not held out; None without any.

    Each language gives about its even share of ``rows`` (with more languages than rows, each gives less than one row
    on average, and those that none is drawn of are not learned), taken by a hash of key and text, so the sample does
    not depend on how rows are dealt out. Sampled texts are learned from whole.
    """
    usable = df.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key"), F.xxhash64(key, text).alias("h")).where(F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out("key"))
    counts = usable.groupBy("lang").agg(F.count("*").alias("n"))
    languages = counts.count()
    if not languages:
        return None
    share = F.least(F.lit(1.0), F.lit(rows / languages) / F.col("n"))
    limits = counts.select("lang", (share * (1 << 30)).cast("long").alias("limit"))
    limits = F.broadcast(limits) if languages <= _BROADCAST_LANGUAGES else limits
    drawn = usable.join(limits, "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("limit"))
    got = sorted((r["lang"], r["h"], r["text"]) for r in drawn.select("lang", "h", "text").distinct().collect())
    if not got:
        return None
    labels = sorted({name for name, _, _ in got})
    index = {name: i for i, name in enumerate(labels)}
    x, owner, _ = windows([t.encode("utf-8", "surrogatepass") for _, _, t in got])
    y = np.array([index[name] for name, _, _ in got])[owner]
    return ByteCNN(labels).fit(x, y)


def predict(df: DataFrame, model: ByteCNN | None, text: str = "text") -> DataFrame:
    """``df`` with lang_pred and score, from the text alone.

    A null text, or one without a letter, is ``und`` with score 0; so is all without a model. Columns lang_pred and
    score that ``df`` has already are replaced; other columns and repeated rows stay as they are.
    """
    ship(df.sparkSession)
    import pandas as pd

    shared = df.sparkSession.sparkContext.broadcast(model)  # a few thousand weights

    def each(it: Iterator) -> Iterator:
        model = shared.value
        tables = model.tables() if model else []
        for s in it:
            names, scores = [], []
            for lo in range(0, len(s), 256):
                some = [t if t is not None and any(map(str.isalpha, t)) else None for t in s.iloc[lo : lo + 256]]
                real = [t.encode("utf-8", "surrogatepass") for t in some if t is not None] if model else []
                best = iter(())
                if real:
                    x, owner, sizes = windows(real)
                    p = model.probabilities(x, tables).astype(np.float64) * sizes[:, None]
                    p = np.add.reduceat(p, np.flatnonzero(np.diff(owner, prepend=-1)), axis=0)
                    p /= p.sum(axis=1, keepdims=True)
                    best = iter([(model.labels[i], float(row[i])) for row, i in zip(p, p.argmax(axis=1))])
                for t in some:
                    name, score = next(best) if t is not None and model else (UNKNOWN, 0.0)
                    names.append(name)
                    scores.append(min(1.0, score))
            yield pd.DataFrame({"lang_pred": names, "score": scores})
        give_back()

    each.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    own = [c for c in df.columns if c not in ("lang_pred", "score")]
    found = df.select(F.struct(*[F.col(c) for c in own]).alias("row"), F.pandas_udf(each, kind)(F.col(text)).alias("found"))
    return found.select("row.*", "found.lang_pred", "found.score")


def op8(spark, sf_dir: str) -> DataFrame:
    """All documents' predicted languages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
