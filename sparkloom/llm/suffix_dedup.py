"""Suffix-array dedup by a common-prefix-aware distributed merge sort.

Goal: remove each byte that a string of ``MATCH`` bytes covers which also starts in a document of a smaller key.

1. Documents are packed into blocks (rows of a staged table), which keep their bytes and document bounds.
2. Every window of MATCH bytes has an anchor, the least-hashed GRAM-byte string in it, so equal windows
   have equal anchors wherever they stand. Blocks send the hashes of their anchors, once each, and learn
   which anchors other documents have too. No other window can match; its suffixes need not be sorted.
3. Each block sorts the suffixes at its remaining anchors, each with the bytes before the anchor behind it,
   as far as windows on that anchor reach. Equal strings of a block are one entry with the least key. The
   sorted run is front-coded, cut at splitters and exchanged.
4. For each key range a loser tree merges the runs. A node remembers how long a prefix its loser shares with
   the last output, so known prefixes are never compared again. The prefixes shared in sorted order (and those
   of the bytes before the anchors) say which windows on an anchor are equal; a bit for each window of an
   entry, whether a smaller key has it, goes back.
5. Blocks put the marked windows together and cut them out of the documents.

An anchor that more than GROUP strings hold is crowded: it isn't merged. Its windows, once a block, go packed to
buckets by a hash of their bytes, as many as the windows need, where sorting finds their least keys; a bit for each
goes back. A string that a third of the documents share is one window a block there, so no bucket gathers it often;
all sizes in a task are bounded by the block size, the number of blocks and ranges, and GROUP.
"""

from __future__ import annotations

import hashlib
import io
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from sparkloom.runtime import Scratch, give_back, partitions, ship

MATCH, GRAM, BLOCK_BYTES = 50, 24, 4 << 20
#: Bytes whose anchors are found at a time.
_STRETCH = 1 << 20
#: Text bytes for each bucket of anchors, and for each range of the merge.
BUCKET_BYTES, RANGE_BYTES = 24 << 20, 16 << 20
_LAST = (1 << 63) - 1
_SPREAD = MATCH - GRAM
#: Strings that hold one anchor beyond which it is crowded.
GROUP = 4096
#: A sort key: the bytes from the anchor on, those before it backwards, both lengths.
_WIDTH = MATCH + _SPREAD + 2
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]

_BLOCK = "block long, extra binary, ords binary, lens binary, text binary, sample binary, bytes long"


def _pack(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 3)


def _unpack(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), kind)


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number, all first bytes first."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(b: bytes, width: int) -> np.ndarray:
    n = len(b) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def _blocks(it: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Packs rows (ord, text, extras ...) into blocks; a document is never split."""
    part, seq = TaskContext.get().partitionId(), 0
    extras: list[pa.RecordBatch] = []
    ords: list[int] = []
    texts: list[bytes] = []
    held = 0

    def flush() -> pa.RecordBatch:
        nonlocal seq, held, extras, ords, texts
        sink = io.BytesIO()
        table = pa.Table.from_batches(extras).combine_chunks()
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        body = b"".join(texts)
        rng = np.random.default_rng(len(body))
        spots = rng.integers(0, max(1, len(body) - 16), 32) if len(body) > 16 else []
        row = [(part << 32) | seq, zstandard.compress(sink.getvalue(), 3), np.array(ords, "<i8").tobytes(), np.array([len(t) for t in texts], "<i8").tobytes(), zstandard.compress(body, 3), b"".join(body[s : s + 16] for s in spots), len(body)]
        seq += 1
        held, extras, ords, texts = 0, [], [], []
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), *[pa.binary()] * 5, pa.int64()))], ["block", "extra", "ords", "lens", "text", "sample", "bytes"])

    for batch in it:
        keys, body = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
        rest = pa.RecordBatch.from_arrays(batch.columns[2:], names=[f"c{i}" for i in range(len(batch.columns) - 2)])
        lo = 0
        for i, key in enumerate(keys):
            t = body[i].as_py() or b""
            ords.append(key)
            texts.append(t)
            held += len(t)
            if held >= size:
                extras.append(rest.slice(lo, i + 1 - lo))
                lo = i + 1
                yield flush()
        if lo < len(keys):
            extras.append(rest.slice(lo))
    if ords:
        yield flush()
    give_back()


class _Anchors:
    """The runs of windows of a block, by anchor: first and last window, anchor hash, hash of the whole string, document."""

    def __init__(self, text: np.ndarray, lens: np.ndarray) -> None:
        n = len(text)
        self.p1 = self.p2 = self.doc = self.anchor = np.empty(0, np.int64)
        self.gram = self.whole = np.empty(0, np.uint64)
        if n < MATCH:
            return
        doc = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
        found = [self._stretch(text, doc, lo, min(lo + _STRETCH, n - MATCH + 1)) for lo in range(0, n - MATCH + 1, _STRETCH)]
        self.p1, self.p2, self.anchor, self.gram, self.whole = map(np.concatenate, zip(*found))
        self.doc = doc[self.p1].astype(np.int64)

    @staticmethod
    def _stretch(text: np.ndarray, doc: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, ...]:
        """The runs of the windows that start from lo to hi - 1; a run ends with its stretch."""
        part = text[lo : hi + MATCH - 1]
        words = np.ndarray((len(part) - 7,), "<u8", part.data, strides=(1,)).copy()
        m = len(part) - GRAM + 1
        h = words[:m] * _C[0]
        h += words[8 : m + 8] * _C[1]
        h += words[16 : m + 16] * _C[2]
        del words
        h ^= h >> np.uint64(32)
        h *= _C[3]
        h ^= h >> np.uint64(29)
        least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
        span = 1
        while span * 2 <= _SPREAD + 1:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if (more := _SPREAD + 1 - span) > 0:
            least = np.minimum(least[:-more], least[more:])
        anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        own = doc[lo:hi]
        ok = own == doc[lo + MATCH - 1 : hi + MATCH - 1]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1]) | (own[1:] != own[:-1])
        p1 = np.flatnonzero(new)
        p2 = np.append(p1[1:], len(anchor)) - 1
        good = ok[p1]
        p1, p2 = p1[good], p2[good]
        gram = (h[anchor[p1]] * _C[1]) >> np.uint64(16)  # anchors are least hashes; this spreads them again
        # Four hashed grams cover the string from its first to its last byte.
        mix = h[p1] * _C[0] + h[p1 + GRAM] * _C[1] + h[p2 + 2] * _C[2] + h[p2 + _SPREAD] * _C[4] + (p2 - p1).astype(np.uint64)
        return p1 + lo, p2 + lo, anchor[p1] + lo, gram, (mix ^ (mix >> np.uint64(31))) * _C[3]

    def strings(self, ords: np.ndarray) -> dict[str, np.ndarray]:
        """Distinct strings by anchor: their least key, a run that has it, each run's string (at), each string's anchor (of);
        the anchors' hashes, sorted, how many strings each has, and whether two keys have it."""
        order = np.lexsort((self.whole, self.gram))
        g, w, o = self.gram[order], self.whole[order], ords[self.doc[order]]
        new_gram, new = np.ones(len(g), bool), np.ones(len(g), bool)
        new_gram[1:] = g[1:] != g[:-1]
        new[1:] = new_gram[1:] | (w[1:] != w[:-1])
        first, grams = np.flatnonzero(new), np.flatnonzero(new_gram)
        at = np.empty(len(g), np.int64)
        at[order] = np.cumsum(new) - 1
        low = lambda f, x, i: f.reduceat(x, i) if len(i) else x
        of = (np.cumsum(new_gram) - 1)[first]
        return {"gram": g[grams], "n": np.bincount(of, minlength=len(grams)), "multi": low(np.minimum, o, grams) != low(np.maximum, o, grams), "least": low(np.minimum, o, first), "run": order[first], "at": at, "of": of}


def _open(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    text = np.frombuffer(zstandard.decompress(row["text"]) if row["text"] else b"", np.uint8)
    return text, np.frombuffer(row["lens"], "<i8"), np.frombuffer(row["ords"], "<i8")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {name: b.column(j)[i].as_py() for j, name in enumerate(b.schema.names)}
        give_back()


def _bucket(gram: np.ndarray, buckets: int) -> np.ndarray:
    return ((gram >> np.uint64(16)) * np.uint64(buckets)) >> np.uint64(32)


def _send_anchors(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 3)
    for row in _rows(batches):
        text, lens, ords = _open(row)
        found = _Anchors(text, lens).strings(ords)
        g, n, multi = found["gram"], np.minimum(found["n"], 255).astype(np.uint8), found["multi"]
        cut = np.searchsorted(_bucket(g, buckets), np.arange(buckets + 1, dtype=np.uint64))
        out: list[list] = [[], [], [], [], [], [], []]
        for b in np.flatnonzero(np.diff(cut)).tolist():
            s, e = int(cut[b]), int(cut[b + 1])
            deltas = _planes(np.diff(g[s:e], prepend=g[s : s + 1]), 6)
            for x, v in zip(out, (b, row["block"], e - s, int(g[s]), zstandard.compress(deltas, 1), _pack(n[s:e]), np.packbits(multi[s:e]).tobytes())):
                x.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], ["bucket", "block", "n", "base", "grams", "strings", "multi"])


def _judge_anchors(t: pa.Table, group: int) -> pa.Table:
    """For each sent anchor: 0 if no other document has it, 1 if some do, 2 if more than ``group`` strings hold it."""
    ns = t["n"].to_numpy()
    g = np.concatenate([np.cumsum(_from_planes(zstandard.decompress(x.as_py()), 6), dtype=np.uint64) + np.uint64(b) for x, b in zip(t["grams"], t["base"].to_pylist())])
    held = np.concatenate([_unpack(x.as_py(), np.uint8) for x in t["strings"]]).astype(np.int64)
    multi = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=n) for x, n in zip(t["multi"], ns)]).astype(bool)
    order = np.argsort(g, kind="stable")
    sg = g[order]
    new = np.ones(len(sg), bool)
    new[1:] = sg[1:] != sg[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(sg)))
    verdict = np.where(np.add.reduceat(held[order], first) > group, 2, (size > 1) | np.logical_or.reduceat(multi[order], first)).astype(np.uint8)
    flags = np.empty(len(sg), np.uint8)
    flags[order] = np.repeat(verdict, size)
    ends = np.cumsum(ns)
    packed = [_pack(flags[e - n : e]) for e, n in zip(ends.tolist(), ns.tolist())]
    return pa.table({"bucket": t["bucket"], "block": t["block"], "flags": pa.array(packed, pa.binary())})


def _sorted_keys(keys: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys (whose last byte isn't 0) in order, the least key of each, and each row's place among them."""
    order = np.argsort(keys.view(f"S{keys.shape[1]}").ravel(), kind="stable")
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    first = np.flatnonzero(new)
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(new) - 1
    return keys[first], np.minimum.reduceat(least[order], first) if len(first) else least, entry


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] times, for each i."""
    return np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


def _runs(batches: Iterator[pa.RecordBatch], splitters: list[bytes]) -> Iterator[pa.RecordBatch]:
    """A block's sorted, front-coded run by range; (range -1) where its entries stand; (range -2) its crowded windows."""
    names = ["range", "block", "n", "lcps", "tails", "ords", "spots"]
    kinds = (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4)
    edges = np.array([int.from_bytes(s.ljust(8, b"\0")[:8], "big") for s in splitters], np.uint64)
    columns = np.arange(_WIDTH)
    for row in _rows(batches):
        text, lens, ords = _open(row)
        a = _Anchors(text, lens)
        found = a.strings(ords)
        flags = np.concatenate([_unpack(x["flags"], np.uint8) for x in sorted(row["found"], key=lambda x: x["bucket"])])[found["of"]]
        shared = np.flatnonzero(flags)
        if not len(shared):
            continue
        hot, run, low = flags[shared] == 2, found["run"][shared], found["least"][shared]
        counts = (a.p2 - a.p1 + 1)[run]
        padded = np.concatenate((np.zeros(_SPREAD, np.uint8), text, np.zeros(MATCH, np.uint8)))
        ahead, behind = (np.lib.stride_tricks.sliding_window_view(padded, n) for n in (MATCH, _SPREAD))
        # Strings around their anchors.
        r = run[~hot]
        at, right, left = a.anchor[r] + _SPREAD, a.p2[r] + MATCH - a.anchor[r], a.anchor[r] - a.p1[r]
        keys = np.empty((len(r), _WIDTH), np.uint8)
        keys[:, :MATCH], keys[:, MATCH:-2] = ahead[at], behind[at - _SPREAD][:, ::-1]
        keys[:, :MATCH][np.arange(MATCH) >= right[:, None]] = 0
        keys[:, MATCH:-2][np.arange(_SPREAD) >= left[:, None]] = 0
        keys[:, -2], keys[:, -1] = right, left + 1
        keys, least, entry = _sorted_keys(keys, low[~hot])
        # Each window of the strings on crowded anchors.
        windows = np.ones((int(counts[hot].sum()), MATCH + 1), np.uint8)
        windows[:, :MATCH] = ahead[_spread(a.p1[run[hot]], counts[hot]) + _SPREAD]
        windows, crowd_least, crowd = _sorted_keys(windows, np.repeat(low[hot], counts[hot]))
        lcp = np.zeros(len(keys), np.uint8)
        lcp[1:] = (keys[1:] != keys[:-1]).argmax(axis=1)
        lead = np.ascontiguousarray(keys[:, :8]).view(">u8").ravel().astype(np.uint64)
        cut = np.concatenate(([0], np.searchsorted(lead, edges), [len(keys)]))
        place = np.full(len(flags), -1, np.int64)
        place[shared] = np.arange(len(shared))
        place = place[found["at"]]
        there = np.flatnonzero(place >= 0)
        spots = {"at": a.p1[there].astype("<u4"), "string": place[there].astype("<u4"), "hot": hot, "counts": counts.astype(np.uint8), "entry": entry.astype("<u4"), "least": least.astype("<i8"), "crowd": crowd.astype("<u4"), "crowd_least": crowd_least.astype("<i8")}
        out: list[list] = [[-1], [row["block"]], [len(keys)], [None], [None], [None], [pickle.dumps({k: _pack(x) for k, x in spots.items()})]]
        if len(windows):
            for x, v in zip(out, (-2, row["block"], len(windows), None, _pack(windows[:, :MATCH]), _pack(crowd_least.astype("<i8")), None)):
                x.append(v)
        for i in np.flatnonzero(np.diff(cut)).tolist():
            s, e = int(cut[i]), int(cut[i + 1])
            k = lcp[s:e].copy()
            k[0] = 0
            for x, v in zip(out, (i, row["block"], e - s, _pack(k), _pack(keys[s:e][columns >= k[:, None]]), _pack(least[s:e].astype("<i8")), None)):
                x.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names)


def _window_hash(windows: np.ndarray) -> np.ndarray:
    """A hash of each row of MATCH bytes."""
    words = np.zeros((len(windows), -(-MATCH // 8) * 8), np.uint8)
    words[:, :MATCH] = windows
    h = np.zeros(len(windows), np.uint64)
    for i, w in enumerate(words.view("<u8").T):
        h = (h ^ w) * _C[i % len(_C)]
        h ^= h >> np.uint64(32)
    return h * _C[3]


def _crowded(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The crowded windows of a block by bucket: their numbers there, their bytes, their least keys."""
    kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 3)
    for row in _rows(batches):
        windows = np.frombuffer(zstandard.decompress(row["tails"]), np.uint8).reshape(-1, MATCH)
        least = _unpack(row["ords"], "<i8")
        own = ((_window_hash(windows) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        order = np.argsort(own, kind="stable")
        cut = np.searchsorted(own[order], np.arange(buckets + 1, dtype=np.uint64))
        out: list[list] = [[], [], [], [], []]
        for b in np.flatnonzero(np.diff(cut)).tolist():
            at = order[cut[b] : cut[b + 1]]
            for x, v in zip(out, (b, row["block"], _pack(at.astype("<u4")), _pack(windows[at]), _pack(least[at]))):
                x.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], ["bucket", "block", "at", "windows", "least"])


def _judge_windows(t: pa.Table) -> pa.Table:
    """The numbers of each block's windows that another block has under a smaller key."""
    windows = np.concatenate([_unpack(x.as_py(), np.uint8) for x in t["windows"]]).reshape(-1, MATCH)
    least = [_unpack(x.as_py(), "<i8") for x in t["least"]]
    keys = np.ones((len(windows), MATCH + 1), np.uint8)
    keys[:, :MATCH] = windows
    first = np.concatenate(([0], np.cumsum([len(x) for x in least])))
    _, low, entry = _sorted_keys(keys, np.concatenate(least))
    at = (_unpack(x.as_py(), "<u4") for x in t["at"])
    beaten = [_pack(n[low[entry[s:e]] < own]) for n, own, s, e in zip(at, least, first[:-1], first[1:])]
    return pa.table({"block": t["block"], "beaten": pa.array(beaten, pa.binary())})


class LoserTree:
    """Merges front-coded sorted runs of byte strings, one width each, by their common prefixes.

    ``lcp[r]`` is how many bytes run r's next string shares with the last output, so of two strings the one
    that shares more is the smaller, and only equally long shared prefixes are compared, from there on.
    """

    def __init__(self, runs: list[tuple[list[int], bytes]], width: int) -> None:
        self.runs, self.width, k = runs, width, len(runs)
        self.at, self.pos = [0] * k, [0] * k
        self.key, self.lcp = [b""] * k, [0] * k
        for r in range(k):
            self._next(r)
            self.lcp[r] = 0 if self.lcp[r] >= 0 else -1
        self.tree = [-1] * k
        for r in range(k):
            self.top = self._climb(r, True)
        self.size = k

    def _next(self, r: int) -> None:
        lcps, tails = self.runs[r]
        i = self.at[r]
        if i >= len(lcps):
            self.lcp[r] = -1
            return
        n = lcps[i]
        end = self.pos[r] + self.width - n
        self.key[r] = self.key[r][:n] + tails[self.pos[r] : end]
        self.lcp[r], self.at[r], self.pos[r] = n, i + 1, end

    def _climb(self, r: int, build: bool = False) -> int:
        """Plays from r's leaf to the root (or, when building, to the first free node); the winner."""
        tree, lcp, key, width = self.tree, self.lcp, self.key, self.width
        node = (r + len(tree)) >> 1
        while node:
            other = tree[node]
            if other < 0:
                if build:
                    tree[node] = r
                    return -1
            else:
                x, y = lcp[r], lcp[other]
                if x < y:
                    tree[node], r = r, other
                elif x == y and x >= 0:
                    a, b = key[r], key[other]
                    if a == b:
                        if other < r:
                            tree[node], r, other = r, other, r
                        lcp[other] = width
                    else:
                        while a[x] == b[x]:
                            x += 1
                        if b[x] < a[x]:
                            tree[node], r, other = r, other, r
                        lcp[other] = x
            node >>= 1
        return r

    def __iter__(self) -> Iterator[tuple[int, int, int]]:
        """(run, index in it, bytes shared with the output before)."""
        r, lcp, at = self.top, self.lcp, self.at
        if not self.size:
            return
        while lcp[r] >= 0:
            yield r, at[r] - 1, lcp[r]
            self._next(r)
            r = self._climb(r)


def _matrix(lcps: np.ndarray, tails: bytes) -> np.ndarray:
    """The strings of a front-coded run, a row each."""
    columns = np.arange(_WIDTH)
    own = columns >= lcps[:, None]
    out = np.zeros((len(lcps), _WIDTH), np.uint8)
    out[own] = np.frombuffer(tails, np.uint8)
    source = np.maximum.accumulate(np.where(own, np.arange(len(lcps))[:, None], 0), axis=0)
    return out[source, columns]


def _lower(groups: np.ndarray, ords: np.ndarray) -> np.ndarray:
    """Whether another member of its group has a smaller key."""
    order = np.argsort(groups, kind="stable")
    g = groups[order]
    first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    out = np.empty(len(g), bool)
    out[order] = np.repeat(np.minimum.reduceat(ords[order], first), np.diff(np.append(first, len(g)))) < ords[order]
    return out


def _merge(t: pa.Table) -> pa.Table:
    """For each run of a range, a bit for each window of each entry: does a smaller key have it?"""
    coded = [(_unpack(lcps.as_py(), np.uint8), zstandard.decompress(tails.as_py())) for lcps, tails in zip(t["lcps"], t["tails"])]
    sizes = np.array([len(k) for k, _ in coded])
    starts = np.cumsum(sizes) - sizes
    merged = np.array([(r, i, shared) for r, i, shared in LoserTree([(k.tolist(), tails) for k, tails in coded], _WIDTH)], np.int64)
    flat, shared = starts[merged[:, 0]] + merged[:, 1], merged[:, 2]
    keys = np.concatenate([_matrix(k, tails) for k, tails in coded])[flat]
    ords = np.concatenate([_unpack(x.as_py(), "<i8") for x in t["ords"]])[flat]
    right, left = keys[:, -2].astype(np.int64), keys[:, -1].astype(np.int64) - 1
    # By window, in the order of their starts counted from the last back, that is by the bytes before the anchor.
    before = np.arange(_SPREAD + 1)
    bits = np.zeros((len(keys), _SPREAD + 1), bool)
    valid = (before <= left[:, None]) & (MATCH - before <= right[:, None])
    group = np.cumsum(shared < GRAM)
    at = np.flatnonzero(np.bincount(group)[group] > 1)
    if len(at):
        # Classes of equal bytes before the anchor, from their own sorted order and its shared prefixes.
        tags = np.concatenate((group[at].astype(">u8").view(np.uint8).reshape(-1, 8), keys[at, MATCH:-2]), axis=1)
        tags = np.concatenate((tags, np.ones((len(at), 1), np.uint8)), axis=1)
        order = np.argsort(np.ascontiguousarray(tags).view(f"S{tags.shape[1]}").ravel(), kind="stable")
        tags = tags[order]
        differs = np.full(len(at), 0)
        unequal = tags[1:] != tags[:-1]
        differs[1:] = np.where(unequal.any(axis=1), unequal.argmax(axis=1), tags.shape[1])
        for o in range(_SPREAD + 1):
            behind = np.empty(len(at), np.int64)
            behind[order] = np.cumsum(differs < 8 + o)
            ahead = np.cumsum(shared < MATCH - o)[at]
            ok = valid[at, o]
            if ok.any():
                bits[at[ok], o] = _lower(behind[ok] * (len(shared) + 1) + ahead[ok], ords[at[ok]])
    back = np.empty(len(flat), np.int64)
    back[flat] = np.arange(len(flat))
    packed, counts = [], []
    for s, n in zip(starts.tolist(), sizes.tolist()):
        rows = back[s : s + n]
        own = bits[rows][:, ::-1][valid[rows][:, ::-1]]
        packed.append(np.packbits(own).tobytes())
        counts.append(len(own))
    return pa.table({"range": t["range"], "block": t["block"], "bits": pa.array(packed, pa.binary()), "n": pa.array(counts, pa.int32())})


def _cut(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        text, lens, ords = _open(row)
        ends = np.cumsum(lens)
        gone = np.zeros(len(text), bool)
        if row["spots"]:
            x = {k: zstandard.decompress(v) for k, v in pickle.loads(row["spots"][0]).items()}
            at, string, entry, crowd = (np.frombuffer(x[k], "<u4").astype(np.int64) for k in ("at", "string", "entry", "crowd"))
            hot, counts = np.frombuffer(x["hot"], bool), np.frombuffer(x["counts"], np.uint8).astype(np.int64)
            least, crowd_least = np.frombuffer(x["least"], "<i8"), np.frombuffer(x["crowd_least"], "<i8")
            # For each window of each string: does another block have it under a smaller key, and its least key here.
            is_hot = np.repeat(hot, counts)
            bit, own_least = np.zeros(len(is_hot), bool), np.empty(len(is_hot), np.int64)
            if len(crowd):
                beaten = np.zeros(len(crowd_least), bool)
                for b in row["beaten"] or []:
                    beaten[_unpack(b, "<u4")] = True
                bit[is_hot], own_least[is_hot] = beaten[crowd], crowd_least[crowd]
            if len(entry):
                width = np.ones(len(least), np.int64)
                width[entry] = counts[~hot]
                bits = np.concatenate([np.unpackbits(np.frombuffer(b["bits"], np.uint8), count=b["n"]) for b in sorted(row["bits"], key=lambda b: b["range"])]).astype(bool)
                bit[~is_hot] = bits[_spread((np.cumsum(width) - width)[entry], counts[~hot])]
                own_least[~is_hot] = np.repeat(least[entry], counts[~hot])
            own = ords[np.searchsorted(ends, at, "right")]
            n = counts[string]
            which = _spread((np.cumsum(counts) - counts)[string], n)
            hit = bit[which] | (np.repeat(own, n) > own_least[which])
            start = _spread(at, n)[hit]
            covered = np.bincount(start, minlength=len(text) + 1)
            covered[MATCH:] -= np.bincount(start, minlength=len(text) + 1)[:-MATCH]
            gone = np.cumsum(covered, out=covered)[:-1] > 0
        extra = pa.ipc.open_stream(zstandard.decompress(row["extra"])).read_all().combine_chunks()
        out: list[list] = [[], [], [], [], []]
        for e, n in zip(ends.tolist(), lens.tolist()):
            own, body = gone[e - n : e], text[e - n : e]
            removed = int(own.sum())
            kept = body[~own].tobytes() if removed else body.tobytes()
            spans = int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if removed else 0
            if removed:  # as text: code points that the cuts split stay whole
                heads = (body & 0xC0) != 0x80
                point = np.cumsum(heads) - 1
                whole = np.logical_and.reduceat(own, np.flatnonzero(heads)) if n and heads[0] else np.zeros(n, bool)
                readable = body[~whole[point]].tobytes() if n and heads[0] else kept
            else:
                readable = kept
            for x, v in zip(out, (n, removed, spans, hashlib.sha256(kept).hexdigest(), readable.decode("utf-8", "replace"))):
                x.append(v)
        cols = [c.chunk(0) if isinstance(c, pa.ChunkedArray) and c.num_chunks else c for c in extra.columns]
        arrays = [pa.array(x, f.type) for x, f in zip(out, schema)]
        yield pa.RecordBatch.from_arrays([*cols, *arrays], [*extra.schema.names, *[f.name for f in schema]])


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", carry: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row: key, the ``carry`` columns, n_bytes, n_removed, n_spans, kept_sha256, kept_text.

    A null text counts as empty. Rows of one key don't remove each other's text; null keys (and keys that are no numbers) count as one key
    that comes last. kept_sha256 is of exactly the remaining bytes; kept_text is the remaining text, where a
    code point that a cut splits stays whole. Texts under MATCH bytes are left as they are.
    """
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "suffix")
    carried = [key, *(carry or [])]
    rows = df.select(F.coalesce(F.col(key).try_cast("long"), F.lit(_LAST)).alias("__ord"), F.col(text).alias("__text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carried)])
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets, ranges = max(partitions(spark), -(-total // BUCKET_BYTES)), max(partitions(spark), -(-total // RANGE_BYTES))
    made = rows.mapInArrow(lambda it: _blocks(it, block_bytes), _BLOCK)
    blocks = scratch.stage_by(made, "block", max(partitions(spark), -(-total // (32 * block_bytes))), "uncompressed")
    # Splitters come from a bounded sample; they only balance the ranges.
    seen = blocks.select("sample", F.xxhash64("block").alias("h")).orderBy("h").limit(2000).select("sample").collect()
    sample = sorted(s[i : i + 16] for (s,) in seen for i in range(0, len(s), 16))
    splitters = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []
    body = blocks.select("block", "ords", "lens", "text")

    sent = body.mapInArrow(lambda it: _send_anchors(it, buckets), "bucket int, block long, n int, base long, grams binary, strings binary, multi binary")
    group = GROUP
    judged = sent.groupBy("bucket").applyInArrow(lambda t: _judge_anchors(t, group), "bucket int, block long, flags binary")
    found = judged.groupBy("block").agg(F.collect_list(F.struct("bucket", "flags")).alias("found"))
    runs = scratch.stage(body.join(found, "block").mapInArrow(lambda it: _runs(it, splitters), "range int, block long, n int, lcps binary, tails binary, ords binary, spots binary"))
    merged = runs.where("range >= 0").groupBy("range").applyInArrow(_merge, "range int, block long, bits binary, n int")
    bits = merged.groupBy("block").agg(F.collect_list(F.struct("range", "bits", "n")).alias("bits"))
    spots = runs.where("range = -1").groupBy("block").agg(F.collect_list("spots").alias("spots"))
    crowd = runs.where("range = -2").select("block", "n", "tails", "ords")
    windows = crowd.agg(F.sum("n")).first()[0] or 0
    found_in = max(partitions(spark), -(-windows * MATCH // RANGE_BYTES))
    packed = crowd.drop("n").mapInArrow(lambda it: _crowded(it, found_in), "bucket int, block long, at binary, windows binary, least binary")
    beaten = packed.groupBy("bucket").applyInArrow(_judge_windows, "block long, beaten binary").groupBy("block").agg(F.collect_list("beaten").alias("beaten"))
    found = spots.join(bits, "block", "left").join(beaten, "block", "left")
    fields = [pa.field("n_bytes", pa.int64()), pa.field("n_removed", pa.int64()), pa.field("n_spans", pa.int64()), pa.field("kept_sha256", pa.string()), pa.field("kept_text", pa.string())]
    schema = T.StructType([*[T.StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(carried)], *[T.StructField(f.name, T.LongType() if pa.types.is_int64(f.type) else T.StringType()) for f in fields]])
    joined = blocks.select("block", "extra", "ords", "lens", "text").join(found, "block", "left")
    out = joined.mapInArrow(lambda it: _cut(it, pa.schema(fields)), schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carried)], *[f.name for f in fields])


def op5(spark, sf_dir: str) -> DataFrame:
    """All documents without the passages that earlier documents have."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept_text")
