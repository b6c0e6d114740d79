"""The registered queries op1 to op10, at their production parameters, against independent versions over awkward rows.

The rows have nulls in every column, empty and very long texts, repeated keys and rows, and columns of clashing names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import tarfile
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
import xxhash

from sparkloom.llm import ctph, langid, media, mixing, queries, simhash, toxicity
from sparkloom.runtime import shared_dir
from tests.llm.test_ops import brute_repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, fp long, row string, h1 long"
VOWELS = {"en": "theandofing", "de": "schüberwelt", "fr": "éauquioùles"}


def _texts():
    rng = np.random.default_rng(11)
    word = lambda lang: "".join(rng.choice(list(VOWELS[lang]), int(rng.integers(2, 8))))
    line = lambda lang, n: " ".join(word(lang) for _ in range(n))
    shared = line("en", 30)
    rows = []
    for i in range(90):
        lang = list(VOWELS)[i % 3]
        t = line(lang, int(rng.integers(5, 120)))
        if i % 9 == 0:
            t = shared + " " + t
        if i % 10 == 5:
            t += " you worthless idiot"
        rows.append((i, t, lang, f"s{i % 4}" if i % 11 else None))
    rows += [(100, rows[3][1], "en", "s1"), (101, rows[3][1].upper(), "en", "s1"), (100, rows[3][1], "en", "s1")]  # copies, a repeated row
    rows += [(102, None, None, None), (103, "", "de", "s1"), (104, " \n\t", None, "s2"), (105, "12 34 !?", "en", None), (None, "a text without a key", "en", "s1"), (None, None, None, None)]
    long_ = line("fr", 9000)
    rows += [(106, long_, "fr", "s3"), (107, "x" * 70_000, "en", "s3"), (108, long_[:20_000] + "!" + long_[20_000:], "fr", None)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return _texts()


@pytest.fixture(scope="module")
def data(spark, rows, tmp_path_factory):
    folder = tmp_path_factory.mktemp("docs")
    spark.createDataFrame([(i, t, lang, s, len(t or ""), "k", 7, "r", 5) for i, t, lang, s in rows], SCHEMA).repartition(5).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(i, 1, int("idiot" in (t or ""))) for i, t, *_ in rows if i is not None and i < 100] + [(5, 0, 1), (900, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder)


def run(spark, data, name):
    return queries.QUERIES[name](spark, data).collect()


def keyed(got, value):
    return sorted((str(r.doc_id), value(r)) for r in got)


def test_op1(spark, data, rows):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t, *_ in rows:
        ids = [x for piece in regex.findall(P.PATTERN, t or "") for x in encoding._encode_single_piece(piece)]
        assert ids == encoding.encode_ordinary(t or "")
        want.append((str(i), (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())))
    assert keyed(run(spark, data, "op1_bpe"), lambda r: (r.n_tokens, r.ids_sha256, r.decoded_sha256)) == sorted(want)


def test_op2(spark, data, rows):
    got = run(spark, data, "op2_sharding")
    assert keyed(got, lambda r: (r.size, r.text_crc32, r.law, r.grown_shard)) == sorted((str(i), (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows", None)) for i, t, *_ in rows)
    counts = np.bincount([r.shard for r in got], minlength=16)
    assert len(counts) == 16 and counts.max() - counts.min() <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in enumerate(counts))
    crc = zlib.crc32(rows[3][1].encode())
    assert len({r.shard for r in got if r.text_crc32 == crc}) == 1  # a group that fits its shard


def naive_fingerprint(text):
    """The fingerprint as its docstring has it, byte by byte."""
    data, mask32, mask64 = (text or "").encode(), (1 << 32) - 1, (1 << 64) - 1
    if not data:
        return "0:::"
    level = []
    for i in range(len(data)):
        h = 0
        for j in range(7):
            at = i - 6 + j
            h = (h + (data[at] if at >= 0 else 0) * pow(0x01000193, j, 1 << 32)) & mask32
        h ^= h >> 15
        h = h * 0x85EBCA6B & mask32
        h ^= h >> 13
        n = 0
        while n < 32 and h >> n & 1:
            n += 1
        level.append(n)
    k = 0
    while sum(n >= k for n in level) >= 64:
        k += 1
    out = [str(k)]
    for size in (k, k + 1, k + 2):
        signature, value, power, open_ = "", 0, 1, False
        for b, n in zip(data, level):
            value, power, open_ = (value + (b + 1) * power) & mask64, power * 0x9E3779B97F4A7C15 & mask64, True
            if n >= size:
                value ^= value >> 32
                signature += ctph._ALPHABET[(value * 0xD6E8FEB86659FD93 & mask64) >> 58]
                value, power, open_ = 0, 1, False
        if open_:
            value ^= value >> 32
            signature += ctph._ALPHABET[(value * 0xD6E8FEB86659FD93 & mask64) >> 58]
        out.append(signature)
    return ":".join(out)


def naive_likeness(a, b):
    if a == b:
        return 1.0
    best = 0.0
    (ka, *xs), (kb, *ys) = a.split(":"), b.split(":")
    for i, x in enumerate(xs):
        for j, y in enumerate(ys):
            if int(ka) + i != int(kb) + j or not x or not y:
                continue
            n = min(4, max(1, min(len(x), len(y)) // 3))
            if x != y and not any(x[p : p + n] == y[q : q + n] for p in range(len(x) - n + 1) for q in range(len(y) - n + 1)):
                continue
            row = [0] * (len(y) + 1)  # the edit distance of insertions and deletions by the longest common subsequence
            for c in x:
                last = 0
                for q, e in enumerate(y):
                    last, row[q + 1] = row[q + 1], last + 1 if c == e else max(row[q + 1], row[q])
            best = max(best, 1 - (len(x) + len(y) - 2 * row[-1]) / (len(x) + len(y)))
    return best


def test_op4(spark, data, rows):
    got = run(spark, data, "op4_ctph")
    assert len(got) == len(rows)
    ordered = sorted(((i, t or "") for i, t, *_ in rows), key=lambda x: (x[0] is None, x[0] or 0))
    plain = [i for i, _ in ordered if i is not None and [k for k, _ in ordered].count(i) == 1]
    by = {r.doc_id: r for r in got}
    for n, (i, t) in enumerate(ordered[:-1]):
        following_key, following = ordered[n + 1]
        if i not in plain or following_key not in plain:
            continue
        r, half = by[i], len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(naive_likeness(r.fingerprint, r.edited_fingerprint)) and r.near_next == pytest.approx(naive_likeness(r.fingerprint, by[following_key].fingerprint))
        if len(t) < 3000:
            assert r.fingerprint == naive_fingerprint(t) and r.edited_fingerprint == naive_fingerprint(edited)
    assert by[106].near_next < 0.5 < ctph.likeness(by[106].fingerprint, by[108].fingerprint)


def test_op5(spark, data, rows):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, data, "op5_suffix_dedup"))
    assert got == sorted((str(i), *rest) for i, *rest in brute_repeats([(i, t) for i, t, *_ in rows]))


def test_a_string_in_a_third_of_all_documents(spark, tmp_path, monkeypatch):
    from sparkloom.llm import suffix_dedup

    rng = np.random.default_rng(9)
    common = "the very same notice stands in a third of all of these documents, word for word. "
    texts = [(common if i % 3 == 0 else "") + "".join(rng.choice(list("abcdefgh "), int(rng.integers(20, 200)))) for i in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    monkeypatch.setattr(suffix_dedup, "GROUP", 3)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, block_bytes=2000).collect())
    assert got == sorted(brute_repeats(list(enumerate(texts))))


def naive_targets(sizes, weights, total):
    """The level at which shares by weight, each at most twice its size, fill the total; by halving."""
    total = min(total, 2 * sum(sizes))
    low, high = 0.0, 4.0 * max(sizes) + total
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(mid * w, 2 * s) for s, w in zip(sizes, weights)) < total else (low, mid)
    return [min(high * w, 2 * s) for s, w in zip(sizes, weights)]


def test_op6(spark, data, rows):
    got = run(spark, data, "op6_mixing")
    size = lambda t: len(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()))
    sources = sorted({s for *_, s in rows if s is not None}) + [None]
    sizes = [sum(size(t) for _, t, _, s in rows if s == name) for name in sources]
    target = dict(zip(sources, naive_targets(sizes, [(5, 2, 1)[k % 3] for k in range(len(sources))], 1.5 * sum(sizes))))
    total = dict(zip(sources, sizes))
    assert keyed(got, lambda r: (r.size, r.source_size, round(r.target, 6))) == sorted((str(i), (size(t), total[s], round(target[s], 6))) for i, t, _, s in rows)
    assert all(r.taken <= 2 * r.size for r in got)
    own = {(i, size(t)): s for i, t, _, s in rows}
    for name in sources:
        taken = sum(r.taken for r in got if own[r.doc_id, r.size] == name)
        assert abs(taken - target[name]) <= max(2, total[name] // mixing.LEAST_BLOCKS + 1)
    assert keyed(got, lambda r: r.taken) == keyed(run(spark, data, "op6_mixing"), lambda r: r.taken)


def test_op7(spark, data, rows):
    got = run(spark, data, "op7_media")
    want = []
    for i, t, *_ in rows:
        body = (t or "").encode()
        padded = body + b" " * ((192 - len(body) % 192) % 192 if body else 192)
        want.append((str(i), (len(body), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))))
    assert keyed(got, lambda r: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32)) == sorted(want)
    by: dict[str, set] = {}
    for r in got:
        by.setdefault(r.payload_sha256, set()).add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by.values())
    # The stored form, read by other means: the tar's own index, the PNG's chunks, unfiltered rows.
    folder = shared_dir(spark).removeprefix("file://")
    import glob

    for r in got[:12]:
        (path,) = glob.glob(f"{folder}/**/{r.shard}", recursive=True)
        with tarfile.open(path) as tar:
            member = next(m for m in tar.getmembers() if m.offset_data == r.offset)
            png = tar.extractfile(member).read()
        assert len(png) == r.media_bytes and hashlib.sha256(png).hexdigest() == r.media_sha256 == member.name.removesuffix(".png")
        assert png[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">IIBB", png[16:26]) == (r.width, r.height, r.bit_depth, 0)
        at, idat = 8, b""
        while at < len(png):
            n, kind = struct.unpack(">I4s", png[at : at + 8])
            idat += png[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
            at += 12 + n
        raw = zlib.decompress(idat)
        lines = [raw[y * (r.width + 1) : (y + 1) * (r.width + 1)] for y in range(r.height)]
        assert all(x[0] == 0 for x in lines) and hashlib.sha256(b"".join(x[1:] for x in lines)).hexdigest() == r.payload_sha256
    with pytest.raises(ValueError):
        media.read_header(b"GIF89a" + b"\0" * 40)


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def test_op8(spark, data, rows):
    got = run(spark, data, "op8_langid")
    assert sorted((str(r.doc_id), r.held_out) for r in got) == sorted((str(i), held(i)) for i, *_ in rows)
    none = {i for i, t, *_ in rows if t is None or not any(c.isalpha() for c in t)}
    assert all((r.lang_pred == "und") == (r.doc_id in none) for r in got if r.doc_id is not None) and all(0 <= r.score <= 1 for r in got)
    lang = {i: name for i, _, name, _ in rows}
    own = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out and r.doc_id is not None and r.doc_id < 90]
    assert np.mean(own) > 0.9 and {r.lang_pred for r in got} <= set(VOWELS) | {"und"}


def test_the_network_is_a_byte_convolution():
    """Responses, pooling and softmax by loops; gradients by differences."""
    model = langid.ByteCNN(["a", "b"], seed=3)
    x = np.random.default_rng(0).integers(0, 256, (3, 20)).astype(np.uint8)
    p = model.probabilities(x)
    for row, got in zip(x, p):
        pooled = []
        for w, f, b in zip(langid.WIDTHS, model.filters, model.bias):
            pooled += [max(0.0, max(sum(float(model.embed[row[at + j]] @ f[j, :, k]) for j in range(w)) for at in range(len(row) - w + 1)) + float(b[k])) for k in range(langid.FILTERS)]
        z = np.array(pooled) @ model.out + model.out_bias
        assert got == pytest.approx(np.exp(z - z.max()) / np.exp(z - z.max()).sum(), abs=1e-4)
    y = np.array([0, 1, 1])
    loss = lambda: -float(np.log(model.probabilities(x)[np.arange(3), y].astype(np.float64)).mean())
    gradients = model._gradients(x, y)
    for part, g in zip(model._parameters(), gradients):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept, step = part[at], 1e-2
        part[at] = kept + step
        up = loss()
        part[at] = kept - step
        down = loss()
        part[at] = kept
        assert (up - down) / (2 * step) == pytest.approx(float(g[at]), rel=0.15, abs=2e-3)


def test_op9(spark, data, rows):
    got = run(spark, data, "op9_toxicity")
    assert sorted((str(r.doc_id), r.held_out) for r in got) == sorted((str(i), held(i)) for i, *_ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.predicted == (r.doc_id % 10 == 5) for r in got if r.doc_id is not None and r.doc_id < 90)
    documents, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(documents, labels)
    for _, t, *_ in rows[:30]:
        found = {w for w in re.findall(r"[^\W\d_]+", (t or "").lower())}
        z = model.base + sum(v for f, v in model.weights.items() if f in found or (f.endswith("*") and any(len(w) > len(f) - 1 and w.startswith(f[:-1]) for w in found)))
        assert model.score(t) == pytest.approx(1 / (1 + np.exp(-z)))


def test_op10(spark, data, rows):
    def naive(t):
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        grams = [b" ".join(words[j : j + 3]) for j in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    marks = [naive(t) for _, t, *_ in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (marks[a] ^ marks[b]).bit_count() <= 3 and label[a] != label[b]:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    least = {c: min((i for (i, *_), x in zip(rows, label) if x == c and i is not None), default=None) for c in label}
    want = sorted((str(i), (f"{m:016x}", least[c])) for (i, *_), m, c in zip(rows, marks, label))
    assert sorted(want, key=str) == sorted(keyed(run(spark, data, "op10_simhash"), lambda r: (r.fingerprint, r.component_id)), key=str)


def test_three_segment_budget():
    """Every pair within three bits keeps to the budgets 0, 1, 2 from some segment on, so pruning by chains loses none."""
    rng = np.random.default_rng(4)
    for _ in range(3000):
        x = sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 4)), replace=False))
        n = [(x >> 16 * i & 0xFFFF).bit_count() for i in range(4)]
        assert any(all(sum(n[(s + j) % 4] for j in range(k + 1)) <= k for k in range(3)) for s in range(4))
    assert [int(c).bit_count() for c in simhash._CHAINS] == [48] * 4


def test_empty_tables(spark, data, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{data}/{t}.parquet").where("false").write.parquet(str(tmp_path / f"{t}.parquet"))
    for name in ("op1_bpe", "op2_sharding", "op4_ctph", "op5_suffix_dedup", "op6_mixing", "op7_media", "op8_langid", "op9_toxicity", "op10_simhash"):
        assert queries.QUERIES[name](spark, str(tmp_path)).collect() == [], name
