"""The pipeline's stages against brute force on a small fixture."""

from __future__ import annotations

import hashlib

import numpy as np

import corpus_pipeline
from sparkloom.llm import mixing, simhash, toxicity
from tests.llm.test_ops import brute_repeats


def test_stages(spark, tmp_path):
    passage = "a shared passage that is a good deal longer than fifty bytes in all, "
    rng = np.random.default_rng(4)
    texts = [" ".join("".join(rng.choice(list("aeimnorst"), 4)) for _ in range(60)) for _ in range(24)]
    rows = [(i, (passage if i % 4 == 0 else "") + t + (" idiot moron" if i % 6 == 5 else "")) for i, t in enumerate(texts)] + [(30, texts[1]), (31, None), (32, "")]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int("idiot" in (t or ""))) for i, t in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, kept = docs, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(out := str(tmp_path / str(k)))
        now = spark.read.parquet(out)
        kept.append(now)
        if k < 4:
            assert now.columns == docs.columns, name
    model = toxicity.train(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    clean = {i: t for i, t in rows if model.score(t) < toxicity.THRESHOLD}
    assert {r.doc_id for r in kept[0].collect()} == set(clean) and not any("idiot" in (t or "") for t in clean.values())
    groups: dict[int, int] = {}
    for i, t in sorted(clean.items()):
        f = simhash.simhash(t)
        groups.setdefault(next((g for g in groups if (g ^ f).bit_count() <= 3), f), i)
    once = {i: clean[i] for i in groups.values()}
    assert {r.doc_id: r.text for r in kept[1].collect()} == once
    want = {x[0]: x[4] for x in brute_repeats(sorted(once.items()))}
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in kept[2].collect()} == want
    taken = sum(p["end"] - p["start"] for r in mixing.draw(kept[2]).collect() for p in r.pieces)
    assert sum(len(r.text.split()) for r in kept[3].collect()) == taken
    final = kept[4].collect()
    assert sorted(r.decoded_sha256 for r in final) == sorted(hashlib.sha256(r.text.encode()).hexdigest() for r in kept[3].collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(final)


def test_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated ids and rows, a clashing column; and empty tables."""
    rng = np.random.default_rng(7)
    line = lambda: " ".join("".join(rng.choice(list("aeimnorst"), 5)) for _ in range(40))
    a, b = line(), line()
    rows = [(None, a), (None, b), (7, line()), (7, line()), (8, None), (9, ""), (10, a), (10, a), (11, line() + " idiot"), (12, line() + " idiot"), (None, None), (13, "x" * 40_000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, shard long"
    docs = spark.createDataFrame([(i, t, None if k % 3 else "en", None if k % 4 else "s", None, "clash", 1) for k, (i, t) in enumerate(rows)], schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    learned = spark.createDataFrame([(100 + i, line() + (" idiot" if i % 2 else "")) for i in range(40)], "doc_id long, text string")
    labels = [(i, None, None) for i, _ in rows] + [(100 + i, 1, i % 2) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = docs.unionByName(learned, allowMissingColumns=True)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(out := str(tmp_path / str(k)))
        now = spark.read.parquet(out)
        if k == 1:
            kept = {(r.doc_id, r.text) for r in now.collect()}
            texts = {t for i, t in rows if t and "idiot" not in t} | {r.text for r in learned.collect() if "idiot" not in r.text}
            assert {t for _, t in kept if t} == texts and now.count() == len(texts) + 1  # one for all without words
            assert (10, a) in kept and (None, b) in kept
        if k == 3:
            assert now.columns == corpus_pipeline.COLUMNS
    assert now.count() > 0
    for t in ("documents", "labels"):
        spark.read.parquet(str(tmp_path / f"{t}.parquet")).where("false").write.parquet(str(tmp_path / "none" / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []
