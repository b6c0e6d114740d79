"""The corpus pipeline: documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns the columns of
documents (the last one: token ids). Each is written as Parquet and read again before the next.

In every stage a null text counts as empty, null and repeated doc_ids are rows like others, lang and source may be
null, columns beside those of documents are left out, and an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.llm import bpe, mixing, simhash, suffix_dedup, toxicity
from sparkloom.runtime import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under its threshold; a null text is not toxic. Repeated rows stay."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs.select(*COLUMNS), model, out="__score")
    return scored.where(F.col("__score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least doc_id (null last); unlike texts under one doc_id, or under none, all stay."""
    return simhash.keep_one(docs.select(*COLUMNS))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document of a smaller doc_id has; one that nothing is left of keeps an empty text, a null text becomes one."""
    kept = suffix_dedup.remove_repeats(docs, carry=["lang", "source"])
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: a row for each stretch of a document that the mix takes, repeats included; a document without words gives none. A null source is one source."""
    return mixing.mix(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and the digest of the bytes that they decode to."""
    import public_tokenizers as P

    coded = bpe.encode(docs.select(*COLUMNS), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, decoded="decoded")
    ids = F.sha2("ids", 256)
    return coded.select("doc_id", "lang", "source", "n_chars", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_copies),
    ("suffix_dedup", drop_repeats),
    ("mix", mix_sources),
    ("encode", encode),
]

#: No SQL: a classifier and keyed draws are part of it; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each staged in the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.stage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
