"""Corpus preparation: toxic texts, exact copies and near copies go, sources are mixed, and what is left becomes tokens.

Each stage reads all rows that the one before kept. All but the last return the columns of `documents`; the last returns
a row of token counts and digests for each time that the mix takes a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treeline.llm import byte_bpe, exact_dedup, mixing, near_dedup, toxicity
from treeline.llm._store import staged, table
from treeline.plans.shipping import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold; null and empty texts get the score of no toxic words and stay. The tagger learns from `labels` and `documents` of sf_dir."""
    ship(spark)
    return toxicity.clean(docs, toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of those whose texts are equal but for white space; null counts as empty, and a row without id stays only if its group has no ids."""
    ship(spark)
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each class of near copies: five words, similarity 0.8. Null, empty and blank texts are in no class and stay."""
    ship(spark)
    return near_dedup.near_dedup(docs, 5, 80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it. Texts without words are taken as often as their source is as a whole; a null source is a source."""
    ship(spark)
    return mixing.mix(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document; null counts as empty."""
    ship(spark)
    return byte_bpe.token_digests(docs, *byte_bpe.vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte-level BPE", to_tokens),
]
#: The trained tagger, hash thresholds and token merges have no SQL; tests hold each stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "-".join(name.split()))
    return STAGES[-1][1](spark, docs, sf_dir)
