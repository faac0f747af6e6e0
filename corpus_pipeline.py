"""A corpus from raw documents to token ids, in five stages.

Each stage is a function of (spark, docs, sf_dir); run() writes what it returns as Parquet in the folder that driver and
executors share and reads it back as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyhouse.llm import bpe, mixing, quality, simhash, toxicity
from tallyhouse.llm._shared import materialise, table
from tallyhouse.llm.queries import tokenizer_file, toxicity_fold


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; cutoffs follow each language and source of the input."""
    return quality.filter_quality(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the toxicity cutoff; learns from the labels of the input's documents, the held-out fourth aside."""
    labels = table(spark, sf_dir, "labels").where(toxicity_fold() != 2).select("doc_id", "toxic")
    return toxicity.filter_toxic(docs, labels)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, that with the smallest doc_id."""
    return simhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of each row, instead of the text."""
    return bpe.encode(docs, tokenizer_file())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", keep_quality),
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe encoding", encode),
]

#: Compression lengths, XXH64 fingerprints and BPE merges are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
