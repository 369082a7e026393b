"""The corpus pipeline: five stages applied one after the other to the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and
rereads it as the next stage's docs. All stages but the last return the columns of documents.

1. ``quality``: documents that the factorisation machine rejects go. The model is fitted on the labels table and the whole
   documents table's labelled rows, never on scores; rows with null text are scored by their structure.
2. ``exact_dedup``: of documents with equal normalised texts the one with the smallest doc_id stays.
3. ``minhash``: of each near-duplicate component the document with the smallest doc_id stays; documents without words are no group.
4. ``source_mix``: documents come as often as the mix takes them, up to three times.
5. ``packing``: the pieces of all documents, with their place in sequences of 2048 tokens. A document that the mix repeats is packed
   each time; its copies have equal piece rows at different places.

Empty tables give empty results at every stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lorebank.llm import exact_dedup, minhash, mixing, packing, quality
from lorebank.llm.common import stored, table
from lorebank.plans.catalogue import prepare

#: Bytes of texts that an executor hands to a Python worker at once. Workers live through all stages and keep the memory of their largest batch.
BATCH_BYTES = 4 << 20


def _stage(run: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """Make the package importable by the session's Python workers before a stage runs, and their batches small."""

    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return prepare(lambda s, d: run(s, docs, d))(spark, sf_dir)

    call.__doc__ = run.__doc__
    return call


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model accepts."""
    return quality.good_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per normalised text."""
    return exact_dedup.dedup_texts(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per near-duplicate component."""
    return minhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality", _stage(keep_good)),
    ("exact_dedup", _stage(drop_copies)),
    ("minhash", _stage(drop_near_copies)),
    ("source_mix", _stage(mix_sources)),
    ("packing", _stage(pack_sequences)),
]

#: No SQL for a trained model and a tokenizer; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
