"""A training corpus in five stages, each an operator of ``kairoscope.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet and hands what it reads back to the next stage. All stages but the
last return the columns of ``documents``; the last adds ``shard`` and ``slot``.

Documents are told apart by their texts, so rows without a doc_id and different
texts of one doc_id are treated like all others; of rows equal in both the
near-duplicate stage keeps one. An empty table gives an empty result. A column
``shard`` or ``slot`` of the input is replaced by the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairoscope.llm import dart_minhash, decontaminate, langid, mixing, sharding
from kairoscope.llm.common import materialize, read_table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no text, or no letter in it.

    The network's language and score drop nothing; without labels there is no
    network, and documents are told by their letters alone.
    """
    model = langid.train(docs)
    if model is None:
        return docs.where(langid.has_letter(F.col("text")))
    return langid.identify(docs, model).where("lang_pred <> 'und'").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class: its least id, and of that the least text."""
    return dart_minhash.one_of_each(docs).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, question and answer."""
    hits = decontaminate.contaminated(docs.select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    hits = materialize(hits.select("content").distinct(), "pipeline-leaks")
    return docs.join(hits, dart_minhash.content(F.col("text")) == F.col("content"), "left_anti").select(docs.columns)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents until the sources have their target weights."""
    return mixing.mix(docs).select(docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the documents to shards in shuffled order."""
    return sharding.external_shuffle(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing_to_weights),
    ("sharding", shards),
]

#: Signatures, language scores and seeded hashes have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
