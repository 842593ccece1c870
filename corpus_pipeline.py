"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, token shards.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; the driver writes a stage's
result as Parquet and reads it again for the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomseg.llm import decontaminate, langid, mixing, simhash, token_store
from loomseg.llm.shared import fresh_path, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language learned from them; rejected ones go (no letter, or far from every language)."""
    return langid.keep_identified(docs, langid.fit_languages(docs)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id: five-word shingles, similarity of 0.8 or more.

    Fingerprints find the candidates; the sets of shingles decide.
    """
    return simhash.simhash_dedup(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, verbatim or with other numbers and names."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.drop_contaminated(docs, items).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate says."""
    return mixing.mix(docs).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus as token shards, read back: a row per emitted document."""
    import public_tokenizers

    manifest = token_store.write_tokens(docs, fresh_path(spark, "pipeline-tokens"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_store.read_tokens(manifest, with_ids=False)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing_stage),
    ("tokens", tokens),
]
#: Language models, fingerprints by shingle majority and token ids are beyond SQL; tests/llm/test_pipeline.py has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
