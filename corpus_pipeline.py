"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plinth.llm import common, decontaminate, language, mixing, simhash, tokens

#: SimHash of a text's distinct words, linked at 3 differing bits of 64.  These find few of
#: the near copies with a changed end or an appendix; ``keep_one`` adds MinHash bands of the
#: five-word shingles, so that candidates don't depend on the kind of edit.
NEAR_FEATURES, NEAR_RADIUS = None, 3


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those whose language is uncertain."""
    return language.keep_known(docs, language.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id in each group of near copies."""
    return simhash.keep_one(docs, NEAR_FEATURES, NEAR_RADIUS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in which a window of a benchmark item occurs."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the weights of domains, languages and sources ask for."""
    return mixing.keep_mixture(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token file, reads it back and returns a row for each document."""
    return tokens.round_trip(docs)


STAGES = [
    ("language_id", known_language),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminated),
    ("source_mixing", mixture),
    ("token_output", token_output),
]

#: The language model, the fingerprints' components and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.saved(docs, name)
    return docs
