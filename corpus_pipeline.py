"""A corpus from raw documents to packed sequences: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet to the shared
folder and gives it to the next stage as its documents. Stages other than the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from adtflow.llm import decontaminate, jaccard_join, packing, quality, suffix_dedup
from adtflow.llm.common import materialize, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the rule ensemble rejects (score under 0.3). It learns from the raw documents."""
    model = quality.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest id, of each class of near-duplicates: five words, similarity 0.8 or more."""
    return jaccard_join.one_each(docs, n=5, percent=80)


#: A passage is a run of so many whole words, taken to be of four bytes each (three letters and a space) at least.
PASSAGE_WORDS, PASSAGE_BYTES = 50, 200


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the passages of 50 words or more that stand in two documents, and without documents of nothing else. What
    a document repeats within itself stays."""
    return suffix_dedup.cut(docs, PASSAGE_BYTES, across=True, least_words=PASSAGE_WORDS)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a copied or edited benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' pieces and their places in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", one_of_each),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", without_leaks),
    ("best-fit packing", packed),
]

#: SQL can express neither the learnt rules nor the tokenizer; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
