"""Corpus preparation: five stages of the llm operators, each on all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes to the shared folder and reads again for the next stage. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlake.llm import minhash_forest, packing, quality_classifier, quality_rules, substring_dedup
from recordlake.llm.queries import crc_fold, table, tokenizer
from recordlake.session import scratch_dir

THRESHOLD = 0.3  # of the classifier's score


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from the labels outside the held-out fold;
    a labelled document that is not in ``docs`` teaches nothing."""
    labels = table(spark, sf_dir, "labels").where(crc_fold() != 0)
    model = quality_classifier.train(docs, labels)
    return quality_classifier.accepted(docs, model, THRESHOLD)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep; accuracies are estimated on all of ``docs``."""
    return quality_rules.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): that with the smallest id."""
    found = minhash_forest.near_duplicates(docs, percent=80)
    path = f"{scratch_dir(spark, 'pipeline')}/near"
    found.write.parquet(path)
    return minhash_forest.first_of_each(docs, spark.read.parquet(path))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that an earlier document has alike (similarity 0.8);
    ``n_chars`` follows the text, and documents of which no word is left go."""
    found = substring_dedup.repeated_passages(docs, min_words=50, similarity=0.8)
    left = substring_dedup.remove_passages(docs, found)
    some = F.length(F.translate("text", " \t\n\x0b\f\r", "")) > 0
    return left.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).where(F.col("text").isNull() | some)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 1024 tokens."""
    import public_tokenizers

    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", classify_quality),
    ("quality rules", apply_rules),
    ("MinHash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("best-fit packing", pack_sequences),
]

#: Trained models, similarity and a search: no stage but the rules' counts is SQL. tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    root = scratch_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
    return docs
