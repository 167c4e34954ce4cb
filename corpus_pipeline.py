"""The corpus pipeline: quality rules, exact copies, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept. ``run`` writes each stage's rows as Parquet in the shared folder and rereads
them for the next, so a lost executor costs no more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import exact_dedup, near_dedup, packing, quality, substring_dedup
from corvane.llm.common import Scratch

#: Words of a repeated passage, shingle size and similarity (percent) of near copies.
PASSAGE_WORDS, SHINGLE_WORDS, SIMILARITY = 50, 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go; short ones are judged too, as clean ones are to stay."""
    return quality.keep_good(docs, judge_short=True)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id stays."""
    return near_dedup.drop_near_duplicates(docs, shingle_words=SHINGLE_WORDS, percent=SIMILARITY)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that come more than once are cut out of every text."""
    return substring_dedup.remove_repeats(docs, window=PASSAGE_WORDS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with their token ids; workers keep no words, as other stages need the room."""
    return packing.pack(docs, with_ids=True, keep_words=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("minhash_near_dedup", near_copies),
    ("substring_dedup", repeated_passages),
    ("packing", packed),
]

#: The rows depend on tokenizer files, which SQL cannot read; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    tmp = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = tmp.save(stage(spark, docs, sf_dir), name)
        if before:
            tmp.drop(before)
        before = name
    return docs
