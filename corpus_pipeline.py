"""A corpus pipeline: quality rules, language, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs.  All but the last return the columns of documents.

Defined results: every row is judged by its own text, so rows without an id, and rows that share
one, stay or go each; of rows that are alike in id and text the near-duplicate stage keeps one;
null, empty and blank texts go in the first stage, texts without a letter in the second; very
long texts are read whole in every stage; other columns are passed on, whatever their names;
empty input gives empty output at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from playtide.llm import language_id, packing, quality_rules, simhash, substrings
from playtide.llm.common import materialise, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned rules and the repetition rule keep."""
    return quality_rules.keep_good(docs, read_table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found."""
    return language_id.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id: SimHash and its index first, then all other links."""
    return simhash.keep_one(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that occur elsewhere."""
    return substrings.rewrite(docs, length_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", passages),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, from documents."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = materialise(out, f"stage-{name}") if k + 1 < len(STAGES) else out
    return docs


#: Learned rules, byte models and token ids are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None
