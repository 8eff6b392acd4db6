"""From raw documents to packed sequences: quality rules, line dedup, near-dedup, mixing, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusforge.llm import lines, mixing, packing, quality, simhash, similar
from corpusforge.session import shared_folder


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the thresholds come from the labels beside the documents.

    Null and empty texts have no words and go; repeated rows are judged alike; a null doc_id has no label.
    """
    judged = quality.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep_row=True)
    return judged.filter("kept").select("row.*")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that match an earlier line; ``n_chars`` follows the text.

    Every row stays, with a null or empty text too; rows of one doc_id and text are one document.
    """
    return lines.replace_text(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, Jaccard 0.8 or at most 3 of 64 bits differ.

    Texts without words are one group, null and empty alike; equal rows are in one group; without a doc_id
    each text is a document of its own.
    """
    return simhash.keep_one(docs, reach=3, shingle_words=similar.SHINGLE_WORDS, more_links=similar.more_links)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that the sources take their target shares, none more than three times.

    A null source is a source, the last; a null text has no words; equal rows may be taken once more or less.
    """
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, placed in sequences.

    A null or empty text is its end token alone; long texts are cut into pieces; each equal row is packed.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_rules", good_documents),
    ("line_dedup", without_repeated_lines),
    ("simhash_near_dedup", one_of_each_group),
    ("source_mixing", mixed_sources),
    ("best_fit_packing", packed),
]

#: Fingerprints and tokens are not expressible in SQL; the tests compare every stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
