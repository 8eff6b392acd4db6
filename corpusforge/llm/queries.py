"""One query per operator over its whole table, and the SQL where SQL can state the result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm import (
    fingerprints,
    lines,
    manifest,
    mixing,
    oracles,
    packing,
    phrases,
    quality,
    sharding,
    simhash,
    substrings,
    tokenfiles,
    tokens,
    urls,
)
from corpusforge.session import shared_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_best_fit_packing")
def op1(spark, folder):
    return packing.pack(table(spark, folder, "documents"))


@query("op2_source_mixing")
def op2(spark, folder):
    plan = mixing.mix_plan(table(spark, folder, "documents"))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("_i")
    rows = plan.select("doc_id", "size", "source_size", "target", "copies", "more", each)
    taken = (F.col("copies") + (F.col("_i") <= F.col("more")).cast("long")) * F.col("size")
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


@query("op3_document_fingerprints", oracles.FINGERPRINTS)
def op3(spark, folder):
    return fingerprints.compare_with_next(table(spark, folder, "documents"))


@query("op4_simhash_components")
def op4(spark, folder):
    return simhash.components(table(spark, folder, "documents"))


@query("op5_line_dedup")
def op5(spark, folder):
    return lines.digest(lines.dedup_lines(table(spark, folder, "documents")))


@query("op6_token_counts")
def op6(spark, folder):
    return tokens.token_counts(table(spark, folder, "documents"))


@query("op7_hash_tree_sharding")
def op7(spark, folder):
    shards = 40
    tree = sharding.even_tree(shards)
    placed = sharding.assign(table(spark, folder, "documents"), tree, sharding.with_region(tree, shards))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("op8_substring_dedup", oracles.SUBSTRINGS)
def op8(spark, folder):
    return substrings.digest(substrings.dedup_substrings(table(spark, folder, "documents")))


@query("op9_url_filters", oracles.url_sql())
def op9(spark, folder):
    return urls.judge_urls(table(spark, folder, "pages"))


@query("op10_quality_rules", oracles.quality_sql())
def op10(spark, folder):
    return quality.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op11_merkle_manifest", oracles.manifest_sql())
def op11(spark, folder):
    return manifest.tampered_proofs(table(spark, folder, "documents"))


@query("op12_token_files")
def op12(spark, folder):
    place = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    tokenfiles.write_ids(table(spark, folder, "documents"), place)
    return tokenfiles.read_documents(spark, place)


@query("op13_phrase_collocations", oracles.PHRASES)
def op13(spark, folder):
    return phrases.collocations(table(spark, folder, "documents"))
