"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codetide.llm import decontaminate, filter_audit, importance, katz, licences, mixing, prefix_trie, reply_trees, simhash, substrings, topk, toxicity, url_filter
from codetide.session import Stages

# The rules that the url query is to apply.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

# The conversation that the chat query adds, whose texts are control strings.
CONTROL_CONVERSATION = ((-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scanned(table(spark, sf_dir, "documents"))


def op2_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return katz.scored(documents, katz.fold(F.col("doc_id"), 7) == 2).drop("text_hash")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.planned(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page counts as bad if the label of its id says low quality or toxic."""
    labels = table(spark, sf_dir, "labels")
    bad = F.greatest(F.coalesce(1 - F.col("quality"), F.lit(0)), F.coalesce("toxic", F.lit(0)))
    outcomes = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, action string")
    return url_filter.judge(table(spark, sf_dir, "pages"), outcomes, rules)


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), words=True).drop("text_hash")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lambda doc: katz.fold(doc, 5) == 0)
    return found.drop("text_hash")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is a tree with one branch: every turn answers the one before."""
    planted = spark.createDataFrame(list(CONTROL_CONVERSATION), "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    keep = Stages(spark).keep
    formatted = reply_trees.formatted(keep(reply_trees.chains(turns), "chains"), keep=keep)
    return reply_trees.read_back(formatted).withColumnRenamed("tree", "conv_id").drop("leaf")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_licence_scan, op2_katz_scoring, op3_exact_topk, op4_source_mixing, op5_simhash_near_dedup, op6_substring_dedup, op7_url_filter,
                                   op8_importance_resampling, op9_toxicity, op10_decontamination, op11_filter_audit, op12_reply_trees, op13_prefix_trie)}
