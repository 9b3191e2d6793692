"""Queries of the training-data operators: name -> callable(spark, folder), and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import leakage, mixing, moderation, neardup, packing, pairs, tokens
from corpusmill.llm.oracles import ORACLES  # noqa: F401
from corpusmill.session import materialise
from corpusmill.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_document_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.document_tokens(spark, table(spark, folder, "documents"), table(spark, folder, "fineweb"))


def p1_token_budget(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_budget(p1_document_tokens(spark, folder), table(spark, folder, "training_manifest"))


def _p2_mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(mixing.document_records(spark, table(spark, folder, "documents")), table(spark, folder, "datasets_config"))


def p2_selection(spark: SparkSession, folder: str) -> DataFrame:
    return _p2_mix(spark, folder)[0].select("phase", "name", F.col("id").alias("doc_id"), F.col("size").alias("n_tokens"), "uses")


def p2_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(*_p2_mix(spark, folder))


def p3_defects(spark: SparkSession, folder: str) -> DataFrame:
    math = table(spark, folder, "open_math_reasoning").select(
        F.lit("open_math_reasoning").alias("source_table"), "row_id", F.lit("solution").alias("kind"), F.col("problem").alias("question"), F.col("generated_solution").alias("answer")
    )
    calls = table(spark, folder, "apigen_fc").select(
        F.lit("apigen_fc").alias("source_table"), "row_id", F.lit("calls").alias("kind"), F.col("query").alias("question"), F.col("answers").alias("answer")
    )
    return pairs.pair_defects(math.unionByName(calls))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_defects(spark, folder).where("priority = 1").select("source_table", "row_id", "defect")


def _p4_records(spark: SparkSession, folder: str) -> DataFrame:
    web = table(spark, folder, "fineweb").select(F.lit("fineweb").alias("scope"), F.col("row_id").alias("id"), "text")
    chats = table(spark, folder, "nemotron_post_training").select(F.lit("nemotron_post_training").alias("scope"), F.col("row_id").alias("id"), neardup.chat_text().alias("text"))
    return web.unionByName(chats)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    near = neardup.near_duplicates(_p4_records(spark, folder), neardup.HALF_OF_THREE_WORDS)
    return neardup.record_pairs(near).select(F.col("scope").alias("source_table"), F.col("id_a").alias("row_id_a"), F.col("id_b").alias("row_id_b"))


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    near = neardup.near_duplicates(_p4_records(spark, folder), neardup.HALF_OF_THREE_WORDS)
    return neardup.groups(near).withColumnRenamed("scope", "source_table").withColumnRenamed("id", "row_id")


def p5_windows(spark: SparkSession, folder: str) -> DataFrame:
    sized = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), tokens.token_count(spark, F.col("text"), kind="bpe").alias("size"))
    return packing.windows(materialise(sized), table(spark, folder, "curriculum")).withColumnRenamed("id", "doc_id")


def p5_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(p5_windows(spark, folder))


def p6_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_coverage(spark, folder).where(f"longest >= {leakage.LEAST}").select("doc_id", "item_id")


def p6_mostly_leaked(spark: SparkSession, folder: str) -> DataFrame:
    """Items of which a document holds at least half, in whatever order the passages stand."""
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"), least_coverage=0.5)


def p7_scores(spark: SparkSession, folder: str) -> DataFrame:
    return moderation.moderate(table(spark, folder, "documents"), table(spark, folder, "moderation_samples"), table(spark, folder, "flag_terms"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_scores(spark, folder).where(f"score >= {moderation.THRESHOLD}").select("doc_id")


def p7_source_rates(spark: SparkSession, folder: str) -> DataFrame:
    return moderation.source_rates(p7_scores(spark, folder))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_document_tokens, p1_token_budget, p2_selection, p2_shares, p3_found, p3_defects, p4_found, p4_groups, p5_windows, p5_fill, p6_found, p6_coverage, p6_mostly_leaked, p7_found, p7_scores, p7_source_rates)}
