"""Registered queries of the training-data operators: whole tables in, whole
results out, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paygrid.llm import (cascade, html, jaccard, langid, licenses, oracles, packing, periodic, quality, recompression, resampling, secrets,
                         sharding, templates)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


@register("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"))


@register("op2_secret_scan", oracles.SECRETS)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


@register("op3_site_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source is the host, its languages are its paths."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.classify(docs, labels, F.col("source"), F.col("lang")).select(
        "doc_id", F.col("_good").alias("evidence"), F.col("_site").alias("site_log_odds"),
        F.col("_posterior").alias("posterior"), F.col("_kept").alias("kept"))


@register("op4_template_leaks")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "item_id", "covered", "item_words", "n_slots", "exact")


@register("op5_tree_scored_text", oracles.PAGES)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


@register("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@register("op7_jaccard_components", oracles.JACCARD)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(table(spark, sf_dir, "documents"))


@register("op8_recompression_dedup", oracles.REPEATS)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.remove_repeats(table(spark, sf_dir, "documents"))


@register("op9_quality_rules", oracles.RULES)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.apply_rules(table(spark, sf_dir, "documents"))


@register("op10_minimax_shards")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


@register("op11_diagonal_licenses", oracles.LICENSES)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


@register("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents is rewritten to repeat its words first."""
    return periodic.periodic_runs(table(spark, sf_dir, "documents"), places=periodic.planted)


@register("op13_ngram_resampling")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
