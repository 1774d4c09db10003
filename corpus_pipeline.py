"""From raw documents to packed training sequences.

``STAGES`` in order: documents of low quality or toxic ones go; one document
of each group of near copies stays; documents with benchmark items go; secrets
in the text are masked; what is left is packed.  Each stage takes
``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept; its
result is written as Parquet and read again for the next.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paygrid.llm import jaccard, packing, quality, secrets, templates
from paygrid.session import write_out

MASK = "[SECRET]"
ORACLE_SQL = None     # a fitted classifier and a tokenizer: not SQL; tested stage by stage against brute force


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the site-aware classifier accepts."""
    judged = quality.classify(docs, _table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))
    return judged.where("_kept").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of similar documents: the one with the
    smallest id (null ids last), whatever other rows share that id.  Documents
    without words stay, as they link with nothing."""
    keyed = write_out(docs.withColumn("_row", F.monotonically_increasing_id()), "keyed")
    groups = jaccard.similar_components(keyed, id_col="_row").where("n_shingles > 0").select(
        F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
    groups = write_out(groups, "groups")
    many = groups.groupBy("_group").agg(F.count("*").alias("_n")).where("_n > 1").select("_group")
    rows = groups.join(many.hint("merge"), "_group").join(
        keyed.select("_row", F.col("doc_id").alias("_id")).hint("merge"), "_row")
    first = rows.groupBy("_group").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_row"))["_row"].alias("_first"))
    others = rows.join(first.hint("merge"), "_group").where("_row <> _first").select("_row")
    others = write_out(others, "near-copies")
    return keyed.join(others.hint("merge"), "_row", "left_anti").select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return templates.drop_leaked(docs, _table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by ``MASK`` and ``n_chars`` renewed."""
    return secrets.redact(docs, put=MASK).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 2048 tokens."""
    return packing.pack(spark, docs)


STAGES = [
    ("quality_classifier", keep_good),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_out(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
