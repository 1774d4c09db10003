"""Shared building blocks: slugs, salted top-k, histograms, running sums."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALT_BUCKETS = 32


def slug(label: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", label.lower()).strip("_")


def top_k_per_group(df: DataFrame, group_cols: list[str], order: list[Column], k: int,
                    salt_cols: list[str], buckets: int = SALT_BUCKETS,
                    rank_col: str = "rank") -> DataFrame:
    """Exact top-k per group in two stages.

    Stage 1 ranks inside (group, hash(salt_cols) mod buckets) and keeps k per
    bucket, so a hot group is spread over ``buckets`` tasks; stage 2 ranks the
    at most k*buckets survivors per group.  ``order`` must be a total order.
    """
    salt = F.pmod(F.hash(*[F.col(c) for c in salt_cols]), F.lit(buckets))
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order)
    stage1 = (df.withColumn("_salt", salt)
                .withColumn("_r1", F.row_number().over(w1))
                .where(F.col("_r1") <= k).drop("_r1", "_salt"))
    w2 = Window.partitionBy(*group_cols).orderBy(*order)
    return stage1.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= k)


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """Global top-k: Spark plans ``orderBy+limit`` as TakeOrderedAndProject
    (per-partition top-k, then a k-row merge) - no full sort."""
    return df.orderBy(*order).limit(k)


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width bins over [min, max], last bin closed, empty bins kept.

    min/max arrive as scalar subqueries (one extra aggregate pass); the bin
    grid is a ``range`` of ``bins`` rows joined to the per-bin counts.
    """
    spark = df.sparkSession
    vals = df.where(F.col(col).isNotNull())
    lo_raw = vals.select(F.min(col).cast("double")).scalar()
    hi_raw = vals.select(F.max(col).cast("double")).scalar()
    # a zero-width range is widened by 0.5 on each side (numpy convention)
    lo = F.when(lo_raw == hi_raw, lo_raw - 0.5).otherwise(lo_raw)
    hi = F.when(lo_raw == hi_raw, hi_raw + 0.5).otherwise(hi_raw)
    idx = F.least(F.floor((F.col(col) - lo) * bins / (hi - lo)), F.lit(bins - 1)).cast("int")
    counts = vals.select(idx.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(counts, "bin", "left")
            .select("bin",
                    (lo + F.col("bin") * (hi - lo) / bins).alias("bin_lo"),
                    (lo + (F.col("bin") + 1) * (hi - lo) / bins).alias("bin_hi"),
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def median(c) -> Column:
    """For values of few kinds; ``selection`` has medians of any values."""
    return F.percentile(c, 0.5)


def running_sum(df: DataFrame, groups: list[str], order: str, value: str, bucket: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` up to each row of its group by
    ``order`` (distinct in a group), in two levels.

    ``bucket`` must not fall as ``order`` rises.  Sums run inside (group,
    bucket), so a hot group is spread over its buckets; what lies before a
    bucket is a running sum of one total per bucket.
    """
    d = df.withColumn("_bucket", bucket)
    to_here = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy(*groups, "_bucket").agg(F.sum(value).alias("_total"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_total").over(
        to_here.partitionBy(*groups) if groups else to_here), F.lit(0))).drop("_total")
    inside = Window.partitionBy(*groups, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("_inside", F.sum(value).over(inside)).join(before, [*groups, "_bucket"]).withColumn(
        name, F.col("_inside") + F.col("_before")).drop("_bucket", "_inside", "_before")


def magnitude(c: Column, steps: int = 64) -> Column:
    """A bucket that does not fall as a number rises: ``steps`` per power of
    two, so at most a few ten thousand whatever the values."""
    return F.when(c > 0, F.floor(F.log2(c + 1) * steps)).otherwise(F.when(c < 0, -F.floor(F.log2(1 - c) * steps)).otherwise(0)).cast("int")
