"""Exact quantiles of hot groups.

``percentile`` keeps a map of all values of a group in one buffer.  Here the
values are first counted by (group, value), which spreads a group over all
tasks, and the wanted ranks are then narrowed down: counts per coarse range
tell which range holds a rank, counts per fine range inside it narrow further,
and only the few values that are left are put in order.  All steps share the
exchange of the value counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paygrid.operators.common import magnitude

FINE = 4096         # ranges that a coarse range is split into


def value_counts(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """``(*groups, _x, _c)``: how often each value (null too) occurs in a group."""
    return df.select(*groups, F.col(value).cast("double").alias("_x")).groupBy(*groups, "_x").agg(
        F.count("*").alias("_c"))


def _holding(counts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of ``counts`` whose range holds one of the ranks ``_ranks``, which
    are cut to those inside; ``_before`` moves up to the range's first rank.
    A window sees one row per range, of which there are a bounded number."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    c = counts.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_n").over(w), F.lit(0)))
    inside = F.filter("_ranks", lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n")))
    return c.withColumn("_ranks", inside).where(F.size("_ranks") > 0).drop("_n")


def _rank(total: Column, fraction: float) -> Column:
    return (total - 1) * F.lit(float(fraction))


def ranked_values(counts: DataFrame, groups: list[str], fractions: list[float]) -> DataFrame:
    """``(_g, _n, _at)`` per group that has a value: the struct of its keys,
    the number of its values and a map from rank to value for the ranks on
    both sides of every fraction."""
    # a struct compares null keys as equal, in joins too; conditions that could be moved below the
    # counting would keep the steps from sharing its exchange: so the filter reads the count, and
    # what is joined on is never null
    rows = counts.where(F.when(F.col("_x").isNotNull(), F.col("_c")) > 0).select(
        F.struct(F.lit(0).alias("_"), *groups).alias("_g"), "_x", "_c", F.coalesce(magnitude(F.col("_x")), F.lit(0)).alias("_b"))
    coarse = rows.groupBy("_g", "_b").agg(F.sum("_c").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    total = F.sum("_n").over(Window.partitionBy("_g"))
    ends = [end(_rank(F.col("_total"), f)).cast("long") for f in fractions for end in (F.floor, F.ceil)]
    coarse = coarse.withColumn("_total", total).withColumns({
        "_ranks": F.array_distinct(F.array(*ends)), "_before": F.lit(0).cast("long")})
    coarse = _holding(coarse, ["_g"], "_b")

    width = F.col("_hi") - F.col("_lo")
    part = F.when(width > 0, F.least(F.floor((F.col("_x") - F.col("_lo")) / width * FINE), F.lit(FINE - 1))).otherwise(0)
    near = rows.join(coarse, ["_g", "_b"]).withColumn("_part", F.coalesce(part.cast("int"), F.lit(0))).select(
        "_g", "_b", "_part", "_x", "_c", "_total", "_before", "_ranks")
    known = ["_g", "_b", "_total", "_before", "_ranks"]
    fine = _holding(near.groupBy(*known, "_part").agg(F.sum("_c").alias("_n")), ["_g", "_b"], "_part")

    left = near.drop("_total", "_before", "_ranks").join(fine, ["_g", "_b", "_part"]).withColumnRenamed("_c", "_n")
    exact = _holding(left, ["_g", "_b", "_part"], "_x")
    return exact.select("_g", "_total", "_x", F.explode("_ranks").alias("_rank")).groupBy("_g", "_total").agg(
        F.map_from_entries(F.collect_list(F.struct("_rank", "_x"))).alias("_at")).withColumnRenamed("_total", "_n")


def quantile_columns(fractions: dict[str, float]) -> dict[str, Column]:
    """Linear interpolation between the ranks on both sides of each fraction."""
    out = {}
    for name, f in fractions.items():
        at = _rank(F.col("_n"), f)
        lo, hi = F.floor(at), F.ceil(at)
        a, b = F.col("_at")[lo.cast("long")], F.col("_at")[hi.cast("long")]
        out[name] = F.when(a == b, a).otherwise((hi - at) * a + (at - lo) * b)
    return out


def with_quantiles(summary: DataFrame, counts: DataFrame, groups: list[str], fractions: dict[str, float]) -> DataFrame:
    """``summary`` (one row per group) with an exact quantile of the counted
    values for each name; null where a group has no value."""
    q = ranked_values(counts, groups, list(fractions.values())).select(
        "_g", *[c.alias(n) for n, c in quantile_columns(fractions).items()])
    keyed = summary.withColumn("_g", F.struct(F.lit(0).alias("_"), *groups))
    return keyed.join(q, "_g", "left").drop("_g")


def describe(df: DataFrame, groups: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Per group: ``n_rows``, ``n`` (values), ``lo``, ``hi``, ``mean`` and the
    named quantiles, from one read of ``df``.  No group's values are held by
    one task.  Without ``groups`` there is one row, also for an empty ``df``."""
    c = value_counts(df, groups, value)
    filled = F.when(F.col("_x").isNotNull(), F.col("_c"))
    summary = c.groupBy(*groups).agg(
        F.coalesce(F.sum("_c"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(filled), F.lit(0)).alias("n"),
        F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.try_divide(F.sum(F.col("_x") * F.col("_c")), F.sum(filled)).alias("mean"))
    return with_quantiles(summary, c, groups, fractions)


def medians(df: DataFrame, groups: list[str], value: str, name: str = "median") -> DataFrame:
    """``(*groups, n_rows, n, <name>)``: rows, values and exact median per group."""
    return describe(df, groups, value, {name: 0.5}).select(*groups, "n_rows", "n", name)


def box_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, 1.5-IQR whiskers (furthest datum inside) and outlier count of
    the groups that have a value, null groups left out."""
    v = value_counts(df.where(F.col(value).isNotNull() & F.col(group).isNotNull()), [group], value)
    n = v.groupBy(group).agg(F.sum("_c").alias("n"))
    q = with_quantiles(n, v, [group], {"q1": 0.25, "median": 0.5, "q3": 0.75})
    x, reach = F.col("_x"), 1.5 * (F.col("q3") - F.col("q1"))
    lo_fence, hi_fence = F.col("q1") - reach, F.col("q3") + reach
    return (v.join(q, group)
             .groupBy(group, "n", "q1", "median", "q3")
             .agg(F.min(F.when(x >= lo_fence, x)).alias("whisker_lo"),
                  F.max(F.when(x <= hi_fence, x)).alias("whisker_hi"),
                  F.coalesce(F.sum(F.when((x < lo_fence) | (x > hi_fence), F.col("_c"))), F.lit(0)).alias("n_outliers")))
