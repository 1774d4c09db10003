"""Pay landscape: distributions by department, seniority, city, currency, mode.

Input is the enriched postings frame (``paygrid.sources.postings.enrich``).
Salaried rows are those with both ends of the range; ``mid_usd`` is null
for currencies without a rate and is then skipped by the statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paygrid import rules as R
from paygrid.functions import classify as C
from paygrid.operators.common import histogram, slug, top_k
from paygrid.operators.selection import box_stats, describe, medians, value_counts, with_quantiles


def salaried(p: DataFrame) -> DataFrame:
    return p.where(F.col("salary_min").isNotNull() & F.col("salary_max").isNotNull())


def with_salary(p: DataFrame) -> DataFrame:
    """Count of rows with a full range against the total."""
    return p.agg(F.count("*").alias("total"),
                 F.count_if(F.col("salary_min").isNotNull() & F.col("salary_max").isNotNull())
                 .alias("with_salary"))


def _stats(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """n/min/max/mean/median/std (ddof 1) per key x measure, long form via stack."""
    stack = "stack({n}, {pairs}) as (measure, value)".format(
        n=len(measures), pairs=", ".join(f"'{m}', cast({m} as double)" for m in measures))
    long = df.select(*keys, F.expr(stack))
    groups = [*keys, "measure"]
    rest = long.groupBy(*groups).agg(
        F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return with_quantiles(rest, value_counts(long, groups, "value"), groups, {"median": 0.5}).select(
        *groups, "n", "min", "max", "mean", "median", "std")


def salary_stats_by_currency(p: DataFrame) -> DataFrame:
    s = salaried(p).where(F.col("currency").isNotNull())
    return _stats(s, ["currency"], ["salary_min", "salary_max", "salary_mid"])


def salary_stats_usd(p: DataFrame) -> DataFrame:
    return _stats(salaried(p), [], ["min_usd", "max_usd", "mid_usd"])


def mid_histogram(p: DataFrame, bins: int = R.BINS_MID) -> DataFrame:
    return histogram(salaried(p), "mid_usd", bins)


def range_histogram(p: DataFrame, bins: int = R.BINS_RANGE) -> DataFrame:
    return histogram(salaried(p), "range_usd", bins)


def box_by(p: DataFrame, group: str = "title_department", value: str = "mid_usd") -> DataFrame:
    return box_stats(salaried(p), group, value).withColumnRenamed(group, "grp")


def department_counts(p: DataFrame, dept: str = "title_department") -> DataFrame:
    """Rows per department plus a TOTAL line (grouping-set rollup)."""
    r = p.rollup(dept).agg(F.count("*").alias("n"), F.grouping(dept).alias("_g"))
    return r.select(F.when(F.col("_g") == 1, F.lit("TOTAL")).otherwise(F.col(dept)).alias("department"), "n")


def department_pay(p: DataFrame, dept: str = "title_department") -> DataFrame:
    """Median USD midpoint and non-null count per department, by median desc."""
    s = salaried(p).select(F.col(dept).alias("department"), "mid_usd")
    return (medians(s, ["department"], "mid_usd", "median_usd").select("department", "median_usd", "n")
            .orderBy(F.desc_nulls_last("median_usd"), "department"))


def seniority_pay(p: DataFrame) -> DataFrame:
    """Rows and median per level present, in the fixed seniority order."""
    return (medians(salaried(p), ["seniority"], "mid_usd", "median_usd")
            .select("seniority", F.col("n_rows").alias("n"), "median_usd")
            .withColumn("level_rank", C.seniority_rank("seniority"))
            .orderBy("level_rank"))


def _conditional_medians(s: DataFrame, key: str, labels: list[str], value: str) -> DataFrame:
    """Median per department for each label plus overall (column index 0): the
    counted values of a department stand under their label and once more under
    the department, one selection serves both, and the cells, a bounded number
    per department, are turned into columns."""
    place = F.array_position(F.array(*[F.lit(lbl) for lbl in labels]), F.col(key))
    rows = s.select(F.col("title_department").alias("department"), F.coalesce(place, F.lit(0)).alias("_place"), value)
    counts = value_counts(rows, ["department", "_place"], value)
    both = F.when(F.col("_place") > 0, F.array(F.col("_place"), F.lit(0).cast("long"))).otherwise(F.array("_place"))
    counts = counts.withColumn("_place", F.explode(both)).groupBy("department", "_place", "_x").agg(F.sum("_c").alias("_c"))
    present = counts.groupBy("department", "_place").agg(F.sum("_c").alias("_n")).where("_n > 0")
    cells = with_quantiles(present, counts, ["department", "_place"], {"_median": 0.5})
    cols = [F.max(F.when(F.col("_place") == i, F.col("_median"))).alias(n)
            for i, n in [*enumerate(map(slug, labels), 1), (0, "overall_median")]]
    return cells.groupBy("department").agg(*cols).orderBy(F.desc_nulls_last("overall_median"), "department")


def dept_seniority_matrix(p: DataFrame) -> DataFrame:
    """Median USD midpoint, department x seniority, columns in level order."""
    return _conditional_medians(salaried(p), "seniority", R.SENIORITY_ORDER, "mid_usd")


def work_mode_summary(p: DataFrame) -> DataFrame:
    """Totals, salaried rows and median per work mode; all modes listed."""
    paid = p.withColumn("_paid", F.when(F.col("has_salary"), F.col("mid_usd")))
    agg = with_quantiles(
        paid.groupBy("work_mode").agg(F.count("*").alias("total"), F.count_if("has_salary").alias("with_salary")),
        value_counts(paid, ["work_mode"], "_paid"), ["work_mode"], {"median_usd": 0.5})
    modes = p.sparkSession.createDataFrame([(m, i) for i, m in enumerate(R.WORK_MODES)],
                                           "work_mode string, mode_rank int")
    return (F.broadcast(modes).join(agg, "work_mode", "left")
            .select("work_mode", F.coalesce("total", F.lit(0)).alias("total"),
                    F.coalesce("with_salary", F.lit(0)).alias("with_salary"), "median_usd", "mode_rank")
            .orderBy("mode_rank"))


def dept_work_mode(p: DataFrame) -> DataFrame:
    """Median by department x mode for the two located modes."""
    modes = ["Remote-Friendly", "Office-Only"]
    s = salaried(p).where(F.col("work_mode").isin(modes))
    return _conditional_medians(s, "work_mode", modes, "mid_usd")


def _strip(c):
    return F.regexp_replace(c, r"^(?U)\s+|(?U)\s+$", "")


def split_locations(loc="location"):
    """Null/empty -> ['Unknown']; else split on | or ;, strip, drop empties."""
    c = F.col(loc) if isinstance(loc, str) else loc
    parts = F.filter(F.transform(F.split(c, "[|;]"), _strip), lambda x: x != "")
    return F.when(c.isNull() | (c == ""), F.array(F.lit("Unknown"))).otherwise(parts)


def cities(df: DataFrame) -> DataFrame:
    return df.select("*", F.explode(split_locations("location")).alias("city"))


def city_counts(p: DataFrame, n: int = 15) -> DataFrame:
    """Top-n cities by roles (all postings) with the number of distinct cities."""
    c = cities(p).groupBy("city").agg(F.count("*").alias("n"))
    distinct = c.select(F.count("*")).scalar()
    return top_k(c, [F.desc("n"), F.asc("city")], n).withColumn("distinct_cities", distinct)


def city_pay(p: DataFrame, n: int = 10) -> DataFrame:
    """Top-n salaried cities by roles, ordered by median USD midpoint."""
    c = medians(cities(salaried(p)), ["city"], "mid_usd", "median_usd").select("city", F.col("n_rows").alias("n"), "median_usd")
    return top_k(c, [F.desc("n"), F.asc("city")], n).orderBy(F.desc_nulls_last("median_usd"), "city")


def pay_kpis(p: DataFrame) -> DataFrame:
    paid = p.where("has_salary")
    rest = p.agg(
        F.count("*").alias("total_roles"),
        F.count_if("has_salary").alias("with_salary"),
        F.max(F.when(F.col("has_salary"), F.col("mid_usd"))).alias("max_mid_usd"),
        F.min(F.when(F.col("has_salary"), F.col("mid_usd"))).alias("min_mid_usd"),
        F.count_distinct(F.when(F.col("has_salary"), F.col("title_department"))).alias("departments"))
    return with_quantiles(rest, value_counts(paid, [], "mid_usd"), [], {"median_usd": 0.5})


def range_spread(p: DataFrame) -> DataFrame:
    return describe(salaried(p), [], "range_usd", {"median_range_usd": 0.5}).select(
        "median_range_usd", F.col("mean").alias("mean_range_usd"))


def minmax_points(p: DataFrame) -> DataFrame:
    """Both ends of every salaried posting's range in USD, by currency, and how
    far they lie above the line of equal ends.  Ends without a rate are null."""
    return salaried(p).select("job_id", "currency", "min_usd", "max_usd", "range_usd")


def minmax_extent(p: DataFrame) -> DataFrame:
    """Ends of the line of equal ends that the points are drawn against."""
    s = salaried(p)
    return s.agg(F.min("min_usd").alias("lo"), F.max("max_usd").alias("hi"),
                 F.count("*").alias("n_points"))


def share_of_total(p: DataFrame) -> DataFrame:
    """Count and percentage per currency (salaried), work mode and status (all)."""
    s = salaried(p)
    parts = [
        s.where(F.col("currency").isNotNull()).groupBy(F.lit("currency").alias("dimension"),
                                                       F.col("currency").alias("key")).count(),
        p.groupBy(F.lit("work_mode").alias("dimension"), F.col("work_mode").alias("key")).count(),
        p.where(F.col("is_active").isNotNull()).groupBy(
            F.lit("status").alias("dimension"), C.status_label("is_active").alias("key")).count(),
    ]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    w = Window.partitionBy("dimension")
    return u.select("dimension", "key", F.col("count").alias("n"),
                    (F.col("count") * 100.0 / F.sum("count").over(w)).alias("pct"))


def top_paid(p: DataFrame, n: int = 10, highest: bool = True) -> DataFrame:
    """n highest (or lowest) USD midpoints; rows without a USD value excluded."""
    s = salaried(p).where(F.col("mid_usd").isNotNull())
    order = [F.desc("mid_usd") if highest else F.asc("mid_usd"), F.asc("job_id")]
    return top_k(s.select("job_id", "title", "mid_usd", "min_usd", "max_usd"), order, n)


def top_keys(p: DataFrame, key: str = "title_department", n: int = 12) -> DataFrame:
    c = p.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return top_k(c, [F.desc("n"), F.asc("key")], n)


def top_n_semi(p: DataFrame, key: str = "title_department", n: int = 3) -> DataFrame:
    """Rows whose key is among the n most frequent keys (semi join to a
    k-row frame; k is a parameter, so the broadcast side is bounded)."""
    keys = top_keys(p, key, n).select(F.col("key").alias(key))
    return p.join(F.broadcast(keys), key, "left_semi")


def top_per_group(p: DataFrame, group: str = "company", key: str = "title_department",
                  n: int = 3) -> DataFrame:
    c = p.groupBy(group, key).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), F.asc(key))
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def fx_lookup(p: DataFrame) -> DataFrame:
    """Left join to the 5-row rate dimension (fixed size: safe to broadcast)."""
    dim = p.sparkSession.createDataFrame(list(R.TO_USD.items()), "currency string, rate double")
    return p.select("job_id", "currency").join(F.broadcast(dim), "currency", "left")


def kde_curve(p: DataFrame, col: str = "mid_usd", grid: int = 200, bins: int = R.BINS_MID) -> DataFrame:
    """Gaussian kernel density under the histogram: bandwidth = sample std *
    n^-1/5 (Scott), evaluated on ``grid`` points over [min, max] and scaled
    to expected rows per histogram bin.

    Values are first collapsed to (value, count), and each distinct value
    adds to the fixed grid through an array transform - no join, and the
    work grows with distinct values, not rows x rows.
    """
    v = salaried(p).where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("v"))
    vals = v.groupBy("v").agg(F.count("*").alias("c"))
    st = v.agg(F.count("*").alias("n"), F.stddev_samp("v").alias("sd"), F.min("v").alias("lo"),
               F.max("v").alias("hi")).where("sd is not null and hi <> lo")
    st = st.select("lo", "hi", (F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("h"),
                   ((F.col("hi") - F.col("lo")) / (grid - 1)).alias("step"))
    lo, hi, h, step = (F.col(c) for c in ("lo", "hi", "h", "step"))
    pts = F.sequence(F.lit(0), F.lit(grid - 1))
    contrib = vals.join(F.broadcast(st)).select("lo", "hi", "h", "step", F.posexplode(F.transform(   # one row
        pts, lambda i: F.col("c") * F.exp(-F.pow((lo + i * step - F.col("v")) / h, 2) / 2))).alias("i", "w"))
    dens = contrib.groupBy("i", "lo", "hi", "h", "step").agg(F.sum("w").alias("w"))
    norm = 1.0 / (h * F.sqrt(F.lit(2 * 3.141592653589793)))
    return dens.select("i", (lo + F.col("i") * step).alias("x"),
                       (F.col("w") * norm * (hi - lo) / bins).alias("expected_rows"))
