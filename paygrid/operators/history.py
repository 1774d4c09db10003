"""History: hiring volume, open roles over time, quarterly pay, time to fill,
re-posted titles, and the snapshot fold that builds history.

Input for the analyses is a history frame (``job_id, title, first_seen,
last_seen, is_active, salary_*, mid_usd, title_department, seniority``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paygrid import rules as R
from paygrid.functions import classify as C
from paygrid.operators.common import histogram, running_sum, top_k
from paygrid.operators.pay import salaried
from paygrid.operators.selection import describe, medians, value_counts, with_quantiles


def history_kpis(h: DataFrame) -> DataFrame:
    return h.agg(F.count("*").alias("total"),
                 F.count_if(F.col("salary_min").isNotNull() & F.col("salary_max").isNotNull())
                 .alias("with_salary"),
                 F.count_if("is_active").alias("active"),
                 F.count_if(~F.col("is_active")).alias("closed"),
                 F.min("first_seen").alias("first_date"), F.max("last_seen").alias("last_date"))


def _month(c):
    return F.trunc(c, "month")


def monthly_new_closed(h: DataFrame) -> DataFrame:
    """New postings by first-seen month, closings by last-seen month of
    inactive rows; full outer alignment, missing -> 0."""
    new = h.groupBy(_month("first_seen").alias("month")).agg(F.count("*").alias("n_new"))
    closed = (h.where(~F.col("is_active"))
               .groupBy(_month("last_seen").alias("month")).agg(F.count("*").alias("n_closed")))
    return (new.join(closed, "month", "full")
               .select("month", F.coalesce("n_new", F.lit(0)).alias("n_new"),
                       F.coalesce("n_closed", F.lit(0)).alias("n_closed"))
               .orderBy("month"))


def peak_month(h: DataFrame) -> DataFrame:
    new = h.groupBy(_month("first_seen").alias("month")).agg(F.count("*").alias("n"))
    return top_k(new, [F.desc("n"), F.asc("month")], 1)


def _sunday_on_or_after(d):
    return F.next_day(F.date_sub(d, 1), "Sun")


def weekly_open_roles(h: DataFrame) -> DataFrame:
    """Roles open on each Sunday from the first Sunday on/after the earliest
    first_seen up to the latest last_seen (weeks with 0 kept).

    Linear form of the interval-stabbing join: each posting contributes +1 at
    the first Sunday it covers and -1 at the first Sunday after it ends; the
    deltas are summed per Sunday (map-side combine), then a running sum runs
    over the week grid, which has one row per week of the date span.
    """
    grid = _week_deltas(h)
    w = Window.orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    return grid.select("week", F.sum("delta").over(w).cast("bigint").alias("active_roles"))


def running_open_roles(h: DataFrame) -> DataFrame:
    """``weekly_open_roles`` for a grid of any length: sums run inside years,
    and one total per year is carried over, so no task holds the whole grid."""
    year = F.floor(F.datediff("week", F.lit("1970-01-04").cast("date")) / (7 * 52))
    return running_sum(_week_deltas(h), [], "week", "delta", year, "active_roles").select("week", F.col("active_roles").cast("bigint").alias("active_roles"))


def _week_deltas(h: DataFrame) -> DataFrame:
    """``(week, delta)`` for every Sunday of the span: roles that it is the first
    Sunday of, less those whose last has passed."""
    spark = h.sparkSession
    s = _sunday_on_or_after(F.col("first_seen"))
    e = F.next_day(F.col("last_seen"), "Sun")
    spans = h.where(F.col("first_seen").isNotNull() & F.col("last_seen").isNotNull()).select(
        s.alias("s"), e.alias("e"))
    spans = spans.where(F.col("s") < F.col("e"))
    deltas = (spans.select(F.explode(F.array(F.struct(F.col("s").alias("week"), F.lit(1).alias("d")),
                                             F.struct(F.col("e").alias("week"), F.lit(-1).alias("d"))))
                           .alias("x"))
                   .groupBy(F.col("x.week").alias("week")).agg(F.sum("x.d").alias("delta")))
    lo = h.select(F.min("first_seen")).scalar()
    hi = h.select(F.max("last_seen")).scalar()
    grid = spark.range(1).select(F.explode(
        F.sequence(_sunday_on_or_after(lo), hi, F.expr("interval 7 days"))).alias("week"))
    return grid.join(deltas, "week", "left").select("week", F.coalesce("delta", F.lit(0)).alias("delta"))


def peak_week(h: DataFrame) -> DataFrame:
    return top_k(weekly_open_roles(h), [F.desc("active_roles"), F.asc("week")], 1)


def dept_month_matrix(h: DataFrame) -> DataFrame:
    """New postings month x department (fixed label set, 0-filled), no Other."""
    labels = [lbl for lbl, _ in R.DEPARTMENT_RULES]
    d = h.where(F.col("title_department") != "Other")
    return (d.groupBy(_month("first_seen").alias("month"))
             .agg(*[F.count_if(F.col("title_department") == lbl).alias(_slug(lbl)) for lbl in labels])
             .orderBy("month"))


def _slug(s):
    from paygrid.operators.common import slug
    return slug(s)


def _quarter(c):
    return F.trunc(c, "quarter")


def quarterly_pay(h: DataFrame) -> DataFrame:
    s = salaried(h).select(_quarter("first_seen").alias("quarter"), "mid_usd")
    q = s.groupBy("quarter").agg(F.avg("mid_usd").alias("mean"), F.count("mid_usd").alias("n"),
                                 F.stddev_samp("mid_usd").alias("std"))
    q = with_quantiles(q, value_counts(s, ["quarter"], "mid_usd"), ["quarter"], {"median": 0.5}).select(
        "quarter", "median", "mean", "n", "std")
    return q.withColumns({"band_lo": F.col("median") - F.col("std"),
                          "band_hi": F.col("median") + F.col("std")}).orderBy("quarter")


def qoq_change(h: DataFrame) -> DataFrame:
    """% change of the quarterly median against the previous present quarter.
    The window runs over the aggregated quarters only (one row per quarter)."""
    q = quarterly_pay(h).select("quarter", "median")
    prev = F.lag("median").over(Window.orderBy("quarter"))
    return q.select("quarter", "median",
                    F.try_divide((F.col("median") - prev) * 100.0, prev).alias("pct_change"))


def dept_quarter_pay(h: DataFrame, min_rows: int = 3, min_quarters: int = 2) -> DataFrame:
    """Median per quarter x department for departments with >= 2 quarters
    holding >= 3 salaried rows (no Other)."""
    s = salaried(h)
    cells = medians(s.select(_quarter("first_seen").alias("quarter"), F.col("title_department").alias("department"), "mid_usd"),
                    ["quarter", "department"], "mid_usd").withColumn("n", F.col("n_rows"))
    good = (cells.where(F.col("n") >= min_rows).groupBy("department").agg(F.count("*").alias("q"))
                 .where((F.col("q") >= min_quarters) & (F.col("department") != "Other")).select("department"))
    return cells.join(good, "department", "left_semi").select("quarter", "department", "median")


def closed_valid(h: DataFrame) -> DataFrame:
    days = F.datediff("last_seen", "first_seen")
    return (h.where(~F.col("is_active")).withColumn("days_open", days)
             .where(F.col("days_open") > 0))


def time_to_fill(h: DataFrame) -> DataFrame:
    return describe(closed_valid(h), [], "days_open", {"median": 0.5, "p25": 0.25, "p75": 0.75}).select(
        "n", "median", "mean", "p25", "p75")


def days_open_histogram(h: DataFrame) -> DataFrame:
    return histogram(closed_valid(h), "days_open", R.BINS_DAYS_OPEN)


def dept_time_to_fill(h: DataFrame) -> DataFrame:
    c = closed_valid(h).select(F.col("title_department").alias("department"), "days_open")
    return (medians(c, ["department"], "days_open", "median_days").select("department", "median_days", "n")
            .orderBy(F.desc("median_days"), "department"))


def status_pay(h: DataFrame) -> DataFrame:
    s = salaried(h).select(C.status_label("is_active").alias("status"), "mid_usd")
    return describe(s, ["status"], "mid_usd", {"median": 0.5}).select(
        "status", F.col("n_rows").alias("n"), "median", "mean")


def dept_status_mix(h: DataFrame) -> DataFrame:
    """Share of each status's postings by department (column-normalised)."""
    c = h.groupBy(F.col("title_department").alias("department")).agg(
        F.count_if(~F.col("is_active")).alias("n_closed"), F.count_if("is_active").alias("n_active"))
    w = Window.partitionBy()
    return c.select("department", "n_closed", "n_active",
                    F.try_divide(F.col("n_closed") * 100.0, F.sum("n_closed").over(w)).alias("pct_closed"),
                    F.try_divide(F.col("n_active") * 100.0, F.sum("n_active").over(w)).alias("pct_active"))


def seniority_status_mix(h: DataFrame) -> DataFrame:
    return (h.groupBy("seniority")
             .agg(F.count_if(~F.col("is_active")).alias("n_closed"), F.count_if("is_active").alias("n_active"))
             .withColumn("level_rank", C.seniority_rank("seniority")).orderBy("level_rank"))


def _title_norm():
    return F.lower(F.regexp_replace("title", r"^(?U)\s+|(?U)\s+$", ""))


def recurring_titles(h: DataFrame, min_postings: int = 2) -> DataFrame:
    """Titles (trimmed, lower) posted under >= 2 ids: dates, earliest and
    latest non-null USD midpoint in (first_seen, job_id) order, % change,
    and the first original-cased title.  One aggregation, no join."""
    s = salaried(h).where(F.col("title").isNotNull()).withColumn("title_norm", _title_norm())
    key = F.struct("first_seen", "job_id")
    has_mid = F.col("mid_usd").isNotNull()
    g = (s.groupBy("title_norm")
          .agg(F.count_distinct("job_id").alias("postings"),
               F.min("first_seen").alias("min_date"), F.max("first_seen").alias("max_date"),
               F.min_by("mid_usd", F.when(has_mid, key)).alias("earliest_mid"),
               F.max_by("mid_usd", F.when(has_mid, key)).alias("latest_mid"),
               F.min_by("title", key).alias("title"))
          .where(F.col("postings") >= min_postings))
    pct = F.try_divide((F.col("latest_mid") - F.col("earliest_mid")) * 100.0, F.col("earliest_mid"))
    return g.withColumn("salary_change_pct", pct).orderBy(F.desc("postings"), "title_norm")


def recurring_series(h: DataFrame, top: int = 8) -> DataFrame:
    """Dated midpoints of the most re-posted titles (semi join to a top-k frame)."""
    t = top_k(recurring_titles(h).select("title_norm", "postings"),
              [F.desc("postings"), F.asc("title_norm")], top).select("title_norm")
    s = salaried(h).where(F.col("title").isNotNull()).withColumn("title_norm", _title_norm())
    return (s.join(F.broadcast(t), "title_norm", "left_semi")
             .select("title_norm", "job_id", "first_seen", "mid_usd"))


# --------------------------------------------------------------------------
# snapshot fold
# --------------------------------------------------------------------------

FIRST = ["title", "location", "department", "snapshot_url"]
SALARY = ["salary_text", "currency", "salary_min", "salary_max", "salary_unit"]


def non_empty_id(records: DataFrame) -> DataFrame:
    """Records with an id: blank and missing ones cannot be followed."""
    return records.where(F.col("job_id").isNotNull() & (F.col("job_id") != ""))


def fold_snapshots(records: DataFrame) -> DataFrame:
    """Fold snapshot records (``boards.snapshot_records``) into one history row per id.

    Order inside an id is (ts, pos).  Title, location, department and snapshot
    URL come from the first record; the whole salary group from the first
    record with a non-zero minimum, else from the first record.  Two structs
    are folded by ``min_by``, beside the dates and the number of records; all
    of it is order-free and merges map-side, so one exchange of partial rows
    by id is the only one.  Structs have no hash buffer and an object-hash
    buffer gives up after a few hundred ids, so Spark sorts before both steps
    (it spills, an id with many records is merged before the exchange).
    """
    order = F.struct("ts", "pos")
    salary = F.struct(*SALARY)
    truthy = F.col("salary_min").isNotNull() & (F.col("salary_min") != 0)
    g = non_empty_id(records).groupBy("job_id").agg(
        F.min_by(F.struct(*FIRST, salary.alias("salary")), order).alias("_first"),
        F.min_by(salary, F.when(truthy, order)).alias("_salary"),
        F.min(F.to_date("ts")).alias("first_seen"), F.max(F.to_date("ts")).alias("last_seen"), F.count("*").alias("n_snapshots"))
    return g.withColumn("_salary", F.coalesce("_salary", "_first.salary")).select(
        "job_id", *[f"_first.{c}" for c in FIRST], *[f"_salary.{c}" for c in SALARY], "first_seen", "last_seen", "n_snapshots")


def mark_active(folded: DataFrame, current_ids: DataFrame | None) -> DataFrame:
    """is_active iff the id is in the current table (existence join against
    distinct ids - never a collected id list).  No current table -> false."""
    if current_ids is None:
        return folded.withColumn("is_active", F.lit(False))
    ids = current_ids.select(F.col("job_id").alias("_id")).distinct()
    return (folded.join(ids, folded["job_id"] == ids["_id"], "left")
                  .withColumn("is_active", F.col("_id").isNotNull()).drop("_id"))


def fold_summary(h: DataFrame) -> DataFrame:
    truthy = F.col("salary_min").isNotNull() & (F.col("salary_min") != 0)
    return h.agg(F.count("*").alias("total"), F.count_if(truthy).alias("with_salary"),
                 F.count_if("is_active").alias("active"), F.count_if(~F.col("is_active")).alias("closed"))


# --------------------------------------------------------------------------
# description backfill
# --------------------------------------------------------------------------

def needs_description(h: DataFrame | None = None) -> Column:
    """Content-family title, blank description, non-blank snapshot URL."""
    blank = F.trim(F.coalesce(F.col("description_md"), F.lit(""))) == ""
    has_url = F.trim(F.coalesce(F.col("snapshot_url"), F.lit(""))) != ""
    return C.is_content_family("title") & blank & has_url


def backfill_description(h: DataFrame, pages: DataFrame) -> DataFrame:
    """Fill blank descriptions of content-family rows from the main content
    (as markdown) of their landed page.

    Only the pages whose URL a blank row names are parsed: a semi join on the
    URL stands before the Python pass.  A missing page leaves an empty text.
    """
    from paygrid.sources.pages import main_content
    need = needs_description(h)
    wanted = h.where(need).select(F.col("snapshot_url").alias("url")).distinct()
    first = pages.join(wanted, "url", "left_semi").groupBy("url").agg(F.min(F.struct("page_id", "html")).alias("p"))
    texts = main_content(first.select("p.page_id", "p.html")).select("page_id", F.col("markdown").alias("_text")).join(
        first.select(F.col("p.page_id").alias("page_id"), F.col("url").alias("_url")), "page_id").drop("page_id")
    out = h.withColumn("_key", F.when(need, F.col("snapshot_url"))).join(texts, F.col("_key") == F.col("_url"), "left")
    return out.withColumn("description_md", F.when(F.col("_key").isNotNull(), F.coalesce("_text", F.lit(""))).otherwise(
        F.col("description_md"))).drop("_key", "_url", "_text")
