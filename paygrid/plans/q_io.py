"""Registered queries: source/sink round trips and operators that otherwise
only live inside others (so each survey id has its own entry)."""

from __future__ import annotations

from pyspark.sql import functions as F

from paygrid.operators import history as H
from paygrid.operators import nlp, pay
from paygrid.plans.catalog import facts, r2, register, sql
from paygrid.plans.q_history import _RT
from paygrid.plans.q_sources import BACKFILL_SQL
from paygrid.plans.q_text import word_freq_sql
from paygrid.sources import fixture
from paygrid.sources import postings as SP
from paygrid.streaming.fold import scratch

PS = f"({fixture.POSTINGS_SQL})"
COLS = ["job_id", "title", "location", "salary_text", "currency", "salary_min", "salary_max",
        "department_raw", "description_md"]


def _board_frame(spark, sf):
    """The raw postings in the 15-column layout (url, updated_at filled)."""
    p = fixture.postings(spark, sf)
    return p.select("company", "job_id", "title", "location",
                    F.concat(F.lit("https://job-boards.greenhouse.io/"), "company", F.lit("/jobs/"), "job_id")
                    .alias("url"), F.col("first_seen").cast("string").alias("updated_at"), "salary_text",
                    "currency", "salary_min", "salary_max", F.lit(None).cast("string").alias("salary_unit"),
                    "department_raw", F.lit(None).cast("string").alias("department"),
                    F.lit(None).cast("string").alias("seniority"), F.lit(None).cast("string").alias("work_mode"),
                    "description_md")


def _roundtrip(spark, sf, fmt):
    path = scratch(spark, f"postings-{fmt}")
    SP.sink_postings(_board_frame(spark, sf), path, fmt=fmt)
    return SP.scan_postings(spark, path, fmt=fmt).select(*COLS)


_SQL = "select " + ", ".join(COLS) + f" from {PS}"
_STR = {"job_id", "title", "location", "salary_text", "currency", "department_raw", "description_md"}
# CSV keeps no difference between empty and missing text (as the CSV readers
# being replaced did): empty strings come back as null
_CSV_SQL = "select " + ", ".join(f"nullif({c}, '') as {c}" if c in _STR else c for c in COLS) + f" from {PS}"
register("scan_postings", _CSV_SQL)(lambda spark, sf: _roundtrip(spark, sf, "csv"))
register("sink_postings", _SQL)(lambda spark, sf: _roundtrip(spark, sf, "parquet"))


def _history_roundtrip(spark, sf):
    path = scratch(spark, "history")
    h = fixture.postings(spark, sf, text=False).withColumn("snapshot_url", F.lit(None).cast("string"))
    SP.sink_history(h, path)
    return SP.scan_history(spark, path).select("job_id", "title", "salary_min", "first_seen", "last_seen",
                                               "is_active")


register("scan_history", "select job_id, title, nullif(salary_min, 0)::double as salary_min, first_seen, "
         f"last_seen, is_active from {PS}")(_history_roundtrip)


def _build_if_absent(spark, sf):
    path = scratch(spark, "history-once")
    h = fixture.postings(spark, sf, text=False).withColumn("snapshot_url", F.lit(None).cast("string"))
    SP.build_if_absent(h, path)
    SP.build_if_absent(h.limit(0), path)        # second build is skipped: output unchanged
    return SP.scan_history(spark, path).select("job_id")


register("build_if_absent", f"select job_id from {PS}")(_build_if_absent)


def _sink_backfill(spark, sf):
    path = scratch(spark, "backfill")
    h = fixture.postings_with_snapshots(spark, sf)
    out = H.backfill_description(h, fixture.table(spark, sf, "pages"))
    SP.sink_backfill(out.select("job_id", "description_md"), path)
    return spark.read.parquet(path).select("job_id", F.length("description_md").alias("n_chars"))


register("sink_backfill", f"{BACKFILL_SQL} select job_id, length(description_md) as n_chars from filled")(_sink_backfill)

register("range_usd", sql(f"select job_id, {r2('range_usd')} as range_usd from p"))(
    lambda spark, sf: facts(spark, sf).select("job_id", "range_usd"))

register("default_columns", sql(
    f"select job_id, title_department as department, title_department as department_raw, {r2('mid_usd')} as mid_usd from p"))(
    lambda spark, sf: SP.default_columns(facts(spark, sf).drop(
        "department", "department_raw", "min_usd", "max_usd", "mid_usd", "range_usd")).select("job_id", "department", "department_raw", "mid_usd"))

register("exclude_other", sql("select job_id from p where title_department <> 'Other'"))(
    lambda spark, sf: facts(spark, sf).where(F.col("title_department") != "Other").select("job_id"))

register("align_to_order", sql(
    "select seniority, count(*) as n, (case " + " ".join(
        f"when seniority = '{s}' then {i + 1}" for i, s in enumerate(
            ["Intern / Fellow", "Junior", "Mid-Level", "Senior", "Staff / Principal", "Lead", "Manager",
             "Director+"])) + " end)::integer as level_rank from s group by 1"))(
    lambda spark, sf: pay.seniority_pay(facts(spark, sf)).select(
        "seniority", "n", F.col("level_rank").cast("int").alias("level_rank")))

register("original_title", sql("select title_norm, title from g", _RT))(
    lambda spark, sf: H.recurring_titles(facts(spark, sf)).select("title_norm", "title"))

register("month_union", sql(
    "select distinct month from (select date_trunc('month', first_seen)::date as month from p union "
    "select date_trunc('month', last_seen)::date from p where not is_active)"))(
    lambda spark, sf: H.monthly_new_closed(facts(spark, sf)).select("month"))

register("stopword_union", "with " + word_freq_sql("documents", "source", "text")[1] + " "
         + word_freq_sql("documents", "source", "text")[0])(
    lambda spark, sf: nlp.word_freq(fixture.table(spark, sf, "documents"), dept="source", text="text"))

_KDE = (
    "v as (select mid_usd::double as v from s where mid_usd is not null), "
    "st as (select count(*) as n, stddev_samp(v) as sd, min(v) as lo, max(v) as hi from v), "
    "k as (select st.*, sd * pow(n, -0.2) as h, (hi - lo) / 199 as step from st), "
    "vals as (select v, count(*) as c from v group by 1), "
    "g as (select range::integer as i from range(200)), "
    "d as (select g.i, sum(c * exp(-pow((lo + g.i * step - v) / h, 2) / 2)) as w from g, vals, k group by 1)")
register("kde_curve", sql(
    f"select d.i::integer as i, {r2('lo + d.i * step')} as x, "
    f"{r2('w * (1 / (h * sqrt(2 * 3.141592653589793))) * (hi - lo) / 30')} as expected_rows from d, k", _KDE))(
    lambda spark, sf: pay.kde_curve(facts(spark, sf)))
