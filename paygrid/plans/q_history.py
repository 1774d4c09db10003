"""Registered queries: hiring history over the postings table, and the
snapshot fold over archived board bodies made of ``events`` (a record per event,
a snapshot per hour)."""

from __future__ import annotations

from pyspark.sql import functions as F

from paygrid import rules as R
from paygrid.operators import history as H
from paygrid.operators.common import slug
from paygrid.plans import oracle_rules as O
from paygrid.plans.catalog import facts, r2, register, sql
from paygrid.plans.q_pay import histogram_sql
from paygrid.sources import boards as B
from paygrid.sources import fixture
from paygrid.sources.postings import history_frame

CURRENT_SINCE = "2024-01-29"   # events at or after this time form the "current" board

register("history_kpis", sql(
    "select count(*) as total, count(*) filter (where salary_min is not null and salary_max is not null) "
    "as with_salary, count(*) filter (where is_active) as active, count(*) filter (where not is_active) as closed, "
    "min(first_seen) as first_date, max(last_seen) as last_date from p"))(
    lambda spark, sf: H.history_kpis(facts(spark, sf)))

register("monthly_new_closed", sql(
    "select coalesce(n.month, c.month) as month, coalesce(n_new, 0) as n_new, coalesce(n_closed, 0) as n_closed "
    "from n full join c on n.month = c.month",
    "n as (select date_trunc('month', first_seen)::date as month, count(*) as n_new from p group by 1), "
    "c as (select date_trunc('month', last_seen)::date as month, count(*) as n_closed from p "
    "where not is_active group by 1)"))(
    lambda spark, sf: H.monthly_new_closed(facts(spark, sf)))

register("peak_month", sql(
    "select date_trunc('month', first_seen)::date as month, count(*) as n from p group by 1 "
    "order by n desc, month limit 1"))(
    lambda spark, sf: H.peak_month(facts(spark, sf)))

_WEEKS = ("b as (select min(first_seen) as lo, max(last_seen) as hi from p), "
          "w as (select unnest(generate_series(lo + ((7 - dayofweek(lo)) % 7)::integer, hi, interval 7 day))::date "
          "as week from b), "
          "wk as (select w.week, count(p.job_id) as active_roles from w left join p "
          "on p.first_seen <= w.week and p.last_seen >= w.week group by 1)")

register("weekly_open_roles", sql("select week, active_roles from wk", _WEEKS))(
    lambda spark, sf: H.weekly_open_roles(facts(spark, sf)))

register("running_open_roles", sql("select week, active_roles from wk", _WEEKS))(
    lambda spark, sf: H.running_open_roles(facts(spark, sf)))

register("peak_week", sql("select week, active_roles from wk order by active_roles desc, week limit 1", _WEEKS))(
    lambda spark, sf: H.peak_week(facts(spark, sf)))

_DEPTS = [lbl for lbl, _ in R.DEPARTMENT_RULES]
register("dept_month_matrix", sql(
    "select date_trunc('month', first_seen)::date as month, "
    + ", ".join(f"count(*) filter (where title_department = {O.q(d)}) as {slug(d)}" for d in _DEPTS)
    + " from p where title_department <> 'Other' group by 1"))(
    lambda spark, sf: H.dept_month_matrix(facts(spark, sf)))

register("quarterly_pay", sql(
    f"select quarter, {r2('median')} as median, {r2('mean')} as mean, n, {r2('std')} as std, "
    f"{r2('median - std')} as band_lo, {r2('median + std')} as band_hi from q",
    "q as (select date_trunc('quarter', first_seen)::date as quarter, quantile_cont(mid_usd, 0.5) as median, "
    "avg(mid_usd) as mean, count(mid_usd) as n, stddev_samp(mid_usd) as std from s group by 1)"))(
    lambda spark, sf: H.quarterly_pay(facts(spark, sf)))

register("qoq_change", sql(
    f"select quarter, {r2('median')} as median, "
    f"{r2('(median - lag(median) over (order by quarter)) * 100 / lag(median) over (order by quarter)')} "
    f"as pct_change from q",
    "q as (select date_trunc('quarter', first_seen)::date as quarter, quantile_cont(mid_usd, 0.5) as median "
    "from s group by 1)"))(
    lambda spark, sf: H.qoq_change(facts(spark, sf)))

register("dept_quarter_pay", sql(
    f"select quarter, department, {r2('median')} as median from cells where department in (select department "
    f"from cells where n >= 3 group by 1 having count(*) >= 2 and department <> 'Other')",
    "cells as (select date_trunc('quarter', first_seen)::date as quarter, title_department as department, "
    "count(*) as n, quantile_cont(mid_usd, 0.5) as median from s group by 1, 2)"))(
    lambda spark, sf: H.dept_quarter_pay(facts(spark, sf)))

_CV = ("cv as (select *, datediff('day', first_seen, last_seen)::integer as days_open from p "
       "where not is_active and datediff('day', first_seen, last_seen) > 0)")

register("closed_valid", sql("select job_id, days_open from cv", _CV))(
    lambda spark, sf: H.closed_valid(facts(spark, sf)).select("job_id", "days_open"))

register("time_to_fill", sql(
    f"select count(*) as n, {r2('quantile_cont(days_open, 0.5)')} as median, {r2('avg(days_open)')} as mean, "
    f"{r2('quantile_cont(days_open, 0.25)')} as p25, {r2('quantile_cont(days_open, 0.75)')} as p75 from cv", _CV))(
    lambda spark, sf: H.time_to_fill(facts(spark, sf)))

_c, _b = histogram_sql("cv", "days_open", R.BINS_DAYS_OPEN)
register("histogram_days_open", sql(_b, _CV + ", " + _c))(
    lambda spark, sf: H.days_open_histogram(facts(spark, sf)))

register("dept_time_to_fill", sql(
    f"select title_department as department, {r2('quantile_cont(days_open, 0.5)')} as median_days, "
    f"count(*) as n from cv group by 1", _CV))(
    lambda spark, sf: H.dept_time_to_fill(facts(spark, sf)))

register("status_pay", sql(
    f"select case when is_active then 'Active' else 'Closed' end as status, count(*) as n, "
    f"{r2('quantile_cont(mid_usd, 0.5)')} as median, {r2('avg(mid_usd)')} as mean from s group by 1"))(
    lambda spark, sf: H.status_pay(facts(spark, sf)))

register("dept_status_mix", sql(
    f"select department, n_closed, n_active, {r2('n_closed * 100::double / sum(n_closed) over ()')} as pct_closed, "
    f"{r2('n_active * 100::double / sum(n_active) over ()')} as pct_active from c",
    "c as (select title_department as department, count(*) filter (where not is_active) as n_closed, "
    "count(*) filter (where is_active) as n_active from p group by 1)"))(
    lambda spark, sf: H.dept_status_mix(facts(spark, sf)))

register("seniority_status_mix", sql(
    f"select seniority, count(*) filter (where not is_active) as n_closed, count(*) filter (where is_active) "
    f"as n_active, ({O.seniority_rank_sql()})::integer as level_rank from p group by 1"))(
    lambda spark, sf: H.seniority_status_mix(facts(spark, sf)).withColumn(
        "level_rank", F.col("level_rank").cast("int")))

_RT = (f"t as (select *, lower(regexp_replace(title, {O.q('^' + O.WS + '+|' + O.WS + '+$')}, '', 'g')) "
       f"as title_norm from s where title is not null), "
       "g as (select title_norm, count(distinct job_id) as postings, min(first_seen) as min_date, "
       "max(first_seen) as max_date, arg_min(mid_usd, (first_seen, job_id)) filter (where mid_usd is not null) "
       "as earliest_mid, arg_max(mid_usd, (first_seen, job_id)) filter (where mid_usd is not null) as latest_mid, "
       "arg_min(title, (first_seen, job_id)) as title from t group by 1 having count(distinct job_id) >= 2)")

register("recurring_titles", sql(
    f"select title_norm, postings, min_date, max_date, {r2('earliest_mid')} as earliest_mid, "
    f"{r2('latest_mid')} as latest_mid, {r2('(latest_mid - earliest_mid) * 100 / earliest_mid')} "
    f"as salary_change_pct, title from g", _RT))(
    lambda spark, sf: H.recurring_titles(facts(spark, sf)))

register("recurring_series", sql(
    f"select title_norm, job_id, first_seen, {r2('mid_usd')} as mid_usd from t where title_norm in "
    f"(select title_norm from g order by postings desc, title_norm limit 8)", _RT))(
    lambda spark, sf: H.recurring_series(facts(spark, sf)))

# ------------------------------------------------------------ snapshot fold

_PAY = "case when event_type in ('purchase', 'click', 'signup') then 'About the ' || title || ' ' || pay end"
_EV = (f"e as (select *, row(ts, event_id) as o, split_part(title, ' ', 1) as event_type from ({fixture.SNAPSHOTS_SQL}) where job_id <> ''), "
       "r as (select job_id, o, ts, title, location, department, 'https://web.archive.org/web/' || strftime(ts, '%Y%m%d%H%M%S') || "
       f"'id_/boards.example.com/jobs' as snapshot_url, {_PAY} as salary_text, "
       "case event_type when 'purchase' then 'USD' when 'click' then 'EUR' when 'signup' then 'CAD' end as currency, "
       "case event_type when 'purchase' then regexp_extract(pay, '(\\d+),000 -', 1)::bigint * 1000 when 'click' then "
       "regexp_extract(pay, '\\d+')::bigint when 'signup' then 0 end as salary_min, "
       "case event_type when 'purchase' then regexp_extract(pay, '(\\d+),000 USD', 1)::bigint * 1000 when 'click' then "
       "regexp_extract(pay, '\\d+')::bigint when 'signup' then 0 end as salary_max, "
       "case event_type when 'purchase' then 'annual' when 'click' then 'hourly' when 'signup' then 'annual' end as salary_unit from e), "
       "w as (select job_id, min(o) as o1, min(o) filter (where salary_min <> 0) as o2, min(ts::date) as first_seen, "
       "max(ts::date) as last_seen, count(*) as n_snapshots from r group by 1), "
       "f as (select w.job_id, a.title, a.location, a.department, a.snapshot_url, s.salary_text, s.currency, s.salary_min, s.salary_max, "
       "s.salary_unit, first_seen, last_seen, n_snapshots from w join r a on a.job_id = w.job_id and a.o = w.o1 "
       "join r s on s.job_id = w.job_id and s.o = coalesce(w.o2, w.o1)), "
       f"cur as (select distinct cast(user_id as varchar) as id from events where ts >= timestamp '{CURRENT_SINCE}'), "
       "m as (select f.*, cur.id is not null as is_active from f left join cur on f.job_id = cur.id)")
FOLD_SQL = "with " + _EV + " select * from f"


def records(spark, sf):
    return B.snapshot_records(B.snapshot_bodies(fixture.snapshot_jobs(fixture.table(spark, sf, "events"))))


def folded(spark, sf):
    return H.fold_snapshots(records(spark, sf))


def marked(spark, sf):
    ev = fixture.table(spark, sf, "events")
    cur = ev.where(F.col("ts") >= F.lit(CURRENT_SINCE).cast("timestamp_ntz")).select(
        F.col("user_id").cast("string").alias("job_id"))
    return H.mark_active(folded(spark, sf), cur)


register("fold_snapshots", FOLD_SQL)(folded)

register("non_empty_id", "with " + _EV + " select job_id, title, snapshot_url, salary_min from r")(
    lambda spark, sf: H.non_empty_id(records(spark, sf)).select("job_id", "title", "snapshot_url", "salary_min"))

register("mark_active", "with " + _EV + " select job_id, is_active from m")(
    lambda spark, sf: marked(spark, sf).select("job_id", "is_active"))

register("fold_summary", "with " + _EV + " select count(*) as total, count(*) filter (where salary_min <> 0) as with_salary, "
         "count(*) filter (where is_active) as active, count(*) filter (where not is_active) as closed from m")(
    lambda spark, sf: H.fold_summary(marked(spark, sf)))

register("sink_history", "with " + _EV + " select job_id, title, location, department, nullif(salary_min, 0) as salary_min, "
         "nullif(salary_max, 0) as salary_max, currency, salary_unit, strftime(first_seen, '%Y%m%d') as first_seen, "
         "strftime(last_seen, '%Y%m%d') as last_seen, case when is_active then 'True' else 'False' end as is_active, snapshot_url from m")(
    lambda spark, sf: history_frame(marked(spark, sf)))
