"""Registered queries: classification columns and the pay landscape."""

from __future__ import annotations

from pyspark.sql import functions as F

from paygrid import rules as R
from paygrid.functions import classify as C
from paygrid.operators import pay
from paygrid.operators.common import slug
from paygrid.plans import oracle_rules as O
from paygrid.plans.catalog import TARGET_JOB_ID, facts, r2, register, sql

# ------------------------------------------------------------ row columns

register("title_department", sql("select job_id, title_department from p"))(
    lambda spark, sf: facts(spark, sf).select("job_id", "title_department"))

register("normalize_department", sql("select job_id, department_raw, department from p"))(
    lambda spark, sf: facts(spark, sf).select("job_id", "department_raw", "department"))

register("seniority", sql("select job_id, seniority from p"))(
    lambda spark, sf: facts(spark, sf).select("job_id", "seniority"))

register("work_mode", sql("select job_id, work_mode from p"))(
    lambda spark, sf: facts(spark, sf).select("job_id", "work_mode"))

register("add_classifications", sql("select job_id, title_department, seniority, work_mode from p"))(
    lambda spark, sf: facts(spark, sf).select("job_id", "title_department", "seniority", "work_mode"))

register("add_usd_salary", sql(
    f"select job_id, rate, {r2('min_usd')} as min_usd, {r2('max_usd')} as max_usd, "
    f"{r2('mid_usd')} as mid_usd from p"))(
    lambda spark, sf: facts(spark, sf).select("job_id", "rate", "min_usd", "max_usd", "mid_usd"))

register("salary_mid", sql(
    f"select job_id, {r2('salary_mid')} as salary_mid, {r2('range_usd')} as range_usd from p"))(
    lambda spark, sf: facts(spark, sf).select("job_id", "salary_mid", "range_usd"))

register("status_label", sql(
    "select job_id, case when is_active then 'Active' when not is_active then 'Closed' end as status from p"))(
    lambda spark, sf: facts(spark, sf).select("job_id", C.status_label("is_active").alias("status")))

register("lookup_posting", sql(
    f"select job_id, title, company, title_department, salary_min, salary_max, location from p "
    f"where job_id = '{TARGET_JOB_ID}' limit 1"))(
    lambda spark, sf: facts(spark, sf).where(F.col("job_id") == TARGET_JOB_ID).limit(1).select(
        "job_id", "title", "company", "title_department", "salary_min", "salary_max", "location"))

register("fx_lookup", sql(
    "select p.job_id, p.currency, d.rate from postings p left join (values "
    + ", ".join(f"('{k}', {v}::double)" for k, v in R.TO_USD.items())
    + ") d(currency, rate) on p.currency = d.currency"))(
    lambda spark, sf: pay.fx_lookup(facts(spark, sf)))

register("with_salary", sql(
    "select count(*) as total, count(*) filter (where salary_min is not null and salary_max is not null) "
    "as with_salary from p"))(
    lambda spark, sf: pay.with_salary(facts(spark, sf)))

# ------------------------------------------------------------ aggregates

register("department_pay", sql(
    f"select title_department as department, {r2('quantile_cont(mid_usd, 0.5)')} as median_usd, "
    f"count(mid_usd) as n from s group by 1"))(
    lambda spark, sf: pay.department_pay(facts(spark, sf)))

register("department_counts", sql(
    "select title_department as department, count(*) as n from p group by 1 "
    "union all select 'TOTAL', count(*) from p"))(
    lambda spark, sf: pay.department_counts(facts(spark, sf)))

register("seniority_pay", sql(
    f"select seniority, count(*) as n, {r2('quantile_cont(mid_usd, 0.5)')} as median_usd, "
    f"({O.seniority_rank_sql()})::integer as level_rank from s group by seniority"))(
    lambda spark, sf: pay.seniority_pay(facts(spark, sf)).withColumn(
        "level_rank", F.col("level_rank").cast("int")))


def _cond_medians_sql(key: str, labels: list[str], where: str = "") -> str:
    cols = ", ".join(f"{r2(f'quantile_cont(mid_usd, 0.5) filter (where {key} = {O.q(lbl)})')} as {slug(lbl)}"
                     for lbl in labels)
    return sql(f"select title_department as department, {cols}, "
               f"{r2('quantile_cont(mid_usd, 0.5)')} as overall_median from s {where} group by 1")


register("dept_seniority_matrix", _cond_medians_sql("seniority", R.SENIORITY_ORDER))(
    lambda spark, sf: pay.dept_seniority_matrix(facts(spark, sf)))

register("dept_work_mode", _cond_medians_sql(
    "work_mode", ["Remote-Friendly", "Office-Only"],
    "where work_mode in ('Remote-Friendly', 'Office-Only')"))(
    lambda spark, sf: pay.dept_work_mode(facts(spark, sf)))

register("work_mode_summary", sql(
    f"select m.work_mode, coalesce(a.total, 0) as total, coalesce(a.with_salary, 0) as with_salary, "
    f"{r2('a.median_usd')} as median_usd, m.mode_rank from modes m left join a on m.work_mode = a.work_mode",
    "modes(work_mode, mode_rank) as (values "
    + ", ".join(f"('{m}', {i})" for i, m in enumerate(R.WORK_MODES)) + "), "
    "a as (select work_mode, count(*) as total, count(*) filter (where has_salary) as with_salary, "
    "quantile_cont(mid_usd, 0.5) filter (where has_salary) as median_usd from p group by 1)"))(
    lambda spark, sf: pay.work_mode_summary(facts(spark, sf)))

_CITIES = ("case when location is null or location = '' then ['Unknown'] else list_filter(list_transform("
           "regexp_split_to_array(location, '[|;]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), "
           "lambda x: x <> '') end")

register("city_counts", sql(
    "select city, n, (select count(*) from g) as distinct_cities from g order by n desc, city limit 15",
    f"e as (select unnest({_CITIES}) as city from p), g as (select city, count(*) as n from e group by 1)"))(
    lambda spark, sf: pay.city_counts(facts(spark, sf)))

register("city_pay", sql(
    f"select city, n, {r2('median_usd')} as median_usd from (select * from g order by n desc, city limit 10)",
    f"e as (select unnest({_CITIES}) as city, mid_usd from s), "
    "g as (select city, count(*) as n, quantile_cont(mid_usd, 0.5) as median_usd from e group by 1)"))(
    lambda spark, sf: pay.city_pay(facts(spark, sf)))

register("pay_kpis", sql(
    f"select count(*) as total_roles, count(*) filter (where has_salary) as with_salary, "
    f"{r2('quantile_cont(mid_usd, 0.5) filter (where has_salary)')} as median_usd, "
    f"{r2('max(mid_usd) filter (where has_salary)')} as max_mid_usd, "
    f"{r2('min(mid_usd) filter (where has_salary)')} as min_mid_usd, "
    f"count(distinct title_department) filter (where has_salary) as departments from p"))(
    lambda spark, sf: pay.pay_kpis(facts(spark, sf)))

register("range_spread", sql(
    f"select {r2('quantile_cont(range_usd, 0.5)')} as median_range_usd, "
    f"{r2('avg(range_usd)')} as mean_range_usd from s"))(
    lambda spark, sf: pay.range_spread(facts(spark, sf)))

register("minmax_extent", sql(
    f"select {r2('min(min_usd)')} as lo, {r2('max(max_usd)')} as hi, count(*) as n_points from s"))(
    lambda spark, sf: pay.minmax_extent(facts(spark, sf)))

register("minmax_points", sql(
    f"select job_id, currency, {r2('min_usd')} as min_usd, {r2('max_usd')} as max_usd, "
    f"{r2('range_usd')} as range_usd from s"))(
    lambda spark, sf: pay.minmax_points(facts(spark, sf)))

register("share_of_total", sql(
    f"select dimension, key, n, {r2('n * 100::double / sum(n) over (partition by dimension)')} as pct from u",
    "u as (select 'currency' as dimension, currency as key, count(*) as n from s where currency is not null "
    "group by 2 union all select 'work_mode', work_mode, count(*) from p group by 2 union all "
    "select 'status', case when is_active then 'Active' else 'Closed' end, count(*) from p "
    "where is_active is not null group by 2)"))(
    lambda spark, sf: pay.share_of_total(facts(spark, sf)))


def _stats_sql(keys: list[str], measures: list[str], where: str) -> str:
    k = ", ".join(keys)
    kk = (k + ", ") if keys else ""
    union = " union all ".join(f"select {kk}'{m}' as measure, {m}::double as value from s {where}"
                               for m in measures)
    return sql(
        f"select {kk}measure, count(value) as n, {r2('min(value)')} as min, {r2('max(value)')} as max, "
        f"{r2('avg(value)')} as mean, {r2('quantile_cont(value, 0.5)')} as median, "
        f"{r2('stddev_samp(value)')} as std from l group by {kk}measure",
        f"l as ({union})")


register("salary_stats_by_currency", _stats_sql(
    ["currency"], ["salary_min", "salary_max", "salary_mid"], "where currency is not null"))(
    lambda spark, sf: pay.salary_stats_by_currency(facts(spark, sf)))

register("salary_stats_usd", _stats_sql([], ["min_usd", "max_usd", "mid_usd"], ""))(
    lambda spark, sf: pay.salary_stats_usd(facts(spark, sf)))


def histogram_sql(src: str, col: str, bins: int) -> tuple[str, str]:
    """(ctes, select) for an equal-width histogram over ``src.col``."""
    ctes = (f"hv as (select {col} as v from {src} where {col} is not null), "
            f"st as (select min(v)::double as lo0, max(v)::double as hi0 from hv), "
            f"b as (select case when lo0 = hi0 then lo0 - 0.5 else lo0 end as lo, "
            f"case when lo0 = hi0 then hi0 + 0.5 else hi0 end as hi from st), "
            f"hc as (select least(floor((v - lo) * {bins} / (hi - lo)), {bins - 1})::integer as bin, "
            f"count(*) as n from hv, b group by 1), "
            f"hg as (select range::integer as bin from range({bins}))")
    body = (f"select hg.bin, {r2(f'lo + hg.bin * (hi - lo) / {bins}')} as bin_lo, "
            f"{r2(f'lo + (hg.bin + 1) * (hi - lo) / {bins}')} as bin_hi, coalesce(hc.n, 0) as n "
            f"from hg cross join b left join hc on hg.bin = hc.bin")
    return ctes, body


_c, _b = histogram_sql("s", "mid_usd", R.BINS_MID)
register("histogram", sql(_b, _c))(lambda spark, sf: pay.mid_histogram(facts(spark, sf)))
_c, _b = histogram_sql("s", "range_usd", R.BINS_RANGE)
register("histogram_range", sql(_b, _c))(lambda spark, sf: pay.range_histogram(facts(spark, sf)))


def box_sql(src: str, group: str, value: str) -> tuple[str, str]:
    ctes = (f"bv as (select {group} as grp, {value}::double as x from {src} "
            f"where {value} is not null and {group} is not null), "
            f"bq as (select grp, count(*) as n, quantile_cont(x, 0.25) as q1, quantile_cont(x, 0.5) as median, "
            f"quantile_cont(x, 0.75) as q3 from bv group by 1)")
    lo, hi = "q1 - 1.5 * (q3 - q1)", "q3 + 1.5 * (q3 - q1)"
    body = (f"select grp, n, {r2('q1')} as q1, {r2('median')} as median, {r2('q3')} as q3, "
            f"{r2(f'min(x) filter (where x >= {lo})')} as whisker_lo, "
            f"{r2(f'max(x) filter (where x <= {hi})')} as whisker_hi, "
            f"count(*) filter (where x < {lo} or x > {hi}) as n_outliers "
            f"from bv join bq using (grp) group by grp, n, q1, median, q3")
    return ctes, body


_c, _b = box_sql("s", "title_department", "mid_usd")
register("box_stats", sql(_b, _c))(lambda spark, sf: pay.box_by(facts(spark, sf)))
for _name, _grp in (("seniority", "seniority"), ("work_mode", "work_mode")):
    _c, _b = box_sql("s", _grp, "mid_usd")
    register(f"box_stats_{_name}", sql(_b, _c))(lambda spark, sf, g=_grp: pay.box_by(facts(spark, sf), g))
_c, _b = box_sql("sa", "status", "mid_usd")
register("box_stats_status", sql(_b, "sa as (select *, case when is_active then 'Active' else 'Closed' end as status from s), " + _c))(
    lambda spark, sf: pay.box_by(facts(spark, sf).withColumn("status", C.status_label("is_active")), "status"))
_c, _b = box_sql("e", "city", "mid_usd")
register("box_stats_city", sql(_b, f"e as (select unnest({_CITIES}) as city, mid_usd from s), " + _c))(
    lambda spark, sf: pay.box_by(pay.cities(facts(spark, sf)), "city"))
for _name, _bins in (("dashboard", R.BINS_DASHBOARD), ("role_gap", R.BINS_ROLE_GAP)):
    _c, _b = histogram_sql("s", "mid_usd", _bins)
    register(f"histogram_{_name}", sql(_b, _c))(lambda spark, sf, b=_bins: pay.mid_histogram(facts(spark, sf), b))

_c, _b = box_sql("s", "currency", "salary_mid")
register("box_stats_currency", sql(_b, _c))(
    lambda spark, sf: pay.box_by(facts(spark, sf), "currency", "salary_mid"))

_TOP = (f"select job_id, title, {r2('mid_usd')} as mid_usd, {r2('min_usd')} as min_usd, "
        f"{r2('max_usd')} as max_usd from s where mid_usd is not null order by mid_usd {{d}}, job_id limit 10")
register("top_paid", sql(_TOP.format(d="desc")))(lambda spark, sf: pay.top_paid(facts(spark, sf)))
register("bottom_paid", sql(_TOP.format(d="asc")))(
    lambda spark, sf: pay.top_paid(facts(spark, sf), highest=False))

register("top_keys", sql(
    "select title_department as key, count(*) as n from p group by 1 order by n desc, key limit 12"))(
    lambda spark, sf: pay.top_keys(facts(spark, sf)))

register("top_n_semi", sql(
    "select job_id, title_department from p where title_department in "
    "(select title_department from p group by 1 order by count(*) desc, title_department limit 3)"))(
    lambda spark, sf: pay.top_n_semi(facts(spark, sf)).select("job_id", "title_department"))

register("top_per_group", sql(
    "select company, title_department, n, rank from (select company, title_department, count(*) as n, "
    "(row_number() over (partition by company order by count(*) desc, title_department))::integer as rank "
    "from p group by 1, 2) where rank <= 3"))(
    lambda spark, sf: pay.top_per_group(facts(spark, sf)))
