"""Registered queries: role gap (scope, comparables, percentile, phrases)."""

from __future__ import annotations

from pyspark.sql import functions as F

from paygrid import rules as R
from paygrid.operators import rolegap as RG
from paygrid.plans import oracle_rules as O
from paygrid.plans.catalog import TARGET_JOB_ID, facts, postings, r2, register, sql

T = TARGET_JOB_ID
WS = O.WS


def role(spark, sf):
    return RG.role_frame(postings(spark, sf))


ROLE = (f"r as (select job_id, k, company, title, salary_min, salary_max, description_md, department, "
        f"{O.scope_sql()} as scope_score, (salary_min + salary_max) / 2::double as mid from p "
        f"where salary_min is not null and salary_max is not null)")

_TIER = (f"t as (select * from r where job_id = '{T}' limit 1), "
         "cand as (select r.*, t.department as t_dept, t.scope_score as t_score from r join t "
         f"on r.company = t.company where r.job_id <> '{T}'), "
         f"cnt as (select count(*) filter (where department = t_dept and abs(scope_score - t_score) <= "
         f"{R.SCOPE_TOLERANCE}) as c1, count(*) filter (where department = t_dept and abs(scope_score - t_score) "
         f"<= {R.SCOPE_TOLERANCE_WIDE}) as c2 from cand), "
         f"tier as (select case when c1 >= {R.MIN_COMPARABLES} then 1 when c2 >= {R.MIN_COMPARABLES} then 2 "
         f"else 3 end as tier from cnt), "
         "comps as (select cand.*, tier.tier from cand, tier where "
         f"(tier.tier = 1 and department = t_dept and abs(scope_score - t_score) <= {R.SCOPE_TOLERANCE}) or "
         f"(tier.tier = 2 and department = t_dept and abs(scope_score - t_score) <= {R.SCOPE_TOLERANCE_WIDE}) or "
         f"(tier.tier = 3 and abs(scope_score - t_score) <= {R.SCOPE_TOLERANCE_WIDE}))")
CTES = ROLE + ", " + _TIER

register("scope_describe", sql(
    f"select count(scope_score) as count, {r2('avg(scope_score)')} as mean, {r2('stddev_samp(scope_score)')} "
    f"as std, {r2('min(scope_score)')} as min, {r2('quantile_cont(scope_score, 0.25)')} as p25, "
    f"{r2('quantile_cont(scope_score, 0.5)')} as p50, {r2('quantile_cont(scope_score, 0.75)')} as p75, "
    f"{r2('max(scope_score)')} as max from r", ROLE))(
    lambda spark, sf: RG.scope_describe(role(spark, sf)))

register("comparables", sql(
    f"select job_id, title, department, scope_score, {r2('mid')} as mid, tier from comps", CTES))(
    lambda spark, sf: RG.comparables(role(spark, sf), T).select(
        "job_id", "title", "department", "scope_score", "mid", "tier"))


def _gap_sql(mid: str, med: str) -> str:
    return (f"{r2(f'{mid} - {med}')} as gap, "
            f"{r2(f'case when {med} = 0 then 0 else ({mid} - {med}) * 100 / {med} end')} as gap_pct, "
            f"case when {mid} - {med} > 0 then 'above' else 'below' end as direction")


register("comparables_summary", sql(
    f"select n, {r2('comp_min')} as comp_min, {r2('comp_max')} as comp_max, {r2('comp_median')} as comp_median, "
    f"tier, {r2('target_mid')} as target_mid, {_gap_sql('target_mid', 'comp_median')} from a",
    CTES + ", a as (select count(*) as n, min(mid) as comp_min, max(mid) as comp_max, "
    "quantile_cont(mid, 0.5) as comp_median, max(tier) as tier, (select mid from t) as target_mid from comps)"))(
    lambda spark, sf: RG.comparables_summary(role(spark, sf), T))

register("posting_summary", sql(
    f"select t.job_id, t.title, t.company, t.department, t.scope_score, t.salary_min, t.salary_max, "
    f"{r2('t.mid')} as mid, {r2('percentile')} as percentile, n as n_comparables, a.tier, {r2('comp_min')} as comp_min, "
    f"{r2('comp_median')} as comp_median, {r2('comp_max')} as comp_max, {_gap_sql('t.mid', 'comp_median')} from t, a, "
    f"(select cd * 100 as percentile from (select job_id, cume_dist() over (partition by company order by mid) as cd "
    f"from r) where job_id = '{T}')",
    CTES + ", a as (select count(*) as n, min(mid) as comp_min, max(mid) as comp_max, "
    "quantile_cont(mid, 0.5) as comp_median, max(tier) as tier from comps)"))(
    lambda spark, sf: RG.posting_summary(role(spark, sf), T))

register("role_groups", sql(
    f"select job_id, scope_score, {r2('mid')} as mid, case when job_id = '{T}' then 'target' when job_id in "
    f"(select job_id from comps) then 'comparable' else 'other' end as grp from r "
    f"where company = (select company from t)", CTES))(
    lambda spark, sf: RG.role_groups(role(spark, sf), T))

_TPC = ("u as (select job_id, k, title, mid, salary_min, salary_max, description_md, false as is_target "
        "from comps union all select job_id, k, title, mid, salary_min, salary_max, description_md, true from t)")

register("range_bars", sql(
    f"select job_id, title, {r2('mid')} as mid, salary_min as start, salary_max - salary_min as width, "
    f"is_target from u", CTES + ", " + _TPC))(
    lambda spark, sf: RG.range_bars(role(spark, sf), T))

register("target_plus_comparables", sql(
    f"select job_id, title, {r2('mid')} as mid, is_target from u", CTES + ", " + _TPC))(
    lambda spark, sf: RG.target_plus_comparables(role(spark, sf), T).select("job_id", "title", "mid", "is_target"))

_YF = f"try_cast(nullif(regexp_extract(description_md, {O.q(O.re2(R.YOE_FIRST_PATTERN, ci=False))}, 1), '') as bigint)"
register("experience_bubbles", sql(
    f"select job_id, yoe, {r2('mid')} as mid, {r2('(salary_max - salary_min) / 500::double')} as size, is_target "
    f"from b where (select count(*) from b) >= 3",
    CTES + ", " + _TPC + f", b as (select *, {_YF} as yoe from u where {_YF} is not null)"))(
    lambda spark, sf: RG.experience_bubbles(role(spark, sf), T))

register("first_seen_wins", sql(
    "select job_id, src from (select job_id, src, row_number() over (partition by job_id order by src) as rn "
    "from x) where rn = 1",
    CTES + f", x as (select job_id, 0 as src from t union all select job_id, 1 from comps union all "
    f"select job_id, 2 from r where company = (select company from t))"))(
    lambda spark, sf: _first_seen_wins(spark, sf))


def _first_seen_wins(spark, sf):
    r = role(spark, sf)
    t = r.where(F.col("job_id") == T).limit(1)
    comps = RG.comparables(r, T)
    co = r.join(F.broadcast(t.select("company")), "company", "left_semi")
    u = (t.select("job_id", F.lit(0).alias("src"))
         .unionByName(comps.select("job_id", F.lit(1).alias("src")))
         .unionByName(co.select("job_id", F.lit(2).alias("src"))))
    return RG.first_seen_wins(u, "job_id", "src")


_ALL = (
    "pc as (select t.job_id, "
    f"count(*) filter (where c.department = t.department and abs(c.scope_score - t.scope_score) <= "
    f"{R.SCOPE_TOLERANCE}) as c1, count(*) filter (where c.department = t.department) as c2 "
    f"from r t join r c on c.company = t.company and c.job_id <> t.job_id "
    f"and abs(c.scope_score - t.scope_score) <= {R.SCOPE_TOLERANCE_WIDE} group by 1), "
    f"tt as (select r.job_id, case when coalesce(c1, 0) >= {R.MIN_COMPARABLES} then 1 "
    f"when coalesce(c2, 0) >= {R.MIN_COMPARABLES} then 2 else 3 end as tier from r left join pc using (job_id)), "
    "pairs as (select t.job_id, c.mid from r t join tt on t.job_id = tt.job_id join r c on c.company = t.company "
    "and c.job_id <> t.job_id and abs(c.scope_score - t.scope_score) <= case when tt.tier = 1 then "
    f"{R.SCOPE_TOLERANCE} else {R.SCOPE_TOLERANCE_WIDE} end and (tt.tier = 3 or c.department = t.department)), "
    "agg as (select job_id, count(*) as n, min(mid) as comp_min, quantile_cont(mid, 0.5) as comp_median, "
    "max(mid) as comp_max from pairs group by 1)")

register("comparables_all", sql(
    f"select r.job_id, r.company, r.department, r.scope_score, {r2('r.mid')} as mid, tt.tier, "
    f"coalesce(agg.n, 0) as n_comparables, {r2('comp_min')} as comp_min, {r2('comp_median')} as comp_median, "
    f"{r2('comp_max')} as comp_max, {_gap_sql('r.mid', 'comp_median')} from r join tt on r.job_id = tt.job_id "
    f"left join agg on r.job_id = agg.job_id", ROLE + ", " + _ALL))(
    lambda spark, sf: RG.comparables_all(role(spark, sf)))

register("comparables_naive", sql(
    f"select r.job_id, tt.tier, coalesce(agg.n, 0) as n_comparables, {r2('comp_median')} as comp_median "
    f"from r join tt on r.job_id = tt.job_id left join agg on r.job_id = agg.job_id", ROLE + ", " + _ALL))(
    lambda spark, sf: RG.comparables_all(role(spark, sf)).select(
        "job_id", "tier", "n_comparables", "comp_median"))

register("pay_percentile", sql(
    f"select job_id, company, {r2('mid')} as mid, "
    f"{r2('cume_dist() over (partition by company order by mid) * 100')} as percentile from r", ROLE))(
    lambda spark, sf: RG.pay_percentile(RG.role_frame(facts(spark, sf).withColumn("description_md", F.lit(None).cast("string")))))

_STOPS = "[" + ", ".join(O.q(w) for w in R.PHRASE_STOPWORDS) + "]"
_PH = (f"w as (select job_id, list_filter(list_filter(regexp_split_to_array(regexp_replace(lower(description_md), "
       f"{O.q('[^a-z' + O.WS_CLASS + '-]')}, ' ', 'g'), {O.q(WS + '+')}), lambda x: x <> ''), "
       f"lambda x: length(x) > 2 and not list_contains({_STOPS}, x)) as w from __SRC__ "
       f"where description_md is not null), "
       "pr as (select job_id, w, unnest(generate_series(1, len(w) - 1)) as i from w where len(w) >= 2), "
       "ph as (select job_id, (i - 1)::integer as pos, w[i] || ' ' || w[i + 1] as phrase from pr), "
       f"pc as (select job_id, phrase, count(*) as n, min(pos) as first_pos from ph group by 1, 2 "
       f"having count(*) >= {R.PHRASE_MIN_COUNT}), "
       "pk as (select *, (row_number() over (partition by job_id order by n desc, first_pos))::integer as rank "
       f"from pc), phr as (select * from pk where rank <= {R.PHRASE_TOP_N})")

register("skill_phrases", sql("select job_id, phrase, n, first_pos, rank from phr",
                              ROLE + ", " + _PH.replace("__SRC__", "r")))(
    lambda spark, sf: RG.skill_phrases(role(spark, sf)))

register("phrase_overlap", sql(
    "select job_id, phrase, n from oc where phrase in (select phrase from oc group by 1 having sum(n) > 0)",
    CTES + ", " + _PH.replace("__SRC__", f"(select * from r where job_id = '{T}')")
    + f", roles as (select job_id, lower(coalesce(description_md, 'nan')) as d from (select job_id, k, "
    f"description_md, 0 as pr from t union all select job_id, k, description_md, 1 from comps) "
    f"order by pr, k limit {R.OVERLAP_ROLES}), "
    "oc as (select job_id, phrase, ((length(d) - length(replace(d, phrase, ''))) // length(phrase))::bigint as n "
    "from roles, (select phrase from phr))"))(
    lambda spark, sf: RG.phrase_overlap(role(spark, sf), T))
