"""Registered queries: text columns, keyword mentions, experience, length,
word frequencies, salary text parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from paygrid import rules as R
from paygrid.functions import classify as C
from paygrid.functions import salary as SAL
from paygrid.functions import text as TX
from paygrid.operators import nlp
from paygrid.plans import oracle_rules as O
from paygrid.plans.catalog import postings, r2, register, sql
from paygrid.sources import fixture

WS = O.WS
D = "description_md"


def _flag_cols_sql(prefix: str, table) -> str:
    return ", ".join(f"{O.flag_sql(D, p)} as {C.flag_name(prefix, lbl)}" for lbl, p in table)


register("skill_flags", sql(f"select job_id, {_flag_cols_sql('skill', R.SKILL_KEYWORDS)} from p"))(
    lambda spark, sf: postings(spark, sf).select("job_id", *[c.alias(n) for n, c in C.skill_flags().items()]))

register("edu_flags", sql(f"select job_id, {_flag_cols_sql('edu', R.EDU_PATTERNS)} from p"))(
    lambda spark, sf: postings(spark, sf).select("job_id", *[c.alias(n) for n, c in C.edu_flags().items()]))


def _counts_ctes(table, by: str | None) -> str:
    keys = f"{by}, " if by else ""
    conds = ", ".join(f"count(*) filter (where {O.flag_sql(D, p)}) as c{i}" for i, (_, p) in enumerate(table))
    agg = f"a as (select {keys}count(*) as n_rows, {conds} from p {'group by 1' if by else ''})"
    union = " union all ".join(f"select {keys}n_rows, {O.q(lbl)} as label, c{i} as n from a"
                               for i, (lbl, _) in enumerate(table))
    return f"{agg}, l as ({union})"


register("skill_counts", sql(
    f"select label as skill, n, {r2('n * 100::double / n_rows')} as pct from l where n > 0 "
    f"order by n desc, skill limit 30", _counts_ctes(R.SKILL_KEYWORDS, None)))(
    lambda spark, sf: nlp.skill_counts(postings(spark, sf)))

register("edu_counts", sql(
    f"select label as requirement, n, {r2('n * 100::double / n_rows')} as pct from l",
    _counts_ctes(R.EDU_PATTERNS, None)))(
    lambda spark, sf: nlp.edu_counts(postings(spark, sf)))

register("dept_skill_matrix", sql(
    f"select title_department as department, label as skill, n_rows as n_dept, "
    f"{r2('n * 100::double / n_rows')} as pct from l where title_department <> 'Other' "
    f"and label in (select label from l group by label having sum(n) > 0 order by sum(n) desc, label limit 20)",
    _counts_ctes(R.SKILL_KEYWORDS, "title_department")))(
    lambda spark, sf: nlp.dept_skill_matrix(postings(spark, sf)))

register("dept_edu_matrix", sql(
    f"select title_department as department, label as requirement, n_rows as n_dept, "
    f"{r2('n * 100::double / n_rows')} as pct from l where title_department <> 'Other'",
    _counts_ctes(R.EDU_PATTERNS, "title_department")))(
    lambda spark, sf: nlp.dept_edu_matrix(postings(spark, sf)))

YOE_SQL = (f"list_max(list_filter(list_transform(regexp_extract_all({D}, {O.q(O.re2(R.YOE_PATTERN))}, 1), "
           f"lambda x: try_cast(x as integer)), lambda x: x between {R.YOE_MIN} and {R.YOE_MAX}))")
YOE_CTE = f"y as (select *, {YOE_SQL} as yoe from p)"

register("extract_yoe_max", sql(f"select job_id, {YOE_SQL} as yoe from p"))(
    lambda spark, sf: postings(spark, sf).select("job_id", TX.extract_yoe_max(D).alias("yoe")))

register("extract_yoe_first", sql(
    f"select job_id, try_cast(nullif(regexp_extract({D}, {O.q(O.re2(R.YOE_FIRST_PATTERN, ci=False))}, 1), '') "
    f"as bigint) as yoe from p"))(
    lambda spark, sf: postings(spark, sf).select("job_id", TX.extract_yoe_first(D).alias("yoe")))

register("yoe_summary", sql(
    f"select count(yoe) as n, {r2('count(yoe) * 100::double / count(*)')} as share, min(yoe) as min, "
    f"max(yoe) as max, {r2('quantile_cont(yoe, 0.5)')} as median, {r2('avg(yoe)')} as mean from y", YOE_CTE))(
    lambda spark, sf: nlp.yoe_summary(postings(spark, sf)))

register("histogram_unit", sql(
    "select g.bin_lo, coalesce(c.n, 0) as n from g left join c on g.bin_lo = c.bin_lo",
    YOE_CTE + ", c as (select least(yoe, 18)::integer as bin_lo, count(*) as n from y "
    "where yoe between 0 and 19 group by 1), g as (select range::integer as bin_lo from range(19))"))(
    lambda spark, sf: nlp.yoe_histogram(postings(spark, sf)))

register("yoe_by_department", sql(
    f"select title_department as department, {r2('quantile_cont(yoe, 0.5)')} as median, "
    f"{r2('avg(yoe)')} as mean, count(yoe) as n from y where yoe is not null group by 1 having count(yoe) >= 3",
    YOE_CTE))(
    lambda spark, sf: nlp.yoe_by_department(postings(spark, sf)))


def _trend_sql(x: str, src: str, having: str) -> str:
    return (f"select count(*) as n, {r2(f'regr_slope(mid_usd, {x})')} as slope, "
            f"{r2(f'regr_intercept(mid_usd, {x})')} as intercept, {r2(f'min({x})')} as x_min, "
            f"{r2(f'max({x})')} as x_max from {src} {having}")


register("yoe_pay_trend", sql(
    _trend_sql("yoe", "y where yoe is not null and mid_usd is not null", "having count(*) > 10"), YOE_CTE))(
    lambda spark, sf: nlp.yoe_pay_trend(postings(spark, sf)))



def _line_sql(x: str, src: str, having: str) -> str:
    at = "x_min + i * (x_max - x_min) / 49"
    return (f"select i, {r2(at)} as x, {r2(f'intercept + slope * ({at})')} as y from "
            f"(select regr_slope(mid_usd, {x}) as slope, regr_intercept(mid_usd, {x}) as intercept, "
            f"min({x})::double as x_min, max({x})::double as x_max from {src} {having}), "
            f"(select range::integer as i from range(50)) where slope is not null")


register("yoe_pay_line", sql(
    _line_sql("yoe", "y where yoe is not null and mid_usd is not null", "having count(*) > 10"), YOE_CTE))(
    lambda spark, sf: nlp.trend_line(nlp.yoe_pay_trend(postings(spark, sf))))

WORDS_SQL = (f"case when {D} is not null then len(list_filter(regexp_split_to_array({D}, {O.q(WS + '+')}), "
             f"lambda x: x <> ''))::integer end")
BULLETS_SQL = f"len(regexp_extract_all({D}, {O.q('(?m)^' + WS + '*[*-]' + WS)}))::integer"
LEN_CTE = (f"ls as (select *, {WORDS_SQL} as desc_words, {BULLETS_SQL} as n_bullets from p), "
           f"lw as (select * from ls where mid_usd is not null and desc_words is not null)")

register("text_shape", sql(
    f"select job_id, length({D})::integer as desc_len, {WORDS_SQL} as desc_words, "
    f"case when {D} is not null then {BULLETS_SQL} end as n_bullets from p"))(
    lambda spark, sf: postings(spark, sf).select("job_id", *[c.alias(n) for n, c in TX.text_shape(D).items()]))

register("length_pay_trend", sql(_trend_sql("desc_words", "lw", ""), LEN_CTE))(
    lambda spark, sf: nlp.length_pay_trend(postings(spark, sf)))

register("length_pay_line", sql(_line_sql("desc_words", "lw", ""), LEN_CTE))(
    lambda spark, sf: nlp.trend_line(nlp.length_pay_trend(postings(spark, sf))))


def _corr_sql(x: str) -> str:
    return (f"case when min({x}) <> max({x}) and min(mid_usd) <> max(mid_usd) then "
            f"covar_samp({x}, mid_usd) / (stddev_samp({x}) * stddev_samp(mid_usd)) end")


register("length_pay_corr", sql(
    f"select count(*) as n, {r2(_corr_sql('desc_words'))} as r_words, "
    f"{r2(_corr_sql('n_bullets'))} as r_bullets from lw", LEN_CTE))(
    lambda spark, sf: nlp.length_pay_corr(postings(spark, sf)))

register("length_by_department", sql(
    f"select title_department as department, count(*) as n_rows, "
    f"{r2('quantile_cont(desc_words, 0.5)')} as median_words from ls group by 1 "
    f"order by n_rows desc, department limit 10", LEN_CTE))(
    lambda spark, sf: nlp.length_by_department(postings(spark, sf)))

register("desc_coverage", sql(
    f"select count({D}) as with_text, count(*) as total, {r2(f'avg(length({D}))')} as mean_chars from p"))(
    lambda spark, sf: nlp.desc_coverage(postings(spark, sf)))

_STOP = ", ".join(O.q(w) for w in R.WORD_FREQ_STOPWORDS)


def word_freq_sql(src: str, dept: str, text: str) -> str:
    return (
        "select dept as department, word, n, rank from (select *, (row_number() over (partition by dept "
        f"order by n desc, word))::integer as rank from c) where rank <= {R.WORD_TOP_N}",
        f"d as (select {dept} as dept, {text} as t from {src} where {text} is not null and {dept} is not null "
        f"and {dept} <> 'Other'), "
        f"ok as (select dept from d group by 1 having sum(length(t)) + count(*) - 1 > {R.DEPT_MIN_TEXT}), "
        f"tk as (select dept, unnest(regexp_extract_all(lower(t), {O.q(R.WORD_TOKEN)})) as word from d), "
        f"c as (select dept, word, count(*) as n from tk where length(word) >= {R.WORD_MIN_LEN} and word not in "
        f"({_STOP}) and dept in (select dept from ok) group by 1, 2)")


register("word_freq", sql(*word_freq_sql("p", "title_department", D)))(
    lambda spark, sf: nlp.word_freq(postings(spark, sf)))

register("word_freq_documents", "with " + word_freq_sql("documents", "source", "text")[1] + " "
         + word_freq_sql("documents", "source", "text")[0])(
    lambda spark, sf: nlp.word_freq(fixture.table(spark, sf, "documents"), dept="source", text="text"))

register("normalize_ws", f"select doc_id, trim(regexp_replace(text, {O.q(WS + '+')}, ' ', 'g')) as text_norm "
         f"from documents")(
    lambda spark, sf: fixture.table(spark, sf, "documents").select("doc_id", TX.normalize_ws("text").alias("text_norm")))


# the references that occur in the driver's tables, written out for SQL
_SQL_REFERENCES = [("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", "\u00a0"), ("&quot;", '"'), ("&#39;", "'"),
                   ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]


def unescape_sql(x: str) -> str:
    for ref, ch in _SQL_REFERENCES:
        x = f"replace({x}, {O.q(ref)}, {O.q(ch)})"
    return x


def html_to_text_sql(col: str) -> str:
    h = f"regexp_replace({unescape_sql(col)}, '(?s)<!--.*?-->', ' ', 'g')"
    h = f"regexp_replace({h}, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g')"
    h = f"regexp_replace({h}, '</?[a-zA-Z!][^>]*>', ' ', 'g')"
    return f"trim(regexp_replace({unescape_sql(h)}, {O.q(WS + '+')}, ' ', 'g'))"


register("html_to_text", f"select page_id, {html_to_text_sql('html')} as text from pages")(
    lambda spark, sf: fixture.table(spark, sf, "pages").select("page_id", TX.html_to_text("html").alias("text")))

register("scope_score", sql(f"select job_id, {O.scope_sql()} as scope_score from p"))(
    lambda spark, sf: postings(spark, sf).select("job_id", C.scope_score(D).alias("scope_score")))

register("is_content_family", sql(f"select job_id, {O.content_family_sql()} as is_content_family from p"))(
    lambda spark, sf: postings(spark, sf).select("job_id", C.is_content_family("title").alias("is_content_family")))

# ------------------------------------------------------------ salary text


def _x(col: str, pattern: str, idx: int) -> str:
    return f"nullif(regexp_extract({col}, {O.q(O.re2(pattern, ci=False))}, {idx}), '')"


def _sym(x: str) -> str:
    return "case " + " ".join(f"when {x} = {O.q(k)} then {O.q(v)}" for k, v in R.SYMBOL_CURRENCY.items()) + " end"


def _amt(x: str, sep: str = ",") -> str:
    return f"try_cast(replace({x}, '{sep}', '') as bigint)"


register("looks_like_salary", f"select job_id, coalesce(salary_text <> '' and "
         f"({O.rx('salary_text', SAL.RANGE, ci=False)} or {O.rx('salary_text', R.CURRENCY_CODE, ci=False)}), "
         f"false) as looks_like_salary from ({fixture.POSTINGS_SQL})")(
    lambda spark, sf: fixture.postings(spark, sf).select(
        "job_id", SAL.looks_like_salary("salary_text").alias("looks_like_salary")))

_BLK = f"trim(regexp_replace({unescape_sql('salary_text')}, {O.q(WS + '+')}, ' ', 'g'))"
register("parse_salary", f"""with b as (select job_id, {_BLK} as blk from ({fixture.POSTINGS_SQL})),
x as (select job_id, blk, {_x('blk', R.CURRENCY_CODE, 1)} as code,
  {_x('blk', SAL.RANGE, 1)} as r_sym, {_x('blk', SAL.RANGE, 2)} as r_min, {_x('blk', SAL.RANGE, 4)} as r_max,
  {_x('blk', SAL.BARE_RANGE, 1)} as b_min, {_x('blk', SAL.BARE_RANGE, 2)} as b_max,
  {_x('blk', SAL.BARE_RANGE, 3)} as b_code,
  {_x('blk', SAL.SINGLE, 1)} as s_sym, {_x('blk', SAL.SINGLE, 2)} as s_val,
  {O.first_match_sql('blk', R.UNIT_RULES, None)} as unit from b)
select job_id, blk as salary_text,
  case when code is not null then code when r_min is not null then {_sym('r_sym')}
       when b_min is not null then b_code when s_val is not null then {_sym('s_sym')} end as currency,
  {_amt('coalesce(r_min, b_min, s_val)')} as salary_min, {_amt('coalesce(r_max, b_max, s_val)')} as salary_max,
  case when blk is not null then unit end as salary_unit from x""")(
    lambda spark, sf: fixture.postings(spark, sf).select(
        "job_id", SAL.parse_salary("salary_text").alias("s")).select("job_id", "s.*"))

_PLAIN = f"trim(regexp_replace(salary_text, {O.q(WS + '+')}, ' ', 'g'))"
register("reparse_salary", f"""with b as (select job_id, {_PLAIN} as t from ({fixture.POSTINGS_SQL})),
x as (select job_id, t, {_x('t', R.CURRENCY_CODE, 1)} as code, {_x('t', '[$£€]', 0)} as sym,
  {_x('t', SAL.COMMA_RANGE, 1)} as c_min, {_x('t', SAL.COMMA_RANGE, 2)} as c_max,
  {_x('t', SAL.DOT_RANGE, 1)} as d_min, {_x('t', SAL.DOT_RANGE, 2)} as d_max,
  {_x('t', SAL.CODE_RANGE, 1)} as k_min, {_x('t', SAL.CODE_RANGE, 2)} as k_max, {_x('t', SAL.CODE_RANGE, 3)} as k_code,
  {O.first_match_sql('t', R.REPARSE_UNIT_RULES, None)} as unit from b)
select job_id,
  case when t is null or t = '' then null when c_min is not null then {_amt('c_min')}
       when d_min is not null then {_amt('d_min', '.')} when k_min is not null then {_amt('k_min')} end as salary_min,
  case when t is null or t = '' then null when c_min is not null then {_amt('c_max')}
       when d_min is not null then {_amt('d_max', '.')} when k_min is not null then {_amt('k_max')} end as salary_max,
  case when t is null or t = '' then null when c_min is not null or d_min is not null then coalesce(code, {_sym('sym')})
       when k_min is not null then k_code else code end as currency,
  case when t is null or t = '' then null else unit end as salary_unit from x""")(
    lambda spark, sf: fixture.postings(spark, sf).select(
        "job_id", SAL.reparse_salary("salary_text").alias("s")).select("job_id", "s.*"))
