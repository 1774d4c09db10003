"""Rule-based classification columns (title, department, seniority, scope...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paygrid import rules as R
from paygrid.functions.regex import first_match, fold, jpat, let, matches, search


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def title_department(title="title") -> Column:
    """16 department labels from a title; null title -> Other (D16)."""
    t = _c(title)
    return F.when(t.isNull(), F.lit(R.DEFAULT_DEPARTMENT)).otherwise(
        first_match(t, R.DEPARTMENT_RULES, R.DEFAULT_DEPARTMENT))


def normalize_department(raw="department_raw") -> Column:
    """15-bucket department from the board's department name (D15)."""
    r = _c(raw)
    return F.when(r.isNull() | (r == ""), F.lit("Other")).otherwise(
        first_match(r, R.NORMALIZED_DEPARTMENT_RULES, "Other"))


def seniority(title="title") -> Column:
    t = _c(title)
    return F.when(t.isNull(), F.lit(R.DEFAULT_SENIORITY)).otherwise(
        first_match(F.lower(t), R.SENIORITY_RULES, R.DEFAULT_SENIORITY))


def work_mode(location="location") -> Column:
    loc = _c(location)
    return (F.when(loc.isNull(), F.lit("Unknown"))
            .when(F.lower(loc).contains("remote"), F.lit("Remote-Friendly"))
            .otherwise(F.lit("Office-Only")))


def work_mode_structured(is_remote="isRemote", workplace_type="workplaceType",
                         location="location") -> Column:
    """Board B: structured remote flags win, else the location text rule."""
    return (F.when(F.coalesce(_c(is_remote), F.lit(False)), F.lit("Remote-Friendly"))
            .when(F.coalesce(_c(workplace_type) == "Remote", F.lit(False)), F.lit("Remote-Friendly"))
            .otherwise(work_mode(location)))


def seniority_rank(level="seniority") -> Column:
    """1-based position in the fixed seniority order (sort key)."""
    return F.array_position(F.array(*[F.lit(s) for s in R.SENIORITY_ORDER]), _c(level))


def fx_rate(currency="currency") -> Column:
    m = F.create_map(*[x for k, v in R.TO_USD.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, _c(currency))


def add_classifications(df: DataFrame, title="title", location="location") -> DataFrame:
    return df.withColumns({
        "title_department": title_department(title),
        "seniority": seniority(title),
        "work_mode": work_mode(location),
    })


def add_usd_salary(df: DataFrame) -> DataFrame:
    """rate, min/max/mid in USD; unmapped currency -> null (not unit-aware)."""
    rate = fx_rate("currency")
    return (df.withColumn("rate", rate)
              .withColumn("min_usd", F.col("salary_min") * F.col("rate"))
              .withColumn("max_usd", F.col("salary_max") * F.col("rate"))
              .withColumn("mid_usd", (F.col("min_usd") + F.col("max_usd")) / 2))


def salary_mid(lo="salary_min", hi="salary_max") -> Column:
    return (_c(lo) + _c(hi)) / 2


def scope_score(desc="description_md") -> Column:
    """5 + 2/builder + 2/owner + 1/leader - 1/contributor hit, clamped 0..10."""
    groups = (R.BUILDER_PATTERNS, R.OWNER_PATTERNS, R.LEADER_PATTERNS, R.CONTRIBUTOR_PATTERNS)

    def score(d: Column) -> Column:
        total = F.lit(R.SCOPE_BASE)
        for weight, pats in zip(R.SCOPE_WEIGHTS, groups):
            for p in pats:
                total = total + F.when(search(d, p, ci=False), F.lit(weight)).otherwise(F.lit(0))
        return F.when(d.isNull(), F.lit(R.SCOPE_BASE)).otherwise(F.greatest(F.lit(0), F.least(F.lit(10), total)))
    # some two dozen patterns read the lower-cased text, which is made once per row
    return let(F.lower(_c(desc)), score)


def is_content_family(title="title") -> Column:
    t = _c(title)
    anyhit = None
    for p in R.CONTENT_FAMILY_PATTERNS:
        h = t.rlike(jpat(p))
        anyhit = h if anyhit is None else (anyhit | h)
    return (F.when(t.isNull() | (t == ""), F.lit(False))
            .when(t.rlike(jpat(R.CONTENT_FAMILY_EXCLUDE)), F.lit(False))
            .otherwise(anyhit))


def flag_name(prefix: str, label: str) -> str:
    """Stable column name for a keyword flag, e.g. ``skill_C_C__``."""
    safe = "".join(ch if ch.isalnum() else "_" for ch in label)
    return f"{prefix}_{safe}"


def skill_flags(desc="description_md", folded=None) -> dict[str, Column]:
    """46 keyword flags; pass ``folded`` (a column holding ``fold(desc)``) to
    share the case-folded text across all prefilters."""
    d = _c(desc)
    f = _c(folded) if folded is not None else fold(d)
    return {flag_name("skill", lbl): matches(d, p, folded=f) for lbl, p in R.SKILL_KEYWORDS}


def edu_flags(desc="description_md", folded=None) -> dict[str, Column]:
    d = _c(desc)
    f = _c(folded) if folded is not None else fold(d)
    return {flag_name("edu", lbl): matches(d, p, folded=f) for lbl, p in R.EDU_PATTERNS}


def status_label(active="is_active") -> Column:
    a = _c(active)
    return F.when(a, F.lit("Active")).when(~a, F.lit("Closed"))
