"""Query catalog: every registered operator as (Spark plan, DuckDB oracle).

``QUERIES[name](spark, sf_dir) -> DataFrame`` builds the Spark plan over the
driver tables; ``ORACLE[name]`` is an independent SQL text over the same
tables (DuckDB, RE2 regexes).  Double columns are rounded to 2 places on both
sides; every computed column carries the same alias on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paygrid import rules as R
from paygrid.plans import oracle_rules as O
from paygrid.sources import fixture
from paygrid.sources.postings import enrich

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TARGET_JOB_ID = "20"     # role-gap target: salaried, with repeated phrases, at every scale factor
DIGITS = 2


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finish(fn(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return deco


def finish(df: DataFrame) -> DataFrame:
    """Round doubles so engine and oracle hash the same values."""
    cols = [round_half_away(F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
            for f in df.schema.fields]
    return df.select(*cols)


def round_half_away(c):
    """sign(x) * floor(|x| * 10^d + 0.5) / 10^d in plain double arithmetic, so
    that both engines round identical doubles identically (no decimal detour)."""
    scale = 10 ** DIGITS
    return F.signum(c) * F.floor(F.abs(c) * scale + 0.5) / scale


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich(fixture.postings(spark, sf_dir))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings without their text, for queries that do not read it."""
    return enrich(fixture.postings(spark, sf_dir, text=False))


# ---------------------------------------------------------------- oracle text

def r2(expr: str) -> str:
    scale = 10 ** DIGITS
    return f"(sign(({expr})::double) * floor(abs(({expr})::double) * {scale} + 0.5) / {scale})"


ENRICHED = f"""postings as ({fixture.POSTINGS_SQL}),
p0 as (select *, {O.title_department_sql()} as title_department,
   {O.normalize_department_sql()} as department, {O.seniority_sql()} as seniority,
   {O.work_mode_sql()} as work_mode, {O.rate_sql()} as rate,
   (salary_min is not null and salary_max is not null) as has_salary,
   (salary_min + salary_max) / 2::double as salary_mid from postings),
p1 as (select *, salary_min * rate as min_usd, salary_max * rate as max_usd from p0),
p as (select *, (min_usd + max_usd) / 2::double as mid_usd, max_usd - min_usd as range_usd from p1),
s as (select * from p where has_salary)"""


def sql(body: str, ctes: str = "") -> str:
    return "with " + ENRICHED + (", " + ctes if ctes else "") + "\n" + body
