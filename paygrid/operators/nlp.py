"""Text analyses over descriptions: skills, education, experience, length,
word frequencies.  Keyword flags are computed once per row in one select and
then summed, so each description is scanned once per pattern, not once per
(department, pattern) cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paygrid import rules as R
from paygrid.functions import classify as C
from paygrid.functions import text as TX
from paygrid.functions.regex import fold
from paygrid.operators.common import SALT_BUCKETS, median, top_k


def desc_coverage(p: DataFrame) -> DataFrame:
    return p.agg(F.count("description_md").alias("with_text"), F.count("*").alias("total"),
                 F.avg(F.length("description_md")).alias("mean_chars"))


def _flag_counts(p: DataFrame, flags: dict, labels: list[str], by: list[str]) -> DataFrame:
    """Per-group row count and per-label mention counts, long form."""
    names = list(flags)
    agg = (p.select(*by, "description_md", fold(F.col("description_md")).alias("_fold"))
            .select(*by, *[f.alias(n) for n, f in flags.items()])
            .groupBy(*by)
            .agg(F.count("*").alias("n_rows"),
                 *[F.count_if(n).alias(n) for n in names]))
    stack = "stack({k}, {pairs}) as (label, n)".format(
        k=len(names), pairs=", ".join(f"'{lbl.replace(chr(39), chr(92) + chr(39))}', `{n}`"
                                      for lbl, n in zip(labels, names)))
    return agg.select(*by, "n_rows", F.expr(stack))


def skill_counts(p: DataFrame, n: int = 30) -> DataFrame:
    """Postings mentioning each skill; zero rows dropped; pct over ALL rows."""
    labels = [lbl for lbl, _ in R.SKILL_KEYWORDS]
    long = _flag_counts(p, C.skill_flags(folded="_fold"), labels, [])
    kept = long.where(F.col("n") > 0).select(
        F.col("label").alias("skill"), "n", (F.col("n") * 100.0 / F.col("n_rows")).alias("pct"))
    return top_k(kept, [F.desc("n"), F.asc("skill")], n)


def edu_counts(p: DataFrame) -> DataFrame:
    """Postings per education requirement; zeros kept; pct over all rows."""
    labels = [lbl for lbl, _ in R.EDU_PATTERNS]
    long = _flag_counts(p, C.edu_flags(folded="_fold"), labels, [])
    return long.select(F.col("label").alias("requirement"), "n",
                       (F.col("n") * 100.0 / F.col("n_rows")).alias("pct")).orderBy(
        F.desc("n"), "requirement")


def _dept_matrix(p: DataFrame, flags: dict, labels: list[str], top: int | None) -> DataFrame:
    """% of each department's rows mentioning each label (no ``Other``).

    One aggregation by department gives both the per-department cells and,
    summed over departments (``Other`` included), the label totals used to
    pick the top labels.
    """
    long = _flag_counts(p, flags, labels, ["title_department"])
    if top is not None:
        # windows over the (departments x labels)-row aggregate: the texts are searched once
        total = F.sum("n").over(Window.partitionBy("label"))
        place = F.dense_rank().over(Window.orderBy(F.desc("total"), F.asc("label")))
        long = long.withColumn("total", total).where("total > 0").withColumn("place", place).where(F.col("place") <= top)
    return (long.where(F.col("title_department") != "Other")
            .select(F.col("title_department").alias("department"), "label",
                    F.col("n_rows").alias("n_dept"),
                    (F.col("n") * 100.0 / F.col("n_rows")).alias("pct")))


def dept_skill_matrix(p: DataFrame, top: int = 20) -> DataFrame:
    labels = [lbl for lbl, _ in R.SKILL_KEYWORDS]
    return _dept_matrix(p, C.skill_flags(folded="_fold"), labels, top).withColumnRenamed("label", "skill")


def dept_edu_matrix(p: DataFrame) -> DataFrame:
    labels = [lbl for lbl, _ in R.EDU_PATTERNS]
    return _dept_matrix(p, C.edu_flags(folded="_fold"), labels, None).withColumnRenamed("label", "requirement")


def with_yoe(p: DataFrame) -> DataFrame:
    return p.withColumn("yoe", TX.extract_yoe_max("description_md"))


def yoe_summary(p: DataFrame) -> DataFrame:
    y = with_yoe(p)
    return y.agg(F.count("yoe").alias("n"),
                 (F.count("yoe") * 100.0 / F.count("*")).alias("share"),
                 F.min("yoe").alias("min"), F.max("yoe").alias("max"),
                 median("yoe").alias("median"), F.avg("yoe").alias("mean"))


def yoe_histogram(p: DataFrame) -> DataFrame:
    """Unit bins [0,1) .. [17,18), [18,19]; values beyond 19 dropped."""
    y = with_yoe(p).where(F.col("yoe").isNotNull() & (F.col("yoe") >= 0) & (F.col("yoe") <= 19))
    counts = y.groupBy(F.least(F.col("yoe"), F.lit(18)).cast("int").alias("bin_lo")).agg(
        F.count("*").alias("n"))
    grid = p.sparkSession.range(19).select(F.col("id").cast("int").alias("bin_lo"))
    return grid.join(counts, "bin_lo", "left").select(
        "bin_lo", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def yoe_by_department(p: DataFrame, min_n: int = 3) -> DataFrame:
    y = with_yoe(p).where(F.col("yoe").isNotNull())
    return (y.groupBy(F.col("title_department").alias("department"))
             .agg(median("yoe").alias("median"), F.avg("yoe").alias("mean"), F.count("yoe").alias("n"))
             .where(F.col("n") >= min_n)
             .orderBy(F.desc("median"), "department"))


def _trend(df: DataFrame, x: str, y: str, min_n: int | None) -> DataFrame:
    t = df.agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"),
               F.regr_intercept(y, x).alias("intercept"),
               F.min(x).cast("double").alias("x_min"), F.max(x).cast("double").alias("x_max"))
    return t.where(F.col("n") > min_n) if min_n is not None else t


def trend_line(trend: DataFrame, points: int = 50) -> DataFrame:
    """``points`` places on a trend, evenly from its smallest to its largest x
    (all of them the same where those are equal); none without a line."""
    i = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")
    x = F.col("x_min") + F.col("i") * (F.col("x_max") - F.col("x_min")) / (points - 1)
    return trend.where(F.col("slope").isNotNull()).select("slope", "intercept", "x_min", "x_max", i).select(
        "i", x.alias("x"), (F.col("intercept") + F.col("slope") * x).alias("y"))


def yoe_pay_trend(p: DataFrame) -> DataFrame:
    """Least-squares line of pay on experience, only when n > 10."""
    y = with_yoe(p).where(F.col("yoe").isNotNull() & F.col("mid_usd").isNotNull())
    return _trend(y, "yoe", "mid_usd", 10)


def _len_frame(p: DataFrame) -> DataFrame:
    return (p.withColumns(TX.text_shape("description_md"))
             .where(F.col("mid_usd").isNotNull() & F.col("desc_words").isNotNull()))


def length_pay_trend(p: DataFrame) -> DataFrame:
    return _trend(_len_frame(p), "desc_words", "mid_usd", None)


def _corr(x: str, y: str):
    """Pearson r; null (not an ANSI error) when either side is constant.
    Constancy is tested exactly (min = max), not by a variance that float
    merge order can leave a hair above zero."""
    varies = (F.min(x) != F.max(x)) & (F.min(y) != F.max(y))
    return F.when(varies, F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y)))


def length_pay_corr(p: DataFrame) -> DataFrame:
    d = _len_frame(p)
    return d.agg(F.count("*").alias("n"), _corr("desc_words", "mid_usd").alias("r_words"),
                 _corr("n_bullets", "mid_usd").alias("r_bullets"))


def length_by_department(p: DataFrame, top: int = 10) -> DataFrame:
    """Median word count for the ``top`` largest departments (all rows)."""
    d = p.withColumn("desc_words", TX.word_count("description_md"))
    per = d.groupBy(F.col("title_department").alias("department")).agg(
        F.count("*").alias("n_rows"), median("desc_words").alias("median_words"))
    return top_k(per, [F.desc("n_rows"), F.asc("department")], top).orderBy("median_words", "department")


def word_freq(p: DataFrame, dept: str = "title_department", text: str = "description_md",
              n: int = R.WORD_TOP_N) -> DataFrame:
    """Top words per department: tokens ``[a-z][a-z']+`` of the lower-cased
    text, longer than 2, not stop words; departments other than ``Other``
    whose joined text exceeds 100 characters.

    Counting is a (department, word) aggregation with map-side combine; the
    per-department ranking is a salted two-stage top-k, so a department
    holding a third of all text is still ranked by many tasks.
    """
    d = p.where(F.col(text).isNotNull() & F.col(dept).isNotNull() & (F.col(dept) != "Other"))
    # one pass: each text also emits a pseudo-token '' carrying its length + 1,
    # so the department size test rides in the same aggregation as the counts
    size_tok = F.array(F.struct(F.lit("").alias("word"), (F.length(text) + 1).alias("chars")))
    words = F.transform(F.regexp_extract_all(F.lower(text), F.lit(R.WORD_TOKEN), F.lit(0)),
                        lambda w: F.struct(w.alias("word"), F.lit(0).alias("chars")))
    toks = d.select(dept, F.explode(F.concat(size_tok, words)).alias("t")).select(dept, "t.word", "t.chars")
    keep = (F.col("word") == "") | ((F.length("word") >= R.WORD_MIN_LEN) & ~F.col("word").isin(R.WORD_FREQ_STOPWORDS))
    agg = toks.where(keep).groupBy(dept, "word").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    # salted two-stage top-k; the size row sorts first in its bucket so the
    # second stage (<= n * buckets rows per department) can test the size
    is_size = F.col("word") == ""
    salt = F.pmod(F.hash("word"), F.lit(SALT_BUCKETS))
    w1 = Window.partitionBy(dept, "_salt").orderBy(F.desc(is_size), F.desc("n"), F.asc("word"))
    s1 = (agg.withColumn("_salt", salt).withColumn("_r1", F.row_number().over(w1))
             .where(F.col("_r1") <= n + 1))
    size = F.max(F.when(is_size, F.col("chars"))).over(Window.partitionBy(dept))
    s2 = s1.withColumn("_size", size).where(~is_size & (F.col("_size") - 1 > R.DEPT_MIN_TEXT))
    w2 = Window.partitionBy(dept).orderBy(F.desc("n"), F.asc("word"))
    ranked = s2.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= n)
    return ranked.select(F.col(dept).alias("department"), "word", "n", "rank")
